"""BPE encoding and decoding: whole texts, with tree concatenation for long unsplit stretches."""
from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import gather, ready, slices, text_bytes

#: A stretch of more bytes is halved down to pieces of this size; a text of more bytes is spread over tasks.
LEAF_BYTES = 4096
LONG_BYTES = 1 << 20
ENCODE_BYTES, DECODE_IDS = 4 << 20, 1 << 20
#: Chunks that a worker remembers, and chunks that are encoded put together.
CACHE, JOINED = 200_000, 2000


@functools.lru_cache(1)
def alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Encoded(NamedTuple):
    """Token ids of many texts, one after the other, and how many come before each text."""
    ids: np.ndarray
    at: np.ndarray


class Codec:
    """One byte-level BPE vocabulary file; made once in each Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.to_byte = alphabet()
        self.to_char = {b: c for c, b in self.to_byte.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = self.whole.get_vocab(with_added_tokens=True)
        raw: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = token.encode() if token in self.added else bytes(self.to_byte[c] for c in token)
        self.raw = raw
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.known = pa.array([], pa.large_binary())
        self.known_ids, self.known_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.sure = np.zeros(256, bool)
        self.sure[[*range(0x21, 0x7F), *range(0xC3, 0xE0)]] = True

    # -- one stretch without split points ------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """The BPE of bytes taken as one stretch."""
        return [t.id for t in self.whole.model.tokenize("".join(map(self.to_char.__getitem__, data)))] if data else []

    def halves(self, data: bytes, leaf: int) -> list[int]:
        """The BPE of a long stretch from those of its halves."""
        if len(data) <= leaf:
            return self.merge(data)
        mid = len(data) // 2
        return self.concatenate(self.halves(data[:mid], leaf), self.halves(data[mid:], leaf))

    def stable(self, left: int, right: int) -> bool:
        return self.merge(self.raw[left] + self.raw[right]) == [left, right]

    def concatenate(self, a: list[int], b: list[int]) -> list[int]:
        """The BPE of two stretches put together.

        A window around the join is encoded anew and doubled until its first and last token keep
        their bounds with the tokens beside it. A sequence is the BPE of its bytes just when every two
        neighbours are the BPE of theirs, so the outcome is exact.
        """
        if not a or not b:
            return a or b
        width = 2
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            mid = self.merge(b"".join(map(self.raw.__getitem__, a[i:] + b[:j])))
            if (i == 0 or self.stable(a[i - 1], mid[0])) and (j == len(b) or self.stable(mid[-1], b[j])):
                return a[:i] + mid + b[j:]
            width *= 2

    # -- texts ---------------------------------------------------------------------------------

    def stretches(self, text: str) -> Iterator[tuple[bytes, int | None]]:
        """The stretches that merges never cross: (bytes, None), or (b"", id) for an added token."""
        rest = text
        while rest:
            found = min(((rest.find(c), -len(c), c) for c in self.added if c in rest), default=None)
            part = rest if found is None else rest[: found[0]]
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(part) if part else ():
                yield bytes(map(self.to_byte.__getitem__, piece)), None
            if found is None:
                return
            yield b"", self.added[found[2]]
            rest = rest[found[0] + len(found[2]):]

    def long_text(self, text: str, leaf: int) -> list[int]:
        ids: list[int] = []
        for data, token in self.stretches(text):
            ids += [token] if token is not None else self.halves(data, leaf)
        return ids

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def fresh(self, chunks: pa.LargeBinaryArray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after the other, and how many each has.

        Chunks that begin with a blank and a byte that surely is no white space are encoded many at a time, put
        together: between two of them the pre-tokenizer always splits, and the bytes of the tokens tell where.
        """
        data, offs = text_bytes(chunks)
        size = np.diff(offs)
        first, second = (data[np.minimum(offs[:-1] + k, len(data) - 1)] for k in (0, 1))
        joined = (size > 1) & (size <= leaf) & (first == 0x20) & self.sure[second]
        for token in self.added:
            joined &= ~pc.match_substring(chunks, token.encode()).to_numpy(zero_copy_only=False)
        many = np.flatnonzero(joined)
        flat, at = text_bytes(chunks.take(pa.array(many)))
        groups = np.unique(np.append(np.arange(0, len(many), JOINED), len(many)))
        ids = np.concatenate([np.zeros(0, np.int32), *(self.ids_of(flat[at[i]: at[j]].tobytes().decode()) for i, j in zip(groups[:-1], groups[1:]))])
        bounds = np.searchsorted(np.append(0, np.cumsum(self.sizes[ids])), at)
        single = np.flatnonzero(~joined)
        alone = [self.whole.encode(x, add_special_tokens=False).ids if n <= leaf else self.long_text(x, leaf)
                 for x, n in zip(chunks.take(pa.array(single)).cast(pa.large_string()).to_pylist(), size[single])]
        counts = np.zeros(len(chunks), np.int64)
        counts[many] = np.diff(bounds)
        counts[single] = [len(x) for x in alone]
        pool = np.concatenate([ids, *(np.array(x, np.int32) for x in alone)])
        begins = np.zeros(len(chunks), np.int64)
        begins[many] = bounds[:-1]
        begins[single] = len(ids) + np.cumsum(counts[single]) - counts[single]
        return gather(pool, begins, counts, np.arange(len(chunks)))[0], counts

    def chunk_ids(self, chunks: pa.LargeBinaryArray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where in it those of each chunk start and how many they are; chunks met before are not encoded again."""
        place = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(place < 0)
        unknown = chunks.take(pa.array(new))
        ids, counts = self.fresh(unknown, leaf) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        table = np.append(self.known_ids, ids)
        sizes = np.append(self.known_sizes, counts)
        starts = np.cumsum(sizes) - sizes
        at = place.copy()
        at[new] = len(self.known) + np.arange(len(new))
        if len(self.known) < CACHE:
            fits = min(len(new), CACHE - len(self.known))
            self.known = pa.concat_arrays([self.known, unknown.slice(0, fits)])
            self.known_sizes = sizes[: len(self.known)]
            self.known_ids = table[: int(self.known_sizes.sum())]
        return table, starts[at], sizes[at]

    def cut_points(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where chunks start: at each text, and at each blank before a byte that surely is not white space.

        There the pre-tokenizer always splits, whatever stands around. Texts with an added token stay whole.
        """
        begins = np.zeros(len(data) + 1, bool)
        begins[:-2] = (data[:-1] == 0x20) & self.sure[data[1:]]
        begins[offs] = True
        whole = data.tobytes()
        for token in map(str.encode, self.added):
            at = whole.find(token)
            while at >= 0:
                t = int(np.searchsorted(offs, at, "right")) - 1
                begins[offs[t] + 1: offs[t + 1]] = False
                at = whole.find(token, at + 1)
        return np.flatnonzero(begins[:-1])

    def encode(self, data: np.ndarray, offs: np.ndarray, leaf: int = LEAF_BYTES) -> Encoded:
        if not len(data):
            return Encoded(np.zeros(0, np.int32), np.zeros(len(offs), np.int64))
        starts = self.cut_points(data, offs)
        bounds = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        table, begins, sizes = self.chunk_ids(coded.dictionary, leaf)
        ids, ends = gather(table, begins, sizes, coded.indices.to_numpy(zero_copy_only=False))
        before = np.append(0, ends)[np.searchsorted(starts, offs)]
        return Encoded(ids, before)

    def decode(self, e: Encoded) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and where each starts; bytes that are no UTF-8 are left to the caller."""
        data, ends = gather(self.table, self.starts, self.sizes, e.ids)
        return data, np.append(0, ends)[e.at]

    def texts(self, e: Encoded) -> pa.Array:
        data, offs = self.decode(e)
        whole = data.tobytes()
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.string())


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def id_lists(e: Encoded) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(e.at, pa.int32()), pa.array(e.ids, pa.int32()))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids", leaf_bytes: int = LEAF_BYTES,
           long_bytes: int = LONG_BYTES, keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of the whole text in ``into`` (array of int), with or without the text itself.

    With ``decoded`` the ids are decoded into that column as well, by the same workers.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table gives an empty
    one. Texts over ``long_bytes`` are cut into pieces that are encoded in parallel and put together
    again, one text at a time; all others are encoded where they are read. ``into`` must be a new column;
    columns beginning with ``_piece`` are used on the way.
    """
    ready(docs.sparkSession)
    others = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*others, F.array().cast("array<int>").alias(into), *([F.lit("").alias(decoded)] if decoded else [])).schema

    def short(batches):
        c = codec(tokenizer)
        for b in slices(batches, text, ENCODE_BYTES):
            e = c.encode(*text_bytes(b.column(text)), leaf_bytes)
            yield pa.RecordBatch.from_arrays([*map(b.column, others), id_lists(e), *([c.texts(e)] if decoded else [])], schema.names)

    is_long = F.coalesce(F.octet_length(text), F.lit(0)) > long_bytes
    usual = docs.where(~is_long).mapInArrow(short, schema)
    long = encode_long(docs.where(is_long), tokenizer, text, into, leaf_bytes, long_bytes).select(*others, into)
    return usual.unionByName(decode(long, tokenizer, into, decoded) if decoded else long)


def encode_long(docs: DataFrame, tokenizer: str, text: str, into: str, leaf: int, piece_bytes: int) -> DataFrame:
    """Very long texts: pieces to many tasks, one join per neighbouring pair, in a tree over each text.

    A text is known by its digest, so copies are encoded once and joined to their rows at the end.
    """
    def pieces(batches):
        c = codec(tokenizer)
        for b in batches:
            for key, t in zip(b.column("_piece_key").to_pylist(), b.column(text).to_pylist()):
                rows = list(cut_text(c, t, piece_bytes))
                yield pa.RecordBatch.from_pydict({"k": [key] * len(rows), "no": list(range(len(rows))), "join": [r[0] for r in rows],
                                                  "raw": [r[1] for r in rows], "body": [r[2] for r in rows]}, schema=PIECES)

    def encoded(batches):
        c = codec(tokenizer)
        for b in batches:
            ids = [[i for x in body for i in (c.halves(x, leaf) if raw else c.encode(np.frombuffer(x, np.uint8), np.array([0, len(x)]), leaf).ids.tolist())]
                   for raw, body in zip(b.column("raw").to_pylist(), b.column("body").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("no"), b.column("join"), pa.array(ids, pa.list_(pa.int32()))], ["k", "no", "join", "ids"])

    def put_together(table: pa.Table) -> pa.Table:
        c = codec(tokenizer)
        parts: list[list[list[int]]] = []
        for _, join, ids in sorted(zip(*(table[x].to_pylist() for x in ("no", "join", "ids")))):
            if join:
                parts[-1].append(ids)
            else:
                parts.append([ids])
        ids = [i for stretch in parts for i in tree(c, stretch)]
        return pa.table({"k": table["k"][:1], into: pa.array([ids], pa.list_(pa.int32()))})

    keyed = docs.withColumn("_piece_key", F.sha2(text, 256))
    one = keyed.groupBy("_piece_key").agg(F.first(text).alias(text))
    cut = one.mapInArrow(pieces, "k string, no int, join boolean, raw boolean, body array<binary>")
    dealt = cut.repartition("k", "no").mapInArrow(encoded, "k string, no int, join boolean, ids array<int>")
    whole = dealt.groupBy("k").applyInArrow(put_together, f"k string, `{into}` array<int>")
    return keyed.join(whole, F.col("_piece_key") == F.col("k")).select(*docs.columns, into)


PIECES = pa.schema([("k", pa.string()), ("no", pa.int32()), ("join", pa.bool_()), ("raw", pa.bool_()), ("body", pa.list_(pa.binary()))])


def cut_text(c: Codec, text: str, piece_bytes: int) -> Iterator[tuple[bool, bool, list[bytes]]]:
    """Pieces of a long text as (goes on with the stretch of the one before, is made of stretches, their bytes)."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.append(c.cut_points(data, np.array([0, len(data)], np.int64)), len(data))
    at = 0
    while at < len(data):
        fits = int(starts[np.searchsorted(starts, at + piece_bytes, "right") - 1])
        if fits > at:
            yield False, False, [data[at:fits].tobytes()]
            at = fits
            continue
        to = int(starts[np.searchsorted(starts, at, "right")])
        held: list[bytes] = []
        for stretch, token in c.stretches(data[at:to].tobytes().decode()):
            if held and (token is not None or sum(map(len, held)) + len(stretch) > piece_bytes):
                yield False, True, held
                held = []
            if token is not None:
                yield False, False, [c.raw[token]]
            elif len(stretch) > piece_bytes:
                for i in range(0, len(stretch), piece_bytes):
                    yield i > 0, True, [stretch[i: i + piece_bytes]]
            else:
                held.append(stretch)
        if held:
            yield False, True, held
        at = to


def tree(c: Codec, parts: list[list[int]]) -> list[int]:
    """The slices of one stretch put together, neighbour by neighbour, until one is left."""
    while len(parts) > 1:
        parts = [c.concatenate(*parts[k: k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``into``; bytes that are no UTF-8 become replacement characters. Null: empty."""
    ready(rows.sparkSession)
    schema = rows.select("*", F.lit("").alias(into)).schema

    def run(batches):
        c = codec(tokenizer)
        for b in id_slices(batches, ids):
            yield pa.RecordBatch.from_arrays([*b.columns, c.texts(encoded_of(b.column(ids)))], [*b.schema.names, into])
    return rows.mapInArrow(run, schema)


def id_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has about DECODE_IDS ids."""
    for b in batches:
        ends, at = encoded_of(b.column(column)).at[1:], 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODE_IDS, "right")))
            yield b.slice(at, to - at)
            at = to


def encoded_of(col: pa.Array) -> Encoded:
    sizes = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return Encoded(pc.list_flatten(col).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)))
