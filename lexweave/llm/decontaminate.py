"""Benchmark decontamination: windows of the test items as a broadcast hash set, scanned over every text's words."""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexweave.llm.common import bits, gather, passes, ready, slices, text_bytes, words
from lexweave.sources.tables import stage

WINDOW = 10
#: Bytes of item text up to which the windows are one broadcast set (some 8 times that); larger benchmarks are joined.
BLOCK_BYTES, PIECE_BYTES, FILTER_BITS = 8 << 20, 4 << 20, 26
#: Fixed value: bytes that belong to a word once A-Z are lower-cased.
WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class Windows(NamedTuple):
    """All windows of one length, sorted by hash: where each first starts in the items' words, and the items that hold it."""
    length: int
    hashes: np.ndarray
    starts: np.ndarray
    item_ends: np.ndarray
    items: np.ndarray


class Benchmark(NamedTuple):
    """``words``: the items' words as places in the vocabulary; ``ids``: names of the items."""
    vocabulary: pa.LargeBinaryArray
    words: np.ndarray
    by_length: list[Windows]
    salt: int
    ids: list


def mix(ids: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of every run of ``length`` word numbers."""
    n = len(ids) - length + 1
    h = np.full(max(n, 0), salt, np.uint64)
    for k in range(length):
        h = (h ^ ids[k: k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def window_starts(at: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length by length, where windows start in the words of all items, and whose they are."""
    size = np.diff(at)
    length = np.minimum(size, window)
    for n in np.unique(length[length > 0]).tolist():
        mine = np.flatnonzero(length == n)
        count = size[mine] - n + 1
        owner = np.repeat(mine, count)
        yield n, np.arange(count.sum()) + np.repeat(at[mine] - (np.cumsum(count) - count), count), owner


def compile_items(ids: list, texts: pa.Array, window: int = WINDOW) -> Benchmark:
    """Number the words of all items and hash every window at once; a salt is found under which no two windows meet."""
    arr, at = words(*text_bytes(texts), WORD)
    coded = arr.dictionary_encode()
    w = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    salt = 1
    while True:
        by_length, met = [], False
        for n, start, owner in window_starts(at, window):
            h = mix(w, n, salt)[start]
            order = np.argsort(h, kind="stable")
            h, start, owner = h[order], start[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])
            which = np.cumsum(new) - 1
            first = start[new][which]
            met = met or any((w[start + k] != w[first + k]).any() for k in range(n))
            pairs = np.unique(which << 32 | owner)
            by_length.append(Windows(n, h[new], start[new], np.searchsorted(pairs >> 32, np.arange(new.sum()), "right"), (pairs & 0xFFFFFFFF).astype(np.int32)))
        if not met:
            return Benchmark(coded.dictionary, w, by_length, salt, ids)
        salt += 1


def occurrences(ids: np.ndarray, at: np.ndarray, w: Windows, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of one length start in the word numbers (-1: not a word of any item), and which they are."""
    n = len(ids) - w.length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unknown = np.append(0, np.cumsum(ids < 0))
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero((unknown[w.length:] == unknown[:-w.length]) & (text_of[:n] == text_of[w.length - 1:]))
    if not len(ok):
        return ok, ok
    h = mix(ids, w.length, bench.salt)[ok]
    place = np.minimum(np.searchsorted(w.hashes, h), len(w.hashes) - 1)
    same = w.hashes[place] == h
    ok, place = ok[same], place[same]
    for k in range(w.length):
        real = ids[ok + k] == bench.words[w.starts[place] + k]
        ok, place = ok[real], place[real]
    return ok, place


def scan(data: np.ndarray, offs: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, list[list]]:
    """Per word whether it is hit; the number of words before each text; per text the items found in it."""
    arr, at = words(data, offs, WORD)
    ids = pc.index_in(arr, value_set=bench.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    cover = np.zeros(len(ids) + 1, np.int64)
    found = [np.zeros(0, np.int64)]
    for w in bench.by_length:
        starts, which = occurrences(ids, at, w, bench)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + w.length, -1)
        pairs = np.unique((np.searchsorted(at, starts, "right") - 1) << 32 | which)
        which = pairs & 0xFFFFFFFF
        begin = np.append(0, w.item_ends)[which]
        held, ends = gather(w.items, np.append(0, w.item_ends[:-1]) if len(w.item_ends) else w.item_ends, np.diff(w.item_ends, prepend=0), which)
        found.append(np.repeat(pairs >> 32, w.item_ends[which] - begin) << 32 | held)
    every = np.unique(np.concatenate(found))
    cut = np.searchsorted(every >> 32, np.arange(len(offs) - 1), "right")
    items = (every & 0xFFFFFFFF).tolist()
    return np.cumsum(cover)[:-1] > 0, at, [sorted(bench.ids[k] for k in items[a:b]) for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte after the last of every word."""
    inside = WORD[data] | ((data >= 65) & (data <= 90))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    begins[at] = inside[at]
    ends[:-1] &= ~inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def byte_spans(data: np.ndarray, offs: np.ndarray, hit: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of hit words as byte ranges of each text."""
    s, e = word_bounds(data, offs)
    text_of = np.searchsorted(offs, s, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offs) - 1)]
    before = None
    for i in np.flatnonzero(hit).tolist():
        t = int(text_of[i])
        a, b = int(s[i] - offs[t]), int(e[i] - offs[t])
        if before == (t, i - 1):
            out[t][-1] = (out[t][-1][0], b)
        else:
            out[t].append((a, b))
        before = (t, i)
    return out


HITS = "array<struct<start:bigint,end:bigint>>"


def compiled(items: DataFrame, window: int) -> Benchmark:
    """The windows of few items, compiled in one task; their arrays come to the driver in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("i", items_type), ("t", pa.large_string())]))
        raw = pickle.dumps(compile_items(t.column("i").to_pylist(), t.column("t").combine_chunks(), window), 5)
        for at in range(0, len(raw), PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([raw[at: at + PIECE_BYTES]], pa.binary())], ["at", "piece"])

    items_type = to_arrow_type(items.schema["i"].dataType)
    one = items.coalesce(1).mapInArrow(lambda b: run(plain(b)), "at bigint, piece binary")
    pieces = sorted(one.collect(), key=lambda r: r.at)
    return pickle.loads(b"".join(r.piece for r in pieces)) if pieces else compile_items([], pa.array([], pa.large_string()), window)


def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.large_string())], ["i", "t"])


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` (with or without the text) with ``_n_words``, ``_n_hit``, ``_items`` (ids of items with a window in the text) and ``_spans`` (byte ranges).

    Up to ``block_bytes`` of item text, one task compiles the windows to a sorted hash set, which is
    broadcast and holds the items' words for the exact check. Of a larger benchmark only a bitmap of
    the windows' hashes, of a fixed 8 MB, goes to the tasks; what passes it is joined by its words with
    the windows themselves, and the hits go back to their texts by row number, in shuffles of the hits alone.

    Null texts and texts without a word have no words and no hits; an item without a word, or with a
    null id, has no windows; ids are of any type that sorts; repeated rows are scanned each; an empty benchmark
    hits nothing. The columns added must not exist in ``docs`` yet; other columns may have any name without a leading underscore.
    """
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    kind = items.schema["i"].dataType.simpleString()
    out = docs.withColumns({"_n_words": F.lit(None).cast("long"), "_n_hit": F.lit(None).cast("long"),
                            "_items": F.array().cast(f"array<{kind}>"), "_spans": F.array().cast(HITS)})
    if items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] > block_bytes:
        return mark_by_join(out, items, text, window, keep_text)
    bench = spark.sparkContext.broadcast(compiled(items, window))
    schema = out.schema if keep_text else out.drop(text).schema
    return out.mapInArrow(lambda batches, names=schema.names: scan_batches(batches, text, bench.value, names), schema)


def scan_batches(batches: Iterator[pa.RecordBatch], text: str, bench: Benchmark, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text):
        data, offs = text_bytes(b.column(text))
        hit, at, items = scan(data, offs, bench)
        sums = np.append(0, np.cumsum(hit)).astype(np.int64)
        new = {"_n_words": np.diff(at), "_n_hit": sums[at[1:]] - sums[at[:-1]], "_items": items,
               "_spans": [[{"start": s, "end": e} for s, e in row] for row in byte_spans(data, offs, hit)]}
        yield pa.RecordBatch.from_arrays([pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in names], names)


# -- benchmarks larger than a set that fits --------------------------------
SEEN = "array<struct<at:bigint,n:int,start:bigint,end:bigint,w:binary>>"


def window_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The words, the number before each text, and a hash of each word that is the same everywhere."""
    arr, at = words(data, offs, WORD)
    coded = arr.dictionary_encode()
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return arr, at, h[coded.indices.to_numpy(zero_copy_only=False)]


def window_words(arr: pa.LargeBinaryArray, start: np.ndarray, n: int) -> pa.Array:
    """The windows' words, joined by a blank (which no word holds)."""
    parts = [arr.take(pa.array(start + k)) for k in range(n)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())


def item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        arr, at, h = window_hashes(*text_bytes(b.column("t")))
        for n, start, owner in window_starts(at, window):
            place = (mix(h, n, n) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)[start]
            for i in range(0, len(start), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(owner[part])), window_words(arr, start[part], n), pa.array(place[part]),
                                                  pa.array(np.full(len(start[part]), n, np.int32))], ["i", "w", "place", "n"])


def possible_hits(batches: Iterator[pa.RecordBatch], text: str, lengths: list[int], bitmap: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with the windows that pass the bitmap: word number, length, bytes and words of each."""
    for b in slices(batches, text):
        data, offs = text_bytes(b.column(text))
        arr, at, h = window_hashes(data, offs)
        begin, end = word_bounds(data, offs)
        seen: list[list] = [[] for _ in range(b.num_rows)]
        text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for n in lengths:
            m = len(h) - n + 1
            if m <= 0:
                continue
            place = mix(h, n, n) >> np.uint64(64 - FILTER_BITS)
            start = np.flatnonzero(passes(bitmap, place) & (text_of[:m] == text_of[n - 1:]))
            for s, t, w in zip(start.tolist(), text_of[start].tolist(), window_words(arr, start, n).to_pylist()):
                seen[t].append({"at": s - int(at[t]), "n": n, "start": int(begin[s] - offs[t]), "end": int(end[s + n - 1] - offs[t]), "w": w})
        new = {"_n_words": np.diff(at), "_seen": seen}
        yield pa.RecordBatch.from_arrays([pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in names], names)


def joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of a row as the number of words hit and the byte ranges of their runs."""
    for b in batches:
        counts, spans = [], []
        for hits in b.column("hits").to_pylist():
            count, last, runs = 0, 0, []
            for h in sorted(hits, key=lambda h: (h["at"], -h["n"])):
                stop = h["at"] + h["n"]
                if runs and h["at"] <= last:
                    runs[-1]["end"] = max(runs[-1]["end"], h["end"])
                else:
                    runs.append({"start": h["start"], "end": h["end"]})
                count += max(0, stop - max(last, h["at"]))
                last = max(last, stop)
            counts.append(count)
            spans.append(runs)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(counts, pa.int64()), pa.array(spans, kinds)], ["_row", "n_hit", "spans"])


def mark_by_join(docs: DataFrame, items: DataFrame, text: str, window: int, keep_text: bool) -> DataFrame:
    """``docs`` with its four columns filled in by a join of the windows that pass a bitmap with those of the items."""
    spark = docs.sparkSession
    kind = items.schema["i"].dataType.simpleString()
    windows = stage(items.mapInArrow(lambda b: item_windows(b, window), f"i {kind}, w binary, place bigint, n int").distinct(), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``window`` numbers
    bitmap = spark.sparkContext.broadcast(bits(windows, FILTER_BITS))
    rows = docs.withColumns({"_row": F.monotonically_increasing_id(), "_seen": F.array().cast(SEEN)})
    schema = rows.schema if keep_text else rows.drop(text).schema
    rows = stage(rows.mapInArrow(lambda b, names=schema.names: possible_hits(b, text, lengths, bitmap.value, names), schema), "possible")
    seen = rows.select("_row", F.explode("_seen").alias("s")).select("_row", "s.*")
    known = windows.groupBy("w").agg(F.collect_set("i").alias("items"))
    hits = stage(seen.join(known, "w"), "hits")
    found = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    spans = hits.groupBy("_row").agg(F.collect_list(F.struct("at", "n", "start", "end")).alias("hits")).mapInArrow(
        joined_spans, f"_row bigint, n_hit bigint, spans {HITS}")
    of = found.join(spans, "_row")
    clean = rows.where(F.size("_seen") == 0).withColumn("_n_hit", F.lit(0).cast("long"))
    other = rows.where(F.size("_seen") > 0).join(of, "_row", "left").withColumns({
        "_n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "_items": F.coalesce("found", "_items"), "_spans": F.coalesce("spans", "_spans")})
    names = [c for c in schema.names if c not in ("_row", "_seen")]
    return clean.select(*names).unionAll(other.select(*names))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Documents without benchmark passages: whole ``documents`` go, or only the hit ``spans`` of their text.

    All columns stay as they are; nulls, empty texts, repeated rows and empty tables as in ``mark`` (a null text is never hit).
    """
    marked = mark(docs, benchmark, text, **options)
    if remove == "documents":
        return marked.where("_n_hit = 0").select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove: documents or spans")
    raw, spans = F.to_binary(F.col(text), F.lit("utf-8")), F.col("_spans")
    pieces = F.transform(F.concat(spans, F.array(F.struct(F.octet_length(text).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))),
                         lambda s, i: F.decode(F.substring(raw, (F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1).cast("int"),
                                                           (s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)).cast("int")), "utf-8"))
    cut = F.when(F.col("_n_hit") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return marked.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns])
