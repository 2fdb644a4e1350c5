"""Token files: ids in patched frame-of-reference blocks, with exception lists and an index of block starts.

A file holds the blocks of consecutive documents and is one row of a table (first key, last key, body),
so Spark writes it to any store and a lost task is simply run again. Its body, little-endian:

    magic "PFR1" | uint32 number of blocks | uint32 number of documents
    per block: uint64 place in the file, uint64 first token       (the index of block starts)
    per document: int64 key, uint64 first token in the file, uint64 tokens
    per block: uint32 tokens, uint32 minimum, uint8 width, uint32 exceptions,
               packed low bits, uint32 place of each exception, uint32 high bits of each exception
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.bpe import ENCODE_BYTES, Encoded, codec, id_lists
from lexweave.llm.common import fresh_uri, ready, slices, text_bytes

MAGIC = b"PFR1"
BLOCK = 8192
PERCENTILE = 95
FILE_TOKENS = 1 << 20
HEAD = struct.Struct("<4sII")
BLOCK_HEAD = struct.Struct("<IIBI")
FILES = "no long, first_key long, tokens long, null_keys long, body binary"


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of every value, one after the other; lane k of 8 values fills the bits k*width on."""
    if not width:
        return b""
    n = -(-len(values) // 8)
    padded = np.zeros(n * 8, np.uint64)
    padded[: len(values)] = values & np.uint64((1 << width) - 1)
    lanes = padded.reshape(n, 8)
    out = np.zeros((n, width), np.uint8)
    for k in range(8):
        bit, done = k * width, 0
        while done < width:
            byte, shift = divmod(bit + done, 8)
            take = min(8 - shift, width - done)
            part = (lanes[:, k] >> np.uint64(done)) & np.uint64((1 << take) - 1)
            out[:, byte] |= (part << np.uint64(shift)).astype(np.uint8)
            done += take
    return out.tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint64)
    n = -(-count // 8)
    cells = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    lanes = np.zeros((n, 8), np.uint64)
    for k in range(8):
        bit, done = k * width, 0
        while done < width:
            byte, shift = divmod(bit + done, 8)
            take = min(8 - shift, width - done)
            part = (cells[:, byte] >> shift) & ((1 << take) - 1)
            lanes[:, k] |= part.astype(np.uint64) << np.uint64(done)
            done += take
    return lanes.reshape(-1)[:count]


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: the width is that of the percentile of the offsets from the minimum; what is wider is an exception."""
    low = int(ids.min())
    off = ids.astype(np.uint64) - np.uint64(low)
    width = int(np.percentile(off, percentile, method="higher")).bit_length()
    over = np.flatnonzero(off >> np.uint64(width)) if width < 64 else np.zeros(0, np.int64)
    return b"".join((BLOCK_HEAD.pack(len(ids), low, width, len(over)), pack(off, width),
                     over.astype("<u4").tobytes(), (off[over] >> np.uint64(width)).astype("<u4").tobytes()))


def decode_block(body: memoryview, at: int) -> np.ndarray:
    count, low, width, over = BLOCK_HEAD.unpack_from(body, at)
    at += BLOCK_HEAD.size
    packed = -(-count // 8) * width
    off = unpack(body[at: at + packed], count, width)
    places = np.frombuffer(body, "<u4", over, at + packed)
    highs = np.frombuffer(body, "<u4", over, at + packed + 4 * over)
    off[places] |= highs.astype(np.uint64) << np.uint64(width)
    return (off + np.uint64(low)).astype(np.uint32)


def file_body(keys: np.ndarray, e: Encoded, block: int = BLOCK) -> bytes:
    blocks = [encode_block(e.ids[i: i + block]) for i in range(0, len(e.ids), block)]
    head = HEAD.size + 16 * len(blocks) + 24 * len(keys)
    places = head + np.append(0, np.cumsum([len(b) for b in blocks]))[:-1]
    index = np.stack([places, np.arange(len(blocks)) * block], 1).astype("<u8") if blocks else np.zeros((0, 2), "<u8")
    docs = np.stack([keys, e.at[:-1], np.diff(e.at)], 1).astype("<i8")
    return b"".join((HEAD.pack(MAGIC, len(blocks), len(keys)), index.tobytes(), docs.tobytes(), *blocks))


class TokenFile(NamedTuple):
    """A file opened by its index: any block, and so any document, can be read alone."""
    body: memoryview
    index: np.ndarray
    docs: np.ndarray

    @classmethod
    def open(cls, body: bytes) -> TokenFile:
        view = memoryview(body)
        magic, blocks, docs = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("no token file")
        index = np.frombuffer(view, "<u8", 2 * blocks, HEAD.size).reshape(-1, 2)
        return cls(view, index, np.frombuffer(view, "<i8", 3 * docs, HEAD.size + 16 * blocks).reshape(-1, 3))

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Tokens [start, start + count), reading only the blocks that hold them."""
        if not count:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.index[:, 1], start, "right")) - 1
        b = int(np.searchsorted(self.index[:, 1], start + count, "left"))
        first = int(self.index[a, 1])
        got = np.concatenate([decode_block(self.body, int(self.index[k, 0])) for k in range(a, b)])
        return got[start - first: start - first + count]


def gathered(parts: Iterator[tuple[np.ndarray, Encoded]], tokens: int) -> Iterator[tuple[np.ndarray, Encoded]]:
    """Put consecutive encoded documents together until a file is full."""
    keys: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    held = 0
    for k, e in parts:
        keys.append(k)
        ids.append(e.ids)
        ends.append(e.at[1:] + held)
        held += len(e.ids)
        if held >= tokens:
            yield np.concatenate(keys), Encoded(np.concatenate(ids), np.concatenate([[0], *ends]))
            keys, ids, ends, held = [], [], [], 0
    if keys:
        yield np.concatenate(keys), Encoded(np.concatenate(ids), np.concatenate([[0], *ends]))


def with_end(e: Encoded, end_id: int) -> Encoded:
    """The end id after every text."""
    return Encoded(np.insert(e.ids, e.at[1:], end_id).astype(np.int32), e.at + np.arange(len(e.at)))


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, key: str = "doc_id", text: str = "text",
          file_tokens: int = FILE_TOKENS) -> None:
    """Encode all texts in order of ``key`` and write the token files to ``path``, in order of their number.

    Null and empty texts are the end id alone; null keys stand before all others, in any number, apart from a key that is the
    least long; repeated rows follow one another; an empty table writes no file; other columns play no part.
    Texts are dealt out by ranges of the key and of chance, so that repeated and null keys span many tasks, and sorted
    within them; a file never crosses a range. Beside its body, a file's row has the number of its tokens and null keys.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("at"))

    def parts(batches):
        c = codec(tokenizer)
        for b in slices(batches, "t", ENCODE_BYTES):
            nulls.append(b.column("k").null_count)
            yield b.column("k").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), with_end(c.encode(*text_bytes(b.column("t"))), end_id)

    nulls: list[int] = []

    def run(batches):
        from pyspark import TaskContext
        part, left = TaskContext.get().partitionId(), 0
        nulls.clear()
        for n, (keys, e) in enumerate(gathered(parts(batches), file_tokens)):
            left += sum(nulls)
            nulls.clear()
            mine = min(left, len(keys))
            left -= mine
            yield pa.RecordBatch.from_pydict({"no": [(part << 32) + n], "first_key": keys[:1], "tokens": [len(e.ids)], "null_keys": [mine], "body": [file_body(keys, e)]})

    order = [F.asc_nulls_first("k"), F.col("at")]
    shuffled = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")
    shuffled.mapInArrow(run, FILES).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True, checksum: bool = False) -> DataFrame:
    """The documents of token files: ``file`` number, ``place`` in it, ``key`` (null where it was), ``first`` token in the file, ``n_tokens``.

    On request also the ``ids``, and the ``checksum``: crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    def run(batches):
        for b in batches:
            for no, nulls, body in zip(*(b.column(c).to_pylist() for c in ("no", "null_keys", "body"))):
                f = TokenFile.open(body)
                n = len(f.docs)
                cols = {"file": pa.array(np.full(n, no)), "place": pa.array(np.arange(n)), "key": pa.array(f.docs[:, 0], mask=np.arange(n) < nulls),
                        "first": pa.array(f.docs[:, 1]), "n_tokens": pa.array(f.docs[:, 2])}
                got = f.tokens(0, int(f.docs[:, 2].sum())) if ids or checksum else None
                if checksum:
                    raw = memoryview(got.astype("<u4").tobytes())
                    cols["checksum"] = pa.array([zlib.crc32(raw[4 * s: 4 * (s + k)]) for s, k in f.docs[:, 1:].tolist()], pa.int64())
                if ids:
                    cols["ids"] = id_lists(Encoded(got.astype(np.int32), np.append(f.docs[:, 1], len(got))))
                yield pa.RecordBatch.from_pydict({c: cols[c] for c in names})
    names = ["file", "place", "key", "first", "n_tokens", *["ids"] * ids, *["checksum"] * checksum]
    ready(spark)
    made = "file long, place long, key long, first long, n_tokens long" + (", ids array<int>" if ids else "") + (", checksum long" if checksum else "")
    return spark.read.schema(FILES).parquet(path).mapInArrow(run, made)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """Per file the number of tokens in all files before it, from the column beside the bodies, which stay closed.

    Files are numbered by range and place in it, so sums per range are added up first (as many rows as
    there were tasks) and then the files of each range on their own.
    """
    from pyspark.sql.window import Window
    sizes = spark.read.schema(FILES).parquet(path).select(F.col("no").alias("file"), F.col("tokens").alias("n"), F.shiftright("no", 32).alias("range"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("total")).select(
        "range", F.coalesce(F.sum("total").over(upto(Window.orderBy("range"))), F.lit(0)).alias("before"))
    own = sizes.withColumn("own", F.coalesce(F.sum("n").over(upto(Window.partitionBy("range").orderBy("file"))), F.lit(0)))
    return own.join(ranges, "range").select("file", (F.col("own") + F.col("before")).alias("file_start"))


def fresh_path(spark: SparkSession) -> str:
    return fresh_uri(spark, "tokens")
