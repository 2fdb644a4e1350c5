"""Helpers shared by the operators: Arrow text batches as byte arrays, word bounds, shared files."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import checkpoint_dir, ship_package

SLICE_BYTES = 4 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: ASCII white space, and the ASCII letters that are lower-cased.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a piece is about ``limit`` bytes (a longer single text stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = text_bytes(b.column(column))[1][1:]
        at = 0
        while at < b.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + limit, "right")))
            yield b.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one after the other, and where each text starts (null: empty)."""
    kind = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    if not len(col) or col.buffers()[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts, lower-cased, and the number of words before each text.

    ``is_word`` says of each byte whether it belongs to a word; bytes from 0x80 up always do, so
    characters are never cut. A word also ends where its text ends.
    """
    low = LOWER[data]
    inside = is_word[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    before = np.cumsum(inside)
    bounds = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int64)
    body = low[inside]
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return arr, np.searchsorted(starts, offs)


def gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the pieces ``table[starts[i]:starts[i]+sizes[i]]`` of all ids; also where each piece ends."""
    n = sizes[ids]
    ends = np.cumsum(n)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - n), n)
    return table[where], ends


def bits(places: DataFrame, log: int) -> np.ndarray:
    """A bitmap of the column ``place`` (below 2^log); whatever the number of rows, at most 2^log / 64 words come to the driver."""
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("b")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["b"].to_numpy()
    return out


def passes(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1


def ready(spark: SparkSession) -> None:
    """Ship the package, and keep the batches that Python workers get small, unless the session says otherwise."""
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(2 * SLICE_BYTES))


def fresh_uri(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base if ':' in base else 'file:' + base}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it (``file:/x`` and ``file:///x`` alike)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many leading underscores as it takes to be none of the ``columns``."""
    mark = "_"
    while any(c.lower() == f"{mark}{n}" for c in columns for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input cannot clash with those made here."""
    return df.select(*names)
