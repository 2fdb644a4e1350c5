"""Exact deduplication: sorted digest runs that meet in rounds of a tree and are merged, keeping the smallest row of each digest."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import ready
from lexweave.sources.tables import stage

#: Lanes are numbered in digits of so many bits; a round exchanges one digit, that is, it does as many binomial rounds at once.
DIGIT_BITS = 4
LANE_ROWS, LEAST_DIGITS, MOST_DIGITS = 1 << 18, 2, 6


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Single spaces, which stay as they are, are not matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def merged(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per (lane, digest, length) of a sorted stream: its first row and the sum of ``n``.

    The stream is what the shuffle's merge of sorted runs gives. Rows are the same text only if the
    whole digest and the length agree. Only the last group of a batch waits for the next batch.
    """
    held = None
    for b in batches:
        t = pa.Table.from_arrays(b.columns, b.schema.names)  # without what Spark says of nulls
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            differs = [pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
                       for c in (t.column(k).combine_chunks() for k in ("lane", "digest", "bytes"))]
            new[1:] = np.logical_or.reduce(differs)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(t.column("n").to_numpy(), starts)
        out = t.take(pa.array(starts)).set_column(t.column_names.index("n"), "n", pa.array(sums)).select(names)
        held = out.slice(len(starts) - 1)
        yield from out.slice(0, len(starts) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def run_of(rows: DataFrame) -> DataFrame:
    """Every partition's rows sorted and merged, without a shuffle; the smallest id comes first, nulls last, then the earlier row."""
    ordered = rows.sortWithinPartitions("lane", "digest", "bytes", F.asc_nulls_last("id"), "row")
    return ordered.mapInArrow(lambda b, names=tuple(rows.columns): merged(b, list(names)), rows.schema)


def exchanged(run: DataFrame, digit: int, digits: int) -> DataFrame:
    """One round: lanes that differ in one digit alone share out their digests by that digit, and each merges what it gets."""
    shift = DIGIT_BITS * digit
    mask = ((1 << DIGIT_BITS) - 1) << shift
    home = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")  # 32 bits
    home = F.shiftright(home, 32 - DIGIT_BITS * digits)
    lane = F.col("lane").bitwiseAND(~mask).bitwiseOR(home.bitwiseAND(mask))
    return run_of(run.withColumn("lane", lane).repartition("lane"))


def digits_for(rows: int) -> int:
    lanes = max(1, -(-rows // LANE_ROWS))
    return min(MOST_DIGITS, max(LEAST_DIGITS, -(-(lanes - 1).bit_length() // DIGIT_BITS)))


def survivors(leaves: DataFrame, digits: int) -> DataFrame:
    """One row per text from the leaves' runs: after a round for each digit, a digest's lane is its own leading digits."""
    run = leaves
    for digit in range(digits):
        run = exchanged(run, digit, digits)
    return run


def mark(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``keep`` of every row with ``_keep`` (key of the row that stays), ``_n`` (rows with that text), ``_kept`` and ``_digest``.

    Texts are equal when they are after ``normalised``; null counts as empty, however long a text is. Of
    equal texts the row with the smallest key stays, null keys last; of rows that tie, the first read, so
    exactly one row of a group stays. Keys are of any type that can be ordered. An empty table gives an
    empty one; only the named columns are read, and they must not begin with an underscore.

    Every scan partition is a leaf, dealt to a lane. Its rows are sorted by digest (SHA-256) and merged
    where they lie: a group of copies leaves as one row per leaf. Then lanes exchange runs, digit by
    digit, and merge again, which ends with every digest whole in one lane; no lane ever holds more than
    its share, and no round meets more rows of one text than 2^DIGIT_BITS per lane. The answer goes back the same
    way: only digests that occur twice, to the leaves that hold them, and from there to the rows, so copies of a
    frequent text are looked up leaf by leaf. Each step is sorted shuffles of narrow rows, which survive lost executors.
    """
    ready(docs.sparkSession)
    clean = normalised(F.col(text))
    rows = stage(docs.select(key, *keep, F.unhex(F.sha2(clean, 256)).alias("digest"), F.octet_length(clean).cast("long").alias("bytes"),
                             F.spark_partition_id().alias("leaf"), F.monotonically_increasing_id().alias("row")), "digests")
    digits = digits_for(rows.count())
    rows = rows.withColumn("lane", F.pmod(F.col("leaf"), F.lit(1 << (DIGIT_BITS * digits))).cast("long"))
    leaves = stage(run_of(rows.select("lane", "digest", "bytes", F.col(key).alias("id"), "row", F.lit(1).cast("long").alias("n"))), "leaves")
    groups = survivors(leaves, digits).where("n > 1").select("digest", "bytes", F.col("id").alias("_keep"), F.col("row").alias("_first"), F.col("n").alias("_n"))
    known = stage(leaves.select("lane", "digest", "bytes").join(groups, ["digest", "bytes"]).distinct(), "groups")
    out = rows.join(known, ["lane", "digest", "bytes"], "left")
    grouped = F.col("_n").isNotNull()
    return out.select(key, *keep, F.when(grouped, F.col("_keep")).otherwise(F.col(key)).alias("_keep"), F.coalesce("_n", F.lit(1)).cast("long").alias("_n"),
                      F.coalesce(F.col("row") == F.col("_first"), F.lit(True)).alias("_kept"), F.lower(F.hex("digest")).alias("_digest"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (which must not begin with an underscore)."""
    others = tuple(c for c in docs.columns if c != key)
    return mark(docs, text, key, others).where("_kept").select(*docs.columns)
