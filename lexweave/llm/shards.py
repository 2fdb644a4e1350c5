"""Sharding: minimax contiguous partition of ordered atomic groups into shards of nearly equal bytes."""
from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.sources.tables import stage

BIN_BITS, SPLIT_BITS = 12, 8
SALTS = 64
ORDER = "order_key"


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def feasible(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Where shards end (positions after the last piece) if greedy packing under ``capacity`` needs at most ``shards``."""
    ends, load = [], 0
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if load + s > capacity:
            ends.append(i)
            load = 0
            if len(ends) == shards:
                return None
        load += s
    return [*ends, len(sizes)]


def smallest(low: int, high: int, works: Callable[[int], bool]) -> int:
    """The smallest capacity in [low, high] that works, by halving; ``high`` must work."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if works(mid) else (mid + 1, high)
    return low


class Piece(NamedTuple):
    """A range of order keys that agree but for their last ``shift`` bits: least and greatest key, size. One key: an atom."""
    least: int
    greatest: int
    size: int
    shift: int

    @property
    def atom(self) -> bool:
        return self.least == self.greatest


Sums = Callable[[list[Piece] | None, int], list[Piece]]


def fluid(pieces: list[Piece], capacity: int) -> tuple[int, set[int]]:
    """Shards needed if a range could be cut at any byte, and the ranges that are cut inside: no real packing needs fewer."""
    used, load, inside = 1, 0, set()
    for i, p in enumerate(pieces):
        if p.atom:
            if load + p.size > capacity:
                used, load = used + 1, 0
            load += p.size
            continue
        load += p.size
        if load > capacity:
            inside.add(i)
            used, load = used + (load - 1) // capacity, (load - 1) % capacity + 1
    return used, inside


def bounds(pieces: list[Piece], shards: int) -> tuple[int, int]:
    """Between these lies the smallest capacity: the least if ranges could be cut anywhere, and the least if nowhere."""
    total = sum(p.size for p in pieces)
    sizes = [p.size for p in pieces]
    least = max([-(-total // shards), *[p.size for p in pieces if p.atom]])
    high = smallest(least, total, lambda c: feasible(sizes, shards, c) is not None)
    return smallest(least, high, lambda c: fluid(pieces, c)[0] <= shards), high


def at_cuts(pieces: list[Piece], shards: int, capacities: tuple[int, ...]) -> set[int]:
    """The ranges in which, or before which, a shard ends for one of the capacities: at most two per shard and capacity."""
    sizes, out = [p.size for p in pieces], set()
    for c in capacities:
        out |= fluid(pieces, c)[1] | {e for e in (feasible(sizes, shards, c) or [])[:-1] if not pieces[e].atom}
    return out


def refine(sums: Sums, shards: int, bin_bits: int, pieces: list[Piece] | None = None) -> list[int]:
    """The first order key of every shard but the first, for the least possible size of the largest shard.

    The capacity is halved between two bounds. Only the ranges at the cuts of the bounds and of the
    capacity between them are split on, so a round asks for at most six ranges per shard, whatever
    the sizes of atoms; it ends when the bounds meet, and then the packing of ranges is exact.
    Where one atom is the capacity, the others are no reason to fill shards up to it: what stands before
    and after it is searched again by itself, with the shards left over. ``pieces``: what to cut, all if None.
    """
    pieces = sorted(sums(None, bin_bits)) if pieces is None else pieces
    while pieces:
        low, high = bounds(pieces, shards)
        if low == high:
            ends = feasible([p.size for p in pieces], shards, high)
            forced = next((i for i, p in enumerate(pieces) if p.atom and p.size == high), None)
            if forced is None or len(pieces) == 1:
                return [pieces[e].least for e in ends[:-1]]
            left, right = pieces[:forced], pieces[forced + 1:]
            k = share_out(left, right, shards - 1, high)
            parts = [refine(sums, n, bin_bits, run) if run else [] for run, n in ((left, k), (right, shards - 1 - k))]
            return [*parts[0], *[pieces[forced].least] * bool(left), *[x.least for x in right[:1]], *parts[1]]
        split = at_cuts(pieces, shards, (low, (low + high) // 2, high))
        pieces = sorted([p for i, p in enumerate(pieces) if i not in split] + sums([pieces[i] for i in sorted(split)], SPLIT_BITS))
    return []


def share_out(left: list[Piece], right: list[Piece], shards: int, capacity: int) -> int:
    """How many of the shards go to the pieces on the left, so that both sides keep the capacity and the larger bound is least."""
    def bound(run: list[Piece], n: int) -> int | None:
        """None if the run does not fit into n shards."""
        if not run:
            return 0
        if n < 1 or feasible([p.size for p in run], n, capacity) is None:
            return None
        return bounds(run, n)[0]

    found = [(max(x, y), k) for k in range(shards + 1) if (x := bound(left, k)) is not None and (y := bound(right, shards - k)) is not None]
    return min(found)[1]


def cuts(groups: DataFrame, shards: int, bin_bits: int = BIN_BITS) -> list[int]:
    """``refine`` over a table of ``order_key`` and ``size``; rows of one key are one atom.

    At first the sums of at most 2^bin_bits ranges come to the driver, then those of at most six ranges per
    shard, cut into 2^SPLIT_BITS each, whatever the size of the input.
    """
    def of(rows: DataFrame, shift: int) -> DataFrame:
        return rows.groupBy(F.shiftright(ORDER, shift).alias("prefix")).agg(
            F.min(ORDER).alias("a"), F.max(ORDER).alias("b"), F.sum("size").alias("s")).withColumn("shift", F.lit(shift))

    def sums(ranges: list[Piece] | None, split: int) -> list[Piece]:
        if ranges is None:
            found = of(groups, max(0, 64 - split))
        else:
            by_shift: dict[int, list[int]] = {}
            for p in ranges:
                by_shift.setdefault(p.shift, []).append(p.least >> p.shift)
            found = functools.reduce(DataFrame.unionAll, [
                of(groups.where(F.shiftright(ORDER, shift).isin(prefixes)), max(0, shift - split)) for shift, prefixes in sorted(by_shift.items())])
        return [Piece(r.a, r.b, r.s, r.shift) for r in found.collect()]
    return refine(sums, shards, bin_bits)


def assign(docs: DataFrame, shards: int = 8, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bin_bits: int = BIN_BITS) -> DataFrame:
    """The ``keep`` columns with ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows with equal texts are one atom and stay together, so a shard can be larger than the mean by
    as much as its largest atom forces. Null texts count as one group apart from empty ones, with
    size 1; repeated rows each get a slot; an empty table gives an empty one. Slots number the rows
    range by range; counts of (range, salt) are added up, so that no task orders a whole shard or a
    whole group. Columns of ``keep`` must not be called like those made here.
    """
    t = F.col(text)
    key = F.when(t.isNull(), F.lit(0)).otherwise(F.xxhash64(t))
    rows = stage(docs.select(*keep, size_of(t).alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), key.alias(ORDER),
                             F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")), "shards")
    starts = cuts(rows, shards, bin_bits)
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col(ORDER) >= s).cast("int")
    placed = rows.select("*", shard.alias("shard"), F.shiftright(ORDER, 64 - bin_bits).alias("range"))
    cell = ["shard", "range", "salt"]
    before = Window.partitionBy("shard").orderBy("range", "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*cell).agg(F.count("*").alias("n")).select(
        *cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # at most ranges x salts rows
    place = Window.partitionBy(*cell).orderBy(ORDER, *keep)
    numbered = placed.withColumn("place", F.row_number().over(place) - 1)
    return numbered.join(counts, cell).select(*keep, "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("slot"))
