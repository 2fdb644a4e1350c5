"""N-gram Jaccard join: count vectors in trees of bounding boxes, one tree per cell of texts that share a rare shingle.

A text is the set of its 5-word shingles. Shingles are hashed into groups; the counts per group are a
point. The overlap of two sets is at most the sum of the smaller counts, and of a set and all points in
a box at most the sum of the smaller of count and upper corner: that is what a search descends by.
One tree over all texts would compare almost every text with every other of its size, as boxes of unrelated
texts overlap in every coordinate. So trees are built per cell. Two sets with similarity t share one of
the first ``n - ceil(t n) + 1`` shingles of each in any fixed order; those are a text's cells, taken
in the order of rising frequency. No pair is lost, and most cells hold one text.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import SPACES, ready, slices, text_bytes, words
from lexweave.sources.tables import stage

SHINGLE = 5
#: The threshold as a share of whole numbers, so that nothing is rounded.
NUM, DEN = 80, 100
GROUPS = 256
#: Frequent shingles known to all tasks (a fixed bound), and the share of a text's shingles that is counted for them.
FREQUENT, COUNTED = 1 << 20, 0.25
#: A cell of a frequent shingle is dealt to parts of about so many texts.
PART = 256
BLOCK = 2048
LEAF = 16
#: Classes or pairs that a task remembers, to name each once.
SEEN = 1 << 18
#: The largest bitmap of wanted texts: 16 MB.
MAX_BITS = 27


# -- sets of shingles ------------------------------------------------------------------------------

def word_hashes(arr: pa.LargeBinaryArray) -> np.ndarray:
    coded = arr.dictionary_encode()
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; of fewer words all as one; of none, nothing."""
    arr, at = words(data, offs, ~SPACES)
    w = word_hashes(arr)
    n = max(0, len(w) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + w[k: k + n])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(runs[a: b - SHINGLE + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in w[a:b]:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
            yield h
        else:
            yield np.zeros(0, np.uint64)


class Frequent(NamedTuple):
    """Frequent shingles sorted by hash, with the number of texts that count them, and a bitmap to rule others out."""
    keys: np.ndarray
    counts: np.ndarray
    bits: np.ndarray

    def count(self, u: np.ndarray) -> np.ndarray:
        """0 for shingles that are not frequent."""
        out = np.zeros(len(u), np.int64)
        maybe = np.flatnonzero(self.bits[(u >> np.uint64(40)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, u[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[place] == u[maybe], self.counts[place], 0)
        return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first shingles of every text by hash, a few more than its cells would be; of equal sets in one task, once."""
    seen: set[int | None] = set()
    for b in slices(batches, "t"):
        new = []
        for u in shingle_sets(*text_bytes(b.column("t"))):
            c = class_of(u)
            if c not in seen:
                if len(seen) < SEEN:
                    seen.add(c)
                new.append(u[: int(COUNTED * len(u)) + 2])
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(new).view(np.int64))], ["h"])


def frequent(docs: DataFrame) -> Frequent:
    """The commonest of the shingles that can be cells, at most FREQUENT of them.

    They only set the order in which a text names its cells, so that common passages come last. Any order
    finds all pairs; a shingle that is not counted here costs time, never a result.
    """
    rows = (docs.mapInArrow(counted, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
            .orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow())
    keys, counts = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    bits = np.zeros(1 << 24, bool)
    bits[(keys >> np.uint64(40)).astype(np.int64)] = True
    return Frequent(keys[order], counts[order], bits)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def counts_of(u: np.ndarray) -> np.ndarray:
    return np.bincount((u & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def packed(counts: np.ndarray) -> bytes:
    """Counts as nibbles, bytes or 32-bit numbers, the narrowest that holds them all; the length tells which."""
    top = counts.max()
    if top < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if top < 256 else "<i4").tobytes()


def unpacked(col: pa.Array) -> np.ndarray:
    """The count vectors of a column, one per row."""
    data, offs = text_bytes(col)
    out = np.zeros((len(col), GROUPS), np.int32)
    for size in (GROUPS // 2, GROUPS, 4 * GROUPS):
        rows = np.flatnonzero(np.diff(offs) == size)
        if not len(rows):
            continue
        raw = data[offs[rows][:, None] + np.arange(size)]
        if size == GROUPS // 2:
            out[rows, ::2], out[rows, 1::2] = raw & 15, raw >> 4
        else:
            out[rows] = raw if size == GROUPS else raw.view("<i4")
    return out


def class_of(u: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True) if len(u) else None


SIGNED = "doc_id long, th long, cls long, n long, counts binary, cells array<long>, parts array<int>"


def signed(docs: DataFrame) -> DataFrame:
    """Per row its text's class (a digest of the shingle set), set size, count vector and cells, and into how many parts each cell is dealt.

    Of rows of one class that a task meets, the first names the cells; so a class that a third of all rows hold is no crowd.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs.select("t")))

    def run(batches):
        f, seen = shared.value, set()
        for b in slices(batches, "t"):
            cls, n, counts, cells, at, parts = [], [], [], [], [0], []
            sets = list(shingle_sets(*text_bytes(b.column("t"))))
            counts_all = f.count(np.concatenate(sets))
            start = 0
            for u in sets:
                r = counts_all[start: start + len(u)]
                start += len(u)
                c = class_of(u)
                p = prefix_length(len(u)) if len(u) and c not in seen else 0
                if len(seen) < SEEN:
                    seen.add(c)
                first = np.flatnonzero(r == 0)[:p]
                if len(first) < p:
                    common = np.flatnonzero(r)
                    first = np.append(first, common[np.argsort(r[common], kind="stable")][: p - len(first)])
                cls.append(c)
                n.append(len(u))
                counts.append(packed(counts_of(u)))
                cells.append(u[first])
                parts.append(r[first] // PART + 1)
                at.append(at[-1] + p)
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(cells).view(np.int64)))
            dealt = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.binary()), flat, dealt],
                                             ["doc_id", "th", "cls", "n", "counts", "cells", "parts"])
    return docs.mapInArrow(run, SIGNED)


# -- trees of bounding boxes -----------------------------------------------------------------------

class Tree(NamedTuple):
    """A packed R-tree over count vectors: points in leaves of LEAF, boxes of boxes above; ``high`` and ``size`` per level."""
    order: np.ndarray
    points: np.ndarray
    sizes: np.ndarray
    high: list[np.ndarray]
    least: list[np.ndarray]
    most: list[np.ndarray]

    @classmethod
    def pack(cls, points: np.ndarray, sizes: np.ndarray) -> Tree:
        order = np.arange(len(points))
        if len(points) > LEAF:
            spread = np.argsort(-points.var(0), kind="stable")[:2]
            order = np.lexsort([*points.T[spread][::-1], sizes])
        p, s = points[order], sizes[order]
        high, least, most = [], [], []
        h, a, b = p, s, s
        while len(h) > 1:
            cut = np.arange(0, len(h), LEAF)
            h, a, b = np.maximum.reduceat(h, cut), np.minimum.reduceat(a, cut), np.maximum.reduceat(b, cut)
            high.append(h)
            least.append(a)
            most.append(b)
        return cls(order, p, s, high, least, most)

    def search(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all points whose bound allows a link with a set of n shingles and counts q; the bounds as similarities."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.high) - 1, -1, -1):
            bound = np.minimum(q, self.high[level][nodes]).sum(1)
            fits = may_link(bound, n, self.least[level][nodes]) & (DEN * n >= NUM * self.least[level][nodes]) & (DEN * self.most[level][nodes] >= NUM * n)
            below = (nodes[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = below[below < (len(self.high[level - 1]) if level else len(self.points))]
        bound = np.minimum(q, self.points[nodes]).sum(1)
        fits = may_link(bound, n, self.sizes[nodes])
        bound, nodes = bound[fits], nodes[fits]
        return self.order[nodes], bound / (n + self.sizes[nodes] - bound)


def may_link(overlap: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and (at least) m shingles with at most this overlap can reach the threshold."""
    return DEN * overlap >= NUM * (n + m - overlap)


def searched(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, block) in, pairs of classes of different components out, one tree per block.

    All pairs that the bounds allow, or with ``best`` of every class the likeliest of each other component.
    Members of the commonest component of a block that meets itself need no search of their own: the others find them.
    """
    def pairs(cls, comp, sizes, points, side) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right) or comp.min() == comp.max():
            return cls[:0], cls[:0]
        major = None
        if side[0] == 2:
            names, times = np.unique(comp, return_counts=True)
            major = names[times.argmax()]
            left = left[comp[left] != major]
        t = Tree.pack(points[right], sizes[right])
        x, y = [cls[:0]], [cls[:0]]
        for i in left:
            places, likeness = t.search(points[i], int(sizes[i]))
            js = right[places]
            keep = comp[js] != comp[i]
            if best:
                js = js[keep][np.argsort(-likeness[keep], kind="stable")]
                js = js[np.unique(comp[js], return_index=True)[1]]
            else:
                js = js[keep & ((side[js] == 1) | (comp[js] == major) | (cls[js] > cls[i]))]
            x.append(np.repeat(cls[i], len(js)))
            y.append(cls[js])
        return np.concatenate(x), np.concatenate(y)

    held = None
    for b in itertools.chain((pa.Table.from_batches([b]) for b in batches), [None]):
        t = b if held is None else held if b is None else pa.concat_tables([held, b])
        if t is None or not t.num_rows:
            continue
        cell, block, cls, comp, n, side = (t[k].to_numpy() for k in ("cell", "block", "cls", "comp", "n", "side"))
        ends = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
        ends = np.append(ends, len(cell)) if b is None else ends
        if len(ends):
            points = unpacked(t["counts"].slice(0, int(ends[-1])).combine_chunks())
            got = [pairs(cls[a:e], comp[a:e], n[a:e], points[a:e], side[a:e]) for a, e in zip([0, *ends[:-1]], ends) if e - a > 1]
            x, y = (np.concatenate([cls[:0], *(g[k] for g in got)]) for k in (0, 1))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
            t = t.slice(int(ends[-1]))
        held = t


# -- the join --------------------------------------------------------------------------------------

def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, part, class) in; out the pairs (x, y) of the least class of a part and every other one.

    ``cell`` is null where the pair is all there is to compare. Otherwise the row also keeps y as a member of
    the cell: in a rare cell all but the least, in a cell dealt to parts all, the least being its own x.
    Only the row before is remembered, so a cell of any size passes through.
    """
    now = lead = last = second = None
    seen: set[tuple[int, int]] = set()
    out: list[tuple[int | None, int, int]] = []

    def end():
        if second is not None and (lead, second) not in seen:
            if len(seen) < SEEN:
                seen.add((lead, second))
            out.append((None, lead, second))

    for b in batches:
        for cell, part, c in zip(*(b.column(k).to_pylist() for k in ("cell", "part", "cls"))):
            if (cell, part) != now:
                end()
                now, lead, last, second = (cell, part), c, c, None
                if part >= 0:
                    out.append((cell, c, c))
            elif c != last:
                if part >= 0:
                    out.append((cell, lead, c))
                elif last == lead:
                    second = c
                else:
                    if second is not None:
                        out.append((cell, lead, second))
                        second = None
                    out.append((cell, lead, c))
                last = c
        if len(out) > 50_000:
            yield pa.RecordBatch.from_pydict(dict(zip(("cell", "x", "y"), map(list, zip(*out)))), schema=STARS)
            out.clear()
    end()
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("cell", "x", "y"), map(list, zip(*out)))), schema=STARS)


STARS = pa.schema([("cell", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sizes and count vectors allow a link."""
    a, b = (points.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}")) for k in "xy")
    sized = (DEN * F.col("nx") >= NUM * F.col("ny")) & (DEN * F.col("ny") >= NUM * F.col("nx"))
    return pairs.join(a, "x").join(b, "y").where(sized).mapInArrow(within, "x long, y long")


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bound = np.minimum(unpacked(b.column("cx")), unpacked(b.column("cy"))).sum(1)
        yield b.select(["x", "y"]).filter(pa.array(may_link(bound, b.column("nx").to_numpy(), b.column("ny").to_numpy())))


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) that are links by the sets themselves.

    Only texts of these pairs are read again. Each y goes once to the x it is paired with; an x with more than
    PART partners is dealt to parts, each with its own copy of x.
    """
    likely = stage(pairs, "likely")
    heads = likely.groupBy("x").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    others = likely.join(heads, "x").select("x", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"), F.col("y").alias("cls"))
    own = heads.select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x").alias("cls"))
    wanted = stage(others.unionByName(own).join(classes, "cls").select(
        "x", "part", "cls", F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t")), "wanted")
    match = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    met = among(texts, wanted, "doc_id", "th").join(wanted, match).select("x", "part", "cls", "t")
    return met.repartition("x", "part").sortWithinPartitions("x", "part", F.col("cls") != F.col("x"), "cls").mapInArrow(linked, "x long, y long")


def among(rows: DataFrame, wanted: DataFrame, key: str, th: str, inside: bool = True) -> DataFrame:
    """Rows whose (key, text hash) may be wanted, by a bitmap of at most 2^MAX_BITS bits, or those that surely are not.

    So a join with many wanted keys need not shuffle all texts. Where the keys outgrow the bitmap it lets more
    pass, never fewer; a join then tells exactly.
    """
    bits = 1 << min(MAX_BITS, max(16, (16 * wanted.count()).bit_length()))
    place = lambda d, t: F.pmod(F.xxhash64(d, t), F.lit(bits))
    at = wanted.select(place(F.col("_d"), F.col("_t")).alias("p"))
    cells = at.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b")).toArrow()
    grid = np.zeros(bits >> 5, np.uint32)
    grid[cells["w"].to_numpy()] = cells["b"].to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(grid)

    def run(batches):
        for b in batches:
            p = b.column("_place").to_numpy()
            maybe = (shared.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
            yield b.filter(pa.array(maybe == inside)).drop_columns(["_place"])
    return rows.withColumn("_place", place(F.col(key), F.col(th))).mapInArrow(run, rows.schema)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (x, part), x's own text first and then by class, in; out the pairs (x, y) that are links, repeated rows once."""
    head, last = np.zeros(0, np.uint64), None
    for b in slices(batches, "t"):
        out = []
        for x, part, c, u in zip(*(b.column(k).to_pylist() for k in ("x", "part", "cls")), shingle_sets(*text_bytes(b.column("t")))):
            if (x, part, c) == last:
                continue
            last = (x, part, c)
            if c == x:
                head = u
                continue
            n = len(np.intersect1d(head, u, assume_unique=True))
            if DEN * n >= NUM * (len(head) + len(u) - n):
                out.append((x, c))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in zip(*out)], ["x", "y"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (x, y); comp is the least node it is connected with.

    Large-star and small-star steps by turns, each written out, until nothing changes; a star of any size
    costs one row per link and step.
    """
    edges = stage(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small_low, "u")
        small = (down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(small_low.select("u", F.col("m").alias("v"))).distinct())
        edges = stage(small, "edges")
        told = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(told) == before:
            break
        before = tuple(told)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))


def cell_pairs(members: DataFrame, points: DataFrame, comps: DataFrame, best: bool) -> DataFrame:
    """Pairs in one cell, of classes in different components, whose count vectors allow a link.

    Cells whose members lie in one component are done. Texts that share a passage share a cell for many of its
    shingles; of cells with the same members (by count and a 128-bit digest) one is searched, as the others hold
    the same pairs. A cell of more than BLOCK members is cut into blocks by hash, and every two blocks meet
    in a task of their own.
    """
    known = members.join(comps, F.col("cls") == F.col("node"), "left").select("cell", "cls", F.coalesce("comp", "cls").alias("comp"))
    open_cells = known.groupBy("cell").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("cls")).alias("d"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("e")).where("a != b")
    alone = open_cells.groupBy("m", "d", "e").agg(F.min("cell").alias("cell"))
    many = alone.select("cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = known.join(many, "cell").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    sides = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "cell", "cls", "comp", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("block"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    full = sides.join(points, "cls")
    sorted_rows = full.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    found = sorted_rows.mapInArrow(lambda batches: searched(batches, best), "x long, y long")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``th`` (hash of the text), ``n_shingles``, ``group`` and ``component_id``.

    ``component_id`` is the smallest key reachable by links (nulls aside; null if a component has no
    other), ``group`` names the component whatever the keys are, and ``keeper`` is true for the rows of one
    text of each component. Null texts and texts without words have an empty set, no links and a component of their own (group null);
    repeated rows and equal sets are one class that needs no pairs; an empty table gives an empty
    one; further columns play no part. Two different sets would be taken as one only if their 64-bit digests met.

    First every class is compared with the least class of each of its cells (of each part, where the shingle is frequent); what is then connected
    needs no further pairs, so a group of copies costs as many comparisons as it has members. Cells in which
    several components are left are searched with their trees, first for the likeliest partner in each other
    component, which joins what can be joined, then for all partners that are left.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    mine = stage(signed(rows), "signed")
    filled = mine.where("n > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = stage(filled.groupBy("cls").agg(F.min(first).alias("first")), "classes")
    part = F.when(F.col("c.parts") > 1, F.pmod(F.xxhash64("c.cells", "cls"), F.col("c.parts")).cast("int")).otherwise(-1)
    named = filled.select("cls", F.explode(F.arrays_zip("cells", "parts")).alias("c")).select(F.col("c.cells").alias("cell"), part.alias("part"), "cls")
    met = stage(named.repartition("cell", "part").sortWithinPartitions("cell", "part", "cls").mapInArrow(stars, "cell long, x long, y long"), "stars")
    ids = stage(met.select(F.explode(F.array("x", "y")).alias("cls")).distinct().select("cls", F.col("cls").alias("_d"), F.col("cls").alias("_t")), "ids")
    points = stage(among(filled.select("cls", "n", "counts"), ids, "cls", "cls").join(ids.select("cls"), "cls").dropDuplicates(["cls"]), "points")
    links = stage(verified(bounded(met.where("x != y").select("x", "y").distinct(), points), classes, rows), "links")
    members = met.where("cell is not null").select("cell", F.col("y").alias("cls"))
    final = components(links)
    for best in (True, False):
        more = stage(verified(cell_pairs(members, points, final, best), classes, rows), "links")
        links = links.unionByName(more)
        final = components(links)
    placed = classes.join(final, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("comp", "cls").alias("group"))
    heads = placed.groupBy("group").agg(F.min("first").alias("head"))
    told = placed.join(heads, "group").select("cls", "group", "head")
    joined = with_class(mine, told)
    return joined.select("doc_id", "th", F.col("n").alias("n_shingles"), "group",
                         F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         F.when(F.col("n") > 0, F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).otherwise(True).alias("keeper"))


def with_class(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Rows with what is told of their class; rows of empty sets have none and are not shuffled to one place."""
    narrow = rows.select("doc_id", "th", "cls", "n")
    empty = narrow.where("n = 0").select("doc_id", "th", "n", F.lit(None).cast("long").alias("group"), F.lit(None).cast(told.schema["head"].dataType).alias("head"))
    return narrow.where("n > 0").join(told, "cls").select("doc_id", "th", "n", "group", "head").unionByName(empty)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key; rows without shingles all stay.

    Rows are known by key and text. Those that go, and keepers that stand on several rows (of which one
    stays), are few; only rows that may be among them are joined, the others pass straight on.
    """
    found = stage(similar(docs, key, text), "similar")
    gone = found.where("not keeper").select("doc_id", "th").distinct().withColumn("one", F.lit(False))
    twice = found.where("keeper and n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("times")).where("times > 1")
    told = stage(gone.unionByName(twice.select("doc_id", "th", F.lit(True).alias("one"))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "one"), "told")
    tagged = docs.withColumns({"_k": F.col(key).cast("long"), "_th": F.xxhash64(text)})
    plain = among(tagged, told, "_k", "_th", inside=False)
    maybe = among(tagged, told, "_k", "_th").join(told, F.col("_k").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    stay, single = maybe.where("one is null"), maybe.where("one").dropDuplicates(["_k", "_th"])
    return plain.select(*docs.columns).unionByName(stay.select(*docs.columns)).unionByName(single.select(*docs.columns))
