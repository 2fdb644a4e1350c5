"""Phrase collocation mining: n-gram counts as weighted acyclic automata, united by prefix range and composed for the parts of phrases."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm import automaton as am
from lexweave.llm.common import LOWER, bits, passes, ready, text_bytes
from lexweave.sources.tables import stage

LONGEST, LEAST, KEEP, INSIDE = 5, 100, 2000, 100
#: Bytes of text counted at once, states a task unites before it sends them, and the bits of the filters.
PIECE_BYTES, STATES, FILTER_BITS = 4 << 20, 1 << 19, 26
#: Automata of one prefix range meet in this many parts first; a range covers about so many words of the corpus.
FAN, RANGE_WORDS, LEAST_RANGE_BITS = 8, 1 << 24, 4
SALTS = 64
UNKNOWN = "und"
#: Bytes at which texts are split into pieces, and bytes between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False


def word_hash(words: list[bytes], salt: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in words), np.uint64, len(words))


def chunks(data: np.ndarray, offs: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cut texts, one after the other, where a text or a piece ends: bytes of about ``limit``, and where texts begin in them."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            stop = np.flatnonzero(BREAK[data[end: end + limit]])
            if len(stop):
                end += int(stop[0])
                break
            end += limit
        end = min(end, len(data))
        i = np.searchsorted(offs, at + limit)
        if i < len(offs) and offs[i] < end:
            end = int(offs[i])
        yield data[at: end], offs[(offs >= at) & (offs < end)] - at
        at = end


def tokens(data: np.ndarray, begins: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words, lower-cased, and of each word the number of its piece."""
    low = LOWER[data]
    inside, edge = WORD[low], BREAK[low].astype(np.int32)
    edge[begins] += 1
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    starts, before = np.flatnonzero(first), np.cumsum(inside)
    bounds = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int64)
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
    return arr.dictionary_encode(), np.cumsum(edge)[starts]


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray, np.ndarray]]:
    """Words of the columns (lang, text), language by language, piece by piece."""
    for b in batches:
        langs = b.column(0)
        for lang in pc.unique(langs).to_pylist():
            texts = b.column(1).filter(pc.equal(langs, lang))
            for data, begins in chunks(*text_bytes(texts), PIECE_BYTES):
                coded, piece = tokens(data, begins)
                if len(coded):
                    yield lang, coded, piece


def count_words(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    for lang, coded, _ in by_language(batches):
        n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
        names = coded.dictionary.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), coded.dictionary.cast(pa.large_string()).cast(pa.string()),
                                          pa.array(word_hash(names, salt).view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "h", "n"])


def keyed(lang: str, *symbols: np.ndarray) -> np.ndarray:
    """Places in a filter of 2^FILTER_BITS bits."""
    h = np.full(len(symbols[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for s in symbols:
        h = (h ^ s) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_BITS)


def windows(lang: str, coded: pa.DictionaryArray, piece: np.ndarray, depth: int, salt: int, words: np.ndarray, pairs: np.ndarray | None) -> am.Automaton | None:
    """From every frequent word on, the longest run of at most ``depth`` words of its piece whose pairs may all be frequent."""
    h = word_hash(coded.dictionary.to_pylist(), salt)
    common = passes(words, keyed(lang, h))
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    index = coded.indices.to_numpy(zero_copy_only=False)
    ids, ok = rank[index], common[index]
    step = ok[1:] & ok[:-1] & (piece[1:] == piece[:-1])
    if pairs is not None:
        at = np.flatnonzero(step)
        step[at] = passes(pairs, keyed(lang, h[order][ids[at]], h[order][ids[at + 1]]))
    step = np.append(step, False)
    single = np.bincount(ids[ok & ~step], minlength=len(h))
    alone = np.flatnonzero(single)
    if depth == 2:
        at = np.flatnonzero(step)
        key, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
        rows = np.stack([key >> 32, key & 0xFFFFFFFF], 1)
    else:
        at = np.flatnonzero(step)
        rows = np.full((len(at), depth), -1, np.int64)
        alive = np.ones(len(at), bool)
        for k in range(depth):
            alive = alive & (step[np.minimum(at + k - 1, len(step) - 1)] if k else True)
            rows[alive, k] = ids[at[alive] + k]
        rows = rows[np.lexsort(rows.T[::-1])] if len(rows) else rows
        new = np.append(True, (rows[1:] != rows[:-1]).any(1)) if len(rows) else np.zeros(0, bool)
        n = np.diff(np.append(np.flatnonzero(new), len(rows)))
        rows = rows[new]
    rows = np.concatenate([rows, np.stack([alone] + [np.full(len(alone), -1)] * (depth - 1), 1)])
    n = np.concatenate([n, single[alone]])
    if not len(rows):
        return None
    order_rows = np.lexsort(rows.T[::-1])
    used, rows_at = np.unique(rows[rows >= 0], return_inverse=True)
    small = np.full(rows.shape, -1, np.int64)
    small[rows >= 0] = rows_at
    return am.build(small[order_rows], n[order_rows].astype(np.int64), h[order][used])


def split_ranges(a: am.Automaton, range_bits: int) -> Iterator[tuple[int, am.Automaton]]:
    """The automaton cut by the leading bits of the first symbol."""
    head = (a.alphabet[a.labels[0]] >> np.uint64(64 - range_bits)).astype(np.int64)
    for r in np.unique(head).tolist():
        yield r, am.part(a, head == r)


SENT = f"lang string, range bigint, part int, {am.PACKED}"


def packed_batch(rows: list[tuple[str, int, int, am.Automaton]], names: list[str]) -> pa.RecordBatch:
    made = [{"lang": lang, "range": r, "part": p, **am.pack(a)} for lang, r, p, a in rows]
    kinds = {"lang": pa.string(), "range": pa.int64(), "part": pa.int32(), "sizes": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in made], kinds.get(c, pa.binary())) for c in names], names)


def count_windows(batches: Iterator[pa.RecordBatch], depth: int, salt: int, words, pairs, range_bits: int) -> Iterator[pa.RecordBatch]:
    """A shard's automata, grown piece by piece, cut by prefix range when they are large and at the end."""
    names = ["lang", "range", "part", *am.COLUMNS]
    held: dict[str, list[am.Automaton]] = {}
    part, size = 0, 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            pieces = [(lang, r, part % FAN, a) for r, a in split_ranges(am.united(parts), range_bits)]
            for i in range(0, len(pieces), 16):
                yield packed_batch(pieces[i: i + 16], names)

    for lang, coded, piece in by_language(batches):
        part = part or xxhash.xxh3_64_intdigest(np.ascontiguousarray(piece[-1:]).tobytes() + str(len(coded)).encode())
        made = windows(lang, coded, piece, depth, salt, words.value, pairs.value if pairs else None)
        if made is None:
            continue
        held.setdefault(lang, []).append(made)
        size += made.size
        if size > STATES:
            held = {k: [am.united(v)] for k, v in held.items()}
            size = sum(v[0].size for v in held.values())
            if size > STATES // 2:
                yield from sent()
                held, size, part = {}, 0, part + 1
    yield from sent()


def unite(blobs: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """One automaton for each value of ``keys``; rows stream in sorted order, so a task holds one union and what came since."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "range", "part", *am.COLUMNS]
        key, held, size = None, [], 0

        def done():
            a = am.pruned(am.united(held), least) if least > 1 else am.united(held)
            if a.labels:
                yield packed_batch([(key[0], key[1], key[2] if "part" in keys else 0, a)], names)

        for b in batches:
            for row in b.to_pylist():
                now = (row["lang"], row["range"], row["part"] if "part" in keys else 0)
                if now != key:
                    if held:
                        yield from done()
                    key, held, size = now, [], 0
                held.append(am.unpack(row))
                size += held[-1].size
                if size > 2 * STATES + 2 * held[0].size:
                    held = [am.united(held)]
                    size = held[0].size
        if held:
            yield from done()

    return blobs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, SENT)


def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            a = am.unpack(row)
            if len(a.labels) > 1:
                symbols, _ = am.paths(a, 1)
                yield pa.RecordBatch.from_arrays([pa.array(keyed(row["lang"], symbols[:, 0], symbols[:, 1]).astype(np.int64))], ["place"])


def word_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        langs = b.column("lang")
        for lang in pc.unique(langs).to_pylist():
            mine = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keyed(lang, h[mine]).astype(np.int64))], ["place"])


def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every phrase of two words and more with its count and the counts of its first parts, from the way to its state."""
    for b in batches:
        for row in b.to_pylist():
            a = am.unpack(row)
            for k in range(1, len(a.labels)):
                symbols, weights = am.paths(a, k)
                n = len(symbols)
                for i in range(0, n, 1 << 16):
                    s, w = symbols[i: i + (1 << 16)].view(np.int64), weights[i: i + (1 << 16)]
                    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(s)), lists(s), pa.array(w[:, -1]), lists(w[:, :-1])],
                                                     ["lang", "path", "a", "firsts"])


def looked_up(automata: DataFrame, requests: DataFrame, range_bits: int) -> DataFrame:
    """``requests`` (lang, ask: symbols, any other columns) with ``found``, the weight of ``ask``.

    Requests travel to the prefix range of what they ask for, where they stream past its automaton, which comes first.
    """
    asked = requests.withColumns({"range": F.shiftrightunsigned(F.col("ask")[0], 64 - range_bits), "part": F.lit(1)})
    out = requests.withColumn("found", F.lit(None).cast("long")).schema
    both = automata.withColumn("part", F.lit(0)).unionByName(asked, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a = None, None
        for b in batches:
            kind = b.column("part").to_numpy(zero_copy_only=False)
            langs, ranges = b.column("lang"), b.column("range").to_numpy(zero_copy_only=False)
            same = (ranges[1:] == ranges[:-1]) & pc.equal(langs.slice(1), langs.slice(0, max(0, len(langs) - 1))).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same | (kind[1:] == 0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                now = (langs[i].as_py(), int(ranges[i]))
                if kind[i] == 0:
                    key, a = now, am.unpack({c: b.column(c)[i].as_py() for c in am.COLUMNS})
                    i += 1
                if i == j:
                    continue
                rows = b.slice(i, j - i)
                lists = rows.column("ask")
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                ask = np.zeros((len(size), int(size.max())), np.int64)
                ask[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
                got = am.composed(a, ask.view(np.uint64), size) if key == now else np.zeros(len(size), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got) if c == "found" else rows.column(c) for c in out.names], out.names)

    return both.repartition("lang", "range").sortWithinPartitions("lang", "range", "part").mapInArrow(run, out)


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """Words with their counts by language, and a salt under which no two words of the corpus share a hash."""
    salt = 0
    while True:
        counted = texts.mapInArrow(lambda batches, s=salt: count_words(batches, s), "lang string, word string, h bigint, n bigint")
        words = stage(counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("h").agg((F.min("word") != F.max("word")).alias("clash")).where("clash").limit(1).count() == 0:
            return words, salt
        salt += 1


def range_of_words(words: int) -> int:
    return max(LEAST_RANGE_BITS, (words // RANGE_WORDS).bit_length())


def first_k(df: DataFrame, order: list[Column], k: int, ties: bool) -> DataFrame:
    """The first ``k`` rows of each language; with ``ties``, also those equal to the last. Salted slices are trimmed first."""
    number = F.rank() if ties else F.row_number()
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    inner = salted.withColumn("_n", number.over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= k)
    return inner.withColumn("_n", number.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= k).drop("_salt")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, keep: int = KEEP,
         inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``keep`` best phrases of each language.

    Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and into words at blanks.
    A phrase of 2 to ``longest`` words counts if it occurs ``a >= least`` times in pieces of the language;
    its score is the least, over its cuts into two parts that occur l and r times, of floor(1000 a n / (l r)),
    n being all words of the language. Phrases inside a longer one with 100 * its count >= ``inside`` * a go.

    Three passes: words; automata of two words where both are frequent; automata of up to ``longest`` words
    where all pairs are frequent (a phrase is no more frequent than its parts). Frequent words and pairs go to
    the tasks as bitmaps of a fixed 8 MB, which may let more through but lose nothing. A shard builds its
    automaton from sorted windows; automata are cut by prefix range and united, in ``FAN`` parts first, so that a
    frequent first word meets pre-summed. l is read on the way to a phrase's state, r by composing requests
    for the rest with the automaton of its range. Arithmetic is in decimals of 38 digits.

    Null texts have no words; a null language is ``und``; repeated rows count each; an empty table gives no
    rows; other columns play no part. Long texts are cut between pieces; one piece is held whole.
    """
    ready(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    words, salt = vocabulary(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    range_bits = range_of_words(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    send = spark.sparkContext.broadcast
    common = send(bits(words.where(F.col("n") >= least).select("lang", "h").mapInArrow(word_places, "place bigint"), FILTER_BITS))

    def automata(depth: int, pairs) -> DataFrame:
        blobs = texts.mapInArrow(lambda b: count_windows(b, depth, salt, common, pairs, range_bits), SENT)
        return unite(unite(blobs, ["lang", "range", "part"]), ["lang", "range"], least)

    pairs = send(bits(automata(2, None).mapInArrow(frequent_pairs, "place bigint"), FILTER_BITS))
    counted = stage(automata(longest, pairs), "automata")
    phrases = stage(counted.mapInArrow(phrases_of, "lang string, path array<bigint>, a bigint, firsts array<bigint>"), "phrases")

    cuts = phrases.select("lang", "path", "a", F.posexplode("firsts").alias("k", "l"))
    cuts = looked_up(counted, cuts.select("*", F.expr("slice(path, k + 2, size(path) - k - 1)").alias("ask")), range_bits)
    exact = {c: F.col(c).cast("decimal(38,0)").alias(c) for c in ("a", "n", "l", "r")}
    scored = cuts.withColumnRenamed("found", "r").join(totals, "lang").withColumns({f"_{c}": d for c, d in exact.items()}).withColumn(
        "score", F.expr("(_a * _n * cast(1000 as decimal(38,0))) div (_l * _r)"))
    best = scored.groupBy("lang", "path").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    parts = F.expr("flatten(transform(sequence(2, size(path) - 1), m -> transform(sequence(1, size(path) - m + 1), s -> slice(path, s, m))))")
    longer = phrases.where(F.size("path") > 2).select("lang", "a", F.explode(parts).alias("path")).groupBy("lang", "path").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "path"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    left = left.select("lang", "path", "a", "n", "cut.score", "cut.l", "cut.r")
    left = first_k(left, [F.desc("score"), F.desc("a")], keep, ties=True).drop("_n")
    named = left.select("lang", "path", F.posexplode("path").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    names = named.groupBy("lang", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first_k(left.join(names, ["lang", "path"]), [F.desc("score"), F.desc("a"), F.asc("phrase")], keep, ties=False)
    return ranked.select("lang", F.col("_n").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
