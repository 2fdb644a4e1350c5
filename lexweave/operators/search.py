"""Lexical retrieval: tokens, stems, phrase matching, BM25 and ranked legs for query batches."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import asked
from lexweave.functions import text as tx
from lexweave.operators.rank import top_k

WORD = r"[\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(tx.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def fold_accents(text) -> Column:
    """Latin letters without their diacritics."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
    moved = {k: v for k, v in plain.items() if k != v}
    return F.translate(tx.col(text), "".join(moved), "".join(moved.values()))


# -- Porter stemming on the vocabulary ------------------------------------
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"^({_C})?{_V}{_C}"
_M1 = f"^({_C})?{_V}{_C}({_V})?$"
_MM = f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL = f"^({_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism",
          "ate", "iti", "ous", "ive", "ize"]


def _swap(w: Column, rules: dict, measure: str) -> Column:
    """Replace the longest matching suffix when the remaining stem is long enough."""
    chain = F
    for suffix in sorted(rules, key=len, reverse=True):
        stem = F.regexp_replace(w, f"{suffix}$", "")
        chain = chain.when(w.endswith(suffix), F.when(stem.rlike(measure), F.concat(stem, F.lit(rules[suffix]))).otherwise(w))
    return chain.otherwise(w)


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """``term -> stem`` by Porter's published rules; run it on distinct terms only."""
    w = F.col("w")
    df = terms.select("term").distinct().withColumn("w", F.regexp_replace("term", "^y", "Y"))
    df = df.withColumn("w", F.when(w.rlike("(ss|i)es$"), F.regexp_replace(w, "es$", ""))
                       .when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))
    eed, cut = F.regexp_replace(w, "eed$", ""), F.regexp_replace(w, "(ed|ing)$", "")
    df = df.withColumn("cut", F.when(~w.endswith("eed") & w.rlike("(ed|ing)$") & cut.rlike(_VOWEL), cut))
    c = F.col("cut")
    df = df.withColumn("w", F.when(w.endswith("eed"), F.when(eed.rlike(_M0), F.concat(eed, F.lit("ee"))).otherwise(w))
                       .when(c.isNull(), w)
                       .when(c.rlike("(at|bl|iz)$"), F.concat(c, F.lit("e")))
                       .when(c.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(c, ".$", ""))
                       .when(c.rlike(_CVC), F.concat(c, F.lit("e"))).otherwise(c))
    y = F.regexp_replace(w, "y$", "")
    df = df.withColumn("w", F.when(w.endswith("y") & y.rlike(_VOWEL), F.concat(y, F.lit("i"))).otherwise(w))
    df = df.withColumn("w", _swap(w, _STEP2, _M0)).withColumn("w", _swap(w, _STEP3, _M0))
    ion = F.regexp_replace(w, "ion$", "")
    longest = {s: "" for s in _STEP4}
    df = df.withColumn("w", F.when(w.rlike("[st]ion$"), F.when(ion.rlike(_MM), ion).otherwise(w)).otherwise(_swap(w, longest, _MM)))
    e = F.regexp_replace(w, "e$", "")
    df = df.withColumn("w", F.when(w.endswith("e") & (e.rlike(_MM) | (e.rlike(_M1) & ~e.rlike(_CVC))), e).otherwise(w))
    df = df.withColumn("w", F.when(w.endswith("ll") & w.rlike(_MM), F.regexp_replace(w, "l$", "")).otherwise(w))
    return df.select("term", F.when(F.length("term") < 3, F.col("term")).otherwise(F.lower("w")).alias("stem"))


# -- index -----------------------------------------------------------------
def text_index(docs: DataFrame, doc: str, topic: Column, fields: list[str], parent: str | None = None) -> DataFrame:
    """``doc, parent, topic, words, len``: one row per text, ready to be written partitioned by topic.

    Fields are joined with a null between them, so that no phrase runs across two fields.
    """
    parts = []
    for f in fields:
        parts += [tokens(f), F.array(F.lit(None).cast("string"))]
    words = tokens(fields[0]) if len(fields) == 1 else F.flatten(F.array(*parts[:-1]))
    return docs.select(
        F.col(doc).alias("doc"), F.col(parent or doc).alias("parent"), topic.alias("topic"), words.alias("words"),
    ).withColumn("len", F.size("words") - (len(fields) - 1))


def stem_index(index: DataFrame) -> DataFrame:
    """The same index over stems; only distinct terms are stemmed."""
    flat = index.select("doc", F.posexplode_outer("words").alias("at", "term"))
    back = (
        flat.join(stem_vocabulary(flat.where("term is not null").select("term")), "term", "left")
        .where("at is not null").groupBy("doc")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "stem"))), lambda x: x["stem"]).alias("stems"))
    )
    return index.join(back, "doc", "left").withColumn("words", F.coalesce("stems", "words")).drop("stems")


def stem_phrases(phrases: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Parsed query phrases with every word replaced by its stem: of a given table (``term, stem``), else by the rules."""
    flat = phrases.select("*", F.posexplode("units").alias("part", "unit")).select("*", F.posexplode("unit.words").alias("at", "term"))
    known = stems if stems is not None else stem_vocabulary(flat.select("term"))
    keys = [c for c in phrases.columns if c not in ("units", "phrase")]
    word = F.coalesce("stem", "term")
    one = flat.join(known, "term", "left").groupBy(*keys, "part", "unit.prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))), lambda x: x["w"]).alias("words"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "words", "prefix"))), lambda u: F.struct(
        u["words"].alias("words"), u["prefix"].alias("prefix"))).alias("units")).withColumn("phrase", phrase_name(F.col("units"), F.col("near")))


# -- queries ---------------------------------------------------------------
def normalise_query(text) -> Column:
    """Bare words become quoted words (all required); operator syntax passes through."""
    text = tx.col(text)
    bare = F.filter(F.split(tx.strip(text), r"\s+"), lambda t: t != "")
    return F.when(text.rlike(fixed.QUERY_OPERATORS) | (F.size(bare) == 0), text).otherwise(
        F.array_join(F.transform(bare, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " "))


def phrase_name(units: Column, near: Column) -> Column:
    """A phrase as text: its words, a star where the last is open, or the NEAR group."""
    one = F.transform(units, lambda u: F.concat(F.array_join(u["words"], " "), F.when(u["prefix"], "*").otherwise("")))
    return F.when(near.isNull(), one[0]).otherwise(F.concat(F.lit("NEAR("), F.array_join(one, ", "), F.lit(", "), near.cast("string"), F.lit(")")))


def query_phrases(queries: DataFrame, text: str = "text") -> DataFrame:
    """Phrases of a batch of queries; the syntax is that of :func:`lexweave.functions.asked.alternatives`.

    One row per phrase: ``query_id, topic, grp`` (alternatives joined by OR), ``no`` (0 when the
    phrase is required, else the number of the excluded unit), ``item`` (its place in the query), ``near`` (null unless a NEAR
    group), ``units`` (array of words and prefix; one unless a NEAR group), ``phrase``.
    """
    q = queries.select("query_id", "topic", F.explode(asked.parsed(F.col(text))).alias("p")).select("query_id", "topic", "p.*")
    units = F.filter(F.transform("parts", lambda p: F.struct(tokens(p).alias("words"), p.endswith("*").alias("prefix"))), lambda u: F.size(u["words"]) > 0)
    q = q.withColumn("units", units).where(F.size("units") > 0).drop("parts")
    return q.withColumn("near", F.when(F.size("units") > 1, F.col("near"))).withColumn("phrase", phrase_name(F.col("units"), F.col("near")))


def asked_units(phrases: DataFrame) -> DataFrame:
    """The single phrases asked for, NEAR groups taken apart: ``unit`` (its name), ``n, off, word, open`` for each word."""
    u = phrases.select(F.explode("units").alias("u")).select("u.words", "u.prefix").distinct()
    u = u.withColumn("unit", phrase_name(F.array(F.struct("words", "prefix")), F.lit(None).cast("int")))
    u = u.select("unit", "prefix", F.size("words").alias("n"), F.posexplode("words").alias("off", "word"))
    return u.select("unit", "n", "off", "word", (F.col("prefix") & (F.col("off") == F.col("n") - 1)).alias("open"))


def opened(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Units with every open word replaced by the words of ``vocabulary`` (``word``) that begin so; only distinct words are tried."""
    initial = F.substring("word", 1, 1)
    stems = units.where("open").select("unit", "n", "off", F.col("word").alias("stem"), initial.alias("initial"))
    full = vocabulary.withColumn("initial", initial).join(stems, "initial").where(F.col("word").startswith(F.col("stem")))
    return units.where("not open").select("unit", "n", "off", "word").unionByName(full.select("unit", "n", "off", "word"))


KEYS = ["doc", "parent", "topic", "len"]


def phrase_hits(index: DataFrame, phrases: DataFrame, prefixes: bool = False) -> DataFrame:
    """Matching texts with their phrase counts: ``doc, parent, topic, len, freqs map<phrase, n>``.

    Words that no query asks for are dropped by the first join, before any shuffle; the query
    side is as small as the batch, so the planner's own size limit decides how it is joined.
    ``prefixes`` also matches a trailing ``*``, through the distinct words of the texts.
    """
    # the outer form keeps the planner from testing (and so tokenising) each text twice
    words = index.select(*KEYS, F.posexplode_outer("words").alias("at", "word"))
    units = asked_units(phrases)
    units = opened(units, words.where("word is not null").select("word").distinct()) if prefixes else units.where("not open").drop("open")
    found = words.join(units, "word").select(*KEYS, "unit", "n", F.array(F.col("at") - F.col("off")).alias("starts"))
    return counted(found, phrases)


def counted(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrase counts of texts from where words of units, less their offset, stand: rows of ``KEYS, unit, n, starts``."""
    return by_text(phrase_counts(found, phrases))


def by_text(counts: DataFrame) -> DataFrame:
    """One row per text with its counts as ``freqs map<phrase, n>``."""
    return counts.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("phrase", "freq"))).alias("freqs"))


def phrase_counts(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """``KEYS, phrase, freq``, one row per text and phrase that stands in it."""
    # sorted in the aggregate: inside the lambda of _full_runs an expression is evaluated once per element
    per_unit = found.groupBy(*KEYS, "unit", "n").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))
    places = F.when(F.col("n") == 1, F.col("starts")).otherwise(_full_runs(F.col("starts"), F.col("n")))
    per_unit = per_unit.withColumn("starts", places).where(F.size("starts") > 0)
    groups = phrases.where("near is not null").select("phrase", "near", F.size("units").alias("parts"), F.posexplode("units").alias("part", "u")).distinct()
    groups = groups.select("phrase", "near", "parts", "part", phrase_name(F.array("u"), F.lit(None).cast("int")).alias("unit"))
    spots = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("n")).alias("end"), F.col("part").alias("part")))
    near = per_unit.join(groups, "unit").groupBy(*KEYS, "phrase", "near", "parts").agg(F.array_sort(F.flatten(F.collect_list(spots))).alias("places"))
    near = near.withColumn("freq", asked.near_count(F.col("places"), F.col("near"), F.col("parts"))).where("freq > 0")
    plain = phrases.where("near is null").select(F.col("phrase").alias("unit")).distinct()
    single = per_unit.join(plain, "unit").select(*KEYS, F.col("unit").alias("phrase"), F.size("starts").cast("long").alias("freq"))
    return single.unionByName(near.select(*KEYS, "phrase", "freq"))


def _full_runs(starts: Column, n: Column) -> Column:
    """The values of a sorted array that occur ``n`` times, which is the most any does (every word of a phrase present)."""
    return F.filter(starts, lambda s, i: F.get(starts, (i + n - 1).cast("int")) == s)


def collection_stats(index: DataFrame) -> DataFrame:
    """One row: number of texts and mean length over the whole collection."""
    return index.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")).withColumn("one", F.lit(1))


def bm25(index: DataFrame, phrases: DataFrame, prefixes: bool = False,
         k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """Okapi BM25 of every matching text: ``query_id, topic, doc, parent, score`` (higher is better)."""
    hits = phrase_hits(index, phrases, prefixes)
    df = hits.select(F.explode(F.map_keys("freqs")).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    return ranked_hits(hits, priced_units(phrases, df, collection_stats(index)), k1, b)


def gain(tf: Column, df: Column, length: Column, n_docs: Column, avg_len: Column, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> Column:
    """What one phrase adds to the score of a text."""
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.greatest(idf, F.lit(fixed.IDF_FLOOR)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / avg_len))


def wanted_units(phrases: DataFrame, df: DataFrame) -> DataFrame:
    """Required and excluded units of queries all of whose phrases occur: ``items`` (phrase, item, df) and the rarest ``phrase``."""
    wanted = phrases.groupBy("query_id", "topic", "grp", "no", "phrase").agg(F.collect_set("item").alias("places"))
    return (
        wanted.join(df, "phrase", "left").groupBy("query_id", "topic", "grp", "no")
        .agg(F.count(F.lit(1)).alias("need"), F.count("df").alias("have"), F.min(F.struct("df", "phrase")).alias("rare"),
             F.collect_list(F.struct("phrase", "places", "df")).alias("items"))
        .where("need = have").select("query_id", "topic", "grp", "no", "items", F.col("rare.phrase").alias("phrase"))
    )


def priced_units(phrases: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """:func:`wanted_units` with the number of texts that hold each phrase and the size of the collection."""
    return wanted_units(phrases, df).withColumn("one", F.lit(1)).join(stats, "one")


def ranked_hits(hits: DataFrame, unit: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """Scores of the texts in ``hits``, given the :func:`priced_units` of the queries.

    A query's candidates are the texts of its rarest phrase only; its other phrases are then
    looked up in the candidate's own row, so a batch of queries over common words never
    multiplies out and the texts are shuffled once. A phrase of the query counts once, in however many alternatives it stands.
    """
    cand = (
        hits.select("*", F.explode(F.map_keys("freqs")).alias("phrase")).join(unit, ["phrase", "topic"])
        .where(F.forall("items", lambda i: F.map_contains_key("freqs", i["phrase"])))
    )

    def gains(i: Column) -> Column:
        worth = gain(F.try_element_at("freqs", i["phrase"]).cast("double"), i["df"], F.col("len"), F.col("n_docs"), F.col("avg_len"), k1, b)
        return F.transform(i["places"], lambda p: F.struct(p.alias("item"), worth.alias("gain")))

    full = cand.select("query_id", "topic", "grp", "no", "doc", "parent", F.flatten(F.transform("items", gains)).alias("gains"))
    # per query and text: alternatives that hold and are not excluded; one shuffle serves both groupings
    alt = full.repartition("query_id", "topic", "doc", "parent").groupBy("query_id", "topic", "doc", "parent", "grp").agg(F.max("no").alias("excluded"), F.flatten(F.collect_list(F.when(F.col("no") == 0, F.col("gains")))).alias("gains"))
    every = alt.where((F.col("excluded") == 0) & (F.size("gains") > 0)).groupBy("query_id", "topic", "doc", "parent").agg(
        F.array_distinct(F.flatten(F.collect_list("gains"))).alias("gains"))
    return every.select("query_id", "topic", "doc", "parent", F.round(F.aggregate("gains", F.lit(0.0), lambda s, g: s + g["gain"]), 6).alias("score"))


def lexical_leg(bill_scores: DataFrame, section_scores: DataFrame, limit: int) -> DataFrame:
    """Rank bills by the better of their own score and their best section's.

    ``query_id, bill_id, lexical_rank, lexical_section``. Bill-level and section-level scores
    come from different collections and are compared directly, as they are.
    """
    best = [F.desc("score"), F.asc("doc")]
    b = top_k(bill_scores, ["query_id"], best, limit).select("query_id", F.col("doc").alias("bill_id"), "score", F.lit(None).cast("string").alias("section"))
    s = top_k(section_scores, ["query_id"], best, limit * 4).select("query_id", F.col("parent").alias("bill_id"), "score", F.col("doc").cast("string").alias("section"))
    per_bill = b.unionByName(s).groupBy("query_id", "bill_id").agg(
        F.max("score").alias("score"),
        F.min_by("section", F.when(F.col("section").isNotNull(), F.struct(-F.col("score"), F.col("section")))).alias("lexical_section"))
    return top_k(per_bill, ["query_id"], [F.desc("score"), F.asc("bill_id")], limit * 5, "lexical_rank")


def matched_words(query, *fields) -> Column:
    """Query words found as substrings in any of the fields (case-insensitive)."""
    query = tx.col(query)
    items = F.regexp_extract_all(query, F.lit(r'"[^"]+"|\S+'), F.lit(0))
    bare = F.filter(F.transform(items, lambda t: F.regexp_replace(t, '^"+|"+$', "")),
                    lambda t: t.rlike(r"^[\p{L}\p{N}]+$") | t.contains(" "))
    words = F.when(F.size(bare) > 0, bare).otherwise(F.filter(
        F.split(query, r"\s+"), lambda t: (t != "") & ~F.upper(t).isin("AND", "OR", "NOT", "NEAR")))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(tx.col(f), F.lit("")) for f in fields]))
    return F.filter(words, lambda t: F.contains(hay, F.lower(t)))
