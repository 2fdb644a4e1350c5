"""Spans in text: locating quotes, structural breaks, mentions of bills."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import text as tx
from lexweave.functions.arrays import let, running_sums

_SPAN = "array<struct<start:int,end:int,match:string>>"


def match_spans(text, pattern: str) -> Column:
    """All matches of a pattern with their 0-based offsets, in order; the text is scanned for the matches and for the gaps between them.

    Gaps and matches add up to the text, so the running sums of their lengths give every offset.
    """
    def place(m):
        steps = F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["hits"])), m["hits"], lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        return let(running_sums(steps), lambda ends: F.transform(m["hits"], lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end"), h.alias("match"))))

    def spans_in(t):
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        made = let(F.struct(found.alias("hits"), F.split(t, pattern).alias("gaps")), place)
        return F.when(t.rlike(pattern), made).otherwise(F.array().cast(_SPAN))

    return let(tx.col(text), spans_in)


def starts_of(text, patterns: list[str]) -> Column:
    """Offsets where any of the patterns begins a match: one scan cuts the text before each, and the pieces' lengths add up."""
    text = tx.col(text)
    # a word border that all patterns begin with is tried once per place, not once per pattern
    border = r"\b" if all(p.startswith(r"\b") for p in patterns) else ""
    ahead = f"(?={border}(?:" + "|".join(f"(?:{p.removeprefix(border)})" for p in patterns) + "))"

    def cuts(pieces):
        sums = running_sums(F.transform(pieces, lambda p: F.length(p).cast("long")))
        inner = let(sums, lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x.cast("int")))
        return F.when(F.size(pieces) > 1, inner).otherwise(F.array().cast("array<int>"))

    return let(F.split(text, ahead), cuts)


def locate_span(haystack, needle) -> Column:
    """``start, end`` (0-based) of the needle in the haystack, or null.

    Exact first; else with any whitespace between its words: both sides are looked at with every
    whitespace run as one blank, and the runs before a place give its offset in the haystack. (A pattern made of
    the words nests as deep as the needle is long.) Needles under three characters are only matched exactly, and nothing is ever made up.
    """
    h, n = tx.col(haystack), tx.col(needle)
    exact = F.position(n, h)
    words = tx.clean_inline(n)
    found = let(F.struct(h.alias("h"), words.alias("words"), F.regexp_replace(h, r"(?U)\s+", " ").alias("flat")),
                lambda x: let(F.struct(x["h"].alias("h"), x["words"].alias("words"), x["flat"].alias("flat"), F.position(x["words"], x["flat"]).alias("at")), _unflattened))
    return (
        F.when(h.isNull() | n.isNull() | (h == "") | (n == ""), F.lit(None))
        .when(exact > 0, F.struct((exact - 1).alias("start"), (exact - 1 + F.length(n)).alias("end")))
        .when(F.length(words) >= 3, found)
    )


def _unflattened(x: Column) -> Column:
    """``start, end`` in ``h`` of ``words`` at place ``at`` of ``flat``, the text with each whitespace run as one blank."""
    blanks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    widths = lambda runs: F.aggregate(runs, F.lit(0), lambda s, r: s + F.length(r) - 1)

    def placed(r: Column) -> Column:
        inner = F.slice(r["runs"], r["before"] + 1, blanks(x["words"]))
        start = x["at"] - 1 + widths(F.slice(r["runs"], F.lit(1), r["before"]))
        return let(F.struct(start.alias("start"), (start + F.length(x["words"]) + widths(inner)).alias("end")), lambda s: F.struct(
            s["start"].alias("start"), F.when(F.length(tx.strip(F.substr(x["h"], s["end"] + 1))) == 0, F.length(x["h"])).otherwise(s["end"]).alias("end")))

    runs = F.struct(F.regexp_extract_all(x["h"], F.lit(r"(?U)\s+"), F.lit(0)).alias("runs"), blanks(F.substr(x["flat"], F.lit(1), x["at"] - 1)).alias("before"))
    return F.when(x["at"] > 0, let(runs, placed))


def break_offsets(text) -> Column:
    """Sorted offsets inside the text where a heading or a lettered provision starts (all headings in one scan)."""
    def offsets(x: Column) -> Column:
        lead = F.transform(match_spans(x["text"], fixed.PROVISION_MARKER),
                           lambda m: m["start"] + F.length(F.regexp_extract(m["match"], r"^[.;—]\s+", 0)))
        every = F.concat(starts_of(x["text"], fixed.HEADING_MARKERS), lead)
        return F.array_sort(F.array_distinct(F.filter(every, lambda o: (o > 0) & (o < x["size"]))))

    # the text is made and measured once: inside a lambda an expression is evaluated once per element
    return let(F.coalesce(tx.col(text), F.lit("")), lambda t: let(F.struct(t.alias("text"), F.length(t).alias("size")), offsets))


def break_count(text) -> Column:
    """How many heading markers a text has (cheap form for profiling)."""
    return reduce(lambda a, b: a + b, [F.regexp_count(tx.col(text), F.lit(p)) for p in fixed.HEADING_MARKERS])


def bill_mentions(text) -> Column:
    """``start, end, bill_type, bill_number`` of bills named in prose, all forms in one scan; the earliest wins, then the longest form."""
    forms = sorted(fixed.BILL_MENTION_PROSE.items(), key=lambda x: -len(x[1]))
    every = "|".join(p for _, p in forms)

    def kind(m: Column) -> Column:
        out = F
        for k, p in forms:
            out = out.when(m.rlike(rf"^{p}\s?\d+$"), k)
        return out

    return F.transform(match_spans(text, rf"\b(?:{every})\s?\d+\b"), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), kind(m["match"]).alias("bill_type"),
        F.regexp_extract(m["match"], r"(\d+)$", 1).cast("long").alias("bill_number")))


def resolved_mentions(mentions: DataFrame, bills: DataFrame) -> DataFrame:
    """``mentions`` (``bill_type, bill_number`` among others) joined to the bills of that name: ``n_bills``, ``congresses`` and, if there is one, its ``bill_id``.

    Bills are grouped by name first, so a mention of a number that many congresses know is one row still.
    """
    known = bills.groupBy("bill_type", "bill_number").agg(F.count(F.lit(1)).alias("n_bills"), F.sort_array(F.collect_set("congress")).alias("congresses"), F.min("bill_id").alias("one"))
    out = mentions.join(known, ["bill_type", "bill_number"], "left")
    return out.withColumn("n_bills", F.coalesce("n_bills", F.lit(0)).cast("long")).withColumn("bill_id", F.when(F.col("n_bills") == 1, F.col("one"))).drop("one")
