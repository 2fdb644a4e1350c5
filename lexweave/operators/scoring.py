"""Scoring generated answers against criteria: content, bill sets, grounding, reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import text as tx
from lexweave.operators.spans import match_spans

_NONE = "array<string>"


def _list(c) -> Column:
    return F.coalesce(tx.col(c), F.array().cast(_NONE))


# -- single checks ---------------------------------------------------------
def citations_in(answer) -> Column:
    return F.regexp_extract_all(tx.col(answer), F.lit(fixed.ANSWER_CITATION), F.lit(0))


def missing(answer, wanted, case_sensitive: bool = False) -> Column:
    """Required substrings that the answer lacks."""
    a = tx.col(answer)
    if case_sensitive:
        return F.filter(_list(wanted), lambda s: ~F.contains(a, s))
    return F.filter(_list(wanted), lambda s: ~F.contains(F.lower(a), F.lower(s)))


def present(answer, forbidden) -> Column:
    low = F.lower(tx.col(answer))
    return F.filter(_list(forbidden), lambda s: F.contains(low, F.lower(s)))


def abstains(answer) -> Column:
    return tx.any_phrase(answer, fixed.ABSTAIN_SIGNALS)


def section_root(citation: Column) -> Column:
    """A citation without its subdivisions."""
    return F.regexp_replace(citation, f"^({fixed.CITE_HEAD}){fixed.CITE_SUBS}({fixed.CITE_TAIL})", "$1$2")


def ungrounded(citations, tool_text) -> Column:
    """Citations that no tool response shows, at section level."""
    t = tx.col(tool_text)
    return F.filter(tx.col(citations), lambda c: ~(F.contains(t, c) | F.contains(t, section_root(c))))


# -- bills an answer names -------------------------------------------------
def _congress_for(text: Column, m: Column) -> Column:
    """Congress right after a mention, else the nearest heading before it."""
    valid = lambda xs: F.filter(xs, lambda c: c.isin(fixed.VALID_CONGRESSES))
    after = valid(F.regexp_extract_all(F.substring(text, m["end"] + 1, F.lit(fixed.CONGRESS_AFTER_CHARS)), F.lit(fixed.CONGRESS_AFTER), F.lit(1)))
    lo = F.greatest(m["start"] - fixed.CONGRESS_BEFORE_CHARS, F.lit(0))
    before = valid(F.regexp_extract_all(F.substring(text, lo + 1, m["start"] - lo), F.lit(fixed.CONGRESS_HEADING), F.lit(1)))
    return F.coalesce(F.try_element_at(after, F.lit(1)), F.try_element_at(before, F.lit(-1)))


def prose_bills(answer) -> Column:
    """Bill ids named in prose with a congress after them or in a heading before."""
    text = tx.col(answer)

    def of(kind: str, prose: str) -> Column:
        found = F.transform(match_spans(text, rf"(?i)\b{prose}\s*\d+\b"), lambda m: F.concat(
            _congress_for(text, m), F.lit(f"-{kind}-"), F.regexp_extract(m["match"], r"(\d+)$", 1)))
        return F.array_compact(found)

    return F.array_distinct(F.concat(*[of(k, p) for k, p in fixed.BILL_TYPE_PROSE.items()]))


def mentioned_bills(answer, prose=None) -> Column:
    """Every bill id an answer names in any form."""
    text = tx.col(answer)
    plain = F.regexp_extract_all(text, F.lit(r"\b\d+-[a-z]+-\d+\b"), F.lit(0))
    urn = F.transform(F.regexp_extract_all(text, F.lit(r"bill:us/\d+/[a-z]+/\d+"), F.lit(0)),
                      lambda u: F.regexp_replace(u, r"^bill:us/(\d+)/([a-z]+)/(\d+)$", "$1-$2-$3"))
    return F.array_distinct(F.concat(plain, urn, prose_bills(answer) if prose is None else tx.col(prose)))


def names_bill(answer, bill: Column, prose) -> Column:
    """True when one bill is named: its id, its URN, or in prose."""
    text = tx.col(answer)
    urn = F.concat(F.lit("bill:us/"), F.replace(bill, F.lit("-"), F.lit("/")))
    return F.contains(text, bill) | F.contains(text, urn) | F.array_contains(tx.col(prose), bill)


def _share(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


def set_scores(df: DataFrame, mentioned: str, truth: str, found_truth: str, minimum: str, found_min: str) -> DataFrame:
    """Add ``precision, recall, f1, missing_min, extras`` from array columns (null without any truth)."""
    t, m = F.size(truth), F.size(minimum)
    base, hit = F.when(t > 0, F.col(truth)).otherwise(F.col(minimum)), F.when(t > 0, F.col(found_truth)).otherwise(F.col(found_min))
    precision = F.when((F.size(mentioned) > 0) & (t > 0), _share(F.size(F.array_intersect(mentioned, truth)), F.size(mentioned))).otherwise(
        F.when(F.size(F.array_intersect(F.col(mentioned), base)) > 0, 1.0).otherwise(0.0))
    asked = (t > 0) | (m > 0)
    df = df.withColumn("precision", F.when(asked, precision)).withColumn("recall", F.when(asked, _share(F.size(hit), F.size(base))))
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("f1", F.when(asked, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)))
        .withColumn("missing_min", F.array_except(minimum, found_min))
        .withColumn("extras", F.when(t > 0, F.array_except(mentioned, truth)).otherwise(F.array().cast(_NONE)))
    )


# -- whole runs ------------------------------------------------------------
def score_runs(runs: DataFrame, criteria: DataFrame) -> DataFrame:
    """One scored row per run.

    ``runs``: ``query_id, category, final_answer, tool_calls array<struct<response_text…>>, error, aborted``;
    ``criteria``: ``query_id`` and the six criteria arrays / flag. Runs that failed only fail.
    """
    c = criteria.select("query_id", "answer_must_contain", "answer_must_not_contain", "answer_must_cite",
                        F.array_distinct(_list("bill_id_min")).alias("minimum"), F.array_distinct(_list("bill_id_set_full")).alias("truth"), "abstain")
    a = F.col("final_answer")
    df = runs.join(c, "query_id").withColumn("broken", F.coalesce("aborted", F.lit(False)) | (F.coalesce("error", F.lit("")) != ""))
    df = df.withColumn("tool_text", F.array_join(F.transform("tool_calls", lambda x: x["response_text"]), " "))
    df = df.withColumn("prose", prose_bills(a)).withColumn("mentioned", mentioned_bills(a, "prose")).withColumn("citations", citations_in(a))
    df = df.withColumn("found_truth", F.filter("truth", lambda b: names_bill(a, b, "prose"))).withColumn(
        "found_min", F.filter("minimum", lambda b: names_bill(a, b, "prose")))
    df = set_scores(df, "mentioned", "truth", "found_truth", "minimum", "found_min").withColumn("ungrounded", ungrounded("citations", "tool_text"))
    empty = lambda x: F.size(x) == 0
    asked = lambda name, applies, ok: F.when(applies, F.struct(F.lit(name).alias("name"), ok.alias("passed")))
    has = lambda col: F.size(_list(col)) > 0
    checks = F.when(F.col("broken"), F.array(F.struct(F.lit("execution").alias("name"), F.lit(False).alias("passed")))).otherwise(F.array_compact(F.array(
        asked("must_contain", has("answer_must_contain"), empty(missing(a, "answer_must_contain"))),
        asked("must_not_contain", has("answer_must_not_contain"), empty(present(a, "answer_must_not_contain"))),
        asked("must_cite", has("answer_must_cite"), empty(missing(a, "answer_must_cite", True))),
        asked("abstain", F.coalesce("abstain", F.lit(False)), abstains(a)),
        asked("bill_set", (F.size("truth") > 0) | (F.size("minimum") > 0), empty(F.col("missing_min")) & empty(F.col("extras"))),
        asked("citation_grounding", F.lit(True), empty(F.col("ungrounded"))))))
    live = lambda col, zero=None: F.when(~F.col("broken"), col).otherwise(F.lit(zero))
    return df.withColumn("checks", checks).select(
        "query_id", "category", "checks", F.forall("checks", lambda x: x["passed"]).alias("overall_passed"),
        *[live(F.col(x)).alias(x) for x in ("precision", "recall", "f1")],
        live(F.size("citations") - F.size("ungrounded"), 0).alias("grounded"), live(F.size("ungrounded"), 0).alias("ungrounded"),
        F.col("broken").alias("aborted"), "mentioned", "missing_min", "extras")


def report(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pass rate, mean precision / recall / F1, shortfall counts and grounding rate (per group)."""
    total = F.sum("grounded") + F.sum("ungrounded")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("overall_passed").alias("n_passed"),
        F.round(F.avg(F.col("overall_passed").cast("double")), 6).alias("pass_rate"),
        *[F.round(F.avg(x), 6).alias(f"mean_{x}") for x in ("precision", "recall", "f1")],
        F.count_if(F.col("recall") < 1.0).alias("under_coverage"), F.count_if(F.col("precision") < 1.0).alias("over_confidence"),
        F.sum("grounded").alias("grounded"), F.sum("ungrounded").alias("ungrounded"),
        F.round(F.when(total > 0, F.sum("grounded") / total), 6).alias("grounding_rate"))


def grade_tally(records: DataFrame, grades: DataFrame, by: list[str] = ()) -> DataFrame:
    """PASS / PARTIAL / FAIL counts; a record without a grade fails."""
    g = records.join(grades, "query_id", "left").withColumn("grade", F.coalesce("grade", F.lit("FAIL")))
    return g.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") == x).alias(x.lower()) for x in ("PASS", "PARTIAL", "FAIL")])
