"""Quality rules: a threshold table compiled into one projection of counts and ratios, without user functions."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import let

SPACE = r"[\x20\x09-\x0D]"
#: The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "are", "this", "be", "by", "at", "not",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "im", "dem", "auf", "als",
    "le", "la", "les", "des", "et", "du", "en", "un", "une", "que", "qui", "pour", "dans", "est", "au",
    "el", "los", "las", "de", "que", "por", "con", "para", "una", "del", "se", "no", "y", "al",
)


class Rule(NamedTuple):
    """A text fails when ``part`` / ``whole`` leaves [low, high]; a rule with an empty whole never fails."""
    name: str
    part: str
    whole: str
    low: float | None
    high: float | None


#: The thresholds; the first two are the base that callers rely on.
BASE = (
    Rule("too_few_words", "n_words", "one", 50, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 0.5),
)
RULES = (
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("mean_word_length", "word_chars", "n_words", 2, 15),
    Rule("capital_ratio", "n_capitals", "word_chars", None, 0.3),
    Rule("stop_words", "n_stop", "n_words", 0.01, None),
)


def removed(text: Column, pattern: str) -> Column:
    """How many characters go when all matches go."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    The windows are sorted by hash, then words, then place, so that equal ones stand side by side;
    the starts of those with an equal neighbour are put back in order and their lengths added up
    without overlap. Equality is that of the words, not of the hash.
    """
    def window(i):
        three = [F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)]
        return F.struct(F.xxhash64(*three).alias("h"), *[w.alias(c) for w, c in zip(three, "abc")], i.alias("i"))

    def same(x, y):
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def starts(s):
        hit = lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
        return F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(hit(x, k), x["i"])), lambda i: i.isNotNull()))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), window)
    return F.when(F.size(ws) >= 4, let(let(F.array_sort(windows), starts), covered)).otherwise(0).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Named counts of one text; each is an expression over the text alone."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    def of_words(ws):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            repeated_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop"))
    def of_lines(ls):
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
    return {
        "by_word": let(word_list(t), of_words), "by_line": let(lines, of_lines),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": removed(t, "[#*$%&|<>]+"), "n_capitals": removed(t, "[A-Z]+")}


def fails(rule: Rule) -> Column:
    """One threshold as a condition on the counts, by products, so that nothing is rounded."""
    part, whole = F.col(rule.part), F.lit(1) if rule.whole == "one" else F.col(rule.whole)
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (part * 1000 < whole * round(rule.low * 1000))
    if rule.high is not None:
        bad = bad | (part * 1000 > whole * round(rule.high * 1000))
    return bad & (whole > 0)


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base=BASE, rules=RULES) -> DataFrame:
    """The ``keep`` columns of each row with its counts, ``base_failed``, ``kept`` and ``failed`` (names of failed rules).

    Null and empty texts have no words and fail the base; long texts are measured whole; repeated
    rows are judged each; an empty table gives an empty one; further columns play no part. A column
    of ``keep`` may not carry the name of a count.
    """
    # one generated row per row: a filter on a count is not pushed below it, so nothing is counted twice
    counted = docs.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in measures(F.col(text)).items()]))))
    flat = counted.select(*keep, "by_word.*", "by_line.*", "word_chars", "n_symbols", "n_capitals")
    names = F.array_compact(F.array(*[F.when(fails(r), r.name) for r in (*base, *rules)]))
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | fails(r)
    return flat.select(*keep, "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_stop",
                       names.alias("failed"), base_failed.alias("base_failed")).withColumn("kept", F.size("failed") == 0)
