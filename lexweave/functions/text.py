"""Text and label expressions. Every function maps columns to a column."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave import fixed


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key, mapping: dict, default=None) -> Column:
    """A literal dictionary as an expression (no join, nothing to broadcast)."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(table, col(key))
    return hit if default is None else F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def first_rule(text, rules, default) -> Column:
    """Label of the first regular expression that matches, in order."""
    text = col(text)
    chain = F
    for pattern, label in rules:
        chain = chain.when(text.rlike(pattern), F.lit(label))
    return chain.otherwise(F.lit(default))


def grab(text, pattern: str, group: int = 1) -> Column:
    """A regex group, or null when the pattern does not match."""
    text = col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def blank_to_null(text) -> Column:
    return F.nullif(col(text), F.lit(""))


# -- whitespace ------------------------------------------------------------
def strip(text) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def clean_block(text) -> Column:
    """Collapse blanks, keep line breaks (at most one empty line)."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[ \t]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def clean_inline(text) -> Column:
    """Collapse every whitespace run to one blank."""
    return strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def strip_tags(text) -> Column:
    return F.regexp_replace(col(text), r"<[^>]+>", "")


def slug(text, sep: str) -> Column:
    s = F.regexp_replace(F.lower(col(text)), r"[^a-zA-Z0-9]+", sep)
    s = F.regexp_replace(s, f"^{sep}+|{sep}+$", "")
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


# -- enumerators and citations --------------------------------------------
def norm_enum(raw) -> Column:
    """``SEC. 2.`` -> ``2``; ``(a)`` -> ``a``."""
    e = F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"(?i)^\s*(SECTION|SEC\.?|§)\s*", "")
    e = F.regexp_replace(strip(e), r"\.+$", "")
    e = strip(e)
    return F.when(e.rlike(r"(?s)^\(.*\)$"), strip(F.substring(e, 2, F.length(e) - 2))).otherwise(e)


def ordinal_suffix(n) -> Column:
    n = col(n)
    last = n % 10
    return (
        F.when((n % 100).between(10, 20), "th")
        .when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd")
        .otherwise("th")
    )


def bill_citation(congress, bill_type, number) -> Column:
    """``H.R. 1736, 119th Cong.``"""
    c, t, n = col(congress), col(bill_type), col(number)
    label = lookup(t, fixed.BILL_TYPE_LABELS, F.upper(t))
    return F.concat(label, F.lit(" "), n.cast("string"), F.lit(", "),
                    c.cast("string"), ordinal_suffix(c), F.lit(" Cong."))


def section_citation(enums, bill_cite) -> Column:
    """First enumerator plain, the rest in parentheses."""
    enums, bill_cite = col(enums), col(bill_cite)
    rest = F.transform(F.slice(enums, 2, F.greatest(F.size(enums) - 1, F.lit(0))),
                       lambda e: F.concat(F.lit("("), e, F.lit(")")))
    return F.when(F.size(enums) == 0, bill_cite).otherwise(
        F.concat(F.lit("Sec. "), F.try_element_at(enums, F.lit(1)), F.array_join(rest, ""),
                 F.lit(" of "), bill_cite))


def last_marker(citation) -> Column:
    """A subsection's own marker: last parenthesis group, else ``§ n``."""
    c = F.coalesce(col(citation), F.lit(""))
    groups = F.regexp_extract_all(c, F.lit(r"\([0-9A-Za-z]+\)"), F.lit(0))
    number = F.regexp_extract(c, r"Sec\.\s*([0-9A-Za-z]+)", 1)
    return (F.when(F.size(groups) > 0, F.try_element_at(groups, F.lit(-1)))
            .when(number != "", F.concat(F.lit("§ "), number)).otherwise(""))


def section_marker(citation, prefix: str = "Sec. ", suffix: str = "") -> Column:
    m = F.regexp_extract(F.coalesce(col(citation), F.lit("")), r"Sec\.\s*([0-9A-Za-z()]+)", 1)
    return F.when(m != "", F.concat(F.lit(prefix), m, F.lit(suffix))).otherwise("")


def short_locator(citation) -> Column:
    """The part of a citation before `` of ``, or the section sign."""
    head = F.trim(F.substring_index(F.coalesce(col(citation), F.lit("")), " of ", 1))
    return F.coalesce(blank_to_null(head), F.lit("§"))


def statute_label(statute_id) -> Column:
    s = col(statute_id)
    p = r"usc/(\w+)/([\w.\-()]+)"
    return (F.when(s.isNull() | (s == ""), "")
            .when(s.rlike(p), F.concat(F.regexp_extract(s, p, 1), F.lit(" U.S.C. "), F.regexp_extract(s, p, 2)))
            .otherwise(F.regexp_replace(s, "^statute:", "")))


# -- labels ----------------------------------------------------------------
def person_label(name, party, state) -> Column:
    name, party, state = col(name), col(party), col(state)
    full = (party.isNotNull() & (party != "") & state.isNotNull() & (state != ""))
    return F.when(full, F.concat(name, F.lit(" ("), party, F.lit("-"), state, F.lit(")"))).otherwise(name)


def chamber(bill_type) -> Column:
    t = F.lower(F.coalesce(col(bill_type), F.lit("")))
    return F.when(t.isin(fixed.HOUSE_TYPES), "house").when(t.isin(fixed.SENATE_TYPES), "senate").otherwise("other")


def short_label(title, bill_urn) -> Column:
    """First clause of a title (at most 80 characters); the bill number if untitled."""
    raw, urn = col(title), col(bill_urn)
    text = strip(raw)
    cut = F.try_element_at(F.split(text, r"[.,;] ", 2), F.lit(1))
    p = r"^bill:us/(\d+)/(\w+)/(\d+)"
    btype = F.regexp_extract(urn, p, 2)
    untitled = F.when(urn.rlike(p), F.concat(
        lookup(btype, fixed.UNTITLED_TYPE_LABELS, F.upper(btype)), F.lit(" "), F.regexp_extract(urn, p, 3))
    ).otherwise(urn)
    clipped = F.concat(F.regexp_replace(F.substring(cut, 1, 77), r"(?U)\s+$", ""), F.lit("…"))
    return (F.when(raw.isNull() | (raw == ""), untitled)
            .when(F.length(text) <= 60, text).when(F.length(cut) <= 80, cut).otherwise(clipped))


def action_date(s) -> Column:
    """Head of ``date: text``, null when blank or missing."""
    return blank_to_null(strip(F.substring_index(col(s), ":", 1)))


def action_text(s) -> Column:
    s = col(s)
    return F.when(s.contains(":"), blank_to_null(strip(F.regexp_replace(s, r"(?s)^[^:]*:", ""))))


def action_parts(s) -> Column:
    """Graph form of the split: without a colon the whole string is the text."""
    s = F.coalesce(col(s), F.lit(""))
    has = s.contains(":")
    body = strip(F.when(has, F.regexp_replace(s, r"(?s)^[^:]*:", "")).otherwise(s))
    return F.struct(
        iso_date(strip(F.when(has, F.substring_index(s, ":", 1)).otherwise(""))).alias("action_date"),
        blank_to_null(body).alias("action_text"),
        blank_to_null(body).alias("status"),
    )


def iso_date(s) -> Column:
    """Date from an ISO prefix; anything else is null."""
    head = F.substring(col(s), 1, 10)
    return F.try_to_date(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head), "yyyy-MM-dd")


def diff_rows(before, after, prose) -> Column:
    """Struck text, inserted text; the prose only when neither exists."""
    before, after, prose = col(before), col(after), col(prose)

    def side(kind, text):
        return F.when(text.isNotNull() & (text != ""), F.struct(F.lit(kind).alias("kind"), text.alias("text")))

    rows = F.array_compact(F.array(side("del", before), side("add", after)))
    return F.when(F.size(rows) > 0, rows).otherwise(F.array_compact(F.array(side("add", prose))))


def anchor_text(before, after) -> Column:
    """Text an amendment anchors to: inserted text unless blank, else struck text."""
    after = col(after)
    return F.when(F.length(strip(F.coalesce(after, F.lit("")))) > 0, after).otherwise(
        F.coalesce(col(before), F.lit("")))


def provenance(sources, notes=None) -> Column:
    return F.struct(
        F.array(*sources).alias("sources"),
        (F.lit(None).cast("string") if notes is None else notes).alias("notes"),
    )


def any_phrase(text, phrases) -> Column:
    """True when the text holds one of the phrases (case-insensitive)."""
    low = F.lower(col(text))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])
