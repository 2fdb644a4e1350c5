"""Identifier expressions: bills, sections, statutes, packages, people."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions.text import blank_to_null, col, grab, slug, strip


def bill_type(text) -> Column:
    """``H. J. Res.`` -> ``hjres``; unknown types are null."""
    t = F.lower(F.regexp_replace(col(text), r"[^a-zA-Z]+", ""))
    return F.when(t.isin(fixed.IN_SCOPE_TYPES), t)


def legacy_bill_id(congress, btype, number) -> Column:
    return F.concat_ws("-", col(congress).cast("string"), col(btype), col(number).cast("string"))


def bill_urn(congress, btype, number) -> Column:
    return F.concat(F.lit("bill:us/"), F.concat_ws(
        "/", col(congress).cast("string"), col(btype), col(number).cast("string")))


def to_bill_urn(bill_id) -> Column:
    """Legacy ids become URNs; everything else passes through."""
    b = col(bill_id)
    return F.when(b.rlike(fixed.LEGACY_BILL), F.regexp_replace(b, fixed.LEGACY_BILL, "bill:us/$1/$2/$3")).otherwise(b)


def to_legacy_bill(urn) -> Column:
    u = col(urn)
    return F.when(u.rlike(fixed.URN_BILL), F.regexp_replace(u, fixed.URN_BILL, "$1-$2-$3")).otherwise(u)


def to_section_urn(section_id) -> Column:
    s = col(section_id)
    head, tail = F.substring_index(s, "::", 1), F.regexp_replace(s, r"^.*?::", "")
    return F.when(~s.startswith("bill:") & s.contains("::") & head.rlike(fixed.LEGACY_BILL),
                  F.concat(to_bill_urn(head), F.lit("::"), tail)).otherwise(s)


def to_legacy_section(section_urn) -> Column:
    s = col(section_urn)
    return F.when(s.rlike(r"^bill:us/[^/:]+/[^/:]+/[^/:]+(::|$)"),
                  F.regexp_replace(s, r"^bill:us/([^/:]+)/([^/:]+)/([^/:]+)", "$1-$2-$3")).otherwise(s)


def normalise_bill(raw) -> Column:
    """Any accepted spelling of a bill -> (bill_id, bill_type, bill_number, congress, status).

    ``status`` is ``ok``, ``needs_congress`` (settle with :func:`disambiguate`) or ``unrecognised``.
    """
    s = strip(col(raw))
    urn = s.rlike(fixed.URN_BILL)
    known = F.when(s.rlike(fixed.LEGACY_BILL), s).when(urn, to_legacy_bill(s))
    prose_type = bill_type(grab(s, fixed.PROSE_BILL, 1))
    prose_num = grab(s, fixed.PROSE_BILL, 2).cast("long")
    prose_cong = blank_to_null(grab(s, fixed.PROSE_BILL, 3))
    bill_id = F.coalesce(known, F.when(prose_cong.isNotNull(), legacy_bill_id(prose_cong, prose_type, grab(s, fixed.PROSE_BILL, 2))))
    return F.struct(
        bill_id.alias("bill_id"),
        F.coalesce(F.split_part(known, F.lit("-"), F.lit(2)), prose_type).alias("bill_type"),
        F.coalesce(F.split_part(known, F.lit("-"), F.lit(3)).try_cast("long"), prose_num).alias("bill_number"),
        F.coalesce(F.split_part(known, F.lit("-"), F.lit(1)), prose_cong).try_cast("long").alias("congress"),
        F.when(bill_id.isNotNull(), "ok").when(prose_type.isNotNull(), "needs_congress")
        .otherwise("unrecognised").alias("status"),
    )


def disambiguate(requests: DataFrame, bills: DataFrame) -> DataFrame:
    """Settle requests without a congress against the corpus.

    ``requests`` holds ``request_id, bill_id, bill_type, bill_number, status``; one row comes
    back per request with ``options`` sorted (one entry per congress, so the list stays short).
    """
    hits = (
        requests.where(F.col("status") == "needs_congress")
        .select("request_id", "bill_type", "bill_number")
        .join(bills.select("bill_type", "bill_number", "congress"), ["bill_type", "bill_number"])
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_set(legacy_bill_id("congress", "bill_type", "bill_number"))).alias("options"))
    )
    n = F.coalesce(F.size("options"), F.lit(0))
    return (
        requests.join(hits, "request_id", "left")
        .select(
            "request_id",
            F.when(F.col("status") == "needs_congress", F.when(n == 1, F.col("options")[0]))
            .otherwise(F.col("bill_id")).alias("bill_id"),
            F.when(F.col("status") != "needs_congress", F.col("status"))
            .when(n == 1, "ok").when(n == 0, "not_found").otherwise("ambiguous").alias("status"),
            F.when(n > 1, F.col("options")).alias("options"),
        )
    )


# -- statutes --------------------------------------------------------------
def statute_id(title, section) -> Column:
    return F.concat(F.lit("statute:us/usc/"), col(title), F.lit("/"), col(section))


def normalise_statute(raw) -> Column:
    """URN, ``15/9401`` or ``15 U.S.C. § 9401`` -> URN; other input passes through."""
    s = strip(col(raw))
    return (
        F.when(s.startswith("statute:"), s)
        .when(s.rlike(r"^\d+/"), F.concat(F.lit("statute:us/usc/"), s))
        .when(s.rlike(fixed.STATUTE_PROSE),
              F.concat(F.lit("statute:us/usc/"), F.regexp_extract(s, fixed.STATUTE_PROSE, 1),
                       F.lit("/"), F.regexp_extract(s, fixed.STATUTE_PROSE, 2)))
        .otherwise(s)
    )


def statute_parent(sid) -> Column:
    """Drop the last path step: the statute a section belongs to."""
    return F.regexp_replace(col(sid), r"/[^/]*$", "")


def parse_cite(cite, legal_doc) -> Column:
    """``usc/15/9401`` -> struct(code, title, section, statute_id, label); null if unparsable."""
    cite, doc = col(cite), col(legal_doc)
    title = grab(cite, fixed.USC_CITE, 1)
    section = F.regexp_replace(grab(cite, fixed.USC_CITE, 2), "^/+|/+$", "")
    kind = F.when(doc == "usc-chapter", " U.S.C. ch. ").when(doc == "usc-appendix", " U.S.C. App. ").otherwise(" U.S.C. ")
    return F.when(
        section.isNotNull() & (section != "") & (title != ""),
        F.struct(
            F.lit("usc").alias("code"), title.alias("title"), section.alias("section"),
            statute_id(title, section).alias("statute_id"),
            F.concat(title, kind, section).alias("label"),
        ),
    )


# -- packages and people ---------------------------------------------------
def parse_package(package_id) -> Column:
    p = col(package_id)
    return F.when(
        p.rlike(fixed.PACKAGE_ID),
        F.struct(
            F.regexp_extract(p, fixed.PACKAGE_ID, 1).cast("long").alias("congress"),
            F.regexp_extract(p, fixed.PACKAGE_ID, 2).alias("bill_type"),
            F.regexp_extract(p, fixed.PACKAGE_ID, 3).cast("long").alias("bill_number"),
            F.regexp_extract(p, fixed.PACKAGE_ID, 4).alias("version_code"),
        ),
    )


def fallback_sponsor_id(name, congress) -> Column:
    digest = F.sha1(F.concat(col(name), F.lit("|"), col(congress).cast("string")))
    return F.concat(F.lit("_legacy:"), F.substring(slug(name, "-"), 1, 40), F.lit(":"), F.substring(digest, 1, 10))


def person_id(bioguide) -> Column:
    return F.concat(F.lit("person:bioguide/"), col(bioguide))


def provenance_id(label) -> Column:
    return F.concat(F.lit("prov:"), F.substring(F.sha1(col(label)), 1, 12))


def version_urn(bill, date_issued, stage) -> Column:
    return F.concat(col(bill), F.lit("@"), col(date_issued), F.lit("/"), col(stage))
