"""Corpus curation: grouping hits to bills, scoring, reviewing, promoting, consolidating."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.operators.rank import keep_first


# -- versions --------------------------------------------------------------
def stage_rank(code) -> Column:
    return tx.lookup(code, fixed.STAGE_PRIORITY, 0)


def order_rank(code) -> Column:
    """Position in the alternative priority list; unlisted codes are null."""
    return tx.lookup(code, {c: i for i, c in enumerate(fixed.VERSION_ORDER)})


def version_order() -> list[Column]:
    return [F.desc(stage_rank("version_code")), F.asc("date_issued"), F.asc("package_id")]


def canonical_version(versions: DataFrame, key: str = "bill_id") -> DataFrame:
    """The version with the highest stage; equal stages go to the earlier date, then the id."""
    return keep_first(versions, [key], version_order())


def first_available(versions: DataFrame, key: str = "bill_id") -> DataFrame:
    """The first version of the priority list that exists."""
    return keep_first(versions.withColumn("__o", order_rank("version_code")).where("__o is not null"),
                      [key], [F.asc("__o"), F.asc("date_issued"), F.asc("package_id")]).drop("__o")


# -- search hits -> candidates --------------------------------------------
def parse_hits(hits: DataFrame) -> DataFrame:
    """Add the parsed package id and why a hit is skipped (``unparseable`` / ``out_of_scope``)."""
    p = hits.withColumn("p", ids.parse_package("packageId"))
    why = F.when(F.col("p").isNull(), "unparseable").when(~F.col("p.bill_type").isin(fixed.IN_SCOPE_TYPES), "out_of_scope")
    return p.select("packageId", F.coalesce("dateIssued", F.lit("")).alias("dateIssued"), F.coalesce("title", F.lit("")).alias("title"), "p.*", why.alias("skipped"))


def skip_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("skipped") == "out_of_scope").alias("out_of_scope"),
                      F.count_if(F.col("skipped") == "unparseable").alias("unparseable"))


def group_hits(parsed: DataFrame) -> DataFrame:
    """One row per bill with its versions, best first.

    A version is one package, so the list is bounded by the stages a bill passes; repeated hits
    of one package are reduced before they are collected.
    """
    key = ["congress", "bill_type", "bill_number"]
    one = parsed.where("skipped is null").groupBy(*key, "packageId", "version_code").agg(
        F.min("dateIssued").alias("date_issued"), F.min("title").alias("title"))
    item = F.struct((-stage_rank("version_code")).alias("k"), F.col("date_issued").alias("d"), F.col("packageId").alias("package_id"), "version_code", "title")
    grouped = one.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("v"))
    return grouped.select(
        ids.legacy_bill_id(*key).alias("bill_id"), *key,
        F.transform("v", lambda x: F.struct(x["package_id"].alias("package_id"), x["version_code"].alias("version_code"),
                                            x["d"].alias("date_issued"), x["title"].alias("title"))).alias("versions"),
        F.transform("v", lambda x: x["title"]).alias("govinfo_titles"))


# -- registry metadata -----------------------------------------------------
def latest_summary(summaries: DataFrame, key: list[str]) -> DataFrame:
    """Newest summary per bill, tags removed (ties go to the larger text)."""
    newest = F.struct(F.coalesce("update_date", F.lit("")), F.coalesce("text", F.lit("")))
    return summaries.groupBy(*key).agg(tx.strip_tags(F.max_by(F.coalesce("text", F.lit("")), newest)).alias("summary_text"))


def reconcile(candidates: DataFrame, registry: DataFrame, summaries: DataFrame) -> DataFrame:
    """Attach registry fields and the latest summary; a bill without registry data carries an error."""
    key = ["congress", "bill_type", "bill_number"]
    reg = registry.select(
        *key, F.col("title").alias("registry_title"), "policy_area", tx.person_label("sponsor_name", "sponsor_party", "sponsor_state").alias("sponsor"),
        "introduced_date", F.when(F.col("action_date").isNotNull() | F.col("action_text").isNotNull(), F.regexp_replace(
            F.concat(F.coalesce("action_date", F.lit("")), F.lit(": "), F.coalesce("action_text", F.lit(""))), "^[: ]+|[: ]+$", "")).alias("latest_action"),
        "subjects", F.lit(True).alias("found"))
    return (
        candidates.join(reg, key, "left").join(latest_summary(summaries, key), key, "left")
        .withColumn("reconciliation_error", F.when(F.col("found").isNull(), "not in registry")).drop("found")
    )


def merge_sources(primary: DataFrame, fallback: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Field by field: the primary source's value, else the fallback's."""
    a, b = primary.alias("a"), fallback.alias("b")
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in columns])


# -- relevance -------------------------------------------------------------
def location_hits(text) -> Column:
    """Distinct criteria terms found in one field: anchors, the upper-case token, extra terms."""
    raw = F.coalesce(tx.col(text), F.lit(""))
    low = F.lower(raw)
    say = lambda t: F.when(low.contains(t), t)
    return F.array_compact(F.array(*[say(t) for t in fixed.ANCHORS], F.when(raw.rlike(fixed.ANCHOR_TOKEN), "AI"),
                                   *[say(t) for t in fixed.EXTRA_TERMS]))


def anchors_only(hits: Column) -> Column:
    return F.filter(hits, lambda t: t.isin([*fixed.ANCHORS, "AI"]))


def score_relevance(df: DataFrame, fields: dict[str, Column], alt_titles: Column) -> DataFrame:
    """Add ``centrality_score, match_locations, has_anchor, proposed_tier``.

    ``fields`` maps the five weighted locations to text columns. The alternative titles (an array)
    count at half the title weight, and only when no location holds an anchor.
    """
    hit = {loc: location_hits(c) for loc, c in fields.items()}
    for loc, c in hit.items():
        df = df.withColumn(f"__{loc}", c)
    col = {loc: F.col(f"__{loc}") for loc in hit}
    anchored = F.size(F.flatten(F.array(*[anchors_only(c) for c in col.values()]))) > 0
    low = F.lower(F.array_join(alt_titles, " "))
    alt = F.concat(
        F.array_compact(F.array(*[F.when(low.contains(a), a) for a in fixed.ANCHORS])),
        F.transform(F.filter(alt_titles, lambda t: t.rlike(fixed.ANCHOR_TOKEN)), lambda t: F.lit("AI")))
    df = df.withColumn("__anchored", anchored).withColumn("__alt", F.when(F.col("__anchored"), F.array().cast("array<string>")).otherwise(alt))
    score = sum((F.size(col[loc]) * w for loc, w in fixed.LOCATION_WEIGHTS.items()), F.lit(0.0))
    score = score + F.size("__alt") * (fixed.LOCATION_WEIGHTS["title"] * 0.5)
    places = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(x) for x in [*hit, "govinfo_title"]]), F.array(*col.values(), F.col("__alt"))),
        lambda k, v: F.size(v) > 0)
    in_title = F.size(anchors_only(F.concat(col["title"], col["short_title"]))) > 0
    return (
        df.withColumn("centrality_score", F.round(score, 3)).withColumn("match_locations", places)
        .withColumn("has_anchor", F.col("__anchored") | (F.size("__alt") > 0))
        .withColumn("proposed_tier", F.when(in_title, "A").otherwise("B"))
        .drop("__anchored", "__alt", *[f"__{loc}" for loc in hit])
    )


def anchor_gate(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by the anchor criterion."""
    return scored.where("has_anchor"), scored.where(~F.col("has_anchor"))


# -- review and decision ---------------------------------------------------
def review_sheet(scored: DataFrame) -> DataFrame:
    """Twelve-column sheet for a human reviewer, best score first."""
    places = F.array_join(F.transform(F.map_entries("match_locations"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), ";")
    blank = F.lit("")
    alt = F.try_element_at("govinfo_titles", F.lit(1))
    text = lambda c: F.coalesce(F.col(c), blank)
    return scored.orderBy(F.desc("centrality_score"), "bill_id").select(
        "bill_id", "centrality_score", F.coalesce("proposed_tier", blank).alias("proposed_tier"),
        F.substring(F.when(alt.isNull(), "").otherwise(F.coalesce(tx.blank_to_null("title"), alt)), 1, 200).alias("title"),
        text("sponsor").alias("sponsor"), text("introduced_date").alias("introduced_date"), text("policy_area").alias("policy_area"),
        places.alias("match_locations"), F.substring(text("summary_text"), 1, 200).alias("summary_first_200"),
        blank.alias("include (y/n)"), blank.alias("tier (A/B)"), blank.alias("notes"))


def read_reviews(sheet: DataFrame) -> DataFrame:
    """Rows of a filled sheet with any human input: ``bill_id, include, tier, notes``."""
    cell = lambda c: tx.strip(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    rows = sheet.select("bill_id", F.lower(cell("include (y/n)")).alias("include"), F.upper(cell("tier (A/B)")).alias("tier"), cell("notes").alias("notes"))
    return rows.where("include != '' or tier != '' or notes != ''")


def decide(scored: DataFrame, reviews: DataFrame, threshold: float) -> DataFrame:
    """Add ``included, final_tier, decided_by``: a human y/n wins, else the score decides."""
    r = reviews.select("bill_id", F.col("include").alias("__inc"), F.col("tier").alias("__tier"))
    human = F.coalesce(F.col("__inc").isin("y", "n"), F.lit(False))
    inc = F.when(human, F.col("__inc") == "y").otherwise(F.col("centrality_score") >= threshold)
    tier = F.when(human & (F.col("__inc") == "y"), F.coalesce(tx.blank_to_null("__tier"), "proposed_tier")).when(~human & inc, F.col("proposed_tier"))
    return (
        scored.join(r, "bill_id", "left").withColumn("included", inc).withColumn("final_tier", tier)
        .withColumn("decided_by", F.when(human, "human-review").otherwise("heuristic")).drop("__inc", "__tier")
    )


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decided_by", "included").agg(F.count(F.lit(1)).alias("n"))


# -- promotion -------------------------------------------------------------
def to_promote(chosen: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Add ``status``: known ids are skipped unless forced, a bill without versions is an error."""
    known = existing.select("bill_id", F.lit(True).alias("__known"))
    status = F.when(F.col("__known") & F.lit(not force), "skipped-exists").when(F.size("versions") < 1, "error").otherwise("added")
    return chosen.join(known, "bill_id", "left").withColumn("status", status).drop("__known")


def consolidated(promoted: DataFrame, fetched_at: Column, criteria_version: str = fixed.CORPUS_META["criteria_version"]) -> tuple[DataFrame, DataFrame]:
    """(metadata records, provenance records) of the rows added, ready for ``write.json``."""
    rows = promoted.where("status = 'added'")
    first = F.col("versions")[0]
    package = first["package_id"]
    slim = F.transform("versions", lambda v: F.struct(v["package_id"], v["version_code"], v["date_issued"]))
    meta = rows.select(
        "bill_id", "congress", "bill_type", "bill_number", "title", "short_title", "sponsor", "introduced_date", "latest_action", "policy_area",
        "subjects", "summary_text", "centrality_score", "match_locations", F.coalesce("final_tier", "proposed_tier").alias("tier"),
        F.lit(fixed.DEFAULT_STREAM).alias("stream"), F.coalesce("topic", F.lit(fixed.DEFAULT_TOPIC)).alias("topic"), slim.alias("versions_available"),
        F.struct(package, first["version_code"], first["date_issued"]).alias("canonical_version"), "actions", "cosponsors")
    base = "https://api.govinfo.gov/packages/"
    prov = rows.select(
        "bill_id", F.lit(criteria_version).alias("criteria_version"), package.alias("canonical_package_id"),
        F.create_map(
            F.lit("govinfo_xml"), F.concat(F.lit(base), package, F.lit("/uslm")), F.lit("govinfo_htm"), F.concat(F.lit(base), package, F.lit("/htm")),
            F.lit("congress_gov_bill"), F.concat(F.lit("https://api.congress.gov/v3/bill/"), F.concat_ws("/", "congress", "bill_type", "bill_number"))).alias("sources"),
        F.create_map(F.lit("bill.xml"), F.col("has_xml"), F.lit("bill.htm"), F.col("has_htm"), F.lit("metadata.json"), F.lit(True)).alias("files"),
        fetched_at.alias("fetched_at"))
    return meta, prov


def index_summary(promoted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one-row count, sorted id rows) of the promoted bills; the ids stay a distributed table."""
    kept = promoted.where(F.col("status").isin("added", "skipped-exists"))
    return kept.agg(F.count(F.lit(1)).alias("bill_count")), kept.select("bill_id").orderBy("bill_id")


def backfill_topic(meta: DataFrame, topic: str = fixed.DEFAULT_TOPIC) -> DataFrame:
    """Stamp the topic; ``backfill`` tells ``updated``, ``already`` or ``missing`` (no record)."""
    status = F.when(~F.col("has_record"), "missing").when(F.col("topic") == topic, "already").otherwise("updated")
    return meta.withColumn("backfill", status).withColumn("topic", F.when(F.col("backfill") == "missing", F.col("topic")).otherwise(F.lit(topic)))
