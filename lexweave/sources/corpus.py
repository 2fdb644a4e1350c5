"""The landed corpus: one folder per bill with metadata, document and provenance files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import fixed, schemas
from lexweave.functions import ids, text as tx
from lexweave.operators.rank import keep_first



def _folder(path: str) -> Column:
    """Folder of a file, without the scheme (readers spell local paths differently)."""
    return F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "^file:/+", "/").alias("dir")


def _json(spark: SparkSession, base: str, name: str, ddl: str) -> DataFrame:
    return (
        spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", name).json(base).select(_folder("_metadata.file_path"), "*")
    )


def scan(spark: SparkSession, base: str) -> DataFrame:
    """Metadata joined with the document: bills lacking either are skipped.

    ``base`` is one topic folder or the root above several. A bill id found twice keeps the folder
    that sorts first.
    """
    meta = _json(spark, base, "metadata.json", schemas.METADATA_DDL).where("bill_id is not null")
    xml = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "bill.xml").load(base)
        .select(_folder("path"), F.col("content").alias("xml"))
    )
    return keep_first(meta, ["bill_id"], [F.col("dir")]).join(xml, "dir")


def read_provenance(spark: SparkSession, base: str) -> DataFrame:
    return _json(spark, base, "provenance.json", schemas.PROVENANCE_DDL)


def xml_format(xml) -> Column:
    """``uslm`` when the namespace stands in the first 500 characters."""
    head = F.decode(F.substring(tx.col(xml), 1, 2000), "ISO-8859-1")
    return F.when(F.contains(F.substring(head, 1, 500), F.lit(fixed.USLM_MARKER)), "uslm").otherwise("pre-uslm")


def bill_table(scanned: DataFrame) -> DataFrame:
    """``bills`` rows with defaults for what the record lacks."""
    v = F.col("canonical_version")
    part = tx.action_parts("latest_action")
    return scanned.select(
        "bill_id", ids.bill_urn("congress", "bill_type", "bill_number").alias("bill_urn"), "congress", "bill_type", "bill_number",
        "title", "short_title", "sponsor", "introduced_date", tx.action_date("latest_action").alias("latest_action_date"),
        tx.action_text("latest_action").alias("latest_action_text"), part["status"].alias("status"), "policy_area", "summary_text", "tier",
        F.coalesce("stream", F.lit(fixed.DEFAULT_STREAM)).alias("stream"), F.coalesce("topic", F.lit(fixed.DEFAULT_TOPIC)).alias("topic"),
        "centrality_score", v["package_id"].alias("canonical_package_id"), v["version_code"].alias("canonical_version_code"),
        v["date_issued"].alias("canonical_version_date"), xml_format("xml").alias("xml_format"), F.col("dir").alias("source_order"))


def child_tables(meta: DataFrame) -> dict[str, DataFrame]:
    """Versions, cosponsors, actions and subjects; repeated keys keep the first."""
    at = lambda c: meta.select("bill_id", "congress", "bill_type", "bill_number", F.posexplode(c).alias("at", "x"))
    first = lambda df, key: keep_first(df, key, [F.col("bill_id"), F.col("at")])
    name = F.coalesce(tx.blank_to_null("x.fullName"), tx.blank_to_null("x.lastName"))
    people = at("cosponsors").select(
        "bill_id", ids.bill_urn("congress", "bill_type", "bill_number").alias("bill_urn"), "at", name.alias("name"),
        F.col("x.bioguideId").alias("bioguide"), F.col("x.fullName").alias("full_name"), F.col("x.firstName").alias("first_name"),
        F.col("x.lastName").alias("last_name"), "x.party", "x.state", "x.district", F.col("x.sponsorshipDate").alias("sponsorship_date"),
        F.col("x.isOriginalCosponsor").alias("original"))
    return {
        "bill_versions": first(at("versions_available").select("bill_id", "at", "x.*"), ["package_id"]).drop("at"),
        "cosponsors": first(people.where("name is not null"), ["bill_id", "name"]).drop("at", "bill_urn"),
        "people": people,
        "actions": at("actions").select("bill_id", F.col("at").alias("ordinal"), F.col("x.actionDate").alias("action_date"), F.col("x.text").alias("action_text")),
        "subjects": at("subjects").select("bill_id", F.col("x").alias("subject")).where("coalesce(subject, '') != ''").distinct(),
    }


def freshness(provenance: DataFrame, bills: DataFrame) -> DataFrame:
    """Newest fetch time, written for both upstream sources."""
    held = provenance.join(bills.select("bill_id"), "bill_id", "left_semi").where("coalesce(fetched_at, '') != ''")
    return held.agg(F.max("fetched_at").alias("last_fetched")).where("last_fetched is not null").select(
        F.explode(F.array(*[F.lit(s) for s in fixed.FRESHNESS_SOURCES])).alias("source"), "last_fetched")


def corpus_meta(spark: SparkSession, now: str) -> DataFrame:
    return spark.createDataFrame([*fixed.CORPUS_META.items(), ("last_updated", now)], "key string, value string")


# -- landed side inputs ----------------------------------------------------
def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HIT_DDL).json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CANDIDATE_DDL).json(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """One JSON object per line, best score first."""
    df.orderBy(F.desc("centrality_score"), "bill_id").write.mode("overwrite").json(path)


def write_review_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """The question set (a small YAML list) as a table with array columns."""
    import yaml

    rows = []
    with open(path, encoding="utf8") as f:
        for q in yaml.safe_load(f).get("queries", []):
            c = q.get("pass_criteria") or {}
            rows.append((q["id"], q.get("category"), q.get("question"), *[c.get(k) for k in (
                "answer_must_contain", "answer_must_not_contain", "answer_must_cite", "bill_id_min", "bill_id_set_full")], bool(c.get("abstain"))))
    return spark.createDataFrame(rows, schemas.CRITERIA_DDL)


def pick_questions(criteria: DataFrame, ids_: list[str] | None = None, category: str | None = None) -> DataFrame:
    out = criteria.where(F.col("query_id").isin(ids_)) if ids_ else criteria
    return out.where(F.col("category") == category) if category else out


def append_traces(traces: DataFrame, path: str) -> None:
    """Turn traces, appended under one folder per day."""
    traces.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRACE_DDL + ", day string").json(path)
