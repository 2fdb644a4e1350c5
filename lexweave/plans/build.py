"""The batch build: landed corpus -> knowledge tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import dense, extracts, graph, lookups, nodes, postings, search, sections
from lexweave.sources import corpus
from lexweave.sources.tables import spread, stage


def build(spark: SparkSession, base: str, out: str, now: str, encode: bool = True) -> dict[str, DataFrame]:
    """Rebuild every table under ``out`` (overwritten) and return them as read back.

    Documents are parsed once into staged element rows; every table is written once and later
    steps read the written table, so nothing is recomputed and lost executors cost one stage.
    """
    tables: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{out}/{name}")
        tables[name] = spark.read.parquet(f"{out}/{name}")
        return tables[name]

    scanned = spread(corpus.scan(spark, base))
    elements = stage(nodes.elements(scanned), "elements")
    bad = put("quarantine", nodes.quarantine(elements))
    good = scanned.join(bad.select("bill_id"), "bill_id", "left_anti")
    bills = put("bills", corpus.bill_table(good))
    children = {k: put(k, v) for k, v in corpus.child_tables(good.drop("xml")).items()}
    put("source_freshness", corpus.freshness(corpus.read_provenance(spark, base), bills))
    put("corpus_meta", corpus.corpus_meta(spark, now))

    sec = put("sections", sections.section_table(elements, bills))
    cites = put("citations", extracts.attach(extracts.citations(elements), sec))
    term_rows = stage(extracts.attach(extracts.defined_terms(elements), sec), "terms")
    term_nodes, defines, by_ref = extracts.term_tables(term_rows)
    terms = put("defined_terms", term_nodes)
    amends = extracts.attach(extracts.amendments(elements), sec)
    amends = put("amendments", amends.withColumn("amendment_id", F.concat("section_urn", F.lit("::amend/"), F.col("n").cast("string"))).withColumn(
        "target_text_unverified", F.lit(True)))
    put("statute_sections", extracts.statute_dimension(cites, term_rows, amends))
    sponsors = stage(graph.sponsor_rows(bills, children["people"]), "sponsors")
    put("sponsors", graph.sponsor_dimension(sponsors))
    put("versions", graph.version_nodes(bills))
    edges = graph.edge_tables(bills, sponsors, sec, cites, defines, by_ref, amends)
    for name, df in edges.items():
        put(f"edge_{name}", df)

    topics = bills.select("bill_id", "topic")
    topical = sec.join(topics, "bill_id")
    for name, texts in (("bill_index", search.text_index(bills, "bill_id", F.col("topic"), ["title", "short_title", "summary_text", "policy_area", "sponsor"])),
                        ("section_index", search.text_index(topical, "section_id", F.col("topic"), ["heading", "text_full"], "bill_id"))):
        tables[name] = postings.write(texts, f"{out}/{name}", stems=True).docs
    if encode:
        put("section_vectors", dense.encode_sections(topical, None, "hashed-v1"), "topic")
    put("build_stats", lookups.table_counts({k: tables[k] for k in ("bills", "sections", "citations", "defined_terms", "amendments", "quarantine")}))
    return tables


def format_mix(bills: DataFrame) -> DataFrame:
    return bills.groupBy("xml_format", "tier").agg(F.count(F.lit(1)).alias("n_bills"))
