"""Typed node and edge tables, the shared-term graph, and the neighbourhood of one bill."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.operators.rank import keep_first, top_k


# -- node and edge tables --------------------------------------------------
def sponsor_rows(bills: DataFrame, cosponsors: DataFrame) -> DataFrame:
    """Primary sponsors (fallback id) and cosponsors (registry id, once per bill), in source order."""
    none = F.lit(None).cast("string")
    primary = bills.where(F.coalesce("sponsor", F.lit("")) != "").select(
        "bill_urn", F.lit(0).alias("kind"), F.lit(0).alias("at"), ids.fallback_sponsor_id("sponsor", "congress").alias("sponsor_id"),
        none.alias("bioguide"), F.col("sponsor").alias("display"), none.alias("first_name"), none.alias("last_name"), none.alias("party"),
        none.alias("state"), none.alias("district"), F.lit("fallback").alias("id_source"), tx.iso_date("introduced_date").alias("since"), F.lit(None).cast("boolean").alias("original"))
    others = cosponsors.where(F.coalesce("bioguide", F.lit("")) != "").select(
        "bill_urn", F.lit(1).alias("kind"), "at", ids.person_id("bioguide").alias("sponsor_id"), "bioguide",
        F.coalesce(tx.blank_to_null("full_name"), tx.blank_to_null("last_name"), "bioguide").alias("display"), "first_name", "last_name", "party", "state",
        F.col("district").cast("string").alias("district"), F.lit("bioguide").alias("id_source"), tx.iso_date("sponsorship_date").alias("since"),
        F.coalesce("original", F.lit(False)).alias("original"))
    return primary.unionByName(keep_first(others, ["bill_urn", "sponsor_id"], [F.col("at")]))


def sponsor_dimension(rows: DataFrame) -> DataFrame:
    """One row per person; the first mention (bill order, sponsor before cosponsors) wins."""
    return keep_first(rows, ["sponsor_id"], [F.col("bill_urn"), F.col("kind"), F.col("at")]).drop("bill_urn", "kind", "at", "since", "original")


def version_nodes(bills: DataFrame) -> DataFrame:
    """Canonical version of each bill that names a date and a stage."""
    known = (F.coalesce("canonical_version_date", F.lit("")) != "") & (F.coalesce("canonical_version_code", F.lit("")) != "")
    return bills.where(known).select(
        ids.version_urn("bill_urn", "canonical_version_date", "canonical_version_code").alias("version_id"), "bill_urn",
        F.col("canonical_version_code").alias("stage"), tx.iso_date("canonical_version_date").alias("version_date"),
        F.col("xml_format").alias("source_format"), F.col("canonical_package_id").alias("package_id"))


def edge_tables(bills: DataFrame, sponsors: DataFrame, sections: DataFrame, cites: DataFrame, defines: DataFrame,
                by_ref: DataFrame, amends: DataFrame, extractor: str = "lexweave/bibliography@v1") -> dict[str, DataFrame]:
    """All filled edge tables; edges whose endpoints are unknown were dropped before."""
    versions = version_nodes(bills)
    vid = versions.select("bill_urn", "version_id")
    prov = ids.provenance_id(F.lit(extractor))
    return {
        "of_jurisdiction": bills.select("bill_urn", F.lit("us").alias("jurisdiction")),
        "has_version": versions.select("bill_urn", "version_id"),
        "has_section": sections.where("parent_urn is null").join(vid, "bill_urn").select("version_id", "section_urn", "ordinal"),
        "parent_of": sections.where("parent_urn is not null").select("parent_urn", "section_urn", "ordinal"),
        "sponsored_by": sponsors.where("kind = 0").select("bill_urn", "sponsor_id", "since"),
        "cosponsored_by": sponsors.where("kind = 1").select("bill_urn", "sponsor_id", "since", "original"),
        "cites_external": cites.select("section_urn", "statute_id", "raw_text", "xml_ref_id", "bill_urn", F.lit("mechanical").alias("derivation"),
                                       F.lit(1.0).alias("confidence"), prov.alias("provenance_id")),
        "defines": defines,
        "by_reference": by_ref,
        "amends": amends.select("section_urn", "amendment_id", "xml_ref_id", "bill_urn"),
        "targets": amends.where("statute_id is not null").select("amendment_id", "statute_id", F.lit("").alias("enum_path")),
        "produced": cites.select(prov.alias("provenance_id"), "section_urn").distinct(),
    }


# -- shared-term graph -----------------------------------------------------
def band_terms(uses: DataFrame, lo: int = fixed.TERM_DF_MIN, hi: int = fixed.TERM_DF_MAX) -> DataFrame:
    """Terms used by ``lo..hi`` bills with those bills in order: ``term, bills``.

    ``uses``: ``term, bill``. At most ``hi + 1`` bills per term leave a map task, which is enough to
    tell that a term is too common, so boilerplate held by a third of the corpus costs nothing.
    """
    few = top_k(uses.where(F.coalesce("term", F.lit("")) != "").distinct(), ["term"], [F.col("bill")], hi + 1)
    return few.groupBy("term").agg(F.sort_array(F.collect_list("bill")).alias("bills")).where(F.size("bills").between(lo, hi))


def term_pairs(band: DataFrame) -> DataFrame:
    """``a, b, term`` with a < b; the band bounds a term's pairs (66 for twelve bills)."""
    each = F.transform("bills", lambda a, i: F.transform(
        F.slice("bills", i + 2, F.greatest(F.size("bills") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return band.select("term", F.inline(F.flatten(each))).select("a", "b", "term")


def shared_term_edges(pairs: DataFrame, min_weight: int = 1, sample: int = 5) -> DataFrame:
    """``a, b, weight, terms``: how many terms two bills share and the first few of them."""
    w = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
    some = top_k(pairs, ["a", "b"], [F.col("term")], sample).groupBy("a", "b").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return w.join(some, ["a", "b"])


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("bill"), "weight")
    return ends.groupBy("bill").agg(F.sum("weight").alias("degree"))


def landing_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = fixed.MAX_NODES,
                  min_weight: int = fixed.MIN_EDGE_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Best-ranked connected nodes and the heavy edges among them.

    Rank is degree plus half the centrality over all raw edges. ``nodes``: ``bill, centrality``.
    """
    rank = F.coalesce("degree", F.lit(0)) + 0.5 * F.coalesce("centrality", F.lit(0.0))
    ranked = nodes.join(weighted_degree(edges), "bill", "left").withColumn("rank", rank)
    kept = ranked.orderBy(F.desc("rank"), "bill").limit(max_nodes).where("degree > 0")
    inside = edges.where(F.col("weight") >= min_weight)
    for end in ("a", "b"):
        inside = inside.join(kept.select(F.col("bill").alias(end)), end, "left_semi")
    seen = inside.select(F.explode(F.array("a", "b")).alias("bill")).distinct()
    return kept.join(seen, "bill", "left_semi"), inside


def shared_between(pairs: DataFrame, band: DataFrame, wanted: DataFrame, k: int = 2) -> DataFrame:
    """For pairs ``a, b`` (a < b): their ``k`` most widely used shared terms."""
    size = band.select("term", F.size("bills").alias("n_bills"))
    hit = pairs.join(wanted, ["a", "b"], "left_semi").join(size, "term")
    return top_k(hit, ["a", "b"], [F.desc("n_bills"), F.asc("term")], k)


def bill_ref(bill_type, number) -> Column:
    t = F.replace(F.replace(F.upper(tx.col(bill_type)), F.lit("HR"), F.lit("H.R.")), F.lit("S"), F.lit("S."))
    return F.concat(t, F.lit(" "), tx.col(number).cast("string"))


def ego_graph(center: str, related: list[str], words: list[str], headings: list[str], statute: str, bills: DataFrame,
              terms: DataFrame, sections: DataFrame, statutes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, kind, label, ref`` and edges ``src, dst, label`` around one bill.

    Pieces that do not exist come back as nodes of kind ``missing``; edges need both ends.
    """
    spark = bills.sparkSession
    asked = [("center", "bill", center)] + [(f"rel_{i}", "bill", b) for i, b in enumerate(related)]
    asked += [(f"def_{i}", "def", w.lower()) for i, w in enumerate(words)] + [(f"sec_{i}", "sec", h) for i, h in enumerate(headings)]
    asked += [("cite_0", "cite", statute)]
    want = spark.createDataFrame(asked, "id string, kind string, key string")
    found = (
        bills.where(F.col("bill_urn").isin([center, *related])).select(F.lit("bill").alias("kind"), F.col("bill_urn").alias("key"), bill_ref("bill_type", "bill_number").alias("label"), F.lit(None).cast("string").alias("ref"))
        .unionByName(terms.where(F.col("bill_urn") == center).select(
            F.lit("def").alias("kind"), F.lower(F.trim("surface_form")).alias("key"), F.concat(F.lit('"'), "surface_form", F.lit('"')).alias("label"), F.col("statute_id").alias("ref"))
            .where(F.col("key").isin([w.lower() for w in words])))
        .unionByName(sections.where((F.col("bill_urn") == center) & F.col("heading").isin(headings) & F.col("parent_section_id").isNull()).select(
            F.lit("sec").alias("kind"), F.col("heading").alias("key"), F.concat(F.lit("Sec. "), "enum").alias("label"), F.lit(None).cast("string").alias("ref")))
        .unionByName(statutes.where(F.col("statute_id") == statute).select(
            F.lit("cite").alias("kind"), F.col("statute_id").alias("key"), F.replace("canonical_citation", F.lit("U.S.C."), F.lit("U.S.C. §")).alias("label"), F.lit(None).cast("string").alias("ref")))
    )
    found = keep_first(found, ["kind", "key"], [F.col("label"), F.col("ref")])
    nodes = want.join(found, ["kind", "key"], "left").select(
        "id", F.when(F.col("label").isNull(), "missing").otherwise(F.col("kind")).alias("kind"), F.coalesce("label", "key").alias("label"), "ref")
    links = [(f"rel_{i}", "center", None) for i in range(len(related))]
    links += [("center", f"def_{i}", "defines") for i in range(len(words))] + [("center", f"sec_{i}", "section") for i in range(len(headings))]
    edges = spark.createDataFrame(links + [("center", "cite_0", "cites")], "src string, dst string, label string")
    refers = nodes.where((F.col("kind") == "def") & (F.col("ref") == statute)).select(F.col("id").alias("src"), F.lit("cite_0").alias("dst"), F.lit("refers to").alias("label"))
    live = nodes.where("kind != 'missing'").select("id")
    edges = edges.unionByName(refers).join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst", "label")


def citation_groups(sections: DataFrame, cites: DataFrame, roll_up: bool = False) -> DataFrame:
    """Citation items under their top-level section: ``bill_urn, root, grp, statute_id, ref``.

    By default only edges attached to the top-level section itself count; ``roll_up`` adds those of
    its descendants.
    """
    root = sections.where("parent_section_id is null").select(
        F.col("section_urn").alias("root"), "bill_urn",
        F.concat(F.coalesce(tx.blank_to_null(tx.section_marker("canonical_citation", "SEC. ")), tx.blank_to_null("heading"), F.lit("Section")),
                 F.lit(" — "), F.coalesce("heading", F.lit(""))).alias("grp"))
    at = cites.select(F.col("section_urn").alias("root"), "statute_id")
    if roll_up:
        top = sections.select("section_urn", F.concat("bill_urn", F.lit("::"), F.regexp_replace(F.col("ancestor_path")[0], "^.*?::", "")).alias("root"))
        at = cites.select("section_urn", "statute_id").join(top, "section_urn").select("root", "statute_id")
    return at.join(root, "root").select("bill_urn", "root", "grp", "statute_id", tx.statute_label("statute_id").alias("ref"))
