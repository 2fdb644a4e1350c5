"""Read queries over the built tables: bills, sections, terms, amendments, citations, coverage.

Tables follow the build's column names. Every tree or prefix question is an equality on a stored
key (``bill_urn``, ``section_urn``, ``statute_id``), so each query is a plain equi-join; small
lookup sides are left to the planner's size-checked broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.operators.rank import keep_first, top_k
from lexweave.sources.tables import pieces


# Keys of at most this many rows are broadcast (about 6 MB of section ids).
FEW_ROWS = 100_000


class Near:
    """Cut tables down to what a few result rows refer to before joining them.

    The rows are counted up to ``FEW_ROWS`` once. If they fit, their keys are broadcast and a table
    is filtered where it lies, so a point question never shuffles it. If not, tables stay whole and
    are joined by shuffling. ``check=False`` (a request batch known to be large) skips the count.
    """

    def __init__(self, rows: DataFrame, check: bool = True):
        self.rows = rows
        self.few = check and rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS

    def __call__(self, table: DataFrame, key: str) -> DataFrame:
        if not self.few:
            return table
        return self.only(table, key)

    def join(self, rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
        """Rows with what the table says of them; many rows and the table are dealt by the key into pieces that do not grow with the table."""
        if self.few:
            return rows.join(self.only(table, key), key, how)
        k = pieces(table)
        return rows.repartition(k, key).join(table.repartition(k, key).hint("merge"), key, how)

    def only(self, table: DataFrame, key: str) -> DataFrame:
        """Exactly the table rows the few (or many) rows refer to."""
        keys = self.rows.select(key)
        return table.join(F.broadcast(keys) if self.few else keys.distinct(), key, "left_semi")


def _cites(sections: DataFrame) -> DataFrame:
    return sections.select("section_urn", F.col("canonical_citation").alias("section_citation"))


def _statutes(statutes: DataFrame) -> DataFrame:
    return statutes.select("statute_id", F.col("canonical_citation").alias("statute_citation"))


# -- bills and sections ----------------------------------------------------
def ordered_list(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Children of a parent as an ordered array (children of one bill or section only)."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, value.alias("v")))).alias("s")).select(
        key, F.transform("s", lambda x: x["v"]).alias(out))


def bill_cards(bills: DataFrame, cosponsors: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """One card per bill: cosponsor labels, top-level sections and versions, each in order."""
    people = ordered_list(cosponsors, "bill_id", ["sponsorship_date", "name"], tx.person_label("name", "party", "state"), "cosponsors")
    heading = F.coalesce("heading", F.concat(F.lit("Section "), "enum"), F.lit("(unnamed)"))
    toc = ordered_list(sections.where("parent_section_id is null"), "bill_id", ["ordinal", "section_id"], heading, "sections")
    stages = ordered_list(versions, "bill_id", ["date_issued", "package_id"], F.col("version_code"), "versions")
    empty = F.array().cast("array<string>")
    return (
        bills.join(people, "bill_id", "left").join(toc, "bill_id", "left").join(stages, "bill_id", "left")
        .select(
            "bill_id", "congress", "bill_type", "bill_number", F.coalesce("title", F.lit("")).alias("title"), "short_title",
            F.coalesce("sponsor", F.lit("")).alias("sponsor"),
            *[F.coalesce(c, empty).alias(c) for c in ("cosponsors", "sections", "versions")],
            tx.iso_date("introduced_date").alias("introduced_date"),
            F.regexp_replace(F.concat(F.coalesce("latest_action_date", F.lit("")), F.lit(": "),
                                      F.coalesce("latest_action_text", F.lit(""))), "^[: ]+|[: ]+$", "").alias("latest_action"),
            F.coalesce("latest_action_text", F.lit("")).alias("status"),
            F.coalesce("tier", F.lit("B")).alias("tier"), F.coalesce("stream", F.lit(fixed.DEFAULT_STREAM)).alias("stream"),
            bill_sources().alias("provenance"))
    )


def bill_sources() -> Column:
    package = F.coalesce("canonical_package_id", F.lit("unknown"))
    return tx.provenance([F.concat(F.lit("govinfo:"), package),
                          F.concat(F.lit("congress.gov:"), F.concat_ws("/", F.col("congress"), "bill_type", "bill_number"))])


def section_lookup(requests: DataFrame, sections: DataFrame, bills: DataFrame, cites: DataFrame,
                   internal: DataFrame | None = None, as_of: bool = False, few: bool = False) -> DataFrame:
    """Sections by id with children, citation counts and version; unknown ids come back flagged.

    ``requests``: ``section_id`` (and ``as_of`` date when the flag is set, which only adds a note).
    """
    near = Near(requests.select("section_id"), few)
    wanted = requests.join(near(sections, "section_id"), "section_id", "left").withColumn("not_found", F.col("section_urn").isNull())
    parents = Near(requests.select(F.col("section_id").alias("parent_section_id")), few)
    kids = ordered_list(
        parents.only(sections, "parent_section_id").withColumnRenamed("parent_section_id", "p"), "p", ["ordinal", "section_id"], F.col("section_id"), "child_section_ids"
    ).withColumnRenamed("p", "section_id")
    found = Near(wanted.where(~F.col("not_found")).select("bill_id", "section_urn", F.col("section_urn").alias("target_urn")), few)
    bill = found(bills.select("bill_id", "canonical_package_id", "canonical_version_code", "canonical_version_date"), "bill_id")
    counts = adjacency(found(cites, "section_urn"), None if internal is None else found(internal, "target_urn"))
    note = F.when(F.col("not_found"), "section_id not found in corpus")
    if as_of:
        note = note.when(F.col("as_of").isNotNull(), F.concat(
            F.lit("as_of="), F.col("as_of").cast("string"),
            F.lit(" requested, but v1 corpus stores one canonical version per bill. Returned version is "),
            F.col("canonical_version_code"), F.lit(" dated "), F.col("canonical_version_date"), F.lit(".")))
    return (
        wanted.join(kids, "section_id", "left").join(bill, "bill_id", "left")
        .join(counts, wanted["section_urn"] == counts["section"], "left")
        .select(
            "section_id", F.coalesce("bill_id", F.when(F.col("section_id").contains("::"), F.substring_index("section_id", "::", 1))
                                     .otherwise("")).alias("bill_id"),
            F.coalesce("heading", F.lit("")).alias("heading"),
            F.coalesce(tx.blank_to_null("text_full"), "text_self").alias("text"), "canonical_citation", "parent_section_id",
            F.coalesce("child_section_ids", F.array().cast("array<string>")).alias("child_section_ids"),
            tx.iso_date("canonical_version_date").alias("version_date"), F.col("canonical_version_code").alias("version_label"),
            (~F.col("not_found")).alias("is_current"), F.coalesce("out_count", F.lit(0)).alias("citations_out"),
            F.coalesce("in_count", F.lit(0)).alias("citations_in"), "by_type_out", "by_type_in", "not_found", note.alias("notes"))
    )


def adjacency(cites: DataFrame, internal: DataFrame | None = None) -> DataFrame:
    """Outgoing and incoming citation counts per section, total and by type.

    ``cites``: ``section_urn, statute_id`` (type ``cites`` unless it has a ``type``); ``internal``:
    ``source_urn, target_urn[, type]``.
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        kind = F.col("type") if "type" in df.columns else F.lit("cites")
        per = df.groupBy(F.col(key).alias("section"), kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy("section").agg(
            F.sum("n").alias(f"{name}_count"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias(f"by_type_{name}"))

    out = side(cites, "section_urn", "out")
    if internal is None:
        return out.withColumn("in_count", F.lit(0).cast("long")).withColumn("by_type_in", F.lit(None).cast("map<string,bigint>"))
    return out.join(side(internal, "target_urn", "in"), "section", "full_outer")


# -- terms -----------------------------------------------------------------
def _maybe(statutes: DataFrame) -> tuple[DataFrame, Column]:
    """Statutes and the condition to join them to rows whose ``statute_id`` may be null: null keys, most of all rows, are dealt by row."""
    row = F.coalesce(F.col("statute_id"), F.concat(F.lit("\0"), F.xxhash64("section_urn").cast("string")))
    return statutes.withColumnRenamed("statute_id", "_statute"), row == F.col("_statute")


def terms_of(bill_urns: DataFrame, terms: DataFrame, sections: DataFrame, statutes: DataFrame, few: bool = False) -> DataFrame:
    """Defined terms of the requested bills, one row per term id, with citation and target.

    ``few`` says that little is asked for (it is checked): tables are then filtered in place.
    """
    mine = Near(bill_urns, few).only(terms, "bill_urn")
    near = Near(mine.select("section_urn", "statute_id"), few)
    return (
        keep_first(mine, ["term_id"], [F.col("section_urn"), F.col("surface_form"), F.col("definition_type"), F.col("statute_id")])
        .join(near(_cites(sections), "section_urn"), "section_urn", "left").join(*_maybe(near(_statutes(statutes), "statute_id")), "left").drop("_statute")
        .select("bill_urn", "term_id", "surface_form", "section_urn", F.coalesce("section_citation", F.lit("")).alias("citation"),
                F.coalesce("scope", F.lit(fixed.DEFAULT_SCOPE)).alias("scope"), F.coalesce("definition_type", F.lit("direct")).alias("definition_type"),
                "definition_text", "statute_id", "statute_citation")
    )


def definition_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("definition_type") == "direct").alias("direct_count"),
        F.count_if(F.col("definition_type") == "by_reference").alias("by_reference_count"))


def _matching(terms: DataFrame, words: list[str], definition_type: str | None, statute: str | None) -> DataFrame:
    rows = terms.where(F.lower("surface_form").isin([w.lower() for w in words]))
    if statute:
        rows = rows.where(F.col("statute_id") == ids.normalise_statute(F.lit(statute)))
        definition_type = "by_reference"
    return rows.where(F.col("definition_type") == definition_type) if definition_type else rows


def bills_defining(terms: DataFrame, bills: DataFrame, sections: DataFrame, statutes: DataFrame, term: str,
                   also_match: list[str] = (), definition_type: str | None = None, by_reference_to: str | None = None) -> DataFrame:
    """Every bill that defines a term (exact surface form, case-insensitive), complete and distinct."""
    rows = _matching(terms, [term, *also_match], definition_type, by_reference_to)
    near = Near(rows.select("bill_urn", "section_urn", "statute_id"))
    named = near.join(near.join(rows, bills.select("bill_urn", "short_title", "title", "congress"), "bill_urn"), _cites(sections), "section_urn", "left")
    known = near(_statutes(statutes), "statute_id") if near.few else _statutes(statutes).hint("merge")
    return (
        named.join(*_maybe(known), "inner" if by_reference_to else "left").drop("_statute")
        .select("bill_urn", "short_title", "title", "congress", "surface_form", "section_urn",
                F.col("section_citation").alias("citation"), "definition_type", "statute_id", "statute_citation").distinct()
    )


def definitions_of(terms: DataFrame, bills: DataFrame, sections: DataFrame, statutes: DataFrame, term: str) -> DataFrame:
    """Each bill's definition of one term, side by side."""
    rows = _matching(terms, [term], None, None)
    near = Near(rows.select("bill_urn", "section_urn", "statute_id"))
    named = near.join(near.join(rows, bills.select("bill_urn", "short_title", "congress"), "bill_urn"), _cites(sections), "section_urn", "left")
    known = near(_statutes(statutes), "statute_id") if near.few else _statutes(statutes).hint("merge")
    return (
        named.join(*_maybe(known), "left").drop("_statute")
        .select("bill_urn", "short_title", "congress", F.col("section_citation").alias("citation"), "definition_type",
                "definition_text", "statute_citation").distinct()
    )


# -- amendments ------------------------------------------------------------
def amendments_of(bill_urns: DataFrame, amends: DataFrame, sections: DataFrame, statutes: DataFrame, few: bool = False) -> DataFrame:
    """Operations issued by the requested bills; the target is optional."""
    mine = Near(bill_urns, few).only(amends, "bill_urn")
    near = Near(mine.select("section_urn", "statute_id"), few)
    return (
        mine.join(near(_cites(sections), "section_urn"), "section_urn", "left").join(*_maybe(near(_statutes(statutes), "statute_id")), "left").drop("_statute")
        .select("bill_urn", "amendment_id", "section_urn", F.coalesce("section_citation", F.lit("")).alias("citation"),
                "operation_type", "before_text", "after_text", "statute_id", "statute_citation")
    )


def amendments_targeting(amends: DataFrame, sections: DataFrame, statutes: DataFrame, statute: str) -> DataFrame:
    """All operations on one statute section."""
    hit = amends.where(F.col("statute_id") == ids.normalise_statute(F.lit(statute)))
    near = Near(hit.select("section_urn", "statute_id"))
    return hit.join(near(_cites(sections), "section_urn"), "section_urn").join(near(_statutes(statutes), "statute_id"), "statute_id").select(
        "amendment_id", "bill_urn", "section_urn", F.col("section_citation").alias("citation"), "operation_type",
        "before_text", "after_text", "statute_id", "statute_citation")


def bills_amending(amends: DataFrame, bills: DataFrame, statutes: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Per bill and statute: distinct operations and their sorted types.

    ``wanted`` restricts the statutes (a condition on ``statute_id``).
    """
    rows = amends.where(F.col("statute_id").isNotNull() if wanted is None else wanted)
    near = Near(rows.select("bill_urn", "statute_id"), wanted is not None)
    return (
        rows.groupBy("statute_id", "bill_urn")
        .agg(F.count_distinct("amendment_id").alias("n_operations"), F.sort_array(F.collect_set("operation_type")).alias("operation_types"))
        .join(near(bills.select("bill_urn", "short_title", "title", "congress"), "bill_urn"), "bill_urn")
        .join(near(_statutes(statutes), "statute_id"), "statute_id")
    )


# -- citation graph --------------------------------------------------------
def neighbourhood(roots: DataFrame, sections: DataFrame, cites: DataFrame, internal: DataFrame | None = None,
                  direction: str = "both", types: list[str] | None = None, max_nodes: int = 50, few: bool = False) -> DataFrame:
    """Edges around each root section (``section_urn``), at most ``max_nodes`` per direction.

    ``truncated`` is set when the outgoing side is full. Unknown roots give no rows.
    """
    known = Near(roots, few).only(sections.select("section_urn"), "section_urn").select(F.col("section_urn").alias("root"))
    parts = []
    if types is None or "cites" in types:
        if direction in ("out", "both"):
            parts.append(cites.select(F.col("section_urn").alias("root"), F.col("section_urn").alias("source_id"),
                                      F.col("statute_id").alias("target_id"), F.lit("out").alias("direction")))
        if direction in ("in", "both") and internal is not None:
            parts.append(internal.select(F.col("target_urn").alias("root"), F.col("source_urn").alias("source_id"),
                                         F.col("target_urn").alias("target_id"), F.lit("in").alias("direction")))
    if not parts:
        return known.limit(0).select("root", *[F.lit(None).cast("string").alias(c) for c in ("source_id", "target_id", "direction")])
    edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = top_k(Near(known, few).only(edges, "root"), ["root", "direction"], [F.col("source_id"), F.col("target_id")], max_nodes, "n")
    full = kept.groupBy("root").agg(F.max(F.when(F.col("direction") == "out", F.col("n"))).alias("out_n"))
    return kept.drop("n").join(full, "root").withColumn("truncated", F.coalesce(F.col("out_n") == max_nodes, F.lit(False))).drop("out_n")


# -- citation strings ------------------------------------------------------
def resolve_citations(requests: DataFrame, bills: DataFrame, sections: DataFrame, few: bool = False) -> DataFrame:
    """``Sec. 3(a)(1) of H.R. N[, Cth Cong.]`` -> section ids.

    ``requests``: ``request_id, text``. Without a congress every bill of that type and number is a
    candidate. ``sections`` needs ``bill_id, section_id, ordinal, enum_path, ancestor_path``. One
    row per resolved bill, one row with a null section when nothing resolves.
    """
    p = fixed.SECTION_OF_BILL
    stripped = lambda e: F.regexp_replace(e, "^0+", "")
    group = lambda i: tx.blank_to_null(F.regexp_extract("text", p, i))
    subs = F.regexp_extract_all(F.coalesce(group(2), F.lit("")), F.lit(r"\(([0-9a-zA-Z]+)\)"), F.lit(1))
    first = stripped(group(1))
    parsed = requests.select(
        "request_id", ids.bill_type(group(3)).alias("bill_type"), group(4).cast("long").alias("bill_number"),
        group(5).cast("long").alias("asked_congress"), F.concat(F.array(F.when(first == "", "0").otherwise(first)), subs).alias("enums"))
    cand = (
        parsed.join(bills.select("bill_id", "bill_type", "bill_number", "congress"), ["bill_type", "bill_number"])
        .where(F.col("asked_congress").isNull() | (F.col("asked_congress") == F.col("congress")))
        .withColumn("key", F.transform("enums", stripped))
    )
    named = Near(cand.select("bill_id"), few)(sections, "bill_id").where(F.size("enum_path") == F.size("ancestor_path")).select(
        "bill_id", "section_id", "ordinal", "enum_path", F.transform("enum_path", stripped).alias("key"))
    match = cand.join(named, ["bill_id", "key"]).where(F.forall(
        F.zip_with("enums", "enum_path", lambda a, b: (a == b) | (stripped(a) == b)), lambda x: x))
    found = keep_first(match, ["request_id", "bill_id"], [F.col("ordinal"), F.col("section_id")]).select("request_id", "bill_id", "section_id")
    n = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    return requests.join(found, "request_id", "left").join(n, "request_id", "left").select(
        "request_id", "bill_id", "section_id", (F.coalesce("n", F.lit(0)) > 1).alias("is_ambiguous"))


# -- coverage and counts ---------------------------------------------------
def coverage(bills: DataFrame) -> DataFrame:
    """Corpus scope in one row; tiers A and B are always counted."""
    return bills.agg(
        F.count(F.lit(1)).alias("bills"), F.sort_array(F.collect_set("congress")).alias("congresses"),
        F.min("introduced_date").alias("first_date"), F.max("introduced_date").alias("last_date"),
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in fixed.TIERS])


def coverage_note(bills: DataFrame) -> DataFrame:
    """The one-line scope text: total, congress span, bills per topic."""
    per = bills.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("congress").alias("lo"), F.max("congress").alias("hi"))
    label = F.concat("topic", F.lit("="), F.col("n").cast("string"))
    return per.agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic", label.alias("l")))), lambda x: x["l"]), ", ").alias("t"),
    ).select(F.concat(F.col("n").cast("string"), F.lit(" bills, Congress "), F.col("lo").cast("string"), F.lit("-"),
                      F.col("hi").cast("string"), F.lit(", topics: "), F.col("t"), F.lit(" (legislation stream only)")).alias("note"))


def embedding_coverage(sections: DataFrame, vectors: DataFrame, topic: str = "topic") -> DataFrame:
    """Embedded and total sections per topic, and the share in percent."""
    done = vectors.select("section_id", F.lit(1).alias("done"))
    return sections.join(done, "section_id", "left").groupBy(topic).agg(
        F.count(F.lit(1)).alias("total"), F.count("done").alias("embedded"),
        F.round(100.0 * F.count("done") / F.count(F.lit(1)), 4).alias("pct"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reach(edges: dict[str, DataFrame]) -> DataFrame:
    """Bills with at least one edge of each kind (``bill_urn`` is stored, no traversal)."""
    parts = [df.agg(F.count_distinct("bill_urn").alias("n_bills")).select(F.lit(k).alias("kind"), "n_bills") for k, df in edges.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_statutes(edges: DataFrame, statutes: DataFrame, k: int = 5) -> DataFrame:
    """Most cited (or amended) statutes; ties go to the smaller id."""
    n = edges.where(F.col("statute_id").isNotNull()).groupBy("statute_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "statute_id").limit(k).join(_statutes(statutes), "statute_id", "left")


def bills_touching(edges: DataFrame, statute: str) -> DataFrame:
    """Distinct bills whose sections cite, amend or define by one statute."""
    return edges.where(F.col("statute_id") == ids.normalise_statute(F.lit(statute))).select("bill_urn").distinct()
