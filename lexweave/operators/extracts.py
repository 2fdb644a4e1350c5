"""Citations, defined terms and amendment operations from element rows.

All functions return rows keyed by ``bill_id`` with local element ids; :func:`attach` turns
those into section ids of both id spaces and drops rows whose section is unknown.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.operators import nodes as nd
from lexweave.operators.rank import keep_first


def _innermost_id(path: Column) -> Column:
    return F.try_element_at(F.filter(path, lambda p: nd.is_level(p) & nd.has_id(p)), F.lit(-1))["id"]


def _body(nodes: DataFrame) -> DataFrame:
    return nd.in_body(nodes.where("has_body"))


def _frags(nodes: DataFrame) -> DataFrame:
    return nd.fragments(nodes.where("has_body"))


# -- citations -------------------------------------------------------------
def citations(nodes: DataFrame) -> DataFrame:
    """Statute references outside quoted blocks, attached to the innermost identified container."""
    refs = (
        _body(nodes)
        .where((F.col("tag") == "external-xref") & F.col("legal_doc").isin(fixed.CITED_DOCS)
               & (F.coalesce("cite", F.lit("")) != ""))
        .where(nd.outside_quotes())
        .select("bill_id", "pos", F.col("id").alias("xml_ref_id"), "legal_doc",
                _innermost_id(F.col("rel")).alias("local_id"), ids.parse_cite("cite", "legal_doc").alias("c"))
        .where(F.col("c").isNotNull() & F.col("local_id").isNotNull())
    )
    raw = nd.subtree_text(_frags(nodes), ["external-xref"], False, "raw")
    return refs.join(raw, ["bill_id", "pos"], "left").select(
        "bill_id", "pos", "local_id", "xml_ref_id", "legal_doc",
        F.col("c.statute_id").alias("statute_id"), F.col("c.title").alias("target_title"),
        F.col("c.section").alias("target_section"), F.col("c.label").alias("statute_label"),
        F.coalesce("raw", F.lit("")).alias("raw_text"),
    )


# -- defined terms ---------------------------------------------------------
def scope_of(text) -> Column:
    return tx.first_rule(text, fixed.SCOPE_HINTS, fixed.DEFAULT_SCOPE)


def is_by_reference(text) -> Column:
    return reduce(lambda a, b: a | b, [tx.col(text).rlike(p) for p in fixed.BY_REFERENCE])


def _boxed(frags: DataFrame) -> DataFrame:
    """Pieces below a definitions container: ``box`` (the outermost, outside quoted blocks), what
    follows it on the path (``child``), the path from there (``sub``) and whether a quote lies between.
    """
    kind = F.transform("rel", lambda p: F.when(nd.is_quoted(p), "q").when(nd.is_level(p) & p["defines"], "d").otherwise("-"))
    return (
        frags.where(F.exists("rel", lambda p: p["defines"])).withColumn("kind", kind)
        .withColumn("b", F.array_position("kind", F.lit("d")).cast("int")).withColumn("q", F.array_position("kind", F.lit("q")).cast("int"))
        .where((F.col("b") > 0) & ((F.col("q") == 0) | (F.col("b") < F.col("q"))))
        .withColumn("box", F.try_element_at("rel", F.greatest("b", F.lit(1)))).where(nd.has_id(F.col("box")))
        .withColumn("child", F.try_element_at("rel", F.col("b") + 1))
        .withColumn("sub", F.slice("rel", F.col("b") + 2, F.size("rel")))
        .withColumn("quoted", F.col("q") > 0)
    )


def _first_text(pieces: Column) -> Column:
    """Text of the first element, in document order, that has any."""
    at = F.array_sort(F.array_distinct(F.transform(pieces, lambda x: x["at"])))
    texts = F.transform(at, lambda a: tx.clean_inline(F.array_join(F.transform(F.array_sort(F.filter(
        pieces, lambda x: (x["at"] == a) & (x["txt"] != ""))), lambda x: x["txt"]), " ")))
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))


def defined_terms(nodes: DataFrame) -> DataFrame:
    """One row per child container of a definitions container that has an id and a surface form.

    A piece of text finds its definitions container and term on its own path, so only text inside
    definitions is shuffled, once.
    """
    nodes = nodes.where(F.array_contains(F.col("path")["defines"], True))  # all that _boxed can keep
    boxed = _boxed(_frags(nodes))
    child, live = F.col("child"), ~F.col("quoted")
    piece = F.when(live & (F.col("txt") != ""), F.struct(F.col("ord").alias("o"), F.col("txt").alias("t")))

    def marks(tag: str) -> Column:
        """The marked elements a piece lies in, unless a quoted block comes between."""
        inside = F.transform("sub", lambda p, i: F.when(
            (p["tag"] == tag) & ~F.exists(F.slice("sub", i + 2, F.size("sub")), nd.is_quoted), F.struct(p["pos"].alias("at"), "ord", "txt")))
        return F.flatten(F.collect_list(F.array_compact(inside)))

    top = F.try_element_at("sub", F.lit(1))
    head = F.when(live & top["tag"].isin(fixed.HEADING_TAGS), F.struct(top["pos"].alias("at"), "ord", "txt"))
    rows = (
        boxed.where(nd.is_level(child) & nd.has_id(child))
        .groupBy("bill_id", F.col("box.pos").alias("box_pos"), F.col("box.id").alias("container_id"), child["pos"].alias("pos"), child["id"].alias("local_id"))
        .agg(F.array_sort(F.collect_list(piece)).alias("all"), marks("term").alias("term"), marks("quote").alias("quote"), F.collect_list(head).alias("head"))
    )
    own = boxed.where(live & (child.isNull() | ~nd.is_level(child)))
    scope = own.groupBy("bill_id", F.col("box.pos").alias("box_pos")).agg(tx.clean_inline(nd.ordered_text()).alias("scope_text"))
    first_head = F.filter("head", lambda x: x["at"] == F.array_min(F.transform("head", lambda y: y["at"])))
    refs = _boxed(_body(nodes).where((F.col("tag") == "external-xref") & F.col("legal_doc").startswith("usc")))
    target = refs.where(nd.is_level(F.col("child"))).groupBy("bill_id", F.col("child.pos").alias("pos")).agg(
        F.min_by(F.struct(ids.parse_cite(F.coalesce("cite", F.lit("")), "legal_doc").alias("c")), F.col("pos")).alias("ref"))
    rows = rows.join(scope, ["bill_id", "box_pos"], "left").join(target, ["bill_id", "pos"], "left")
    text = tx.clean_inline(F.array_join(F.transform("all", lambda x: x["t"]), " "))
    by_ref = is_by_reference("text")
    return (
        rows.withColumn("text", text).withColumn("surface_form", F.coalesce(_first_text(F.col("term")), _first_text(F.col("quote")), _first_text(first_head)))
        .where(F.col("surface_form").isNotNull())
        .select(
            "bill_id", "pos", "local_id", "container_id", "surface_form",
            scope_of(F.coalesce("scope_text", F.lit(""))).alias("scope"),
            F.col("text").alias("definition_text"),
            F.when(by_ref, "by_reference").otherwise("direct").alias("definition_type"),
            F.when(by_ref, F.col("ref.c.statute_id")).alias("statute_id"),
            F.when(by_ref, F.col("ref.c.label")).alias("statute_label"),
        )
    )


def term_id(container, surface) -> Column:
    return F.concat(tx.col(container), F.lit("::term/"), tx.slug(surface, "_"))


# -- amendments ------------------------------------------------------------
def operation_of(text) -> Column:
    return tx.first_rule(text, fixed.OPERATIONS, fixed.DEFAULT_OPERATION)


def struck_text(text) -> Column:
    return tx.strip(tx.grab(text, fixed.BEFORE_TEXT, 1))


def locator(cite, target) -> Column:
    """JSON locator of the amended provision; ``unknown`` keeps the raw cite."""
    found = F.to_json(F.struct(
        F.lit("usc").alias("code"), target["title"].alias("title"), target["section"].alias("section"),
        F.array().cast("array<string>").alias("subdivisions")))
    unknown = F.to_json(F.struct(F.lit("unknown").alias("code"), cite.alias("raw")), {"ignoreNullFields": "false"})
    return F.when(target.isNotNull(), found).otherwise(unknown)


def amendments(nodes: DataFrame) -> DataFrame:
    """One operation per outermost quoted block inside an identified container."""
    frags = _frags(nodes)
    body = _body(nodes)
    around = nd.above()
    blocks = (
        body.where(F.col("tag") == "quoted-block").where(~F.exists(around, nd.is_quoted))
        .select("bill_id", "body_pos", "pos", F.col("id").alias("xml_ref_id"), around.alias("around"),
                _innermost_id(around).alias("local_id"))
        .where(F.col("local_id").isNotNull())
    )
    boxes = blocks.select("bill_id", F.col("pos").alias("block"), F.posexplode(
        F.filter("around", nd.is_level)).alias("depth", "p")).select("bill_id", "block", "depth", F.col("p.pos").alias("pos"))
    prose = nd.quoting_container_text(frags, "prose").where("prose != ''")
    prose = boxes.join(prose, ["bill_id", "pos"]).groupBy("bill_id", F.col("block").alias("pos")).agg(
        F.max_by("prose", "depth").alias("prose"))

    # nearest enclosing element (the body included) below which a statute reference stands
    refs = body.where((F.col("tag") == "external-xref") & F.col("legal_doc").startswith("usc")).where(nd.outside_quotes())
    step = F.explode(F.array_union(F.array("body_pos"), F.transform(nd.above(), lambda p: p["pos"])))
    first_ref = (
        refs.select("bill_id", "pos", F.coalesce("cite", F.lit("")).alias("cite"), step.alias("at"))
        .groupBy("bill_id", "at").agg(F.min_by("cite", "pos").alias("cite"))
    )
    chain = F.array_union(F.array("body_pos"), F.transform("around", lambda p: p["pos"]))
    target = (
        blocks.select("bill_id", "pos", F.explode(chain).alias("at"))
        .join(first_ref, ["bill_id", "at"])
        .groupBy("bill_id", "pos").agg(F.max_by("cite", "at").alias("cite"))
    )
    after = nd.subtree_text(frags, ["quoted-block"], False, "after")
    number = F.row_number().over(Window.partitionBy("bill_id").orderBy("pos"))
    rows = blocks.drop("around", "body_pos").withColumn("n", number)
    for part in (prose, target, after):
        rows = rows.join(part, ["bill_id", "pos"], "left")
    text = F.coalesce("prose", F.lit(""))
    found = ids.parse_cite("cite", F.lit("usc"))
    return rows.withColumn("t", found).select(
        "bill_id", "pos", "local_id", "n", "xml_ref_id",
        operation_of(text).alias("operation_type"), text.alias("operation_text"),
        F.col("t.statute_id").alias("statute_id"), F.col("t.label").alias("statute_label"),
        locator(F.col("cite"), F.col("t")).alias("target_locator_json"),
        struck_text(text).alias("before_text"),
        F.coalesce("after", F.lit("")).alias("after_text"),
    )


# -- thin metadata ---------------------------------------------------------
def thin_metadata(nodes: DataFrame) -> DataFrame:
    """Title, short title, sponsor, first action date and stage as far as the document tells."""
    own = tx.blank_to_null(tx.clean_inline("text"))
    day = F.coalesce(tx.blank_to_null("date"), tx.blank_to_null(tx.strip("text")))
    iso = F.when(F.length(day) >= 8, F.when(day.contains("-"), F.substring(day, 1, 10)).otherwise(
        F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))))

    def first(tag: str, value: Column) -> Column:
        mine = F.when(F.col("tag") == tag, value)
        return F.min_by(mine, F.when(mine.isNotNull(), F.col("pos")))

    # a sponsor is its searchable name when it has one, else all text below it
    sponsor = F.try_element_at(F.filter("path", lambda p: p["tag"] == "sponsor"), F.lit(1))
    texts = (
        nodes.where(sponsor.isNotNull())
        .select("bill_id", sponsor["pos"].alias("at"), F.col("pos"), F.inline(F.array(
            F.struct(F.col("pos").alias("ord"), F.coalesce("text", F.lit("")).alias("txt"), F.lit(True).alias("own"),
                     (F.col("tag") == "name-search").alias("name")),
            F.struct(F.col("end").alias("ord"), F.when(F.col("tag") != "sponsor", F.col("tail")).alias("txt"),
                     F.lit(False).alias("own"), F.lit(False).alias("name")))))
        .groupBy("bill_id", "at").agg(
            F.min_by(tx.blank_to_null(tx.strip("txt")), F.when(F.col("name") & (F.col("txt") != ""), F.col("ord"))).alias("name"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "txt"))), lambda x: x["txt"]), "").alias("all"))
        .withColumn("sponsor", F.coalesce("name", tx.blank_to_null(tx.clean_inline("all"))))
        .groupBy("bill_id").agg(F.min_by("sponsor", F.when(F.col("sponsor").isNotNull(), F.col("at"))).alias("sponsor"))
    )
    # a document's root is its row at 0, so every readable document keeps a row and paths are not read
    told = nodes.where(F.col("error").isNull() & ((F.col("pos") == 0) | F.col("tag").isin("official-title", "short-title", "action-date")))
    rest = told.groupBy("bill_id").agg(
        first("official-title", own).alias("title"), first("short-title", own).alias("short_title"),
        first("action-date", iso).alias("introduced_date"),
        F.min_by("stage", F.when(F.col("pos") == 0, F.col("pos"))).alias("bill_stage"))
    return rest.join(texts, "bill_id", "left")


# -- joining extracts to sections -----------------------------------------
def attach(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Add section ids and keep only rows whose source section exists."""
    known = sections.where(F.col("xml_id").isNotNull()).select(
        "bill_id", F.col("xml_id").alias("local_id"), "section_id", "section_urn", "bill_urn", "canonical_citation")
    return rows.join(known, ["bill_id", "local_id"])


def term_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attached term rows -> (term nodes, defining edges, by-reference edges).

    A repeated term id keeps its first node while every edge stays.
    """
    t = rows.withColumn("term_id", term_id(F.concat("bill_urn", F.lit("::"), "container_id"), "surface_form"))
    node = keep_first(t, ["term_id"], [F.col("bill_id"), F.col("pos")])
    defines = t.select("section_urn", "term_id", "definition_type", "bill_urn")
    by_ref = t.where(F.col("statute_id").isNotNull()).select("term_id", "statute_id", F.lit(1.0).alias("confidence"))
    return node, defines, by_ref


def statute_dimension(cites: DataFrame, terms: DataFrame, amends: DataFrame) -> DataFrame:
    """Statute sections named anywhere; the label of the first mention wins.

    Order: document, then citations before terms before amendments, then position.
    """
    part = lambda df, n: df.where(F.col("statute_id").isNotNull()).select(
        "statute_id", "statute_label", "bill_id", F.lit(n).alias("kind"), "pos")
    every = part(cites, 0).unionByName(part(terms, 1)).unionByName(part(amends, 2))
    return (
        every.groupBy("statute_id")
        .agg(F.min_by("statute_label", F.struct("bill_id", "kind", "pos")).alias("canonical_citation"))
        .select("statute_id", ids.statute_parent("statute_id").alias("parent_id"),
                F.lit("").alias("enum_path"), "canonical_citation")
    )
