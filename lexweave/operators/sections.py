"""Section rows from element rows: ids, order, enumerators, own and full text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.functions.arrays import fixed_once, let
from lexweave.operators import nodes as nd
from lexweave.operators.rank import keep_first

def _locate(frags: DataFrame) -> DataFrame:
    """Find the section that owns each text piece and the role the piece plays in it.

    Containers count as sections while the path from the outermost container holds nothing but
    containers and quoting wrappers; whatever lies below that is the owner's own text.
    """
    own = ("bill_id", "ord", "txt", "opens", "tag")
    df = fixed_once(frags, *own, "rel", first=F.array_position(F.transform("rel", nd.is_level), F.lit(True)).cast("int")).where(F.col("first") > 0)
    df = fixed_once(df, *own, "first", inner=F.slice("rel", F.greatest("first", F.lit(1)), F.size("rel")))
    df = fixed_once(df, *own, "first", "inner", marks=F.transform("inner", lambda p: F.when(nd.is_level(p), "l").when(nd.is_wrapper(p), "w").otherwise("-")))
    stop = F.array_position("marks", F.lit("-")).cast("int")
    df = fixed_once(df, *own, "first", "inner", "marks", length=F.when(stop == 0, F.size("marks")).otherwise(F.greatest(stop - 1, F.lit(0))))
    last = F.col("length") - F.array_position(F.reverse(F.slice("marks", F.lit(1), F.col("length"))), F.lit("l")) + 1
    df = fixed_once(df, *own, "first", "inner", "length", k=last.cast("int"))
    df = fixed_once(
        df, *own, "first", "inner", "k", owner=F.try_element_at("inner", F.greatest("k", F.lit(1))), below=F.try_element_at("inner", F.greatest("k", F.lit(1)) + 1),
        chain=F.transform(F.filter(F.slice("inner", F.lit(1), F.col("length")), nd.is_level), lambda p: p["pos"]),
        at_table=F.array_position(F.col("inner")["tag"], F.lit("table")).cast("int"))
    df = df.withColumn("direct", (F.col("first") == 1) & (F.size("chain") == 1))
    below = F.col("below")
    kind = (
        F.when(below.isNull(), "self")
        .when(below["tag"].isin(fixed.ENUM_TAGS), "enum")
        .when(below["tag"].isin(fixed.HEADING_TAGS), "head")
        .when(nd.is_wrapper(below) & below["holds"], F.lit(None))
        .otherwise("self")
    )
    table = F.when(F.col("at_table") > 0, F.try_element_at("inner", F.greatest("at_table", F.lit(1)))["pos"])
    breaks = F.col("opens") & F.col("tag").isin("br", "p") & (F.size("inner") > F.col("k") + 1)
    cells = F.array_compact(F.transform("inner", lambda p, i: F.when(
        (p["tag"] == "tr") & F.try_element_at("inner", (i + 2).cast("int"))["tag"].isin("td", "th"),
        F.struct(p["pos"].alias("tr"), F.try_element_at("inner", (i + 2).cast("int"))["pos"].alias("cell")))))
    return (
        df.withColumn("kind", kind).where(F.col("kind").isNotNull())
        .withColumn("part", F.when(F.col("kind") != "self", below["pos"]))
        .withColumn("tbl", table)
        .withColumn("txt", F.when(breaks & F.col("tbl").isNull(), F.concat(F.lit("\n"), "txt")).otherwise(F.col("txt")))
        .withColumn("c", F.explode_outer(F.when(F.col("tbl").isNotNull(), cells)))
        .where(F.col("tbl").isNull() | F.col("c").isNotNull())
        .select(
            "bill_id", F.col("owner.pos").alias("pos"), "owner", "chain", "direct",
            F.struct("kind", "part", F.coalesce("tbl", "ord").alias("at"), F.col("c.tr").alias("tr"), F.col("c.cell").alias("cell"), "ord",
                     "tbl", "txt").alias("piece"))
    )


def _text(pieces: Column) -> Column:
    """Pieces of one element to text: blank-joined; table cells by `` | ``, table rows by line.

    ``pieces`` are in order. Rows without any text are dropped, empty cells of other rows stay.
    """
    return let(pieces, _text_of)


def _text_of(pieces: Column) -> Column:
    plain = F.array_join(F.transform(F.filter(pieces, lambda x: x["txt"] != ""), lambda x: x["txt"]), " ")
    live = F.array_distinct(F.transform(F.filter(pieces, lambda x: x["tr"].isNotNull() & (tx.strip(x["txt"]) != "")), lambda x: x["tr"]))
    kept = let(live, lambda rows: F.filter(pieces, lambda x: x["tbl"].isNull() | F.array_contains(rows, x["tr"])))

    def part(kept: Column, x: Column, i: Column) -> Column:
        before = F.try_element_at(kept, F.when(i > 0, i))
        cell = (before["tbl"] == x["tbl"]) & (before["tr"] == x["tr"]) & (before["cell"] == x["cell"])
        sep = F.when(x["tbl"].isNull() | cell, " ").when((before["tbl"] == x["tbl"]) & (before["tr"] == x["tr"]), " | ").when(
            before["tbl"] == x["tbl"], "\n").otherwise(" ")
        opens = x["tbl"].isNotNull() & ~F.coalesce((i > 0) & cell, F.lit(False))
        txt = F.when(x["tbl"].isNull(), x["txt"]).otherwise(F.regexp_replace(x["txt"], r"(?U)\s+", " "))
        return F.when(opens | (txt != ""), F.concat(F.when(i == 0, "").otherwise(sep), txt))

    tabular = let(kept, lambda k: F.array_join(F.array_compact(F.transform(k, lambda x, i: part(k, x, i))), ""))
    return F.when(F.exists(pieces, lambda x: x["tbl"].isNotNull()), tabular).otherwise(plain)


def _assemble(located: DataFrame) -> DataFrame:
    """One row per section with its raw enumerator, heading and own text."""
    got = located.groupBy("bill_id", "pos").agg(
        F.first("owner").alias("owner"), F.first("chain").alias("chain"), F.first("direct").alias("direct"),
        F.array_sort(F.collect_list("piece")).alias("pieces"))

    def first_child(kind: str) -> Column:
        def text(mine: Column) -> Column:
            one = let(F.get(mine, 0)["part"], lambda part: F.filter(mine, lambda x: x["part"] == part))
            return F.when(F.size(mine) > 0, _text(one))

        return let(F.filter("pieces", lambda x: x["kind"] == kind), text)

    return got.select(
        "bill_id", "owner", "chain", "direct", first_child("enum").alias("enum_raw"), first_child("head").alias("head_raw"),
        _text(F.filter("pieces", lambda x: x["kind"] == "self")).alias("self_raw"))


def walk(nodes: DataFrame) -> DataFrame:
    """Sections of every document, one row each, before ids are attached to bills.

    ``bill_id, pos, local_id, xml_id, level, enum, heading, text_self, text_full, ordinal, id_path,
    enum_path``. All grouping is by document, so the fragments are shuffled once.
    """
    own = _assemble(_locate(nd.fragments(nodes)).repartition("bill_id"))
    doc = Window.partitionBy("bill_id").orderBy("pos")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    until = doc.rowsBetween(Window.unboundedPreceding, 0)
    siblings = Window.partitionBy("bill_id", "parent_pos").orderBy("pos")
    s = own.select(
        "bill_id", "chain", "direct", F.col("owner.pos").alias("pos"), F.col("owner.end").alias("end"),
        F.col("owner.tag").alias("level"), F.nullif(F.col("owner.id"), F.lit("")).alias("xml_id"),
        F.try_element_at("chain", F.lit(-2)).alias("parent_pos"),
        tx.blank_to_null(tx.norm_enum(tx.clean_inline("enum_raw"))).alias("enum"),
        tx.blank_to_null(tx.clean_inline("head_raw")).alias("heading"),
        tx.clean_block("self_raw").alias("text_self"),
        F.array_join(F.filter(F.array(tx.strip(F.coalesce("enum_raw", F.lit(""))), tx.strip(F.coalesce("head_raw", F.lit("")))),
                              lambda x: x != ""), " ").alias("label"),
    )
    s = s.withColumn("gen", F.sum(F.col("xml_id").isNull().cast("int")).over(until))
    s = s.withColumn("tops", F.coalesce(F.sum(F.col("direct").cast("int")).over(before), F.lit(0)))
    s = s.withColumn("ordinal", F.when(F.col("parent_pos").isNull(), F.col("tops")).otherwise(
        F.row_number().over(siblings) - 1).cast("int"))
    s = s.withColumn("local_id", F.coalesce("xml_id", F.concat(F.lit("gen-"), F.col("gen").cast("string"))))
    return _with_paths(_with_full_text(s))


def _with_full_text(s: DataFrame) -> DataFrame:
    """Attach ``text_full``: own text, then ``enum heading text`` of every descendant.

    Two neighbouring pieces share a line only when the first is the label of a section that
    encloses the second; otherwise a new line starts. That rule does not depend on the section
    whose text is built, so each section's label and text get theirs once and are sent to all its ancestors.
    """
    # what the last section with any text before this one ended on: its label (0) or its text (1)
    ends_on = F.when(F.col("text_self") != "", F.struct(F.lit(1).alias("step"), F.col("end").alias("end"))).when(
        F.col("label") != "", F.struct(F.lit(0).alias("step"), F.col("end").alias("end")))
    before = Window.partitionBy("bill_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("prev", F.last(ends_on, ignorenulls=True).over(before))
    outer = F.when((F.col("prev.step") == 0) & (F.col("pos") <= F.col("prev.end")), " ").otherwise("\n")
    said = F.col("label") != ""
    mine = F.col("to") == F.col("pos")
    sent = s.select(
        "bill_id", "pos", *KEEP, F.when(said, F.concat(outer, "label")).alias("named"),
        F.when(F.col("text_self") != "", F.concat(F.when(said, " ").otherwise(outer), "text_self")).alias("own"), F.explode("chain").alias("to"))
    # its own text goes to the section itself, its label and text to those around it
    txt = F.when(mine, F.col("own")).otherwise(F.coalesce(F.concat("named", "own"), "named", "own"))
    piece = F.when(txt.isNotNull(), F.struct("pos", txt.alias("txt")))
    full = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["txt"]), "")
    return sent.groupBy("bill_id", "to").agg(
        tx.clean_block(full).alias("text_full"), *_of_itself(mine, KEEP), F.collect_list("pos").alias("below"))


#: What a section knows about itself. Each is carried as a column of its own, so that a query that does not ask for one does not build it.
KEEP = ("chain", "level", "xml_id", "local_id", "enum", "heading", "text_self", "ordinal")


def _of_itself(mine: Column, names: tuple[str, ...]) -> list[Column]:
    """Aggregates: the values of the one row of a group that is the section itself."""
    return [F.first(F.when(mine, F.col(c)), ignorenulls=True).alias(c) for c in names]


def _with_paths(full: DataFrame) -> DataFrame:
    """Let every section tell its id and enumerator to itself and all its descendants."""
    step = F.struct(F.size("chain").alias("depth"), "local_id", "enum")
    told = full.select("bill_id", "to", step.alias("step"), *KEEP, "text_full", F.explode("below").alias("pos"))
    got = told.groupBy("bill_id", "pos").agg(
        F.array_sort(F.collect_list("step")).alias("steps"), *_of_itself(F.col("to") == F.col("pos"), (*KEEP, "text_full")))
    return got.select(
        "bill_id", "pos", *KEEP, "text_full", F.transform("steps", lambda x: x["local_id"]).alias("id_path"),
        F.filter(F.transform("steps", lambda x: x["enum"]), lambda e: e.isNotNull()).alias("enum_path"))


def section_table(nodes: DataFrame, bills: DataFrame) -> DataFrame:
    """The ``sections`` table: both id spaces, parent pointer, id and enumerator paths.

    ``bills`` needs ``bill_id, congress, bill_type, bill_number``. Repeated ids keep the first.
    """
    head = bills.select("bill_id", ids.bill_urn("congress", "bill_type", "bill_number").alias("bill_urn"),
                        tx.bill_citation("congress", "bill_type", "bill_number").alias("bill_cite"))
    full = lambda x: F.concat(F.col("bill_id"), F.lit("::"), x)
    urn = lambda x: F.concat(F.col("bill_urn"), F.lit("::"), x)
    parent = F.try_element_at("id_path", F.lit(-2))
    return (
        keep_first(walk(nodes), ["bill_id", "local_id"], [F.col("pos")]).join(head, "bill_id")
        .select(
            full(F.col("local_id")).alias("section_id"), urn(F.col("local_id")).alias("section_urn"),
            "bill_id", "bill_urn", full(parent).alias("parent_section_id"), urn(parent).alias("parent_urn"),
            "level", "enum", "heading", "text_self", "text_full",
            tx.section_citation("enum_path", "bill_cite").alias("canonical_citation"),
            "ordinal", "xml_id", "pos",
            F.transform("id_path", lambda x: F.concat(F.col("bill_id"), F.lit("::"), x)).alias("ancestor_path"),
            "enum_path",
        )
    )