"""Trees: closure, roots, outlines, own text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.session import checkpoint_dir


def closure(parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All (id, ancestor, distance) of a parent-pointer table ``id, parent``.

    Distances double with every join, so a tree of depth d takes log2(d) joins. Without
    ``max_depth`` it goes on until nothing new appears, cutting the plan at a checkpoint each time; pairs
    that are known are not followed again, so it also ends on a cycle, where a node is its own ancestor.
    """
    pairs = parents.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    reach = 1
    while max_depth is None or reach < max_depth:
        far = pairs.where(F.col("distance") == reach).select("id", F.col("ancestor").alias("mid"))
        up = pairs.select(F.col("id").alias("mid"), "ancestor", (F.col("distance") + reach).alias("distance"))
        more = far.join(up, "mid").select("id", "ancestor", "distance")
        if max_depth is None:
            checkpoint_dir(parents.sparkSession)
            more = more.dropDuplicates(["id", "ancestor"]).join(pairs, ["id", "ancestor"], "left_anti").checkpoint()
            if more.isEmpty():
                break
        pairs = pairs.unionByName(more)
        reach *= 2
    return pairs if max_depth is None else pairs.where(F.col("distance") <= max_depth)


def root_index(parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node with its root (itself when it has no parent)."""
    far = closure(parents, max_depth).groupBy("id").agg(F.max_by("ancestor", "distance").alias("root"))
    return parents.select("id").join(far, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def section_roots(sections: DataFrame) -> DataFrame:
    """The same from the stored path: no join at all."""
    return sections.select("section_id", F.col("ancestor_path")[0].alias("root_id"))


def descendants(sections: DataFrame, section_id: str) -> DataFrame:
    return sections.where(F.array_contains("ancestor_path", section_id) & (F.col("section_id") != section_id))


def outline(sections: DataFrame) -> DataFrame:
    """Flat outline: ``bill_id, pos, section_id, level, marker, title``; order by bill and position."""
    return sections.select("bill_id", "pos", "section_id", F.size("ancestor_path").alias("level"),
                           F.coalesce(tx.blank_to_null(tx.section_marker("canonical_citation")), F.lit("§")).alias("marker"),
                           F.coalesce("heading", F.lit("")).alias("title"))


# -- own text --------------------------------------------------------------
def own_text(sections: DataFrame) -> DataFrame:
    """Section tree rows with each node's own text, as the walk stored it, and the number of its children."""
    kids = sections.where("parent_section_id is not null").groupBy(F.col("parent_section_id").alias("section_id")).agg(F.count("*").alias("kids"))
    return (sections.join(kids, "section_id", "left").withColumn("own_text", tx.strip(F.coalesce("text_self", F.lit(""))))
            .withColumn("n_children", F.coalesce("kids", F.lit(0)).cast("int")).drop("kids"))


def blocks(tree: DataFrame) -> DataFrame:
    """Rendered blocks below every top-level section: ``root_id, section_id, depth, marker, own_text``.

    A node without text and heading only groups others: it is left out and its marker is put before
    the first child's.
    """
    folded = (F.col("own_text") == "") & (F.coalesce("heading", F.lit("")) == "") & (F.col("n_children") > 0)
    first = F.col("ordinal") == 0
    flags = tree.select(F.col("section_id").alias("step_id"), folded.alias("folded"), first.alias("first"), tx.last_marker("canonical_citation").alias("mark"))
    path = tree.select("section_id", F.posexplode("ancestor_path").alias("at", "step_id")).where("at > 0").join(flags, "step_id")
    steps = path.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("at", "folded", "first", "mark"))).alias("steps"))
    start = F.struct(F.lit("").alias("mark"), F.lit(False).alias("open"), F.lit(0).alias("hidden"))

    def go(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(F.when(acc["open"] & x["first"], acc["mark"]).otherwise(""), x["mark"]).alias("mark"),
                        x["folded"].alias("open"), (acc["hidden"] + x["folded"].cast("int")).alias("hidden"))

    return (
        tree.join(steps, "section_id").withColumn("s", F.aggregate("steps", start, go)).where(~folded)
        .select("bill_id", F.col("ancestor_path")[0].alias("root_id"), "pos", "section_id", (F.size("steps") - 1 - F.col("s.hidden")).alias("depth"),
                F.col("s.mark").alias("marker"), F.coalesce("heading", F.lit("")).alias("heading"), "own_text")
    )
