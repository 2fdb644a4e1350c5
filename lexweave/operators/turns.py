"""Conversation turns: histories, tool traces, display mode, merged result lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import text as tx
from lexweave.operators.rank import first_non_null


def history(turns: DataFrame) -> DataFrame:
    """Turns that are replayed: user or assistant, with text. Order is the turn number.

    The history stays one row per turn (a filter, no grouping), however long a conversation is.
    """
    return turns.where(F.col("role").isin("user", "assistant") & (F.length(tx.strip(F.coalesce("text", F.lit("")))) > 0))


def display_mode(calls: DataFrame, turn: str = "turn", name: str = "name") -> DataFrame:
    """Mode of a turn from the tools it used: definition, amendment, citation, else structure."""
    order = {m: i for i, m in enumerate(fixed.MODE_PRIORITY)}
    rank = F.lit(order["structure"])
    for mode in reversed(list(fixed.MODE_TOOLS)):
        rank = F.when(F.col(name).isin(fixed.MODE_TOOLS[mode]), F.lit(order[mode])).otherwise(rank)
    best = calls.groupBy(turn).agg(F.min(rank).alias("r"))
    return best.select(turn, tx.lookup("r", {i: m for m, i in order.items()}).alias("mode"))


def trace_rollup(steps: DataFrame, turn: str = "turn") -> DataFrame:
    """Per turn: model and tool time and how often each ran. ``steps``: ``turn, kind (llm|tool), ms``."""
    llm, tool = F.col("kind") == "llm", F.col("kind") == "tool"
    return steps.groupBy(turn).agg(
        F.count_if(llm).alias("n_iterations"), F.count_if(tool).alias("n_tool_calls"),
        F.round(F.coalesce(F.sum(F.when(llm, F.col("ms"))), F.lit(0.0)), 1).alias("llm_ms_total"),
        F.round(F.coalesce(F.sum(F.when(tool, F.col("ms"))), F.lit(0.0)), 1).alias("tool_ms_total"))


def trace_totals(traces: DataFrame) -> DataFrame:
    """The same from nested trace records (``iterations`` and ``tool_calls`` arrays)."""
    ms = lambda c, f: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x[f]), 1)
    return traces.withColumn("n_iterations", F.size("iterations")).withColumn("n_tool_calls", F.size("tool_calls")).withColumn(
        "llm_ms_total", ms("iterations", "llm_ms")).withColumn("tool_ms_total", ms("tool_calls", "ms"))


def merge_results(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Bills surfaced by a turn's results: first-seen order, first non-null value per field.

    ``rows``: ``turn, bill_id, seen, relevance, <fields>``. Relevance is divided by the turn's best.
    """
    seen = F.col("seen")
    g = rows.groupBy("turn", "bill_id").agg(
        F.min("seen").alias("first_seen"), *[first_non_null(F.col(f), seen).alias(f) for f in [*fields, "relevance"]])
    best = g.groupBy("turn").agg(F.max("relevance").alias("best"))
    rel = F.when(F.col("best") > 0, F.col("relevance") / F.col("best")).otherwise(F.col("relevance"))
    return g.join(best, "turn").withColumn("relevance", rel).drop("best")


def response_label(response) -> Column:
    """One-line summary of a tool response (JSON text)."""
    raw = tx.col(response)
    v = F.try_parse_json(raw)
    get = lambda path, t: F.try_variant_get(v, path, t)
    kind = F.schema_of_variant(v)
    is_obj = kind.startswith("OBJECT") | (kind == "STRUCT<>")
    out = F.when(v.isNull(), F.concat(F.lit("<unparseable response, "), F.length(raw).cast("string"), F.lit(" chars>")))
    out = out.when(is_obj & get("$.error", "string").isNotNull(), F.concat(F.lit("error: "), F.substring(get("$.error", "string"), 1, 80)))
    out = out.when(is_obj & F.coalesce(get("$.not_found", "boolean"), F.lit(False)), "not_found")
    for key in fixed.TOOL_LIST_KEYS:
        items = get(f"$.{key}", "array<variant>")
        out = out.when(is_obj & items.isNotNull(), F.concat(F.size(items).cast("string"), F.lit(f" {key}")))
    out = out.when(is_obj & get("$.bill_id", "string").isNotNull(), F.concat(F.lit("bill_id="), get("$.bill_id", "string")))
    sid = get("$.section_id", "string")
    out = out.when(is_obj & sid.isNotNull(), F.concat(F.lit("section="), F.right(sid, F.lit(50))))
    name = (F.when(is_obj, "dict").when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool")
            .when(kind == "VOID", "NoneType").when(kind == "BIGINT", "int").otherwise("float"))
    return out.otherwise(F.concat(F.lit("<"), name, F.lit(">")))
