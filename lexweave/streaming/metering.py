"""Usage metering on streams: lifetime totals and the cap, with no event-time eviction."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from lexweave import schemas
from lexweave.operators import usage
from lexweave.session import ship_package


def read_calls(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed usage events as a file stream."""
    return spark.readStream.schema(schemas.CALL_DDL).format(fmt).load(path)


def totals_stream(calls: DataFrame) -> DataFrame:
    """Lifetime totals per account; Spark's state store keeps one row per account.

    Calls are pre-aggregated in every task, so a busy account sends one row per task.
    """
    return usage.account_totals(calls)


class Cap(StatefulProcessor):
    """An account's running total as keyed state: its calls of a micro-batch are decided in order of time."""

    def __init__(self, limit: int, exempt: list[str]):
        self.limit, self.exempt = limit, {x.strip().lower() for x in exempt}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "charged bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        kept = self.total.get()
        start = int(kept[0]) if kept else 0
        before = start + calls["tokens"].cumsum() - calls["tokens"]
        free = calls["email"].fillna("").str.strip().str.lower().isin(self.exempt)
        calls["admitted"] = free | (before < self.limit)
        calls["total_after"] = before + calls["tokens"]
        calls["charged"] = calls["tokens"].where(calls["admitted"], 0)
        self.total.update((start + int(calls["charged"].sum()),))
        yield calls

    def close(self) -> None:
        pass


def start_gate(calls: DataFrame, ledger: str, limit: int, exempt: list[str] = ()) -> StreamingQuery:
    """Decide every call of the stream, with one running total per account in the state store.

    Decisions go to the file sink under ``ledger``, whose log (which Spark compacts) and the state's
    checkpoint make each charge count once; no copies of earlier balances are kept. An account's calls of one
    micro-batch meet in one task, so ``maxFilesPerTrigger`` on the source bounds what that is.
    """
    spark = calls.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    priced = calls.withColumn("tokens", usage.charge().cast("long"))
    made = priced.withColumns({"admitted": F.lit(True), "total_after": F.lit(0).cast("long"), "charged": F.lit(0).cast("long")}).schema
    decided = priced.groupBy("user_id").transformWithStateInPandas(
        Cap(limit, list(exempt)), StructType([StructField(f.name, f.dataType) for f in made]), "Append", "None")
    return (
        decided.writeStream.format("parquet").option("path", f"{ledger}/decisions").option("checkpointLocation", f"{ledger}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )


def read_decisions(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(f"{ledger}/decisions")


def read_balances(spark: SparkSession, ledger: str) -> DataFrame:
    """``user_id, charged``: the running totals as they stand in the state store."""
    state = spark.read.format("statestore").option("stateVarName", "total").load(f"{ledger}/checkpoint")
    return state.select(F.col("key.user_id").alias("user_id"), F.col("value.charged").alias("charged"))


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """The per-day trace folders as a stream of turns with their totals."""
    from lexweave.operators.turns import trace_totals

    return trace_totals(spark.readStream.schema(schemas.TRACE_DDL + ", day string").json(path))
