"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read by the next."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, decontaminate, jaccard, quality, secrets
from lexweave.llm.queries import TOKENIZER
from lexweave.sources.tables import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that one owner alone holds struck out of the text."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids; ``exact`` tells whether decoding gave the text back."""
    coded = bpe.encode(docs.select(*COLUMNS), TOKENIZER, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_values), ("BPE encoding", token_ids)]

#: Token ids have no SQL form; tests hold the rows against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, fn) in enumerate(STAGES):
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
