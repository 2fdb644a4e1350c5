"""The operators as registered queries over whole tables, each with the digest columns of its contract."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import (bpe, decontaminate, exact, jaccard, phrases, quality, quality_model, repair, secrets, shards, tokenfile, urls,
                          warc)
from lexweave.llm.common import fresh_uri
from lexweave.llm.twins import SQL

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SHARDS = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archives back; lengths and digests are those of the payloads read."""
    path = fresh_uri(spark, "warc")
    warc.write(warc.records(table(spark, sf_dir, "pages")), path)
    read = warc.read(spark, path)
    response = F.col("record_type") == "response"
    key = lambda c: warc.page_key(F.col(c)).try_cast("long")
    return read.select(
        key("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", key("refers_to").alias("refers_to"))


def joined_ids(ids: Column) -> Column:
    return F.concat_ws(",", ids.cast("array<string>"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.encode(docs, TOKENIZER, keep_text=False, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined_ids(F.col("ids")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@query
def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_join(F.array_sort(F.col("_items").cast("array<string>")), ",")
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                         F.sha2(ids, 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


@query
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.fresh_path(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), TOKENIZER, END_ID, path)
    rows = tokenfile.read(spark, path, ids=False, checksum=True)
    return rows.join(tokenfile.file_starts(spark, path), "file").select(
        F.col("key").alias("doc_id"), (F.col("file_start") + F.col("first")).alias("start"),
        "n_tokens", F.col("checksum").alias("ids_crc32"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in secrets.BASE]))
    return found.select("doc_id", *[of(k.name).alias(f"n_{k.name}") for k in secrets.BASE],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.audit(repair.damaged(rows), rows.select(F.col("conv_id").alias("conv")).distinct()).withColumnRenamed("conv", "conv_id")


__all__ = ["QUERIES", "SQL"]
