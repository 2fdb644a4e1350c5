"""The pipeline on the smallest tables against a plain version of all its stages."""
import brute
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import quality


def test_pipeline(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    text = {d[0]: d[1] for d in docs}
    good = {r.doc_id for r in quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    kept = [d for d in docs if d[0] in good]
    heads = {k for k, n, c in brute.jaccard([d[:2] for d in kept]) if n == 0 or k == c}
    kept = [d for d in kept if d[0] in heads]
    clean = {k for k, *_, bad in brute.decontaminate([d[:2] for d in kept], items) if not bad}
    kept = [d for d in kept if d[0] in clean]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == {d[0] for d in kept} and all(r.exact for r in rows.values())
    t = brute.tokenizer()
    for k, r in rows.items():
        got = t.decode(r.ids, skip_special_tokens=False)
        assert got == text[k] or "[secret]" in got
        assert r.ids == t.encode(got, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 0


def test_stages_take_odd_rows(spark, sf_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"), F.lit(1).alias("hash"), F.lit("x").alias("cls"))
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs, sf_dir).count() <= docs.count()
