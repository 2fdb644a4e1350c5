"""Every registered query on the smallest tables, against the plain version of its contract."""
import brute
import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from lexweave.llm import queries, urls


def test_warc(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    same(queries.op1_warc(spark, sf_dir), brute.warc(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_bpe(spark, sf_dir, docs):
    same(queries.op2_bpe(spark, sf_dir), brute.bpe(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_quality_model(spark, sf_dir):
    rows = queries.op3_quality_model(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0
    held = rows.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.85 * held.count()
    assert rows.where("held_out").count() == rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).count()


def test_quality_scores_are_calibrated_differences(spark):
    """Scores of some texts computed anew, and the ranking of rows that were held out."""
    import zstandard as z

    from lexweave.llm import quality_model as q
    sf = "/root/testdata/sf0.1"  # 4,000 labels; a few hundred are too few for dictionaries
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels, ~queries.held_out(F.col("doc_id")))
    rows = q.score(docs, model).join(labels, "doc_id").where(queries.held_out(F.col("doc_id"))).collect()
    good, bad = (z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d)) for d in (model.good, model.bad))
    for r in rows[:40]:
        t = r.text.encode()
        a, b = (sum(len(c.compress(t[i: i + 1024])) for i in range(0, len(t), 1024)) for c in (good, bad))
        assert abs(r.score - 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * 100 * (b - a) / (len(t) + 16))))) < 1e-9
    pos, neg = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert model.weights[1] > 0 and auc > 0.99, auc


def test_decontaminate(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    same(queries.op4_decontaminate(spark, sf_dir), brute.decontaminate(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_jaccard(spark, sf_dir, docs):
    same(queries.op6_jaccard(spark, sf_dir), brute.jaccard(docs), "doc_id", "n_shingles", "component_id")


def test_token_files(spark, sf_dir, docs):
    same(queries.op7_token_files(spark, sf_dir), brute.token_files(docs), "doc_id", "start", "n_tokens", "ids_crc32")


def test_quality_rules(spark, sf_dir, docs):
    rows = queries.op8_quality_rules(spark, sf_dir)
    same(rows, brute.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows.where("kept and base_failed").count() == 0


def test_secrets(spark, sf_dir, docs):
    same(queries.op9_secrets(spark, sf_dir), brute.secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def test_urls(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    same(queries.op10_urls(spark, sf_dir), brute.urls(pages, urls.RULES), "page_id", "host", "path", "rule", "verdict")


def test_shards(spark, sf_dir):
    rows = queries.op5_shards(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("text").alias("h"), (F.octet_length("text") + 1).alias("s"))
    best = brute.shards([(r.h, r.s) for r in docs.collect()])
    assert max(r.s for r in rows.groupBy("shard").agg(F.sum("size").alias("s")).collect()) == best
    slots = rows.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d"), F.count("*").alias("n")).collect()
    assert all((r.a, r.b, r.d) == (0, r.n - 1, r.n) for r in slots) and len(slots) == 8
    assert rows.join(docs, "doc_id").groupBy("h").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_columns_of_twins(spark, sf_dir, name):
    import oracle
    ok, said = oracle.compare(spark, oracle.connect(sf_dir), sf_dir, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, said


def test_exact(spark, sf_dir, docs):
    same(queries.op11_exact(spark, sf_dir), brute.exact(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_phrases(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    same(queries.op12_phrases(spark, sf_dir), brute.phrases(rows), "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op13_conversations(spark, sf_dir), brute.conversations(rows), "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
         "repaired_sha256")
