"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""
import brute
import contextlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import bpe, decontaminate, exact, jaccard, phrases, quality, quality_model, repair, secrets, shards, tokenfile, urls, warc
from lexweave.llm.queries import TOKENIZER

SHA = ("doc_id", "n", "i", "d")


def coded(df, **options):
    rows = bpe.decode(bpe.encode(df.select("doc_id", "text"), TOKENIZER, **options), TOKENIZER)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").alias("n"), F.sha2(ids, 256).alias("i"), F.sha2("decoded", 256).alias("d"))


def test_bpe(odd_docs, odd_rows):
    same(coded(odd_docs), brute.bpe(odd_rows), *SHA)


def test_bpe_over_many_tasks(odd_docs, odd_rows):
    same(coded(odd_docs, leaf_bytes=7, long_bytes=64), brute.bpe(odd_rows), *SHA)


def test_bpe_of_nothing(odd_docs):
    assert coded(odd_docs.where("false")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abeilnorst\u00e9 \n'1!")), st.integers(1, 9))
def test_tree_concatenation_is_exact(text, leaf):
    c = bpe.codec(TOKENIZER)
    data = text.encode()
    assert c.halves(data, leaf) == c.merge(data)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_chunks_do_not_change_ids(texts):
    from lexweave.llm.common import text_bytes
    e = bpe.codec(TOKENIZER).encode(*text_bytes(pa.array(texts, pa.string())), leaf=5)
    want = [x.ids for x in brute.tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [e.ids[a:b].tolist() for a, b in zip(e.at[:-1], e.at[1:])] == want


def test_token_files(spark, odd_docs, odd_rows, tmp_path):
    path = str(tmp_path / "t")
    tokenfile.write(odd_docs, TOKENIZER, 2, path, file_tokens=500)
    rows = tokenfile.read(spark, path, ids=True, checksum=True)
    told = rows.join(tokenfile.file_starts(spark, path), "file").select(
        F.col("key").alias("doc_id"), (F.col("file_start") + F.col("first")).alias("start"), "n_tokens", "checksum")
    ends = sorted(r.start + r.n_tokens for r in told.collect())
    assert sorted(r.start for r in told.collect()) == [0, *ends[:-1]]
    want = [(k, n, c) for k, _, n, c in brute.token_files(odd_rows)]
    same(told, want, "doc_id", "n_tokens", "checksum")
    same(rows.select(F.size("ids").cast("long").alias("n"), "n_tokens"), [(n, n) for _, n, _ in want], "n", "n_tokens")
    tokenfile.write(odd_docs.where("false"), TOKENIZER, 2, path + "0")
    assert tokenfile.read(spark, path + "0").collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=70), st.integers(0, 100))
def test_blocks(ids, percentile):
    body = tokenfile.encode_block(np.array(ids, np.uint32), percentile)
    assert tokenfile.decode_block(memoryview(body), 0).tolist() == ids


def test_token_file_reads_any_stretch():
    ids = np.arange(1000, dtype=np.int32) * 7 % 501
    f = tokenfile.TokenFile.open(tokenfile.file_body(np.array([5]), bpe.Encoded(ids, np.array([0, 1000])), block=64))
    assert all((f.tokens(a, n) == ids[a: a + n]).all() for a, n in ((0, 1000), (0, 0), (63, 2), (64, 64), (990, 10), (1, 130)))


def test_quality_rules(odd_docs, odd_rows):
    same(quality.judge(odd_docs), brute.quality(odd_rows), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert quality.judge(odd_docs.where("false")).collect() == []


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs"), (2, "w5 w6 w7"), (3, None), (None, "k k k"), (4, "!!"), (5, ""),
         (6, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 w30 w31"), (6, "w90"), (7, "w5 W6 w7"), (8, "中文 中文")]


def marked(df, items, **options):
    m = decontaminate.mark(df, items, **options)
    told = F.sha2(F.array_join(F.array_sort(F.col("_items").cast("array<string>")), ","), 256)
    return m.select("doc_id", "_n_words", "_n_hit", F.size("_items").alias("k"), told.alias("s"), (F.col("_n_hit") > 0).alias("c"))


def test_decontaminate(spark, odd_docs, odd_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    merged = [(i, t) for i, t in ITEMS if i is not None and t is not None]
    want = list(brute.decontaminate(odd_rows, [x for x in merged if x != (6, "w90")]))
    plain = items.where("text != 'w90' or text is null")
    same(marked(odd_docs, plain), want, "doc_id", "_n_words", "_n_hit", "k", "s", "c")
    same(marked(odd_docs, plain, block_bytes=20), want, "doc_id", "_n_words", "_n_hit", "k", "s", "c")
    assert marked(odd_docs, items.where("false")).where("_n_hit > 0").count() == 0
    clean = {r.doc_id for r in decontaminate.decontaminate(odd_docs, items).select("doc_id").collect()}
    assert clean == {r.doc_id for r in marked(odd_docs, items).where("_n_hit = 0").collect()}


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Ünder W5, w6 -- w7; end é w5 w6 w7"), (2, "w5 w6"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(2, "w5 w6 w7")], "item_id long, text string")
    cut = decontaminate.decontaminate(docs, items, remove="spans").orderBy("doc_id").collect()
    assert [r.text for r in cut] == ["Ünder ; end é ", "w5 w6", None]


def test_jaccard(odd_docs, odd_rows):
    rows = jaccard.similar(odd_docs)
    same(rows, brute.jaccard(odd_rows), "doc_id", "n_shingles", "component_id")
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == rows.where("n_shingles > 0").select("group").distinct().count() + rows.where("n_shingles = 0").count()
    assert jaccard.similar(odd_docs.where("false")).collect() == []


def test_jaccard_of_chains_and_blocks(spark, monkeypatch):
    """Chains of near copies, each a little further on, in cells cut into small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i: 4 * i + 100])) for i in range(60)] + [(100 + i, " ".join([*words[:60], *(f"u{i}x{j}" for j in range(40 - i))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(jaccard.similar(df), brute.jaccard(rows), "doc_id", "n_shingles", "component_id")


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 6, (30, jaccard.GROUPS)).astype(np.int32)
    points = np.maximum(0, base[rng.integers(0, 30, 500)] + rng.integers(-1, 2, (500, jaccard.GROUPS))).astype(np.int32)
    sizes = points.sum(1).astype(np.int64)
    t = jaccard.Tree.pack(points, sizes)
    for i in range(50):
        want = np.flatnonzero(jaccard.may_link(np.minimum(points[i], points).sum(1), int(sizes[i]), sizes))
        assert sorted(t.search(points[i], int(sizes[i]))[0].tolist()) == want.tolist()


def test_shards(odd_docs):
    rows = shards.assign(odd_docs, 4, bin_bits=3)
    atoms = odd_docs.select(F.coalesce(F.xxhash64(F.when(F.col("text").isNotNull(), F.col("text"))), F.lit(0)).alias("h"), "text").collect()
    keyed = [(0 if r.text is None else r.h, 1 + len((r.text or "").encode())) for r in atoms]
    per = rows.groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d")).collect()
    assert max(r.s for r in per) == brute.shards(keyed, 4)
    assert all(r.b == r.n - 1 and r.d == r.n for r in per)
    assert rows.count() == odd_docs.count()
    assert shards.assign(odd_docs.where("false")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-40, 40), st.integers(1, 30)), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 6))
def test_cuts_equal_those_over_all_atoms(rows, n, bits):
    """The refinement with driver-side sums alone, against a search over all atoms."""
    scaled = [(k << 57, s) for k, s in rows]
    spread = _cuts(scaled, n, bits)
    load = {}
    for k, s in scaled:
        shard = sum(k >= c for c in spread)
        load[shard] = load.get(shard, 0) + s
    assert max(load.values()) == brute.shards(scaled, n) and len(load) <= n


def _cuts(rows, n, bits, asked=None):
    def sums(ranges, split):
        got = {}
        for k, s in rows:
            of = [None] if ranges is None else [p for p in ranges if p.least <= k <= p.greatest]
            for p in of:
                shift = max(0, (64 if p is None else p.shift) - split)
                a, b, t, _ = got.get((k >> shift, shift), (k, k, 0, 0))
                got[k >> shift, shift] = (min(a, k), max(b, k), t + s, shift)
        if asked is not None:
            asked.append(0 if ranges is None else len(ranges))
        return [shards.Piece(*p) for p in got.values()]
    return shards.refine(sums, n, bits)


def test_large_atoms_do_not_widen_the_search():
    """With one atom of any share, a round asks for a few ranges per shard, and the shards are the best there are."""
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 63), 1 << 63, 30_000, np.int64).tolist()
    sizes = rng.integers(1, 5000, 30_000).tolist()
    for share in (0.03, 0.06, 0.12, 0.3, 0.6):
        hot = int(sum(sizes) * share / (1 - share))
        rows, asked = [*zip(keys, sizes), (keys[777], hot)], []
        found, load = _cuts(rows, 8, 12, asked), np.zeros(8, np.int64)
        for k, s in rows:
            load[sum(k >= c for c in found)] += s
        assert load.max() == brute.shards(rows) and max(asked) <= 6 * 8 and len(asked) <= 40 and (load > 0).all(), (share, asked)


def test_shards_with_a_hot_text(spark):
    """200,000 texts beside one that holds 5 % or a third of the bytes; sizes and checksums against plain ones."""
    import zlib
    for share in (20, 2):
        text = F.when(F.col("id") % share == 0, F.repeat(F.lit("hot text "), 8)).otherwise(F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256)))
        df = spark.range(200_000 * share // (share - 1)).select(F.col("id").alias("doc_id"), text.alias("text"))
        rows = shards.assign(df, 8, keep=("doc_id", "text")).toPandas()
        assert len(rows) == df.count() and (rows["size"] == rows["text"].str.len() + 1).all()
        some = rows.iloc[::997]
        assert [zlib.crc32(t.encode()) for t in some["text"]] == some["text_crc32"].tolist()
        assert rows.groupby("text")["shard"].nunique().max() == 1
        load = rows.groupby("shard")["size"].sum()
        hot = rows.loc[rows["text"].str.startswith("hot"), "size"].sum()
        assert load.max() <= max(hot, load.sum() / 8 + 10_000) and len(load) == 8
        slots = rows.groupby("shard")["slot"].agg(["min", "max", "nunique", "count"])
        assert (slots["min"] == 0).all() and (slots["max"] == slots["count"] - 1).all() and (slots["nunique"] == slots["count"]).all()


def test_secrets(odd_docs, odd_rows):
    rows = secrets.scan(odd_docs)
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k))
    base = F.filter("spans", lambda s: s["kind"] != "mixed")
    told = rows.select("doc_id", of("assign").alias("a"), of("access").alias("b"), of("hex").alias("c"), F.sha2(text(base), 256).alias("s"))
    same(told, brute.secrets(odd_rows), "doc_id", "a", "b", "c", "s")
    assert secrets.scan(odd_docs.where("false")).collect() == []


def test_owners_decide(spark):
    mine, shared, base = "Zx9" + "aB3" * 8, "Qy8" + "cD4" * 8, "password=hunter2000"
    rows = [(1, f"a {mine} b", "o1"), (2, f"{shared}", "o1"), (3, f"{shared} {base}", "o2"), (4, base, "o3"), (5, None, None), (6, f"x {mine}", "o1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = {r.doc_id: [(s.kind, s.start, s.verdict, s.owners) for s in r.spans] for r in secrets.scan(df).collect()}
    assert spans == {1: [("mixed", 2, "live", 1)], 2: [], 3: [("assign", 28, "example", 2)], 4: [("assign", 0, "example", 2)], 5: [], 6: [("mixed", 2, "live", 1)]}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean == {1: "a [secret] b", 2: shared, 3: f"{shared} {base}", 4: base, 5: None, 6: "x [secret]"}


def test_long_runs_of_matches(spark):
    text = " ".join(["0123456789abcdef01234567"] * 20000)
    df = spark.createDataFrame([(1, text, "o")], "doc_id long, text string, source string")
    got = secrets.scan(df).select(F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("e")).first()
    assert (got.n, got.e) == (20000, len(text))


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://a.NET/x", "http://example.net/en/1", "https://b.example.net/en", "x://example.com/de/?q", "x://example.com?/de/",
        "http://q.org/fr/a#b", "http://org//fr/", "http://fakeexample.com/de/", "a://b://net/", "http://..net/", "http://x.net\n/\ny", "http://é.net/ü", "http://net"]


def test_urls(spark):
    rules = [*urls.RULES, ("block", "q.org", "/fr/"), ("allow", None, "/"), ("block", "Net", None), ("allow", "net", "/")]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, short string")
    df = spark.createDataFrame(rules, "verdict string, host string, path string")
    want = brute.urls([(i, u) for i, u in enumerate([*URLS, URLS[4]])], [*urls.RULES, ("block", "q.org", "/fr/")])
    same(urls.judge(pages, df), want, "page_id", "host", "path", "rule", "verdict")
    assert urls.judge(pages.where("false"), df).collect() == []
    assert urls.judge(pages, df.where("false")).where("verdict != 'allow' or rule is not null").count() == 0


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 20
    rows = [(1, "http://a/%41 ü\r\nX: y", big), (2, None, big), (0, "u", None), (5, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", big), (1, "again", big),
            (9, "u", "WARC/1.1\r\n\r\n" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file:{tmp_path}/w"
    warc.write(warc.records(pages), path, split_bytes=300)
    got = warc.read(spark, path)
    key = lambda c: warc.page_key(F.col(c)).try_cast("long")
    assert got.where("record_id is null").count() == 0
    told = got.select(key("record_id").alias("k"), "payload_bytes", F.regexp_replace("payload_digest", "sha256:", "").alias("d"), "record_type", key("refers_to").alias("r"))
    same(told, brute.warc(rows), "k", "payload_bytes", "d", "record_type", "r")
    same(got, [(u,) for _, u, _ in rows], "uri")
    whole = {r.payload_digest[7:]: bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert set(whole.values()) == {t or "" for _, _, t in rows}
    plan = got.where("record_type = 'revisit'")
    assert plan.count() == 2 and "payload" not in warc.read(spark, path, payload=False).columns
    warc.write(warc.records(pages.where("false")), path + "0")
    assert warc.read(spark, path + "0").collect() == []


def test_token_files_of_many_null_and_least_keys(spark, tmp_path):
    """Null keys span files and tasks and stay apart from the least long; starts follow without a gap."""
    rows = [(None, f"n {i}") for i in range(40)] + [(-(1 << 63), "least"), (5, "five"), (5, "five again")]
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), TOKENIZER, 2, str(tmp_path / "t"), file_tokens=9)
    got = tokenfile.read(spark, str(tmp_path / "t"), ids=False).join(tokenfile.file_starts(spark, str(tmp_path / "t")), "file").collect()
    got = sorted(((r.file_start + r.first, r.n_tokens, r.key) for r in got))
    assert [k for _, _, k in got] == [None] * 40 + [-(1 << 63), 5, 5]
    assert [s for s, _, _ in got] == [0, *np.cumsum([n for _, n, _ in got])[:-1].tolist()]


def test_warc_appends_and_replaces(spark, tmp_path):
    """Two appends read back whole, archives without a manifest count only if they are not our own, overwrite replaces all."""
    path = f"file:{tmp_path}/w"
    pages = lambda a, b: warc.records(spark.range(a, b).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")))
    warc.write(pages(0, 5), path)
    warc.write(pages(5, 9), path)
    ids = lambda: sorted(int(r.payload) for r in warc.read(spark, path).collect())
    assert ids() == list(range(9))
    (tmp_path / "w" / "lexweave-of-a-lost-task.warc").write_bytes(warc.record({"record_type": "response"}, b"77"))
    (tmp_path / "w" / "other.warc").write_bytes(warc.record({"record_type": "response"}, b"99"))
    assert ids() == [*range(9), 99]
    warc.write(pages(20, 22), path, mode="overwrite")
    assert ids() == [20, 21]


FOREIGN = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 7\r\n\r\nhello\r\n\r\n\r\n"
           b"WARC/1.1\r\nwarc-type:response\r\nWARC-Target-URI: http://a/%41?q=%e9\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Other: a\r\n  folded\r\n"
           b"WARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 26\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\n" + b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: b\r\n c\r\n"
           b"Content-Length: 200000\r\n\r\n" + b"z" * 200000 + b"\r\n\r\n")


def test_warc_of_others(spark, tmp_path):
    """Hand-written archives, plain, gzipped whole and by record; headers as they are, folded ones joined."""
    import gzip
    cut = [FOREIGN.index(b"WARC/1.1\r\nwarc-type"), FOREIGN.index(b"WARC/1.1\r\nWARC-Type: response")]
    members = [FOREIGN[: cut[0]], FOREIGN[cut[0]: cut[1]], FOREIGN[cut[1]:]]
    (tmp_path / "a.warc").write_bytes(FOREIGN)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(FOREIGN))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "notes.txt").write_bytes(b"x")
    rows = warc.read(spark, f"file:{tmp_path}").collect()
    want = [("warcinfo", None, 7, b"hello\r\n"), ("response", "http://a/%41?q=%e9", 26, FOREIGN[FOREIGN.index(b"WARC/1.1\r\n\r\n\r\n"):][:26]), ("response", "b c", 200000, b"z" * 200000)]
    assert sorted((r.record_type, str(r.uri), r.payload_bytes, bytes(r.payload)) for r in rows) == sorted((t, str(u), n, p) for t, u, n, p in want * 3)
    some = warc.read(spark, f"file:{tmp_path}", columns=("uri", "record_type")).where("record_type = 'response' and uri like 'http://%'")
    assert [r.uri for r in some.collect()] == ["http://a/%41?q=%e9"] * 3


def test_warc_pushes_filters_and_skips_payloads(spark, tmp_path):
    warc.write(warc.records(spark.createDataFrame([(1, "u", "a" * 500), (2, "v", "a" * 500)], "page_id long, url string, html string")), f"file:{tmp_path}/w")
    some = warc.read(spark, f"file:{tmp_path}/w").where("record_type = 'revisit' and uri in ('u', 'v')")
    said = some._jdf.queryExecution().explainString(some._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert some.count() == 1 and "* Filter (" not in said, said
    reads: list[tuple[int, int]] = []
    class Watched(warc.Plain):
        def get(self, at, n):
            reads.append((at, n))
            return super().get(at, n)
    reader = warc.WarcReader(f"file:{tmp_path}/w", ["uri"])
    reader.tests.append(("record_type", "EqualTo", "revisit"))
    for part in reader.partitions():
        s = part.value
        with open(f"{tmp_path}/w/{s.file}", "rb") as f:
            for row, length, at in warc.headers(Watched(f), s.start, s.end):
                assert not any(at < a + 1 and a >= at and a < at + length for a, _ in reads)


def test_decontaminate_by_join_in_bulk(spark):
    """Ten windows in common, over many texts and items with text ids, by the set and by the join; one window in a third of all texts."""
    rng = np.random.default_rng(3)
    w = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    items = [(f"i{k}", w(int(rng.integers(1, 30)))) for k in range(60)] + [("same", "w1 w2 w3"), ("same", "w1 w2 w3"), ("é", None)]
    texts = [(k, " ".join([w(int(rng.integers(0, 60))), items[k % 60][1] if k % 5 == 0 else "", items[7][1] if k % 3 == 0 else ""])) for k in range(400)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string")
    told = lambda **o: [(r.doc_id, r._n_words, r._n_hit, r._items, r._spans) for r in decontaminate.mark(docs, bench, **o).orderBy("doc_id").collect()]
    assert told() == told(block_bytes=1)
    joined = [(i, " ".join(t for k, t in items if k == i and t)) for i in dict.fromkeys(k for k, _ in items) if i != "same"] + [("same", "w1 w2 w3")]
    want = {k: (n, h, c) for k, n, h, c, _, _ in brute.decontaminate(texts, joined)}
    assert {k: (n, h, len(i)) for k, n, h, i, _ in told()} == want


def test_a_large_benchmark_compiles_at_once():
    """4 MB of item text in a few seconds."""
    import time
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 200)) for _ in range(3000)]
    t = time.time()
    bench = decontaminate.compile_items(list(range(len(texts))), pa.array(texts, pa.large_string()))
    assert time.time() - t < 20 and sum(len(x.hashes) for x in bench.by_length) > 500_000


def test_quality_model(spark, odd_docs):
    labels = spark.createDataFrame([(i, int(i > 14)) for i in range(30)] + [(3, None), (None, 1)], "doc_id long, quality int")
    m = quality_model.train(odd_docs, labels, F.lit(True))
    rows = quality_model.score(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    alike = {}
    for r in rows:
        assert alike.setdefault(r.text or "", r.score) == r.score
    one = quality_model.train(odd_docs, labels.where("quality = 1"), F.lit(True))
    assert {round(r.score, 2) for r in quality_model.score(odd_docs, one).collect()} == {0.99}
    none = quality_model.train(odd_docs.where("false"), labels, F.lit(True))
    assert {r.score for r in quality_model.score(odd_docs, none).collect()} == {0.5}
    assert quality_model.score(odd_docs.where("false"), m).collect() == []


def test_count_vectors_of_any_size():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, top, jaccard.GROUPS).astype(np.int32) for top in (1, 16, 17, 256, 257, 1 << 30)]
    for r, size in zip(rows, (128, 128, None, None, None, 1024)):
        assert size is None or len(jaccard.packed(r)) == size
    held = pa.array([b"?", *map(jaccard.packed, rows)], pa.binary())[1:]
    assert (jaccard.unpacked(held) == np.array(rows)).all()
    assert jaccard.unpacked(held[:0]).shape == (0, jaccard.GROUPS)


def test_cross_blocks_of_equal_halves_are_searched():
    """Two classes of one component on the left, two other components on the right, all alike."""
    rows = pa.RecordBatch.from_pydict({
        "cell": [7] * 4, "block": [1] * 4, "cls": [10, 11, 20, 21], "comp": [1, 1, 2, 3], "n": [jaccard.GROUPS] * 4, "side": [0, 0, 1, 1],
        "counts": pa.array([jaccard.packed(np.ones(jaccard.GROUPS, np.int32))] * 4, pa.binary())})
    for best in (True, False):
        got = {(x, y) for b in jaccard.searched(iter([rows]), best) for x, y in zip(*(c.to_pylist() for c in b.columns))}
        assert got == {(10, 20), (10, 21), (11, 20), (11, 21)}


def test_quality_of_the_end_of_a_long_text():
    """Good words after 4 MB of other bytes count as much as before them."""
    rng = np.random.default_rng(5)
    good, bad = (rng.integers(0, 256, quality_model.DICTIONARY_BYTES, np.uint8).tobytes() for _ in range(2))
    other = rng.integers(0, 256, 4 << 20, np.uint8).tobytes()
    m = quality_model.Model(good, bad, ())
    first, last, none = quality_model.features([good + other, other + good, other], m)[:, 1]
    assert last > 0.1 and abs(first - last) < 0.05 and abs(none) < 0.01


def test_quality_sample_passes_over_a_text_that_does_not_fit(spark):
    rows = [(i, f"good words of text {i} " * 9) for i in range(20)] + [(100 + i, f"BAD!! {i} " * 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    first = docs.where("doc_id < 100").orderBy(F.xxhash64("doc_id")).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 100)).otherwise(F.col("text")))
    m = quality_model.train(long, labels, F.lit(True), sample_bytes=5000)
    assert m.good and m.bad
    assert all((r.score > 0.5) == (r.doc_id < 100) for r in quality_model.score(docs, m).collect())


def test_few_of_many_owners_hold_a_live_secret(spark):
    """Two of 20 owners make no example, nor do 1001 documents of one; half of the owners do."""
    two, many, wide = (k + "aB3" * 8 for k in ("Tw9", "Mn8", "Wd7"))
    rows = [(i, f"x {wide}" if i < 10 else "x", f"o{i}") for i in range(20)] + [(30, f"y {two} AKIA{'Q' * 16}", "o1"), (31, f"y {two} AKIA{'Q' * 16}", "o2")]
    rows += [(1000 + i, f"z {many}", "o3") for i in range(1001)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = {r.doc_id: [(s.kind, s.verdict) for s in r.spans] for r in secrets.scan(df).collect()}
    assert spans[0] == [] and spans[30] == spans[31] == [("mixed", "live"), ("access", "live")] and spans[1000] == [("mixed", "live")]
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] == f"x {wide}" and clean[30] == clean[31] == "y [secret] [secret]" and clean[2000] == "z [secret]"
    assert [secrets.widely(n) for n in (0, 1, 2, 3, 4, 6, 20, 1000)] == [2, 2, 2, 2, 3, 5, 5, 100]


def test_repositories_are_counted_apart_from_owners(spark):
    """One repository under three owners is one; two owners with a good share of all repositories make an example; names may clash."""
    shared, wide, own = (k + "xY7" * 8 for k in ("Sh1", "Wi2", "Ow3"))
    rows = [(1, f"a {shared}", o) for o in ("o1", "o2", "o3")] + [(100 + i, f"b {wide}", f"o{i % 2}") for i in range(120)] + [(1000 + i, f"c {own} {i}", "o4") for i in range(120)]
    rows += [(5000 + i, "plain", f"o{i}") for i in range(40)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, _found int, _key int, _live int")
    told = {(s.hash, s.owners, s.repositories, s.verdict) for r in secrets.scan(df).collect() for s in r.spans}
    import hashlib
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert told == {(h(shared), 3, 1, "live"), (h(own), 1, 120, "live")}
    clean = secrets.redact(df)
    assert clean.columns == df.columns and {r.text for r in clean.where("doc_id < 1000").collect()} == {"a [secret]", f"b {wide}"}


def test_shards_beside_a_hot_group_are_even():
    """One atom of a third of all bytes: the other seven shards share the rest, none is empty."""
    rows = [(k, 1500 if k == 7 else 100) for k in range(-15, 16)]
    scaled = [(k << 57, s) for k, s in rows]
    for bits in (1, 3, 6):
        spread, load = _cuts(scaled, 8, bits), {}
        for k, s in scaled:
            load[sum(k >= c for c in spread)] = load.get(sum(k >= c for c in spread), 0) + s
        assert len(load) == 8 and max(load.values()) == 1500 and sorted(load.values())[-2] <= 500


@contextlib.contextmanager
def small_batches(spark, rows):
    """Arrow batches of so few rows that every stream crosses many of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_exact(spark, odd_docs, odd_rows, batch):
    with small_batches(spark, batch):
        same(exact.mark(odd_docs), brute.exact(odd_rows), "doc_id", "_keep", "_n", "_kept", "_digest")
        kept = exact.keep_one(odd_docs)
        assert kept.columns == odd_docs.columns and kept.count() == len({d[4] for d in brute.exact(odd_rows)})
        assert exact.mark(odd_docs.where("false")).collect() == []


def test_exact_of_a_hot_text(spark):
    """A third of 30,000 rows is one text, under text keys; three rounds of lanes."""
    df = spark.range(30_000).repartition(16).select(F.concat(F.lit("k"), F.lpad("id", 6, "0")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(
        F.concat(F.lit("hot \t"), F.col("id").cast("string"))).alias("text"))
    run = exact.mark(df).collect()
    hot = [r for r in run if r._n > 1]
    assert len(run) == 30_000 and len(hot) == 10_000 and {(r._keep, r._n) for r in hot} == {("k000000", 10_000)}
    assert [r.doc_id for r in hot if r._kept] == ["k000000"] and all(r._kept and r._keep == r.doc_id for r in run if r._n == 1)
    assert exact.digits_for(1) == 2 and exact.digits_for(1 << 30) == 3 and exact.digits_for(10 ** 13) == 6


PHRASE_TEXTS = ["New York city, new york CITY! the the the the the\nthe new york", "new york city hall is in new york city hall", None, "", " \t ", "a.b.c", "x " * 40,
                "\u00c9a \u00e9a \u00c9a \u00e9a. \u00c9a \u00e9a", "one two three four five six seven " * 6, "one two three four five six seven", "the\u00a0new york"]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_phrases(spark, monkeypatch, least):
    """Odd texts, repeated rows, null languages; many small ranges and sent parts."""
    monkeypatch.setattr(phrases, "PIECE_BYTES", 64)
    monkeypatch.setattr(phrases, "STATES", 20)
    rows = [(i, t, [None, "en", "und"][i % 3], 1) for i, t in enumerate(PHRASE_TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, a int").repartition(3)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for inside in (100, 60):
        want = list(brute.phrases([(r[2], r[1]) for r in rows if r[2] != "und"] + [(None, r[1]) for r in rows if r[2] == "und"], least, keep=7, inside=inside))
        same(phrases.mine(df, least=least, keep=7, inside=inside), want, *columns)
    assert phrases.mine(df.where("false")).collect() == []


def test_minimal_automata_keep_their_paths():
    from lexweave.llm import automaton as am
    rng = np.random.default_rng(2)
    alphabet = np.unique(rng.integers(1, 1 << 62, 9).astype(np.uint64))
    def made():
        rows = np.unique(rng.integers(0, len(alphabet), (200, 4)), axis=0)
        for row in rows[::3]:
            row[rng.integers(1, 4):] = -1
        rows = np.unique(rows, axis=0)
        n = rng.integers(1, 3, len(rows))
        want = {}
        for row, w in zip(rows.tolist(), n.tolist()):
            for k in range(1, 5):
                if row[k - 1] >= 0:
                    key = tuple(alphabet[row[:k]].tolist())
                    want[key] = want.get(key, 0) + w
        return am.build(rows, n, alphabet), want
    def told(a):
        return {tuple(s): int(w[-1]) for k in range(len(a.labels)) for s, w in zip(am.paths(a, k)[0].tolist(), am.paths(a, k)[1])}
    (a, x), (b, y) = made(), made()
    both = {k: x.get(k, 0) + y.get(k, 0) for k in {*x, *y}}
    assert told(a) == x and told(am.unpack(am.pack(b))) == y and told(am.united([a, b])) == both
    assert told(am.pruned(am.united([a, b]), 6)) == {k: w for k, w in both.items() if w >= 6}
    asked = np.array([list(k) + [0] * (4 - len(k)) for k in both] + [[5, 0, 0, 0]], np.uint64)
    assert am.composed(am.united([a, b]), asked, np.array([len(k) for k in both] + [1])).tolist() == [*both.values(), 0]
    few = am.pack(am.build(np.array([[i, 3, 4] for i in range(3)]), np.ones(3, np.int64), alphabet))
    assert few["sizes"] == [1, 3, 1, 1, 1, 1]  # three ways, one continuation


TURNS = [(1, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("user", "Hi."), ("user", "Hi."), ("assistant", "Yes"), ("tool", "x."), ("user", " \n"), ("assistant", "Ok!")])]
TURNS += [(2, None, "user", "q."), (2, None, None, None), (2, 5, "assistant", "a."), (2, 9, "assistant", "a."), (None, 1, "assistant", "b?"), (None, None, "", "c."), (3, 0, "system", "only.")]
TURNS += [(4, t, "ua"[t % 2] + "x", f"long {t}.") for t in range(300)] + [(5, 7, "user", "same.")] * 40 + [(6, t, "assistant", f"{t}!") for t in range(50)]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_conversations(spark, monkeypatch, block):
    """Odd conversations in blocks of four rows and in one; repaired turns give the digests."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    df = spark.createDataFrame([(*r, "x") for r in TURNS], "conv_id long, turn long, role string, text string, cost string").repartition(5)
    names = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    with small_batches(spark, 50):
        ids = df.select(F.col("conv_id").alias("conv")).distinct()
        want = list(brute.conversations(TURNS))
        same(repair.audit(repair.damaged(df), ids), want, *names)
        turns = repair.repaired(repair.damaged(df)).collect()
        assert repair.audit(df.where("false")).collect() == [] and repair.repaired(df.where("false")).collect() == []
    for conv, *_, audit, sha in want:
        mine = sorted((r for r in turns if r.conv == conv), key=lambda r: r.place)
        assert brute.sha("\n".join(f"{r.role}:{r.text}" for r in mine)) == sha and "".join(r.edit for r in mine) == audit.replace("D", "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), min_size=1, max_size=30), min_size=1, max_size=6))
def test_grammar_gives_the_cheapest_audits(rows):
    """Matrices and ropes of the grammar against trying every way turn by turn."""
    symbols = np.array([s for r in rows for s in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    g, roots, _ = repair.repair_pairs(symbols, owner)
    _, _, letters = repair.row_edits()
    for row, root in zip(rows, roots):
        ways = {0: (0, "")}
        for s in row:
            new = {}
            cost, _, _ = repair.row_edits()
            for i, (c, a) in ways.items():
                for k in range(4):
                    if letters[s][i][k]:
                        w = (c + int(cost[s, i, k]), a + letters[s][i][k])
                        new[k] = min(new.get(k, w), w)
            ways = new
        for k, (c, a) in ways.items():
            assert g.cost[root, 0, k] == c
            got = repair.unrolled(g, np.array([root]), np.array([0]), np.array([k]))
            assert "".join(letters[s][i][j] for s, i, j in zip(*(x.tolist() for x in got))) == a
