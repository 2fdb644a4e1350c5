"""Small hand-made tables per operator."""
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import ids, text as tx
from lexweave.operators import curate, dense, graph, lookups, scoring, search, spans, tree, turns, usage
from lexweave.sources import corpus
from lexweave.streaming import metering


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


# -- ids and labels --------------------------------------------------------
def test_bill_ids(spark):
    want = {"119-hr-1736": "119-hr-1736", "bill:us/119/hr/1736": "119-hr-1736", "H.R. 1736 (119th Cong.)": "119-hr-1736",
            "HR1736 119": "119-hr-1736", "H. J. Res. 24, 118th Congress": "118-hjres-24", "S. 5": None, "nonsense": None}
    df = spark.createDataFrame([(k,) for k in want], "raw string").withColumn("n", ids.normalise_bill("raw"))
    got = {r.raw: (r.n.bill_id, r.n.status) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["S. 5"][1] == "needs_congress" and got["nonsense"][1] == "unrecognised"


def test_statute_and_package_ids(spark):
    r = one(spark, *[ids.normalise_statute(F.lit(x)) for x in ("statute:us/usc/5/552", "15/9401", "15 U.S.C. 9401", "15 USC § 9401", "odd")],
            ids.parse_package(F.lit("BILLS-118hr5949ih")), ids.parse_package(F.lit("BILLS-9x")), ids.to_legacy_section(F.lit("bill:us/118/hr/5::H4")), ids.to_section_urn(F.lit("118-hr-5::H4")))
    assert list(r)[:5] == ["statute:us/usc/5/552"] + ["statute:us/usc/15/9401"] * 3 + ["odd"]
    assert tuple(r[5]) == (118, "hr", 5949, "ih") and r[6] is None and r[7] == "118-hr-5::H4" and r[8] == "bill:us/118/hr/5::H4"


def test_labels(spark):
    long = "To establish something large. And more text that goes on and on beyond sixty characters"
    r = one(spark, tx.norm_enum(F.lit("SEC. 2.")), tx.norm_enum(F.lit("(a)")), tx.norm_enum(F.lit("SECTION 1")), tx.short_label(F.lit(long), F.lit("u")),
            tx.short_label(F.lit(None).cast("string"), F.lit("bill:us/118/hr/7")), tx.last_marker(F.lit("Sec. 3(a)(1) of x")), tx.last_marker(F.lit("Sec. 3 of x")),
            tx.short_locator(F.lit("Sec. 3(b) of H.R. 1")), tx.iso_date(F.lit("2025-02-30")), tx.person_label(F.lit("A"), F.lit("D"), F.lit("NY")), tx.ordinal_suffix(F.lit(112)), tx.clean_block(F.lit(" a \t b \n\n\n\n c ")))
    assert list(r) == ["2", "a", "1", "To establish something large", "H.R. 7", "(1)", "§ 3", "Sec. 3(b)", None, "A (D-NY)", "th", "a b\n\nc"]


# -- curation --------------------------------------------------------------
HITS = [("BILLS-119hr9ih", "2025-01-13"), ("BILLS-119hr9rh", "2025-03-01"), ("BILLS-119hr9eh", "2025-04-01"), ("BILLS-119hr9eh", "2025-03-20"),
        ("garbage", "2025-01-01"), ("BILLS-119hres5ih", "2025-01-01")]


def test_hits_and_versions(spark, tmp_path):
    with open(tmp_path / "h.json", "w") as f:
        f.writelines(json.dumps({"packageId": p, "dateIssued": d, "title": "T"}) + "\n" for p, d in HITS)
    parsed = curate.parse_hits(corpus.read_hits(spark, str(tmp_path / "h.json")))
    assert tuple(curate.skip_counts(parsed).collect()[0]) == (1, 1)
    (b,) = curate.group_hits(parsed).collect()
    assert [(v.version_code, v.date_issued) for v in b.versions] == [("eh", "2025-03-20"), ("rh", "2025-03-01"), ("ih", "2025-01-13")]
    v = parsed.where("skipped is null").select(F.lit("b").alias("bill_id"), "version_code", F.col("dateIssued").alias("date_issued"), F.col("packageId").alias("package_id"))
    assert curate.canonical_version(v).collect()[0].date_issued == "2025-03-20"
    assert curate.first_available(v).collect()[0].version_code == "eh"


def candidates(spark):
    rows = [("b1", "AI Act", None, ["x"]), ("b2", None, "uses machine learning", ["x"]), ("b3", "said aid", None, ["aid"]), ("b4", "none", None, ["On machine learning"])]
    df = spark.createDataFrame(rows, "bill_id string, title string, summary_text string, govinfo_titles array<string>")
    for c in ("short_title", "policy_area", "sponsor", "introduced_date"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    f = {"title": F.col("title"), "short_title": F.col("short_title"), "policy_area": F.col("policy_area"), "subjects": F.lit(""), "summary": F.col("summary_text")}
    return curate.score_relevance(df, f, F.col("govinfo_titles"))


def test_relevance(spark, tmp_path):
    scored = candidates(spark)
    got = {r.bill_id: (r.centrality_score, r.has_anchor, r.proposed_tier) for r in scored.collect()}
    assert got == {"b1": (4.0, True, "A"), "b2": (1.0, True, "B"), "b3": (0.0, False, "B"), "b4": (2.0, True, "B")}
    kept, rejected = curate.anchor_gate(scored)
    assert kept.count() == 3 and rejected.count() == 1
    sheet = curate.review_sheet(kept)
    corpus.write_review_sheet(sheet, str(tmp_path / "sheet"))
    back = corpus.read_review_sheet(spark, str(tmp_path / "sheet"))
    assert len(back.columns) == 12 and back.where("bill_id = 'b1'").collect()[0].match_locations == "title:AI"
    assert curate.read_reviews(back).count() == 0


def test_decisions(spark):
    s = spark.createDataFrame([("a", 2.9), ("b", 9.0), ("c", 3.0), ("d", 2.9)], "bill_id string, centrality_score double").withColumn("proposed_tier", F.lit("B"))
    r = spark.createDataFrame([("a", " Y", "a", ""), ("b", "n", "", ""), ("c", "", "", "later")], "bill_id string, `include (y/n)` string, `tier (A/B)` string, notes string")
    got = {x.bill_id: (x.included, x.final_tier, x.decided_by) for x in curate.decide(s, curate.read_reviews(r), 3.0).collect()}
    assert got == {"a": (True, "A", "human-review"), "b": (False, None, "human-review"), "c": (True, "B", "heuristic"), "d": (False, None, "heuristic")}


def test_candidate_file_promotion_and_records(spark, tmp_path):
    v = "array(named_struct('package_id', 'P', 'version_code', 'ih', 'date_issued', '2025-01-01', 'title', 't'))"
    df = candidates(spark).where("has_anchor").selectExpr(
        "*", "119L as congress", "'hr' as bill_type", "cast(substring(bill_id, 2) as bigint) as bill_number", "cast(null as string) as topic", f"{v} as versions",
        "cast(null as string) as latest_action", "array('s') as subjects", "cast(null as string) as reconciliation_error")
    corpus.write_candidates(df, str(tmp_path / "c"))
    back = corpus.read_candidates(spark, str(tmp_path / "c"))
    assert back.count() == 3 and back.where("bill_id = 'b1'").collect()[0].match_locations == {"title": ["AI"]}
    old = spark.createDataFrame([("b2",)], "bill_id string")
    status = {r.bill_id: r.status for r in curate.to_promote(back, old).collect()}
    assert status == {"b1": "added", "b2": "skipped-exists", "b4": "added"}
    assert curate.to_promote(back, old, force=True).where("status = 'added'").count() == 3
    ready = curate.to_promote(back, old).selectExpr("*", "cast(null as string) as final_tier", "true as has_xml", "false as has_htm", "array() as actions", "array() as cosponsors")
    meta, prov = curate.consolidated(ready, F.lit("2025-01-01T00:00:00"))
    m = meta.where("bill_id = 'b1'").collect()[0]
    assert (m.tier, m.topic, m.canonical_version.package_id) == ("A", "ai_governance", "P")
    assert prov.collect()[0].files["bill.xml"] is True
    count, index = curate.index_summary(ready)
    assert count.collect()[0].bill_count == 3 and [r.bill_id for r in index.collect()] == ["b1", "b2", "b4"]


# -- search ----------------------------------------------------------------
def test_stems(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat",
            "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
            "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustable": "adjust", "adoption": "adopt", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is"}
    got = search.stem_vocabulary(spark.createDataFrame([(w,) for w in want], "term string")).collect()
    assert {r.term: r.stem for r in got} == want


DOCS = [(1, "t", "The frontier model, and models"), (2, "t", "model frontier"), (3, "u", "frontier model elsewhere"), (4, "t", "nothing here")]


def ask(spark, *texts, topic="t"):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string").withColumn("topic", F.lit(topic))


def index(spark):
    return search.text_index(spark.createDataFrame(DOCS, "id int, topic string, text string"), "id", F.col("topic"), ["text"])


def test_query_forms(spark):
    q = search.query_phrases(ask(spark, "frontier model", '"frontier model"', "nothing OR frontier", "model NOT and", "front* AND mod*", "zebra model", ""))
    got = {}
    for r in search.bm25(index(spark), q, prefixes=True).collect():
        got.setdefault(r.query_id, set()).add(r.doc)
    assert got == {0: {1, 2}, 1: {1}, 2: {1, 2, 4}, 3: {2}, 4: {1, 2}}


GRAMMAR = {
    '(a OR b) AND c': [(0, 0, "a"), (0, 0, "c"), (1, 0, "b"), (1, 0, "c")], '"cats OR dogs"': [(0, 0, "cats OR dogs")], "a NOT (b OR c)": [(0, 0, "a"), (0, 1, "b"), (0, 2, "c")],
    "a NOT (b NOT c)": [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 0, "c")], "(a": [(0, 0, "a")], " ) OR (": [], "NOT a": [], "a OR": [(0, 0, "a")], '"new yo"*': [(0, 0, "new yo*")],
    'NEAR(a "b c", 3) x': [(0, 0, (3, "a", "b c")), (0, 0, "x")], "NEAR(a b,5)": [(0, 0, (5, "a", "b"))], "NEAR(a , b)": [(0, 0, (10, "a", "b"))], "NEAR(a b 7)": [(0, 0, (10, "a", "b", "7"))]}


@pytest.mark.parametrize("text", GRAMMAR)
def test_grammar(text):
    from lexweave.functions.asked import alternatives
    assert [(r["grp"], r["no"], (r["near"], *r["parts"]) if r["near"] is not None else r["parts"][0]) for r in alternatives(text)] == GRAMMAR[text]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list('ab" ()*,1') + [" AND ", " OR ", " NOT ", "NEAR("]), max_size=12))
def test_any_query_text_is_read(parts):
    from lexweave.functions.asked import alternatives
    alternatives("".join(parts))


NEAR_DOCS = [(1, "t", "alpha x x beta"), (2, "t", "beta x alpha beta gamma x x x x x x x alpha"), (3, "t", "alpha beta"), (4, "t", "big alpha big beta big"), (5, "t", "Éclair regulations")]


def test_postings_equal_the_scan(spark, tmp_path):
    """The stored index, read whole and by block maxima, against scoring over all words; small ranges."""
    from lexweave.operators import postings
    docs = NEAR_DOCS + [(10 + i, "tu"[i % 2], " ".join(f"{'alpha' if i % 3 else 'beta'} w{(i * k) % 7}" for k in range(1, 2 + i % 5))) for i in range(200)]
    texts = search.text_index(spark.createDataFrame(docs, "id int, topic string, text string"), "id", F.col("topic"), ["text"])
    old, postings.RANGE_DOCS = postings.RANGE_DOCS, 16
    try:
        ix = postings.write(texts, f"{tmp_path}/ix")
    finally:
        postings.RANGE_DOCS = old
    q = search.query_phrases(ask(spark, "alpha", '"alpha w1"', "NEAR(alpha beta, 1)", "NEAR(alpha beta gamma, 3)", "(alpha OR beta) w3", "al* NOT w2", "w1 OR zebra", "beta w5", "alpha OR alpha"))
    key = lambda df: sorted((r.query_id, r.doc, r.score) for r in df.collect())
    want = key(search.bm25(texts, q, prefixes=True))
    assert {d for i, d, _ in want if i == 2} == {2, 3, 4} and {d for i, d, _ in want if i == 3} == {2}
    assert key(postings.bm25(ix, q, True)) == want
    top = postings.top_hits(ix, q, 5, True, probes=1)
    first = [sorted((-s, d) for i, d, s in want if i == n)[:5] for n in range(9)]
    assert key(top.scores) == sorted((n, d, -s) for n, rows in enumerate(first) for s, d in rows)
    report = top.report.collect()
    assert all(0 < r.read <= r.ranges for r in report) and sum(r.read for r in report) < sum(r.ranges for r in report)
    plan = postings.bm25(ix, q)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and not any("words" in x for x in scans) and any("PartitionFilters: [bucket" in x and "places" in x for x in scans), scans


def test_postings_over_stems(spark, tmp_path):
    from lexweave.operators import postings
    texts = search.text_index(spark.createDataFrame(NEAR_DOCS + [(6, "t", "regulation eclairs"), (7, "t", "the new regulations regulation")], "id int, topic string, text string"),
                              "id", F.col("topic"), ["text"])
    ix = postings.write(texts, f"{tmp_path}/ix", stems=True)
    q = postings.stemmed(ix, search.query_phrases(ask(spark, "regulation", "eclair", '"REGULATING éclair"', "unheard-of")))
    got = {}
    for r in postings.bm25(ix, q).collect():
        got.setdefault(r.query_id, set()).add(r.doc)
    assert got == {0: {5, 6, 7}, 1: {5, 6}, 2: {6}}
    assert {r.term for r in ix.stems.collect()} >= {"regulations", "éclair"} and ix.terms.where("term = 'regul'").first().df == 3


def test_stemmed_index_and_accents(spark):
    ix = search.stem_index(index(spark))
    q = search.stem_phrases(search.query_phrases(ask(spark, "modeling")))
    assert {r.doc for r in search.bm25(ix, q).collect()} == {1, 2}
    assert one(spark, search.fold_accents(F.lit("Éçole ñ")))[0] == "Ecole n"


def test_no_phrase_across_fields(spark):
    d = spark.createDataFrame([(1, "t", "ends frontier", "model starts")], "id int, topic string, a string, b string")
    ix = search.text_index(d, "id", F.col("topic"), ["a", "b"])
    assert ix.collect()[0].len == 4
    assert search.bm25(ix, search.query_phrases(ask(spark, '"frontier model"'))).count() == 0


def test_clustered_vectors(spark, tmp_path):
    """Every vector is in the index; with all clusters probed the result is the exact one, with some it has nine in ten."""
    from lexweave.operators import vectors as nearby
    rng = np.random.default_rng(7)
    m = rng.normal(size=(40, 12))[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 12))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i // 4, "tu"[i % 2], v.tolist()) for i, v in enumerate(m)] + [(9999, 0, "t", []), (9998, 0, None, [1.0] * 12)],
                               "section_id long, bill_id long, topic string, vector array<double>")
    ix = nearby.write(df, str(tmp_path / "v"), clusters=30)
    assert ix.vectors.count() == 1500 and ix.centroids.count() == 30 and ix.vectors.select("cluster").distinct().count() > 20
    q = df.where("section_id % 50 = 0").select(F.col("section_id").alias("query_id"), "topic", "vector")
    key = lambda d: {(r.query_id, r.section_id, round(r.score, 6)) for r in d.collect()}
    exact = key(dense.dense_scores(df, q, 10))
    assert key(nearby.nearest(ix, q, 10, probes=30)) == exact
    assert len(key(nearby.nearest(ix, q, 10, probes=5)) & exact) >= 0.9 * len(exact)
    assert nearby.nearest(nearby.write(df.where("false"), str(tmp_path / "e")), q, 10).collect() == []


def test_products_with_centroids_are_bounded(spark):
    """The fit and the choice of clusters hold a bounded number of products, however many vectors and clusters there are."""
    import tracemalloc

    from lexweave.operators import vectors as nearby
    rng = np.random.default_rng(3)
    m = rng.normal(size=(6000, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "section_id long, vector array<double>")
    tracemalloc.start()
    try:
        c = nearby.centroids_of(df, 1500)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert c.shape == (1500, 4) and peak < 40e6, peak
    assert (nearby.nearest_of(m, c) == np.argmax(m @ c.T, axis=1)).all()


def test_fusion(spark):
    lex = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, bill_id string, lexical_rank int").withColumn("lexical_section", F.lit("l"))
    den = spark.createDataFrame([(0, "b", 1), (0, "c", 2), (1, "z", 1)], "query_id int, bill_id string, dense_rank int").withColumn("dense_section", F.lit("d"))
    got = dense.fuse(lex, den, 10).orderBy("query_id", "fused_rank").collect()
    assert [(r.bill_id, round(r.score, 9), r.section_id) for r in got] == [
        ("b", round(1 / 62 + 1 / 61, 9), "d"), ("a", round(1 / 61, 9), "l"), ("c", round(1 / 62, 9), "d")]


def nearest(sections, queries, k):
    want = {}
    for j, topic, v in queries:
        mine = [x for x in sections if x[2] == topic]
        score = np.round(np.array([x[3] for x in mine]) @ np.array(v), 6)
        want[j] = [mine[i][0] for i in sorted(range(len(mine)), key=lambda i: (-score[i], mine[i][0]))[:k]]
    return want


def found(spark, sections, queries, k):
    sd = spark.createDataFrame(sections, "section_id long, bill_id long, topic string, vector array<double>")
    qd = spark.createDataFrame(queries, "query_id long, topic string, vector array<double>")
    got = {}
    for r in dense.dense_scores(sd, qd, k).orderBy("query_id", F.desc("score"), "section_id").collect():
        got.setdefault(r.query_id, []).append(r.section_id)
    return got


def test_dense_matches_brute_force_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    s = [(i, i // 3, "t" if i % 2 else "u", rng.normal(size=8).tolist()) for i in range(60)]
    q = [(j, "t", rng.normal(size=8).tolist()) for j in range(3)]
    for size in (1024, 7, 1):
        monkeypatch.setattr(dense, "SECTION_BLOCK", size)
        monkeypatch.setattr(dense, "QUERY_BLOCK", min(size, 2))
        assert found(spark, s, q, 5) == nearest(s, q, 5)


def test_dense_with_thousands_of_queries(spark):
    rng = np.random.default_rng(1)
    s = [(i, i, "tu"[i % 2], rng.normal(size=8).tolist()) for i in range(200)]
    q = [(j, "tuv"[j % 3], rng.normal(size=8).tolist()) for j in range(3000)]
    assert found(spark, s, q, 5) == {j: w for j, w in nearest([x for x in s if x[2] in "tu"], [x for x in q if x[1] != "v"], 5).items()}


def test_encoding_resumes_and_skips_empty(spark):
    s = spark.createDataFrame([("a", "b", "t", "H", "x"), ("c", "b", "t", None, ""), ("d", "b", "t", "", "y")], "section_id string, bill_id string, topic string, heading string, text_full string")
    first = dense.encode_sections(s.where("section_id != 'd'"), None, "v1")
    rows = first.collect()
    assert [r.section_id for r in rows] == ["a"] and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6 and rows[0].dim == 384
    assert [r.section_id for r in dense.encode_sections(s, first, "v1").collect()] == ["d"]
    assert one(spark, dense.unit(F.array(F.lit(0.0), F.lit(0.0))))[0] == [0.0, 0.0]


# -- graphs ----------------------------------------------------------------
def test_shared_terms(spark):
    uses = [("x", "b1")] + [("y", b) for b in ("b1", "b2")] + [("z", f"b{i}") for i in range(13)]
    band = graph.band_terms(spark.createDataFrame(uses, "term string, bill string"))
    pairs = graph.term_pairs(band)
    assert [(r.a, r.b, r.weight, r.terms) for r in graph.shared_term_edges(pairs).collect()] == [("b1", "b2", 1, ["y"])]
    assert graph.shared_term_edges(pairs, min_weight=2).count() == 0


def test_closure_ends_on_a_cycle(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "id string, parent string")
    got = {(r.id, r.ancestor) for r in tree.closure(ring).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}


def test_closure_until_done(spark):
    chain = spark.createDataFrame([("n0", None)] + [(f"n{i}", f"n{i-1}") for i in range(1, 9)], "id string, parent string")
    assert tree.closure(chain).count() == 36 == tree.closure(chain, 8).count()
    assert {r.root for r in tree.root_index(chain).collect()} == {"n0"}


def test_ego_graph_reports_missing(spark):
    b = spark.createDataFrame([("u1", "hr", 1), ("u2", "s", 2)], "bill_urn string, bill_type string, bill_number int")
    t = spark.createDataFrame([("u1", "Big Model", "st")], "bill_urn string, surface_form string, statute_id string")
    s = spark.createDataFrame([("u1", "Scope", "5", None)], "bill_urn string, heading string, enum string, parent_section_id string")
    st = spark.createDataFrame([("st", "15 U.S.C. 1")], "statute_id string, canonical_citation string")
    n, e = graph.ego_graph("u1", ["u2"], ["big model", "gone"], ["Scope"], "st", b, t, s, st)
    assert {(r.id, r.kind, r.label) for r in n.collect()} == {("center", "bill", "H.R. 1"), ("rel_0", "bill", "S. 2"), ("def_0", "def", '"Big Model"'), ("def_1", "missing", "gone"), ("sec_0", "sec", "Sec. 5"), ("cite_0", "cite", "15 U.S.C. § 1")}
    assert {(r.src, r.dst) for r in e.collect()} == {("rel_0", "center"), ("center", "def_0"), ("center", "sec_0"), ("center", "cite_0"), ("def_0", "cite_0")}


def test_index_of_odd_rows(spark, tmp_path):
    from lexweave.operators import postings
    rows = [(1, "a b a", "x"), (1, "a b a", "x"), (1, "b", "x"), (2, "", "x"), (3, None, None), (4, "a é b", None), (None, "b a", "x")]
    texts = search.text_index(spark.createDataFrame(rows, "id long, t string, tp string"), "id", F.col("tp"), ["t", "tp"])
    ix = postings.write(texts, f"{tmp_path}/odd")
    got = {(r.topic, r.term): [(t.doc, t.len, t.places) for t in r.texts] for r in ix.blocks.collect()}
    assert {k: sorted(v, key=str) for k, v in got.items() if k[1] in ("a", "é")} == {
        ("x", "a"): [(1, 4, [0, 0, 2, 2]), (None, 3, [1])], (None, "a"): [(4, 3, [0])], (None, "é"): [(4, 3, [1])]}
    assert got[("x", "x")] == [(None, 3, [3]), (1, 2, [2]), (1, 4, [4, 4]), (2, 1, [1])]
    assert (ix.stats.first().n_docs, {r.term: r.df for r in ix.terms.collect()}) == (7, {"a": 3, "b": 4, "é": 1, "x": 4})
    q = search.query_phrases(spark.createDataFrame([(0, "a", "x")], "query_id long, text string, topic string"))
    # what a unit is worth is read, not worked out beside every hit
    scores = postings.ranked(postings.hits_of(ix, q), q, postings.document_frequencies(ix, q), ix)
    assert any("/stage-units-" in f for f in scores.inputFiles()) and [r.doc for r in scores.orderBy("doc").collect()] == [None, 1]


def test_the_index_shuffles_texts_only(spark, tmp_path, monkeypatch):
    """Blocks are packed, sorted and written by the task that has their slice of the texts; words are not stored beside them."""
    from lexweave.operators import postings
    monkeypatch.setattr(postings, "RANGE_DOCS", 16)
    monkeypatch.setattr(postings, "SLICE_WORDS", 400)
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 8)) + (" rare" if i == 5 else "")) for i in range(300)]
    texts = search.text_index(spark.createDataFrame(rows, "id long, t string"), "id", F.lit("x"), ["t"])
    ix = postings.write(texts, f"{tmp_path}/ix")
    assert ix.docs.columns == ["doc", "parent", "topic", "len", "range"]
    got = {(r.term, t.doc): (t.len, t.places) for r in ix.blocks.collect() for t in r.texts}
    want = {}
    for i, t in rows:
        for at, w in enumerate(t.split()):
            want.setdefault((w, i), (len(t.split()), []))[1].append(at)
    assert got == want
    # a bucket has a file per slice of ranges at most, and each range's blocks of a bucket lie in one file
    files = ix.blocks.select("bucket", "range", F.input_file_name().alias("f")).distinct()
    assert 2 < files.groupBy("bucket").agg(F.countDistinct("f").alias("n")).agg(F.max("n")).first()[0] <= 6
    assert files.groupBy("bucket", "range").count().where("count > 1").count() == 0


# -- spans -----------------------------------------------------------------
@pytest.mark.parametrize("hay, needle, want", [
    ("abc def", "c d", (2, 5)), ("abc  def\n ghi ", "def ghi", (5, 14)), ("a.c (x)", "a.c  (x)", (0, 7)), ("ab", "a  b", None), ("abc", "zzz", None), ("a b", "xy", None)])
def test_locate_span(spark, hay, needle, want):
    got = one(spark, spans.locate_span(F.lit(hay), F.lit(needle)))[0]
    assert (got and tuple(got)) == want


def test_locate_span_of_a_long_text(spark):
    lines = [f"word{i} and (a) x" for i in range(60000)]
    hay, needle = "\t ".join(["intro", *lines]) + " \n", "\n".join(lines[1:])
    got = spark.createDataFrame([(hay, needle)], "h string, n string").select(spans.locate_span("h", "n")).collect()[0][0]
    assert tuple(got) == (hay.index("word1 "), len(hay))


def test_breaks_and_mentions(spark):
    t = "Intro; (a) one. (2) two TITLE IV x Sec. 3 y"
    r = one(spark, spans.break_offsets(F.lit(t)), spans.bill_mentions(F.lit("See S. 12 and H.R. 5 or H.J. Res. 7.")), spans.break_count(F.lit(t)))
    assert r[0] == [t.index("(a)"), t.index("(2)"), t.index("TITLE"), t.index("Sec.")] and r[2] == 2
    assert [(m.bill_type, m.bill_number) for m in r[1]] == [("s", 12), ("hr", 5), ("hjres", 7)]


def test_breaks_make_their_text_once(spark):
    made = F.replace(F.col("t"), F.lit("\n"), F.lit("; (a) Sec. 1 "))
    assert str(spans.break_offsets(made)).count("replace(t") == 1 == str(spans.bill_mentions(made)).count("replace(t")
    got = spark.createDataFrame([("x\ny",), (None,)], "t string").select(spans.break_offsets(made).alias("o")).collect()
    assert [r.o for r in got] == [[3, 7], []]


# -- scoring ---------------------------------------------------------------
def score(spark, answer, tool="", aborted=False, **c):
    base = {k: None for k in ("answer_must_contain", "answer_must_not_contain", "answer_must_cite", "bill_id_min", "bill_id_set_full")} | {"abstain": False} | c
    runs = spark.createDataFrame([("q", "c", answer, [(tool,)], None, aborted)], "query_id string, category string, final_answer string, tool_calls array<struct<response_text:string>>, error string, aborted boolean")
    crit = spark.createDataFrame([("q", *[base[k] for k in ("answer_must_contain", "answer_must_not_contain", "answer_must_cite", "bill_id_min", "bill_id_set_full", "abstain")])],
                                 "query_id string, answer_must_contain array<string>, answer_must_not_contain array<string>, answer_must_cite array<string>, bill_id_min array<string>, bill_id_set_full array<string>, abstain boolean")
    return scoring.score_runs(runs, crit).collect()[0]


def test_bill_sets(spark):
    full = ["118-hr-5", "119-s-7"]
    r = score(spark, "## 118th Congress\n- H.R. 5" + " and much more text" * 5 + "\n S. 7 (119th Cong.)", bill_id_set_full=full)
    assert r.overall_passed and (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)
    r = score(spark, "118-hr-5 only", bill_id_set_full=full, bill_id_min=full)
    assert not r.overall_passed and r.recall == 0.5 and r.missing_min == ["119-s-7"]
    r = score(spark, "118-hr-5, bill:us/119/s/7 and 119-hr-1", bill_id_set_full=full)
    assert not r.overall_passed and r.extras == ["119-hr-1"] and round(r.precision, 3) == 0.667


def test_content_grounding_and_abort(spark):
    cite = "Sec. 2(a)(1) of H.R. 9, 119th Cong."
    ok = score(spark, f"As in {cite}", "has Sec. 2 of H.R. 9, 119th Cong. text", answer_must_cite=[cite], answer_must_contain=["AS IN"])
    assert ok.overall_passed and (ok.grounded, ok.ungrounded) == (1, 0)
    bad = score(spark, f"As in {cite}", "nothing")
    assert not bad.overall_passed and [c.name for c in bad.checks if not c.passed] == ["citation_grounding"]
    assert score(spark, "That is out of scope.", abstain=True).overall_passed and not score(spark, "It is 5.", abstain=True).overall_passed
    gone = score(spark, "x", aborted=True)
    assert not gone.overall_passed and gone.precision is None and [c.name for c in gone.checks] == ["execution"]


def test_response_labels(spark):
    want = {'{"error": "boom"}': "error: boom", '{"not_found": true}': "not_found", '{"hits": [1, 2]}': "2 hits", '{"bill_id": "b"}': "bill_id=b",
            '{"section_id": "s"}': "section=s", "[1]": "<list>", "{oops": "<unparseable response, 5 chars>", '{"x": 1}': "<dict>", '"s"': "<str>"}
    df = spark.createDataFrame([(k,) for k in want], "r string").select("r", turns.response_label("r").alias("l"))
    assert {x.r: x.l for x in df.collect()} == want


def test_criteria_file(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("queries:\n- id: a\n  category: x\n  question: q\n  pass_criteria:\n    answer_must_contain: [one]\n    abstain: true\n- id: b\n  category: y\n")
    c = corpus.read_criteria(spark, str(tmp_path / "q.yaml"))
    assert corpus.pick_questions(c, ["a"]).collect()[0].answer_must_contain == ["one"] and corpus.pick_questions(c, category="y").count() == 1


# -- usage -----------------------------------------------------------------
T0 = datetime(2025, 1, 1)
CALLS = [(1, 1, "a@x", 30, 20), (2, 1, "a@x", 25, 0), (3, 1, "a@x", 30, -5), (4, 2, "Boss@x ", 50000, 50000), (5, 1, "a@x", 9, 9), (6, 2, "boss@x", 1, None)]


def calls(spark):
    rows = [(e, u, m, i, o, T0 + timedelta(hours=e)) for e, u, m, i, o in CALLS]
    return spark.createDataFrame(rows, "event_id long, user_id long, email string, input_tokens long, output_tokens long, ts timestamp")


def test_cap(spark):
    got = {r.event_id: (r.total_after, r.admitted) for r in usage.gate(calls(spark), 100, ["BOSS@x"]).collect()}
    assert got[1] == (50, True) and got[2] == (75, True) and got[3] == (105, True) and got[5][1] is False
    assert got[4] == (100000, True) and got[6][1] is True


def test_stream_equals_batch(spark, tmp_path):
    want = {(r.event_id, r.admitted, r.charged) for r in usage.gate(calls(spark), 100, ["boss@x"]).collect()}
    src, led = str(tmp_path / "in"), str(tmp_path / "ledger")
    for e in (1, 3, 5):  # three landings, two calls each, one micro-batch per run
        calls(spark).where(f"event_id in ({e}, {e + 1})").coalesce(1).write.mode("append").json(src)
        metering.start_gate(metering.read_calls(spark, src), led, 100, ["boss@x"]).awaitTermination()
    assert sorted((r.event_id, r.admitted, r.charged) for r in metering.read_decisions(spark, led).collect()) == sorted(want)
    spent = {}
    for r in usage.gate(calls(spark), 100, ["boss@x"]).collect():
        spent[r.user_id] = spent.get(r.user_id, 0) + r.charged
    assert {tuple(r) for r in metering.read_balances(spark, led).collect()} == set(spent.items())  # one row per account
    metering.start_gate(metering.read_calls(spark, src), led, 100, ["boss@x"]).awaitTermination()  # nothing new, nothing charged again
    assert metering.read_decisions(spark, led).count() == len(want) and not [x for x in (tmp_path / "ledger").iterdir() if x.name not in ("decisions", "checkpoint")]
    q = metering.totals_stream(metering.read_calls(spark, src)).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("totals").collect()} == {tuple(r) for r in usage.account_totals(calls(spark)).collect()}


def test_traces(spark, tmp_path):
    row = [("2025-01-02T00:00:00", 5, 0, 9.0, None, [(0, 2.04, 0.0, 0.0, ["a"]), (1, 3.0, 1.0, 0.0, [])], [("t", 1.5)], None)]
    from lexweave import schemas

    corpus.append_traces(spark.createDataFrame(row, schemas.TRACE_DDL), str(tmp_path / "tr"))
    r = turns.trace_totals(corpus.read_traces(spark, str(tmp_path / "tr"))).collect()[0]
    assert (r.n_iterations, r.n_tool_calls, r.llm_ms_total, r.tool_ms_total, r.day) == (2, 1, 5.0, 1.5, "2025-01-02")


def test_embedding_coverage(spark):
    s = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "section_id string, topic string")
    got = {r.topic: (r.total, r.embedded, r.pct) for r in lookups.embedding_coverage(s, s.where("section_id = 'a'")).collect()}
    assert got == {"t": (2, 1, 50.0), "u": (1, 0, 0.0)}
