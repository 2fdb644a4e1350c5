"""Catalog queries against their SQL twins on the smallest tables, and shapes of plans."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.operators import lookups, rank, search, sections
from lexweave.plans.catalog import bills_xml
from lexweave.sources.tables import read_table
from oracle import compare, connect

SAMPLE = ["bm25_topk", "dense_topk", "rrf", "bills_defining", "per_bill_rollup", "path_resolve", "hit_groups", "centrality", "decide",
          "shared_term_graph", "tree_closure", "section_split", "span_locate", "prf", "usage_cap", "xml_sections", "xml_terms"]


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf_dir, name):
    ok, message = compare(spark, connect(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_sections_take_one_text_shuffle(spark, sf_dir):
    bills, n = bills_xml.derived(lambda t: read_table(spark, sf_dir, t, True))
    p = plan(sections.walk(n))
    assert p.count("Exchange hashpartitioning") == 1


def test_point_question_does_not_shuffle_the_section_table(spark, sf_dir, tmp_path):
    from lexweave.plans.catalog import model

    load = lambda t: read_table(spark, sf_dir, t)
    for name in ("terms", "bills", "sections", "statutes"):
        getattr(model, name)(load).write.parquet(f"{tmp_path}/{name}")
    t, b, s, st = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("terms", "bills", "sections", "statutes"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were large
    try:
        near = lookups.Near(t.where("lower(surface_form) = 'red widget'").select("section_urn"))
        p = near(s, "section_urn")._jdf.queryExecution().executedPlan().toString()
        assert near.few and "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_ships_few_rows(spark):
    hot = spark.range(20000).select((F.col("id") % 1).alias("k"), "id")
    p = plan(rank.keep_first(hot, ["k"], [F.col("id")]))
    assert "Partial" in p and "WindowGroupLimit" in p


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = rank.top_k(df, ["k"], [F.asc("v")], 1500, "n").orderBy("n").collect()
    assert [(r.v, r.n) for r in got] == [(i, i + 1) for i in range(1500)]


def test_prefix_sum_equals_plain_window(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 40).alias("b"), "id", (F.col("id") % 7).alias("v"))
    got = rank.prefix_sum(df, "k", "b", [F.col("id")], "v", "s")
    want = df.selectExpr("k", "id", "sum(v) over (partition by k order by id) as s")
    assert got.select("k", "id", "s").exceptAll(want).count() == 0


def test_texts_are_tokenised_once_per_use(spark, sf_dir):
    ix = search.text_index(read_table(spark, sf_dir, "documents"), "doc_id", F.lit("t"), ["text"])
    q = search.query_phrases(spark.createDataFrame([(0, "of the")], "query_id int, text string").withColumn("topic", F.lit("t")))
    assert plan(search.bm25(ix, q)).count("FileScan") <= 2


@pytest.mark.parametrize("name", ["keep_first_all", "first_available_all", "source_priority_all", "shared_between_all"])
def test_whole_tables_match_sql(spark, sf_dir, name):
    ok, message = compare(spark, connect(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_whole_tables_are_covered(spark, sf_dir):
    run = lambda name: entry.queries()[name](spark, sf_dir)
    ids = {r.doc_id for r in read_table(spark, sf_dir, "documents").select("doc_id").collect()}
    assert ids <= {r.doc_id for r in run("source_priority_all").select("doc_id").collect()}
    assert run("keep_first_all").where("version_code = 'pl'").count() and run("first_available_all").where("version_code = 'pl'").count()
    assert run("shared_between_all").where("a % 5 != 0").count()


def test_all_breaks_of_whole_texts(spark, tmp_path):
    """Against a plain scan of every text, breaks at its end included."""
    import re

    from lexweave import fixed

    texts = ["Sec. 1 at the start. (a) one; (12) two", "x " * 5000 + "SEC. 7 y TITLE IV z Subtitle B, PART II DIVISION C CHAPTER 3. (iv) end", "no break (a) here", "", None,
             "\U0001f600 é— (b) after wide letters Sec. 2", "Sec. 3 Sec. 4 Sec. 5. (abcde) x; (1) y.  (2) z"]

    def brute(t):
        found = {m.start() for p in fixed.HEADING_MARKERS for m in re.finditer(p, t)} | {m.start(1) for m in re.finditer(fixed.PROVISION_MARKER, t)}
        return ",".join(map(str, sorted(o for o in found if 0 < o < len(t))))

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.offsets for r in entry.queries()["break_offsets_all"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)} and len(got[1].split(",")) == 7


def odd_orders(spark, folder):
    """Orders and line items with repeated rows, keys that repeat with another priority, null keys and lines without an order."""
    at = "timestamp '1995-01-02 00:00:00'"
    o = [(1, "1-URGENT"), (1, "1-URGENT"), (1, "2-HIGH"), (2, None), (2, None), (3, "5-LOW"), (None, "1-URGENT"), (-7, "3-MEDIUM")]
    l = [(1, 1), (1, 1), (1, 2), (2, 1), (2, None), (2, None), (3, 4), (None, 1), (9, 1), (-7, 6)]
    orders = spark.createDataFrame(o, "o_orderkey long, o_orderpriority string").selectExpr(
        "o_orderkey", "1L as o_custkey", "'F' as o_orderstatus", "1.0D as o_totalprice", f"{at} as o_orderdate", "o_orderpriority")
    items = spark.createDataFrame(l, "l_orderkey long, l_linenumber int").selectExpr(
        "l_orderkey", "1L as l_partkey", "1L as l_suppkey", "l_linenumber", "'A' as l_returnflag", "'O' as l_linestatus")
    orders.write.parquet(f"{folder}/orders.parquet")
    items.write.parquet(f"{folder}/lineitem.parquet")
    return lambda name: read_table(spark, str(folder), name)


def test_sections_are_distinct_pairs_in_pieces_that_do_not_grow(spark, tmp_path, monkeypatch):
    from lexweave.plans.catalog import model
    from lexweave.sources import tables

    load = odd_orders(spark, tmp_path)
    kept = ["bill_id", "bill_urn", "section_urn", "section_id", "ordinal"]
    want = model.lines(load).selectExpr("bill_id", "bill_urn", "section_urn", "concat(bill_id, '::L', cast(l_linenumber as string)) as section_id", "l_linenumber as ordinal").distinct()
    got = model.sections(load)
    assert sorted(map(str, got.select(*kept).collect())) == sorted(map(str, want.collect())) and got.distinct().count() == got.count() == 8
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()  # no map of wide rows in a task
    monkeypatch.setattr(tables, "PIECE_BYTES", 512)
    k = tables.pieces(load("lineitem"))
    assert k > 4 and "hashpartitioning(l_orderkey" in plan(model.sections(load)) and f", {k}), REPARTITION_BY_NUM" in plan(model.sections(load))
    assert f", {k}), REPARTITION_BY_NUM" in plan(model.cites(load)) and model.sections(load).count() == 8


def test_topic_of_sections_is_joined_in_pieces(spark, sf_dir):
    p = plan(entry.queries()["carry_topic"](spark, sf_dir))
    assert sum("hashpartitioning(bill_id" in x and "REPARTITION_BY_NUM" in x for x in p.splitlines()) >= 2


@pytest.mark.parametrize("name", ["bills_defining", "terms_side_by_side"])
def test_many_definitions_are_joined_in_pieces(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(lookups, "FEW_ROWS", 0)
    run, sql = entry.queries()[name], entry.oracle_sql()[name]
    ok, message = compare(spark, connect(sf_dir), sf_dir, name, run, sql)
    assert ok, message
    p = run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(section_urn" in x and "REPARTITION_BY_NUM" in x for x in p.splitlines()) == 2
