"""The corpus readers, writers and table builders over records and files that are derived from the test tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave import fixed, schemas
from lexweave.operators import curate, dense, postings, search, turns
from lexweave.plans.catalog import documents, model
from lexweave.plans.catalog.model import BILLS
from lexweave.plans.catalog.registry import query
from lexweave.session import checkpoint_dir
from lexweave.sources import corpus
from lexweave.sources.tables import stage


def fresh(df, label):
    """A new folder for files that a query writes and reads back."""
    return f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def scanned(load):
    """Orders as landed bills: metadata records with gaps, and the document's first bytes."""
    none, key = F.lit(None).cast("string"), F.col("okey")
    line = load("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("mode")))).alias("ls"))
    b = model.bills(load).join(line, key == F.col("l_orderkey"), "left")
    ls = F.coalesce("ls", F.array().cast(dict(line.dtypes)["ls"]))
    person = lambda x: F.struct(F.lit(None).cast("string").alias("bioguideId"), F.lit(None).cast("string").alias("firstName"), F.when(x["l_linenumber"] == 1, "Last").alias("lastName"),
                                F.when(x["l_linenumber"] > 1, F.concat(F.lit("Member "), (x["l_suppkey"] % 3).cast("string"))).alias("fullName"), F.lit("D").alias("party"), F.lit("NY").alias("state"),
                                F.lit(None).cast("string").alias("sponsorshipDate"), F.lit(None).cast("bigint").alias("district"), F.lit(True).alias("isOriginalCosponsor"))
    action = lambda x: F.struct(F.concat(F.lit("2024-01-0"), x["l_linenumber"].cast("string")).alias("actionDate"), x["mode"].alias("text"))
    version = F.struct(F.concat(F.lit("BILLS-"), key.cast("string")).alias("package_id"), F.when(key % 2 == 0, "ih").otherwise("enr").alias("version_code"), F.lit("2024-02-03").alias("date_issued"))
    xml = F.concat(F.when(key % 2 == 0, f'<bill xmlns="{fixed.USLM_MARKER}">').otherwise("<bill>"), F.lit(" " * 600), F.lit(fixed.USLM_MARKER))
    return b.select(
        "bill_id", "congress", "bill_type", "bill_number", "title", "short_title", "sponsor", "introduced_date", none.alias("latest_action"), none.alias("policy_area"), none.alias("summary_text"),
        "tier", F.when(key % 2 == 0, F.lit("regulatory")).alias("stream"), F.when(key % 3 == 0, F.col("topic")).alias("topic"), (key % 7 / 7.0).alias("centrality_score"),
        version.alias("canonical_version"), F.array(version, version).alias("versions_available"), F.transform(ls, person).alias("cosponsors"), F.transform(ls, action).alias("actions"),
        F.transform(ls, lambda x: F.when(x["l_partkey"] % 2 == 0, x["mode"]).otherwise("")).alias("subjects"), F.encode(xml, "utf-8").alias("xml"), F.concat(F.lit("/c/"), "bill_id").alias("dir"))


@query("bill_records", f"""with {BILLS} select bill_id, bill_urn, case when okey % 2 = 0 then 'regulatory' else '{fixed.DEFAULT_STREAM}' end as stream, case when okey % 3 = 0 then topic else '{fixed.DEFAULT_TOPIC}' end as topic,
  case when okey % 2 = 0 then 'uslm' else 'pre-uslm' end as xml_format, 'BILLS-' || okey as canonical_package_id, case when okey % 2 = 0 then 'ih' else 'enr' end as canonical_version_code from bills""")
def bill_records(load):
    """Landed records as bill rows: defaults for gaps, the document's format by its head."""
    return corpus.bill_table(scanned(load)).select("bill_id", "bill_urn", "stream", "topic", "xml_format", "canonical_package_id", "canonical_version_code")


@query("bill_children", f"""with {BILLS}, l as (select bill_id, l.* from lineitem l join bills on l_orderkey = okey)
select 'cosponsors' as kind, bill_id, case when l_linenumber = 1 then 'Last' else 'Member ' || l_suppkey % 3 end as value from l group by all
union all select 'actions', bill_id, '2024-01-0' || l_linenumber || ' m' || l_partkey % 7 from l
union all select distinct 'subjects', bill_id, 'm' || l_partkey % 7 from l where l_partkey % 2 = 0
union all select 'bill_versions', bill_id, 'BILLS-' || okey from bills""")
def bill_children(load):
    """Versions, cosponsors, actions and subjects of landed records; repeats keep the first."""
    t = corpus.child_tables(scanned(load))
    say = lambda name, value: t[name].select(F.lit(name).alias("kind"), "bill_id", value.alias("value"))
    return say("cosponsors", F.col("name")).unionByName(say("actions", F.concat_ws(" ", "action_date", "action_text"))).unionByName(
        say("subjects", F.col("subject"))).unionByName(say("bill_versions", F.col("package_id")))


@query("fetch_freshness", f"""with {BILLS} select unnest(['{"', '".join(fixed.FRESHNESS_SOURCES)}']) as source, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) as last_fetched
from events join (select distinct bill_number from bills) on user_id = bill_number where event_type <> 'view' having count(*) > 0""")
def fetch_freshness(load):
    """The newest fetch time of the bills that are held, for both sources."""
    p = load("events").select(F.col("user_id").cast("string").alias("bill_id"), F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("").alias("fetched_at"))
    return corpus.freshness(p, model.bills(load).select(F.col("bill_number").cast("string").alias("bill_id")).distinct())


def candidates(load):
    d = load("documents")
    kinds = {f.split(" ")[0] for f in ("bill_id", "centrality_score", "topic", "title", "has_anchor", "proposed_tier")}
    empty = d.sparkSession.createDataFrame([], schemas.CANDIDATE_DDL)
    made = d.select(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("bill_id"), (F.col("n_chars") % 100 / 100.0).alias("centrality_score"), F.col("lang").alias("topic"),
                    F.concat(F.col("source"), F.lit(' "q", \n'), F.col("lang")).alias("title"), (F.col("n_chars") % 2 == 0).alias("has_anchor"), F.lit("A").alias("proposed_tier"))
    return made.select(*[F.col(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])


@query("candidate_files", """select 'b' || doc_id as bill_id, n_chars % 100 / 100.0::double as centrality_score, lang as topic, source || ' "q", ' || chr(10) || lang as title, n_chars % 2 = 0 as has_anchor from documents""")
def candidate_files(load):
    """Candidates written as JSON lines and read back."""
    rows = candidates(load)
    path = fresh(rows, "candidates")
    corpus.write_candidates(rows, path)
    return corpus.read_candidates(rows.sparkSession, path).select("bill_id", "centrality_score", "topic", "title", "has_anchor")


@query("review_files", """select 'b' || doc_id as bill_id, case doc_id % 4 when 0 then 'y' when 1 then 'n' else '' end as include, case doc_id % 4 when 0 then 'B' else '' end as tier, case doc_id % 4 when 2 then 'see "x", y' else '' end as notes
from documents where doc_id % 4 <> 3""")
def review_files(load):
    """A review sheet written as CSV, filled in, and read back: rows with any human input."""
    sheet = curate.review_sheet(candidates(load))
    path = fresh(sheet, "review")
    n = F.substring("bill_id", 2, 20).cast("long") % 4
    filled = sheet.withColumns({"include (y/n)": F.when(n == 0, " Y ").when(n == 1, "n").otherwise(""), "tier (A/B)": F.when(n == 0, "b").otherwise(""), "notes": F.when(n == 2, 'see "x", y').otherwise("")})
    corpus.write_review_sheet(filled, path)
    return curate.read_reviews(corpus.read_review_sheet(sheet.sparkSession, path))


@query("hit_files", """select event_id::varchar as "packageId", strftime(ts, '%Y-%m-%d') as "dateIssued", event_type as title from events""")
def hit_files(load):
    """Search hits landed as JSON lines."""
    hits = load("events").select(F.col("event_id").cast("string").alias("packageId"), F.date_format("ts", "yyyy-MM-dd").alias("dateIssued"), F.col("event_type").alias("title"))
    path = fresh(hits, "hits")
    hits.write.json(path)
    return corpus.read_hits(hits.sparkSession, path)


@query("trace_files", """select strftime(ts, '%Y-%m-%d') as day, count(*) as n_traces, count(*) * 2 as n_iterations, count(*) as n_tool_calls from events group by 1""")
def trace_files(load):
    """Turn traces appended under one folder per day, read back and totalled."""
    one = F.struct(F.lit(0).cast("long").alias("i"), F.lit(2.0).alias("llm_ms"), F.lit(1.0).alias("tool_ms"), F.lit(0.0).alias("gap_ms"), F.array(F.lit("a")).alias("tools"))
    t = load("events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit(5).cast("long").alias("message_chars"), F.lit(0).cast("long").alias("history_turns"), F.lit(9.0).alias("total_ms"),
                              F.lit(None).cast("double").alias("first_token_ms"), F.array(one, one).alias("iterations"), F.array(F.struct(F.lit("t").alias("name"), F.lit(1.5).alias("ms"))).alias("tool_calls"),
                              F.lit(None).cast("string").alias("error"))
    path = fresh(t, "traces")
    corpus.append_traces(t, path)
    totals = turns.trace_totals(corpus.read_traces(t.sparkSession, path))
    return totals.groupBy("day").agg(F.count(F.lit(1)).alias("n_traces"), F.sum("n_iterations").cast("long").alias("n_iterations"), F.sum("n_tool_calls").cast("long").alias("n_tool_calls"))


# -- encoding and topics ---------------------------------------------------
@query("encode_resume", f"""with d as (select doc_id, lang, exists(select 1 from labels l where l.doc_id = d.doc_id) as done from documents d where text <> '')
select lang as topic, count(*) filter (done) as n_done, count(*) filter (not done) as n_new, {fixed.VECTOR_DIM} as dim from d group by lang""")
def encode_resume(load):
    """Encoding picked up where it stopped: the labelled documents have vectors, the others get theirs; empty texts get none."""
    d = load("documents")
    s = d.select(F.col("doc_id").cast("string").alias("section_id"), F.col("doc_id").cast("string").alias("bill_id"), F.col("lang").alias("topic"), F.lit("").alias("heading"), F.col("text").alias("text_full"))
    done = dense.encode_sections(s.join(load("labels").select(F.col("doc_id").cast("string").alias("section_id")).distinct(), "section_id", "left_semi"), None, "v1")
    new = dense.encode_sections(s, done, "v1")
    count = lambda df, name: df.groupBy("topic", "dim").agg(F.count(F.lit(1)).alias(name))
    return count(done, "n_done").join(count(new, "n_new"), ["topic", "dim"], "full").select("topic", F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"), F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), "dim")


_TOPIC = "case q.query_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end"


@query("topic_search", f"""with {documents._TOKENS}, r as (select q.query_id, q.doc_id, q.score, row_number() over (partition by q.query_id order by q.score desc, q.doc_id) as rank
  from scores q join documents d using (doc_id) where d.lang = {_TOPIC})
select query_id::bigint as query_id, doc_id, score, rank from r where rank <= 20""")
def topic_search(load):
    """Questions that ask one topic each (the language): no hit of another topic, statistics of the whole collection."""
    index = documents.stored(load, "topics", lambda load: search.text_index(load("documents"), "doc_id", F.col("lang"), ["text"]))
    k = F.col("query_id") % 4
    asked = documents.questions(load).withColumn("topic", F.when(k == 0, "en").when(k == 1, "fr").when(k == 2, "de").otherwise("es"))
    best = search.top_k(postings.bm25(index, stage(search.query_phrases(asked), "phrases")), ["query_id"], [F.desc("score"), F.asc("doc")], 20, "rank")
    return best.select("query_id", F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))
