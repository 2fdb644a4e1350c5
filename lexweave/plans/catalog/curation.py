"""Curation, versions, promotion and field scalars over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.operators import curate as cu
from lexweave.operators.rank import first_non_null, keep_first
from lexweave.plans.catalog import model
from lexweave.plans.catalog.model import BILLS, LINES
from lexweave.plans.catalog.registry import query

CODES = ["pl", "enr", "eas", "eh", "rs", "ih", "pcs", "zz"]


def versions(load):
    """Events as bill versions: the user is the bill, the event its package."""
    code = tx.lookup(F.col("event_id") % 8, dict(enumerate(CODES)))
    return load("events").select(
        F.col("user_id").alias("bill_id"), code.alias("version_code"), F.date_format("ts", "yyyy-MM-dd").alias("date_issued"), F.col("event_id").alias("package_id"))


_V = """v as (select user_id as bill_id, ['pl','enr','eas','eh','rs','ih','pcs','zz'][event_id % 8 + 1] as version_code, strftime(ts, '%Y-%m-%d') as date_issued, event_id as package_id
  from events)"""


@query("keep_first", f"""with {_V} select bill_id, version_code, date_issued, package_id from v qualify row_number() over (partition by bill_id order by
  case version_code when 'pl' then 99 when 'enr' then 90 when 'eas' then 80 when 'eh' then 70 when 'rs' then 60 when 'ih' then 50 else 0 end desc, date_issued, package_id) = 1""")
def keep_first_query(load):
    """Canonical version per bill."""
    return cu.canonical_version(versions(load))


@query("first_available", f"""with {_V} select bill_id, version_code, date_issued, package_id from v where version_code <> 'zz' qualify row_number() over (partition by bill_id order by
  list_position(['pl','enr','eah','eas','es','eh','rh','rs','pcs','pp','ath','ats','ih','is'], version_code), date_issued, package_id) = 1""")
def first_available(load):
    """First version of the alternative priority list."""
    return cu.first_available(versions(load))


@query("keep_first_all", f"""with {_V} select bill_id, version_code, date_issued, package_id from v qualify row_number() over (partition by bill_id order by
  case version_code when 'pl' then 99 when 'enr' then 90 when 'eas' then 80 when 'eh' then 70 when 'rs' then 60 when 'ih' then 50 else 0 end desc, date_issued, package_id) = 1""")
def keep_first_all(load):
    """Canonical version per bill, of all events."""
    return cu.canonical_version(versions(load))


@query("first_available_all", f"""with {_V} select bill_id, version_code, date_issued, package_id from v where version_code <> 'zz' qualify row_number() over (partition by bill_id order by
  list_position(['pl','enr','eah','eas','es','eh','rh','rs','pcs','pp','ath','ats','ih','is'], version_code), date_issued, package_id) = 1""")
def first_available_all(load):
    """First version of the alternative priority list, of all events."""
    return cu.first_available(versions(load))


def hits(load):
    """Events as search hits; some package ids do not parse, some types are out of scope."""
    kind = F.when(F.col("event_type") == "error", "hres").when(F.col("event_type") == "view", "hr").when(F.col("event_type") == "click", "s").otherwise("hjres")
    code = tx.lookup(F.col("event_id") % 8, dict(enumerate(CODES)))
    good = F.concat(F.lit("BILLS-118"), kind, F.col("user_id").cast("string"), code)
    return load("events").select(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("X"), good)).otherwise(good).alias("packageId"),
                                 F.date_format("ts", "yyyy-MM-dd").alias("dateIssued"), F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string")).alias("title"))


_HITS = """h as (select case event_type when 'error' then 'hres' when 'view' then 'hr' when 'click' then 's' else 'hjres' end as bill_type, user_id as bill_number,
  ['pl','enr','eas','eh','rs','ih','pcs','zz'][event_id % 8 + 1] as code, strftime(ts, '%Y-%m-%d') as d, 'T' || (event_id % 5) as title, event_id % 11 = 0 as bad from events)"""


@query("hit_groups", f"""with {_HITS}, o as (select bill_type, bill_number, code, min(d) as d, min(title) as title from h where not bad and bill_type <> 'hres' group by all),
r as (select *, case code when 'pl' then 99 when 'enr' then 90 when 'eas' then 80 when 'eh' then 70 when 'rs' then 60 when 'ih' then 50 else 0 end as k from o)
select '118-' || bill_type || '-' || bill_number as bill_id, 118::bigint as congress, bill_type, bill_number,
 string_agg('BILLS-118' || bill_type || bill_number || code || '@' || d || '/' || title, ';' order by k desc, d, 'BILLS-118' || bill_type || bill_number || code) as versions from r group by bill_type, bill_number""")
def hit_groups(load):
    """Search hits grouped to unique bills with their version list."""
    g = cu.group_hits(cu.parse_hits(hits(load)))
    v = F.transform("versions", lambda x: F.concat(x["package_id"], F.lit("@"), x["date_issued"], F.lit("/"), x["title"]))
    return g.select("bill_id", "congress", "bill_type", "bill_number", F.array_join(v, ";").alias("versions"))


@query("skip_counts", f"""with {_HITS} select count(*) filter (not bad and bill_type = 'hres') as out_of_scope, count(*) filter (bad) as unparseable from h""")
def skip_counts(load):
    return cu.skip_counts(cu.parse_hits(hits(load)))


# the criteria phrases do not occur in invented prose, so the test texts carry them by id
_PLANT = {0: " Artificial Intelligence ", 1: " machine learning and AI ", 2: " said aid ", 3: " facial recognition, generative ai ", 4: " frontier model of machine learning "}


def relevance_input(load):
    def planted(offset):
        return F.concat(F.col("source"), tx.lookup((F.col("doc_id") + offset) % 7, _PLANT, ""))
    d = load("documents")
    return d.select(F.col("doc_id").alias("bill_id"), planted(0).alias("title"), F.when(F.col("doc_id") % 2 == 0, planted(1)).alias("short_title"),
                    F.col("lang").alias("policy_area"), F.array(planted(3), F.col("lang")).alias("subjects"), F.concat("text", planted(2)).alias("summary_text"),
                    F.array(planted(4), F.lit("AI title")).alias("govinfo_titles"))


def relevance(load):
    f = {"title": F.col("title"), "short_title": F.col("short_title"), "policy_area": F.col("policy_area"),
         "subjects": F.array_join("subjects", " "), "summary": F.col("summary_text")}
    return cu.score_relevance(relevance_input(load), f, F.col("govinfo_titles"))


def _plant_sql(offset):
    return f"source || case (doc_id + {offset}) % 7 when 0 then ' Artificial Intelligence ' when 1 then ' machine learning and AI ' when 2 then ' said aid ' when 3 then ' facial recognition, generative ai ' when 4 then ' frontier model of machine learning ' else '' end"


_TERMS = ["artificial intelligence", "machine learning", *fixed.EXTRA_TERMS]
_HIT = "list_filter([" + ", ".join(
    f"case when contains(lower(x), '{t}') then '{t}' end" for t in _TERMS) + r", case when regexp_matches(x, '(^|[^\p{L}\p{N}_])AI($|[^\p{L}\p{N}_])') then 'AI' end], lambda y: y is not null)"
_REL = f"""d as (select doc_id as bill_id, {_plant_sql(0)} as title, case when doc_id % 2 = 0 then {_plant_sql(1)} else '' end as short_title, lang as policy_area,
  {_plant_sql(3)} || ' ' || lang as subjects, text || {_plant_sql(2)} as summary, {_plant_sql(4)} as alt from documents),
loc as (unpivot d on title, short_title, policy_area, subjects, summary into name loc value x),
hit as (select bill_id, loc, alt, {_HIT} as h from loc),
agg as (select bill_id, any_value(alt) as alt, sum(len(h) * case loc when 'title' then 4.0 when 'short_title' then 3.0 when 'policy_area' then 2.5 when 'subjects' then 2.0 else 1.0 end) as s,
  bool_or(list_has_any(h, ['artificial intelligence', 'machine learning', 'AI'])) as anchored,
  bool_or(loc in ('title', 'short_title') and list_has_any(h, ['artificial intelligence', 'machine learning', 'AI'])) as in_title,
  string_agg(loc || ':' || len(h), ';' order by loc) filter (len(h) > 0) as places from hit group by bill_id),
alt as (select *, case when anchored then 0 else contains(lower(alt), 'artificial intelligence')::int + contains(lower(alt), 'machine learning')::int
  + regexp_matches(alt, '(^|[^a-z])AI($|[^a-z])')::int + 1 end as n_alt from agg)"""


@query("centrality", f"""with {_REL} select bill_id, round(s + n_alt * 2.0, 3)::double as centrality_score, anchored or n_alt > 0 as has_anchor,
case when in_title then 'A' else 'B' end as proposed_tier, coalesce(places, '') as places from alt""")
def centrality(load):
    """Weighted relevance score, match locations, anchor gate and tier of every document."""
    r = relevance(load)
    places = F.filter(F.array_sort(F.map_entries("match_locations")), lambda e: e["key"] != "govinfo_title")
    return r.select("bill_id", "centrality_score", "has_anchor", "proposed_tier", F.array_join(
        F.transform(places, lambda e: F.concat(e["key"], F.lit(":"), F.size(e["value"]).cast("string"))), ";").alias("places"))


_DECIDE = """s as (select doc_id as bill_id, (n_chars % 60) / 10.0 as score, case when n_chars % 2 = 0 then 'A' else 'B' end as tier0 from documents),
r as (select doc_id as bill_id, case when quality = 1 and toxic = 0 then 'y' when toxic = 1 then 'n' else '' end as inc, case when doc_id % 3 = 0 then 'A' else '' end as tier from labels),
dec as (select bill_id, case when inc = 'y' then true when inc = 'n' then false else score >= 3.0 end as included,
 case when inc = 'y' then coalesce(nullif(tier, ''), tier0) when inc = 'n' then null when score >= 3.0 then tier0 end as final_tier,
 case when inc in ('y', 'n') then 'human-review' else 'heuristic' end as decided_by from s left join r using (bill_id))"""


def decided(load):
    s = load("documents").select(F.col("doc_id").alias("bill_id"), ((F.col("n_chars") % 60) / 10.0).alias("centrality_score"),
                                 F.when(F.col("n_chars") % 2 == 0, "A").otherwise("B").alias("proposed_tier"))
    inc = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Y ").when(F.col("toxic") == 1, " n").otherwise("")
    sheet = load("labels").select(F.col("doc_id").alias("bill_id"), inc.alias("include (y/n)"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise("").alias("tier (A/B)"), F.lit(None).cast("string").alias("notes"))
    return cu.decide(s, cu.read_reviews(sheet), 3.0)


@query("decide", f"with {_DECIDE} select * from dec")
def decide(load):
    """Inclusion decision per document with reviews from the labels."""
    return decided(load).select("bill_id", "included", "final_tier", "decided_by")


@query("decision_counts", f"with {_DECIDE} select decided_by, included, count(*) as n from dec group by all")
def decision_counts(load):
    return cu.decision_counts(decided(load))


@query("promotion_status", """select doc_id as bill_id, case when l.doc_id is not null then 'skipped-exists' when n_chars < 200 then 'error' else 'added' end as status
from documents left join (select distinct doc_id from labels) l using (doc_id)""")
def promotion_status(load):
    """Which documents a promotion run would add, skip or refuse."""
    d = load("documents").select(F.col("doc_id").alias("bill_id"), F.when(F.col("n_chars") >= 200, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("versions"))
    return cu.to_promote(d, load("labels").select(F.col("doc_id").alias("bill_id")).distinct()).select("bill_id", "status")


@query("index_summary", """select (select count(*) from labels where quality = 1) as bill_count, doc_id as bill_id from labels where quality = 1""")
def index_summary(load):
    """Promoted ids, sorted, each next to the total."""
    rows = load("labels").select(F.col("doc_id").alias("bill_id"), F.when(F.col("quality") == 1, "added").otherwise("error").alias("status"))
    n, bills = cu.index_summary(rows)
    return bills.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").select("bill_count", "bill_id")


@query("backfill", """select backfill, count(*) as n from (select case when n_chars < 200 then 'missing' when lang = 'en' then 'already' else 'updated' end as backfill from documents) group by 1""")
def backfill(load):
    """Topic backfill outcome counts (the language stands for the topic)."""
    d = load("documents").select(F.col("lang").alias("topic"), (F.col("n_chars") >= 200).alias("has_record"))
    return cu.backfill_topic(d, "en").groupBy("backfill").agg(F.count(F.lit(1)).alias("n"))


@query("reconcile_merge", f"""with {BILLS}, reg as (select o_orderkey, o_orderstatus, c_name, c_mktsegment, c_nationkey from orders join customer on o_custkey = c_custkey where o_orderkey % 5 <> 0),
sm as (select event_id % (select count(*) from orders) as okey, strftime(ts, '%Y-%m-%d %H:%M:%S') as d, '<p>' || event_type || '</p> ' || user_id as t from events),
ls as (select okey, regexp_replace(arg_max(t, d || t), '<[^>]+>', '', 'g') as summary_text from sm group by okey)
select bill_id, case when o_orderkey is not null then c_name || ' (' || c_mktsegment || '-' || c_nationkey || ')' end as sponsor,
case when o_orderkey is not null then introduced_date || ': ' || o_orderstatus end as latest_action, summary_text, case when o_orderkey is null then 'not in registry' end as reconciliation_error
from bills b left join reg on b.okey = o_orderkey left join ls on ls.okey = b.okey""")
def reconcile_merge(load):
    """Bills joined with registry data and their newest summary."""
    b = model.bills(load)
    key = ["congress", "bill_type", "bill_number"]
    reg = b.where(F.col("okey") % 5 != 0).join(load("orders"), F.col("okey") == F.col("o_orderkey")).join(load("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        *key, "title", F.lit(None).cast("string").alias("policy_area"), F.col("c_name").alias("sponsor_name"), F.col("c_mktsegment").alias("sponsor_party"),
        F.col("c_nationkey").cast("string").alias("sponsor_state"), "introduced_date", F.col("introduced_date").alias("action_date"),
        F.col("o_orderstatus").alias("action_text"), F.array().cast("array<string>").alias("subjects"))
    n = load("orders").agg(F.count(F.lit(1)).alias("n_orders")).withColumn("k", F.lit(1))
    s = load("events").withColumn("k", F.lit(1)).join(n, "k").select(
        (F.col("event_id") % F.col("n_orders")).alias("okey"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("update_date"),
        F.concat(F.lit("<p>"), F.col("event_type"), F.lit("</p> "), F.col("user_id").cast("string")).alias("text"))
    s = s.join(b.select("okey", *key), "okey").drop("okey")
    return cu.reconcile(b.select("bill_id", *key), reg, s).select("bill_id", "sponsor", "latest_action", "summary_text", "reconciliation_error")


@query("source_priority", """select coalesce(l.doc_id, d.doc_id) as doc_id, coalesce(case when quality = 1 then 'q' end, lang) as a, coalesce(toxic::varchar, source) as b
from labels l full join documents d using (doc_id)""")
def source_priority(load):
    """Two sources merged field by field."""
    first = load("labels").select("doc_id", F.when(F.col("quality") == 1, "q").alias("a"), F.col("toxic").cast("string").alias("b"))
    second = load("documents").select("doc_id", F.col("lang").alias("a"), F.col("source").alias("b"))
    return cu.merge_sources(first, second, "doc_id", ["a", "b"])


@query("source_priority_all", """select coalesce(l.doc_id, d.doc_id) as doc_id, coalesce(case when quality = 1 then 'q' end, lang) as a, coalesce(toxic::varchar, source) as b
from labels l full join documents d using (doc_id)""")
def source_priority_all(load):
    """Two sources merged field by field, all documents; labels cover only some of them."""
    first = load("labels").select("doc_id", F.when(F.col("quality") == 1, "q").alias("a"), F.col("toxic").cast("string").alias("b"))
    second = load("documents").select("doc_id", F.col("lang").alias("a"), F.col("source").alias("b"))
    return cu.merge_sources(first, second, "doc_id", ["a", "b"])


@query("defaults_freshness", """select source, coalesce(nullif(lang, 'fr'), 'legislation') as stream, max(doc_id) as newest, count(*) as n, count(try_cast(substr(case when doc_id % 4 = 0 then 'n/a' else '2024-01-' || lpad((doc_id % 40)::varchar, 2, '0') end, 1, 10) as date)) as dated from documents group by all""")
def defaults_freshness(load):
    """Defaults for missing fields, newest record per source, lenient dates."""
    day = F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("T00:00")))
    d = load("documents").select("source", "doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("fr")), F.lit(fixed.DEFAULT_STREAM)).alias("stream"), tx.iso_date(day).alias("d"))
    return d.groupBy("source", "stream").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("n"), F.count("d").alias("dated"))


@query("merge_hits", """with e as (select event_id, user_id as bill_id, case when event_type = 'view' then null else event_type end as title, case when event_id % 3 = 0 then value end as score from events),
g as (select bill_id, min(event_id) as first_seen, arg_min(title, event_id) filter (title is not null) as title, arg_min(score, event_id) filter (score is not null) as score from e group by 1)
select bill_id, first_seen, title, round(score / (select max(score) from g), 6) as relevance from g""")
def merge_hits(load):
    """Bills surfaced by many results: first-seen order, first value per field, relative score."""
    from lexweave.operators.turns import merge_results

    e = load("events").select(F.col("user_id").alias("bill_id"), F.col("event_id").alias("seen"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("title"),
                              F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("relevance"), F.lit("all").alias("turn"))
    return merge_results(e, ["title"]).select("bill_id", "first_seen", "title", F.round("relevance", 6).alias("relevance"))


@query("scalar_pack", f"""with {BILLS}, x as (select bill_id, bill_urn, bill_type, congress, okey, title, short_title, sponsor, introduced_date, {model._LABELS} as label from bills)
select bill_id, case when bill_type in ('hr','hjres','hconres') then 'house' else 'senate' end as chamber,
'_legacy:customer-' || substr(sponsor, 10) || ':' || substr(sha1(sponsor || '|' || congress), 1, 10) as sponsor_id, 'prov:' || substr(sha1(bill_id), 1, 12) as prov_id,
'(' || (okey % 9) || ')' as marker, 'Sec. ' || (okey % 30) as locator, (okey % 50) || ' U.S.C. ' || okey as statute, 'Received' as action,
introduced_date as action_day, title as label_text, upper(bill_type) || ' ' || okey as untitled_raw, 'Sec. ' || (okey % 30) || '(' || (okey % 9) || ') of ' || label || ' ' || okey || ', ' || congress || 'th Cong.' as citation from x""")
def scalar_pack(load):
    """Row-wise label and id expressions over every bill."""
    b = model.bills(load)
    k = F.col("okey")
    enums = F.array(tx.norm_enum(F.concat(F.lit("SEC. "), (k % 30).cast("string"), F.lit("."))), tx.norm_enum(F.concat(F.lit(" ("), (k % 9).cast("string"), F.lit(")"))))
    cite = tx.section_citation(enums, tx.bill_citation("congress", "bill_type", "bill_number"))
    action = F.concat("introduced_date", F.lit(": Received"))
    return b.withColumn("citation", cite).select(
        "bill_id", tx.chamber("bill_type").alias("chamber"), ids.fallback_sponsor_id("sponsor", "congress").alias("sponsor_id"), ids.provenance_id("bill_id").alias("prov_id"),
        tx.last_marker("citation").alias("marker"), tx.short_locator(F.concat(tx.section_citation(F.array((k % 30).cast("string")), F.lit("x")))).alias("locator"),
        tx.statute_label(ids.statute_id((k % 50).cast("string"), k.cast("string"))).alias("statute"), tx.action_text(action).alias("action"), tx.action_date(action).alias("action_day"),
        tx.short_label("title", "bill_urn").alias("label_text"), F.concat(F.upper("bill_type"), F.lit(" "), k.cast("string")).alias("untitled_raw"), "citation")


@query("statute_ids", """select p_partkey, 'statute:us/usc/' || (p_partkey % 50 + 1) || '/' || p_partkey as statute_id from part""")
def statute_ids(load):
    """Four spellings of a statute section to one id."""
    p, t = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 50 + 1).cast("string")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, ids.statute_id(t, p)).when(k == 1, F.concat_ws("/", t, p)).when(k == 2, F.concat(t, F.lit(" U.S.C. "), p)).otherwise(F.concat(t, F.lit(" USC § "), p))
    return load("part").select("p_partkey", ids.normalise_statute(raw).alias("statute_id"))


@query("diff_rows", f"""with {LINES}, a as (select amendment_id, section_urn, before_text, nullif(after_text, ' ') as after_text, operation_type from amends),
r as (select amendment_id, section_urn, 'del' as kind, before_text as text, operation_type from a where before_text is not null union all
select amendment_id, section_urn, 'add', after_text, operation_type from a where after_text is not null union all
select amendment_id, section_urn, 'add', operation_type, operation_type from a where before_text is null and after_text is null)
select amendment_id, kind, text, case operation_type when 'strike_and_insert' then 'replace' when 'add_at_end' then 'add-end' when 'repeal' then 'strike' when 'other' then 'insert' else operation_type end as op from r""")
def diff_rows(load):
    """Struck and inserted side of every operation; the prose when both are empty."""
    a = model.amends(load).withColumn("after_text", F.nullif(F.col("after_text"), F.lit(" ")))
    rows = tx.diff_rows("before_text", "after_text", "operation_type")
    return a.select("amendment_id", tx.lookup("operation_type", fixed.OPERATION_DISPLAY, "insert").alias("op"), F.inline(rows))


@query("anchor_texts", f"""with {LINES} select amendment_id, case when trim(after_text) <> '' then after_text else coalesce(before_text, '') end as anchor from amends""")
def anchor_texts(load):
    """The text each operation anchors to."""
    return model.amends(load).select("amendment_id", tx.anchor_text("before_text", "after_text").alias("anchor"))
