"""Read queries of the knowledge base over the mapped tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import ids
from lexweave.operators import lookups as lk
from lexweave.plans.catalog import model
from lexweave.plans.catalog.model import BILLS, LINES
from lexweave.plans.catalog.registry import query
from lexweave.sources.tables import pieces

TERM, ALSO, STATUTE = "red widget", ["Blue Bolt"], "12/711"


def args(load):
    return model.terms(load), model.bills(load), model.sections(load), model.statutes(load)


_DEFS = f"""with {LINES} select distinct bill_urn, short_title, title, congress, surface_form, section_urn, citation, definition_type, statute_id, statute_citation
from terms join bills using (bill_urn) join sections using (bill_urn, section_urn) """


@query("bills_defining", _DEFS + "left join statutes using (statute_id) where lower(surface_form) in ('red widget', 'blue bolt')")
def bills_defining(load):
    """Bills that define a term or a synonym."""
    return lk.bills_defining(*args(load), TERM, ALSO)


@query("bills_defining_by_reference", _DEFS + "join statutes using (statute_id) where lower(surface_form) = 'red widget' and definition_type = 'by_reference' and statute_id = 'statute:us/usc/2/1'")
def bills_defining_by_reference(load):
    """The same with a required statute target in prose form."""
    return lk.bills_defining(*args(load), TERM, by_reference_to="2 U.S.C. § 1")


@query("terms_side_by_side", f"""with {LINES} select distinct bill_urn, short_title, congress, citation, definition_type, definition_text, statute_citation
from terms join bills using (bill_urn) join sections using (bill_urn, section_urn) left join statutes using (statute_id) where lower(surface_form) = 'red widget'""")
def terms_side_by_side(load):
    """One term across all bills."""
    return lk.definitions_of(*args(load), TERM)


@query("terms_of", f"""with {LINES}, t as (select * from terms where bill_urn in (select bill_urn from bills where tier = 'A')
  qualify row_number() over (partition by term_id order by section_urn, surface_form, definition_type, statute_id nulls first) = 1)
select bill_urn, term_id, surface_form, section_urn, citation, 'section_local' as scope, definition_type, statute_id, statute_citation
from t left join sections using (bill_urn, section_urn) left join statutes using (statute_id)""")
def terms_of(load):
    """Terms of every tier-A bill, one row per term id."""
    asked = model.bills(load).where("tier = 'A'").select("bill_urn")
    t, _, s, st = args(load)
    return lk.terms_of(asked, t, s, st).drop("definition_text")


@query("definition_counts", f"""with {LINES} select bill_urn, count(*) as total, count(*) filter (definition_type = 'direct') as direct_count,
count(*) filter (definition_type = 'by_reference') as by_reference_count from terms group by bill_urn""")
def definition_counts(load):
    return lk.definition_counts(model.terms(load), ["bill_urn"])


@query("ops_of", f"""with {LINES} select bill_urn, amendment_id, section_urn, citation, operation_type, before_text, after_text, statute_id, statute_citation
from amends left join sections using (bill_urn, section_urn) left join statutes using (statute_id) where bill_urn in (select bill_urn from bills where tier = 'B')""")
def ops_of(load):
    """Operations of every tier-B bill; the target may be missing."""
    asked = model.bills(load).where("tier = 'B'").select("bill_urn")
    return lk.amendments_of(asked, model.amends(load), model.sections(load), model.statutes(load))


@query("amendments_targeting", f"""with {LINES} select amendment_id, bill_urn, section_urn, citation, operation_type, before_text, after_text, statute_id, statute_citation
from amends join sections using (bill_urn, section_urn) join statutes using (statute_id) where statute_id = 'statute:us/usc/12/711'""")
def amendments_targeting(load):
    return lk.amendments_targeting(model.amends(load), model.sections(load), model.statutes(load), STATUTE)


@query("per_bill_rollup", f"""with {LINES}, r as (select statute_id, bill_urn, count(distinct amendment_id) as n_operations, string_agg(distinct operation_type, ',' order by operation_type) as operation_types
from amends where statute_id is not null group by all)
select r.*, short_title, title, congress, statute_citation from r join bills using (bill_urn) join statutes using (statute_id)""")
def per_bill_rollup(load):
    """Per bill and statute: distinct operations and their types."""
    out = lk.bills_amending(model.amends(load), model.bills(load), model.statutes(load))
    return out.withColumn("operation_types", F.array_join("operation_types", ","))


@query("adjacency", f"""with {LINES}, o as (select section_urn as section, type, count(*) as n from cites group by all),
i as (select section_urn as section, type, count(*) as n from (select section_urn, lower(l_linestatus) as type from lines where l_returnflag = 'R') group by all),
oo as (select section, sum(n)::bigint as out_count, string_agg(type || '=' || n, ',' order by type) as by_type_out from o group by 1),
ii as (select section, sum(n)::bigint as in_count, string_agg(type || '=' || n, ',' order by type) as by_type_in from i group by 1)
select coalesce(oo.section, ii.section) as section, out_count, by_type_out, in_count, by_type_in from oo full join ii on oo.section = ii.section""")
def adjacency(load):
    """Outgoing and incoming edge counts per section by type (flag R stands for incoming edges)."""
    inbound = model.lines(load).where("l_returnflag = 'R'").select(F.col("section_urn").alias("target_urn"), F.lower("l_linestatus").alias("type"))
    out = lk.adjacency(model.cites(load), inbound)
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("by_type_out", flat("by_type_out")).withColumn("by_type_in", flat("by_type_in"))


@query("neighbourhood", f"""with {LINES}, e as (
  select section_urn as root, section_urn as source_id, statute_id as target_id, 'out' as direction from cites
  union all select section_urn, 'bill:' || l_suppkey, section_urn, 'in' from lines where l_returnflag = 'R'),
k as (select *, row_number() over (partition by root, direction order by source_id, target_id) as n from e qualify n <= 2),
f as (select root, max(n) filter (direction = 'out') as o from k group by root)
select root, source_id, target_id, direction, coalesce(o = 2, false) as truncated from k join f using (root)""")
def neighbourhood(load):
    """Up to two edges per direction around every section."""
    internal = model.lines(load).where("l_returnflag = 'R'").select(
        F.concat(F.lit("bill:"), F.col("l_suppkey").cast("string")).alias("source_urn"), F.col("section_urn").alias("target_urn"))
    s = model.sections(load)
    return lk.neighbourhood(s.select("section_urn"), s, model.cites(load), internal, max_nodes=2)


@query("top_cited", f"""with {LINES} select t.*, statute_citation from (select statute_id, count(*) as n from cites group by 1 order by n desc, statute_id limit 5) t left join statutes using (statute_id)""")
def top_cited(load):
    return lk.top_statutes(model.cites(load), model.statutes(load))


@query("distinct_reach", f"""with {LINES} select 'cites' as kind, count(distinct bill_urn) as n_bills from cites union all
select 'defines', count(distinct bill_urn) from terms union all select 'amends', count(distinct bill_urn) from amends""")
def distinct_reach(load):
    """Bills with at least one citation, term or amendment."""
    return lk.reach({"cites": model.cites(load), "defines": model.terms(load), "amends": model.amends(load)})


@query("bills_touching", f"""with {LINES} select distinct bill_urn from (select * exclude (type) from cites union all by name select bill_urn, section_urn, statute_id from amends union all by name select bill_urn, section_urn, statute_id from terms) where statute_id = 'statute:us/usc/12/711'""")
def bills_touching(load):
    """Distinct bills citing, amending or defining by one statute."""
    c = ["bill_urn", "statute_id"]
    edges = model.cites(load).select(c).unionByName(model.amends(load).select(c)).unionByName(model.terms(load).select(c))
    return lk.bills_touching(edges, STATUTE)


@query("sponsor_counts", f"with {BILLS} select sponsor, congress, count(*) as n from bills group by all order by n desc, sponsor, congress limit 10")
def sponsor_counts(load):
    """Bills per sponsor and congress, the ten largest."""
    return model.bills(load).groupBy("sponsor", "congress").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sponsor", "congress").limit(10)


@query("coverage", f"""with {BILLS} select count(*) as bills, (select string_agg(distinct congress, ',' order by congress) from bills) as congresses, min(introduced_date) as first_date,
max(introduced_date) as last_date, count(*) filter (tier = 'A') as tier_a, count(*) filter (tier = 'B') as tier_b from bills""")
def coverage(load):
    out = lk.coverage(model.bills(load))
    return out.withColumn("congresses", F.array_join(F.transform("congresses", lambda c: c.cast("string")), ","))


@query("coverage_note", f"""with {BILLS}, p as (select topic, count(*) as n from bills group by 1)
select (select count(*) from bills) || ' bills, Congress ' || (select min(congress) from bills) || '-' || (select max(congress) from bills) || ', topics: ' ||
(select string_agg(topic || '=' || n, ', ' order by topic) from p) || ' (legislation stream only)' as note""")
def coverage_note(load):
    return lk.coverage_note(model.bills(load))


@query("build_statistics", f"""with {LINES} select 'bills' as table_name, count(*) as n_rows from bills union all select 'sections', count(*) from sections
union all select 'cites', count(*) from cites union all select 'terms', count(*) from terms union all select 'amends', count(*) from amends""")
def build_statistics(load):
    """Rows per table."""
    m = {"bills": model.bills, "sections": model.sections, "cites": model.cites, "terms": model.terms, "amends": model.amends}
    return lk.table_counts({k: f(load) for k, f in m.items()})


@query("bill_card", f"""with {LINES}, s as (select bill_id, string_agg(coalesce(heading, 'Section ' || enum), '; ' order by ordinal) as sections from sections group by 1)
select bill_id, congress, bill_type, bill_number, title, short_title, sponsor, 'Customer#' || lpad(o_custkey::varchar, 9, '0') || ' (' || c_mktsegment || '-' || c_nationkey || ')' as cosponsors,
coalesce(s.sections, '') as sections, lower(o_orderstatus) as versions, introduced_date, introduced_date || ': ' || o_orderstatus as latest_action, coalesce(tier, 'B') as tier,
'govinfo:unknown|congress.gov:' || congress || '/' || bill_type || '/' || bill_number as sources
from bills join orders on okey = o_orderkey join customer on o_custkey = c_custkey left join s using (bill_id)""")
def bill_card(load):
    """Every bill with its cosponsors, table of contents and versions."""
    o = model.bills(load).select("bill_id", "okey").join(load("orders"), F.col("okey") == F.col("o_orderkey"))
    people = o.join(load("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "bill_id", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").cast("string").alias("state"), F.col("o_orderdate").alias("sponsorship_date"))
    versions = o.select("bill_id", F.lower("o_orderstatus").alias("version_code"), F.col("o_orderdate").alias("date_issued"), F.col("bill_id").alias("package_id"))
    bills = o.select("bill_id", F.col("o_orderstatus").alias("latest_action_text")).join(model.bills(load), "bill_id").withColumn(
        "latest_action_date", F.col("introduced_date")).withColumn("canonical_package_id", F.lit(None).cast("string"))
    card = lk.bill_cards(bills, people, model.sections(load), versions)
    return card.select(
        "bill_id", "congress", "bill_type", "bill_number", "title", "short_title", "sponsor", F.array_join("cosponsors", "; ").alias("cosponsors"),
        F.array_join("sections", "; ").alias("sections"), F.array_join("versions", "; ").alias("versions"),
        F.col("introduced_date").cast("string").alias("introduced_date"), "latest_action", "tier", F.array_join("provenance.sources", "|").alias("sources"))


@query("not_found_lookup", f"""with {LINES}, r as (select distinct bill_id || '::L' || (1 + okey % 9) as section_id from bills)
select section_id, coalesce(bill_id, split_part(section_id, '::', 1)) as bill_id, coalesce(heading, '') as heading, citation as canonical_citation, bill_id is null as not_found,
(select count(*) from cites c where c.section_urn = s.section_urn) as citations_out from r left join sections s using (section_id)""")
def not_found_lookup(load):
    """One section request per bill; some ids do not exist."""
    asked = model.bills(load).select(F.concat("bill_id", F.lit("::L"), (1 + F.col("okey") % 9).cast("string")).alias("section_id"))
    s = model.sections(load).withColumn("text_full", F.lit("")).withColumn("text_self", F.lit(""))
    none = F.lit(None).cast("string")
    b = model.bills(load).select("bill_id", *[none.alias(c) for c in ("canonical_package_id", "canonical_version_code", "canonical_version_date")])
    out = lk.section_lookup(asked, s, b, model.cites(load).drop("type"))
    return out.select("section_id", "bill_id", "heading", "canonical_citation", "not_found", "citations_out")


@query("path_resolve", f"""with {LINES}, r as (select bill_id as request_id, {model._LABELS} as label, bill_number, bill_type, congress, okey from bills),
q as (select *, 1 + okey % 8 as n, case when okey % 5 <> 0 then congress end as asked from r),
m as (select request_id, s.bill_id, s.section_id from q join bills b on q.bill_type = b.bill_type and q.bill_number = b.bill_number and (asked is null or asked = b.congress)
  join sections s on s.bill_id = b.bill_id and s.enum = q.n::varchar)
select request_id, m.bill_id, m.section_id, count(m.section_id) over (partition by request_id) > 1 as is_ambiguous from q left join m using (request_id)""")
def path_resolve(load):
    """Citation strings built for every bill, resolved back to sections."""
    from lexweave import fixed
    from lexweave.functions import text as tx

    b = model.bills(load)
    number = F.concat(F.when(F.col("okey") % 2 == 0, "0").otherwise(""), (1 + F.col("okey") % 8).cast("string"))
    cong = F.when(F.col("okey") % 5 != 0, F.concat(F.lit(", "), F.col("congress").cast("string"), F.lit("th Cong."))).otherwise("")
    text = F.concat(F.lit("see Sec. "), number, F.lit(" of "), tx.lookup("bill_type", fixed.BILL_TYPE_LABELS), F.lit(" "), F.col("bill_number").cast("string"), cong)
    s = model.sections(load).withColumn("enum_path", F.array("enum")).withColumn("ancestor_path", F.array("section_id"))
    return lk.resolve_citations(b.select(F.col("bill_id").alias("request_id"), text.alias("text")), b, s)


@query("anti_resume", """with d as (select d.doc_id, source, l.doc_id is not null as done from documents d left join labels l using (doc_id))
select source as topic, count(*) as total, count(*) filter (done) as embedded, round(100.0 * count(*) filter (done) / count(*), 4)::double as pct, coalesce(sum(doc_id) filter (not done), 0)::bigint as todo_sum from d group by 1""")
def anti_resume(load):
    """Per source: sections with a vector (here: a label), and what is still to encode."""
    docs = load("documents").select(F.col("doc_id").alias("section_id"), F.col("source").alias("topic"))
    done = load("labels").select(F.col("doc_id").alias("section_id"))
    todo = docs.join(done, "section_id", "left_anti").groupBy("topic").agg(F.sum("section_id").alias("todo_sum"))
    return lk.embedding_coverage(docs, done).join(todo, "topic", "left").withColumn("todo_sum", F.coalesce("todo_sum", F.lit(0)))


@query("ref_filter", f"""with {LINES} select section_urn, statute_id from cites where exists (select 1 from statutes s where s.statute_id = cites.statute_id and p_name like 'red%')""")
def ref_filter(load):
    """Edges whose endpoint exists in the (restricted) statute table."""
    known = model.statutes(load).where(F.col("p_name").startswith("red"))
    return model.cites(load).join(known, "statute_id", "left_semi").select("section_urn", "statute_id")


@query("carry_topic", f"""with {LINES} select section_id, topic from sections join bills using (bill_id) where topic = 'redistricting'""")
def carry_topic(load):
    """Sections take their bill's topic; one topic is read."""
    topics, k = model.bills(load).select("bill_id", "topic"), pieces(load("lineitem"))
    return model.sections(load).repartition(k, "bill_id").join(topics.repartition(k, "bill_id").hint("merge"), "bill_id").where("topic = 'redistricting'").select("section_id", "topic")


@query("id_normalise", f"""with {BILLS}, s as (select case okey % 4 when 0 then bill_id when 1 then bill_urn when 2 then {model._LABELS} || ' ' || bill_number || ' (' || congress || 'th Cong.)' else {model._LABELS} || ' ' || bill_number end as raw, * from bills)
select raw, case when okey % 4 = 3 then null else bill_id end as bill_id, case when okey % 4 = 3 then 'needs_congress' else 'ok' end as status, bill_type, bill_number from s""")
def id_normalise(load):
    """Four spellings of a bill back to one id."""
    from lexweave import fixed
    from lexweave.functions import text as tx

    k = F.col("okey") % 4
    prose = F.concat(tx.lookup("bill_type", fixed.BILL_TYPE_LABELS), F.lit(" "), F.col("bill_number").cast("string"))
    raw = F.when(k == 0, F.col("bill_id")).when(k == 1, F.col("bill_urn")).when(
        k == 2, F.concat(prose, F.lit(" ("), F.col("congress").cast("string"), F.lit("th Cong.)"))).otherwise(prose)
    n = model.bills(load).select(raw.alias("raw")).withColumn("n", ids.normalise_bill("raw"))
    return n.select("raw", "n.bill_id", "n.status", "n.bill_type", "n.bill_number")


@query("disambiguate", f"""with {BILLS}, m as (select okey % 50 as num, bill_type, congress from bills),
c as (select distinct num as bill_number, bill_type, congress from m),
r as (select distinct num as bill_number, bill_type from m),
g as (select r.bill_number, r.bill_type, count(*) as n, string_agg(congress || '-' || r.bill_type || '-' || r.bill_number, ',' order by congress) as o, min(congress) as c0
  from r join c using (bill_number, bill_type) group by all)
select bill_type || bill_number as request_id, case when n = 1 then o end as bill_id, case when n = 1 then 'ok' else 'ambiguous' end as status, case when n > 1 then o end as options from g""")
def disambiguate(load):
    """Requests without a congress, settled against the corpus."""
    b = model.bills(load).select("bill_type", (F.col("okey") % 50).alias("bill_number"), "congress").distinct()
    r = b.select(F.concat("bill_type", F.col("bill_number").cast("string")).alias("request_id"), "bill_type", "bill_number",
                 F.lit(None).cast("string").alias("bill_id"), F.lit("needs_congress").alias("status")).distinct()
    return ids.disambiguate(r, b).withColumn("options", F.array_join("options", ","))
