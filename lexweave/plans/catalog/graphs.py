"""Graph, tree and set queries over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import ids, text as tx
from lexweave.operators import graph as gr, search, tree as tr
from lexweave.plans.catalog import model
from lexweave.plans.catalog.model import BILLS, LINES
from lexweave.plans.catalog.registry import query


def uses(load):
    return load("documents").select(F.explode(search.tokens("text")).alias("term"), F.col("doc_id").alias("bill"))


_PAIRS = r"""u as (select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term, doc_id as bill from documents),
band as (select term, count(*) as n from u group by 1 having count(*) between 2 and 12),
b as (select u.* from u join band using (term)),
pairs as (select x.bill as a, y.bill as b, term from b x join b y using (term) where x.bill < y.bill)"""


@query("shared_term_graph", f"""with {_PAIRS}, r as (select *, row_number() over (partition by a, b order by term collate "C") as rn from pairs)
select a, b, count(*) as weight, string_agg(term, ',' order by rn) filter (rn <= 5) as terms from r group by a, b having count(*) >= 2""")
def shared_term_graph(load):
    """Documents that share at least two rare tokens, with the first five of them."""
    e = gr.shared_term_edges(gr.term_pairs(gr.band_terms(uses(load))), min_weight=2)
    return e.withColumn("terms", F.array_join("terms", ","))


_RANK = f"""{_PAIRS}, e as (select a, b, count(*) as weight from pairs group by all),
deg as (select bill, sum(weight)::bigint as degree from (select a as bill, weight from e union all select b, weight from e) group by 1),
rk as (select doc_id as bill, degree, coalesce(degree, 0) + 0.5 * (n_chars / 100.0) as rank from documents left join deg on bill = doc_id order by rank desc, bill limit 60),
kept as (select * from rk where degree > 0),
ins as (select e.* from e where weight >= 2 and a in (select bill from kept) and b in (select bill from kept))"""


@query("node_rank", f"with {_RANK} select bill, degree, round(rank, 6)::double as rank from kept where bill in (select a from ins union select b from ins)")
def node_rank(load):
    """Best-ranked connected documents of the shared-token graph."""
    nodes, _ = _landing(load)
    return nodes.select("bill", "degree", F.round("rank", 6).alias("rank"))


@query("landing_edges", f"with {_RANK} select a, b, weight from ins")
def landing_edges(load):
    """Heavy edges among the kept nodes."""
    return _landing(load)[1].select("a", "b", "weight")


def _landing(load):
    pairs = gr.term_pairs(gr.band_terms(uses(load)))
    e = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return gr.landing_graph(load("documents").select(F.col("doc_id").alias("bill"), (F.col("n_chars") / 100.0).alias("centrality")), e)


@query("shared_between", f"""with {_PAIRS} select a, b, term, n as n_bills from pairs join band using (term) where b = a + 1
qualify row_number() over (partition by a, b order by n desc, term collate "C") <= 2""")
def shared_between(load):
    """The two most widely used tokens shared by neighbouring documents."""
    band = gr.band_terms(uses(load))
    want = load("documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return gr.shared_between(gr.term_pairs(band), band, want).select("a", "b", "term", F.col("n_bills").cast("long").alias("n_bills"))


@query("shared_between_all", f"""with {_PAIRS} select a, b, term, n as n_bills from pairs join band using (term) where b = a + 1
qualify row_number() over (partition by a, b order by n desc, term collate "C") <= 2""")
def shared_between_all(load):
    """The two most widely used tokens shared by neighbouring documents, all pairs of neighbours."""
    band = gr.band_terms(uses(load))
    want = load("documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return gr.shared_between(gr.term_pairs(band), band, want).select("a", "b", "term", F.col("n_bills").cast("long").alias("n_bills"))


# -- region / nation / customer as a tree ----------------------------------
def nodes(load):
    r = load("region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("int").alias("ordinal"), F.col("r_name").alias("name"))
    n = load("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("int").alias("ordinal"), F.col("n_name").alias("name"))
    c = load("customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.col("c_custkey").cast("int").alias("ordinal"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


_TREE = """nd as (select 'R' || r_regionkey as id, null as parent, r_regionkey as ordinal, r_name as name from region union all
select 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey, n_name from nation union all select 'C' || c_custkey, 'N' || c_nationkey, c_custkey, c_name from customer)"""


@query("tree_closure", f"""with recursive {_TREE}, t(id, ancestor, distance) as (select id, parent, 1 from nd where parent is not null
union all select t.id, nd.parent, distance + 1 from t join nd on nd.id = t.ancestor where nd.parent is not null) select * from t""")
def tree_closure(load):
    """All ancestor pairs of the region, nation and customer tree."""
    return tr.closure(nodes(load).select("id", "parent"))


@query("root_index", f"""with recursive {_TREE}, t(id, root) as (select id, id from nd where parent is null union all select nd.id, t.root from nd join t on nd.parent = t.id) select * from t""")
def root_index(load):
    return tr.root_index(nodes(load).select("id", "parent"))


@query("outline", f"""with recursive {_TREE}, t(id, level, key, title) as (select id, 1, lpad(ordinal::varchar, 9, '0'), name from nd where parent is null
union all select nd.id, level + 1, key || '/' || lpad(nd.ordinal::varchar, 9, '0'), name from nd join t on nd.parent = t.id) select id, level, key, title from t""")
def outline(load):
    """Preorder keys and levels from parent pointers."""
    n = nodes(load)
    key = F.lpad(F.col("ordinal").cast("string"), 9, "0")
    up = tr.closure(n.select("id", "parent")).join(n.select(F.col("id").alias("ancestor"), key.alias("k")), "ancestor")
    path = up.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "k"))).alias("p"))
    full = F.concat(F.transform(F.coalesce("p", F.array().cast("array<struct<d:int,k:string>>")), lambda x: x["k"]), F.array(key))
    return n.join(path, "id", "left").select("id", F.size(full).alias("level"), F.array_join(full, "/").alias("key"), F.col("name").alias("title"))


@query("edge_tables", f"""with {LINES} select 'of_jurisdiction' as edge, count(*) as n from bills union all select 'has_version', count(*) from bills where tier is not null
union all select 'has_section', count(*) from sections join bills using (bill_urn) where bills.tier is not null and ordinal < 4 union all select 'parent_of', count(*) from sections where ordinal >= 4
union all select 'sponsored_by', count(*) from bills union all select 'cosponsored_by', count(*) from (select distinct bill_urn, l_suppkey from lines)
union all select 'cites_external', count(*) from cites union all select 'defines', count(*) from terms union all select 'by_reference', count(*) from terms where statute_id is not null
union all select 'amends', count(*) from amends union all select 'targets', count(*) from amends where statute_id is not null union all select 'produced', count(distinct section_urn) from cites""")
def edge_tables(load):
    """Row counts of all twelve edge tables built from the mapped model."""
    from lexweave.operators.lookups import table_counts

    none = F.lit(None).cast("string")
    b = model.bills(load).withColumn("canonical_version_date", F.col("introduced_date")).withColumn("canonical_version_code", F.col("tier")).withColumn(
        "xml_format", none).withColumn("canonical_package_id", none)
    people = model.lines(load).select(
        "bill_urn", F.col("l_linenumber").alias("at"), F.col("l_suppkey").cast("string").alias("bioguide"), none.alias("full_name"), none.alias("last_name"), none.alias("first_name"),
        none.alias("party"), none.alias("state"), none.alias("district"), none.alias("sponsorship_date"), F.lit(True).alias("original"))
    s = model.sections(load).withColumn("parent_urn", F.when(F.col("ordinal") >= 4, F.concat("bill_urn", F.lit("::L"), (F.col("ordinal") - 3).cast("string"))))
    t = model.terms(load)
    c = model.cites(load).withColumn("raw_text", none).withColumn("xml_ref_id", none)
    e = gr.edge_tables(b, gr.sponsor_rows(b, people), s, c, t.select("section_urn", "term_id", "definition_type", "bill_urn"),
                       t.where("statute_id is not null").select("term_id", "statute_id"), model.amends(load).withColumn("xml_ref_id", none))
    return table_counts(e).select(F.col("table_name").alias("edge"), F.col("n_rows").alias("n"))


@query("sponsor_dimension", f"""with {LINES}, r as (select bill_urn, 0 as kind, 0 as pos, '_legacy:customer-' || substr(sponsor, 10) || ':' || substr(sha1(sponsor || '|' || congress), 1, 10) as sponsor_id, sponsor as display from bills
union all select bill_urn, 1, l_linenumber, 'person:bioguide/' || l_suppkey, coalesce(nullif(l_returnflag, 'N') || bill_number, 'S' || l_suppkey) from (select l.*, okey as bill_number from lines l join bills using (bill_urn)))
select sponsor_id, display, case kind when 0 then 'fallback' else 'bioguide' end as id_source from r qualify row_number() over (partition by sponsor_id order by bill_urn, kind, pos, display) = 1""")
def sponsor_dimension(load):
    """People named as sponsors or cosponsors; the first mention gives the name."""
    none = F.lit(None).cast("string")
    l = model.lines(load)
    people = l.groupBy("bill_urn", "l_suppkey", F.col("l_linenumber").alias("at")).agg(F.min(F.coalesce(
        F.concat(F.nullif("l_returnflag", F.lit("N")), F.col("okey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))).alias("full_name"))
    people = people.select("bill_urn", "at", F.col("l_suppkey").cast("string").alias("bioguide"), "full_name", *[none.alias(c) for c in (
        "last_name", "first_name", "party", "state", "district", "sponsorship_date")], F.lit(True).alias("original"))
    return gr.sponsor_dimension(gr.sponsor_rows(model.bills(load), people)).select("sponsor_id", "display", "id_source")


@query("ego_graph", f"""with {LINES}, c as (select bill_urn from terms where surface_form = 'red widget' order by bill_urn limit 1), rel as (select bill_urn from bills where okey = 6)
select 'center' as id, 'bill' as kind, (select case bill_type when 'hr' then 'H.R.' when 's' then 'S.' when 'hjres' then 'HJRES.' else 'X' end from bills where bill_urn = 'x') as label, null as ref where false
union all select 'rel_0', 'bill', upper(replace(replace(upper(bill_type), 'HR', 'H.R.'), 'S', 'S.')) || ' ' || bill_number, null from bills where okey = 6
union all select 'center', 'bill', replace(replace(upper(bill_type), 'HR', 'H.R.'), 'S', 'S.') || ' ' || bill_number, null from bills where okey = 1
union all select 'def_0', case when count(*) > 0 then 'def' else 'missing' end, case when count(*) > 0 then '"red widget"' else 'red widget' end, min(statute_id) from terms where surface_form = 'red widget' and bill_urn = (select bill_urn from bills where okey = 1)
union all select 'sec_0', case when count(*) > 0 then 'sec' else 'missing' end, case when count(*) > 0 then 'Sec. 2' else 'Line 2' end, null from sections where heading = 'Line 2' and bill_urn = (select bill_urn from bills where okey = 1)
union all select 'cite_0', 'cite', replace(statute_citation, 'U.S.C.', 'U.S.C. §'), null from statutes where statute_id = 'statute:us/usc/12/111'""")
def ego_graph(load):
    """Neighbourhood of one bill; pieces that do not exist are reported."""
    b = model.bills(load)
    urn = {r.okey: r.bill_urn for r in b.where("okey in (1, 6)").select("okey", "bill_urn").collect()}
    n, _ = gr.ego_graph(urn[1], [urn[6]], ["red widget"], ["Line 2"], "statute:us/usc/12/111", b, model.terms(load), model.sections(load), model.statutes(load))
    return n


@query("grouped_citations", f"""with {LINES} select c.bill_urn, section_urn as root, 'SEC. ' || enum || ' — ' || coalesce(heading, '') as grp, statute_id,
split_part(statute_id, '/', 3) || ' U.S.C. ' || split_part(statute_id, '/', 4) as ref from cites c join sections using (section_urn)""")
def grouped_citations(load):
    """Citation items under their top-level section."""
    return gr.citation_groups(model.sections(load), model.cites(load))


@query("set_ops", """with c as (select distinct c_nationkey as k from customer where c_acctbal > 9000), s as (select distinct s_nationkey as k from supplier where s_acctbal > 5000)
select 'union' as op, k::bigint as k from (select k from c union select k from s) union all select 'intersect', k from (select k from c intersect select k from s) union all select 'except', k from (select k from c except select k from s)""")
def set_ops(load):
    """Union, intersection and difference of two id sets (topic disjointness is an empty intersection)."""
    c = load("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("k"))
    s = load("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("k"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "intersect")).unionByName(tag(c.subtract(s), "except"))
