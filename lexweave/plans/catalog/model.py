"""The legal data model read out of the star-schema tables.

An order is a bill, the distinct (order, line number) pairs are its sections, a part is a statute
section, and each line item is one citation (flag A), defined term (N) or amendment (R).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import ids, text as tx
from lexweave.operators.rank import keep_first
from lexweave.sources.tables import pieces

TYPES = ["hr", "s", "hjres", "sjres", "hconres"]
OPS = ["insert", "strike", "replace", "repeal", "strike_and_insert", "add_at_end", "other"]


def bills(load):
    o = load("orders")
    key = F.col("o_orderkey")
    kind = tx.lookup(F.substring("o_orderpriority", 1, 1), {str(i + 1): t for i, t in enumerate(TYPES)})
    o = o.withColumn("congress", 118 + key % 2).withColumn("bill_type", kind)
    return o.select(
        ids.legacy_bill_id("congress", "bill_type", key).alias("bill_id"), ids.bill_urn("congress", "bill_type", key).alias("bill_urn"),
        "congress", "bill_type", key.alias("bill_number"),
        F.concat(F.lit("An Act on "), F.col("o_orderpriority"), F.lit(" matters of customer "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(key % 3 != 0, F.concat(F.lit("Act "), key.cast("string"))).alias("short_title"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("sponsor"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("introduced_date"),
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").alias("tier"),
        F.when(key % 4 == 0, "redistricting").otherwise("ai_governance").alias("topic"),
        F.lit("legislation").alias("stream"), key.alias("okey"))


def lines(load):
    """Line items with their bill: both sides dealt by order key into pieces that do not grow, ids built after the join."""
    l, b = load("lineitem"), bills(load).select("okey", "congress", "bill_type", "bill_number")
    k, key, part = pieces(l), ("congress", "bill_type", "bill_number"), F.col("l_partkey")
    l = l.repartition(k, "l_orderkey").join(b.repartition(k, "okey").hint("merge"), F.col("l_orderkey") == F.col("okey"))
    l = l.withColumn("bill_id", ids.legacy_bill_id(*key)).withColumn("bill_urn", ids.bill_urn(*key))
    return l.withColumn("section_urn", F.concat("bill_urn", F.lit("::L"), F.col("l_linenumber").cast("string"))).withColumn(
        "statute_id", ids.statute_id((part % 50 + 1).cast("string"), part.cast("string")))


def sections(load):
    """Distinct (order, line number) pairs.

    Both sides are dealt by order key once, are made distinct there while they are still narrow, and are
    joined in the same order; ids and citations are built last. A task holds two sorted pieces, whose
    size does not grow with the tables.
    """
    l, b = load("lineitem"), bills(load).select("okey", "congress", "bill_type", "bill_number")
    k = pieces(l)
    l = keep_first(l.where("l_orderkey is not null").select("l_orderkey", "l_linenumber").repartition(k, "l_orderkey"),
                   ["l_orderkey", "l_linenumber"], [F.col("l_linenumber")])
    b = keep_first(b.where("okey is not null").repartition(k, "okey"), ["okey", "bill_type"], [F.col("bill_type")])
    key, n = ("congress", "bill_type", "bill_number"), F.col("l_linenumber").cast("string")
    return l.join(b.hint("merge"), F.col("l_orderkey") == F.col("okey")).select(
        "l_linenumber", *key, ids.legacy_bill_id(*key).alias("bill_id"), ids.bill_urn(*key).alias("bill_urn")).select(
        "bill_id", "bill_urn", F.concat("bill_urn", F.lit("::L"), n).alias("section_urn"), F.concat("bill_id", F.lit("::L"), n).alias("section_id"),
        F.col("l_linenumber").alias("ordinal"),
        n.alias("enum"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Line "), n)).alias("heading"),
        F.lit(None).cast("string").alias("parent_section_id"),
        F.concat(F.lit("Sec. "), n, F.lit(" of "), tx.bill_citation("congress", "bill_type", "bill_number")).alias("canonical_citation"))


def statutes(load):
    p = F.col("p_partkey")
    return load("part").select(ids.statute_id((p % 50 + 1).cast("string"), p.cast("string")).alias("statute_id"),
                               F.concat((p % 50 + 1).cast("string"), F.lit(" U.S.C. "), p.cast("string")).alias("canonical_citation"), "p_partkey", "p_name")


def cites(load):
    return lines(load).where("l_returnflag = 'A'").select("bill_id", "bill_urn", "section_urn", "statute_id", F.lower("l_linestatus").alias("type"))


def terms(load):
    named = lines(load).where("l_returnflag = 'N'").join(load("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    by_ref = F.col("l_linestatus") == "O"
    return named.select(
        F.concat("section_urn", F.lit("::term/"), tx.slug("p_name", "_")).alias("term_id"), F.col("p_name").alias("surface_form"),
        "section_urn", "bill_urn", F.lit(None).cast("string").alias("scope"), F.when(by_ref, "by_reference").otherwise("direct").alias("definition_type"),
        F.concat(F.lit("means "), F.col("p_name"), F.lit(" of supplier "), F.col("l_suppkey").cast("string")).alias("definition_text"),
        F.when(by_ref, F.col("statute_id")).alias("statute_id"))


def amends(load):
    op = tx.lookup(F.col("l_linenumber") % 7, dict(enumerate(OPS)))
    return lines(load).where("l_returnflag = 'R'").select(
        F.concat("section_urn", F.lit("::amend/"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("amendment_id"),
        "section_urn", "bill_urn", op.alias("operation_type"), F.when(F.col("l_suppkey") % 10 != 0, F.col("statute_id")).alias("statute_id"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("old "), F.col("l_suppkey").cast("string"))).alias("before_text"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("new "), F.col("l_partkey").cast("string"))).alias("after_text"))


_LABELS = "case bill_type when 'hr' then 'H.R.' when 's' then 'S.' when 'hjres' then 'H.J. Res.' when 'sjres' then 'S.J. Res.' else 'H. Con. Res.' end"
BILLS = """
bills as (select b.congress || '-' || bill_type || '-' || okey as bill_id, 'bill:us/' || b.congress || '/' || bill_type || '/' || okey as bill_urn, b.* from (
  select 118 + o_orderkey % 2 as congress,
    case substr(o_orderpriority, 1, 1) when '1' then 'hr' when '2' then 's' when '3' then 'hjres' when '4' then 'sjres' else 'hconres' end as bill_type,
    o_orderkey as bill_number, 'An Act on ' || o_orderpriority || ' matters of customer ' || o_custkey as title,
    case when o_orderkey % 3 <> 0 then 'Act ' || o_orderkey end as short_title, 'Customer ' || o_custkey as sponsor,
    strftime(o_orderdate, '%Y-%m-%d') as introduced_date, case o_orderstatus when 'F' then 'A' when 'O' then 'B' end as tier,
    case when o_orderkey % 4 = 0 then 'redistricting' else 'ai_governance' end as topic, o_orderkey as okey from orders) b)"""
LINES = BILLS + f""",
lines as (select l.*, b.bill_id, b.bill_urn, b.bill_urn || '::L' || l_linenumber as section_urn, b.bill_id || '::L' || l_linenumber as section_id,
  'Sec. ' || l_linenumber || ' of ' || {_LABELS} || ' ' || bill_number || ', ' || congress || 'th Cong.' as citation,
  'statute:us/usc/' || (l_partkey % 50 + 1) || '/' || l_partkey as sid from lineitem l join bills b on l_orderkey = okey),
sections as (select distinct bill_id, bill_urn, section_urn, section_id, l_linenumber as ordinal, l_linenumber::varchar as enum,
  case when l_linenumber % 2 = 0 then 'Line ' || l_linenumber end as heading, citation from lines),
statutes as (select 'statute:us/usc/' || (p_partkey % 50 + 1) || '/' || p_partkey as statute_id, (p_partkey % 50 + 1) || ' U.S.C. ' || p_partkey as statute_citation, p_partkey, p_name from part),
cites as (select bill_urn, section_urn, sid as statute_id, lower(l_linestatus) as type from lines where l_returnflag = 'A'),
terms as (select section_urn || '::term/' || replace(p_name, ' ', '_') as term_id, p_name as surface_form, section_urn, bill_urn,
  case l_linestatus when 'O' then 'by_reference' else 'direct' end as definition_type, 'means ' || p_name || ' of supplier ' || l_suppkey as definition_text,
  case l_linestatus when 'O' then sid end as statute_id from lines join part on l_partkey = p_partkey where l_returnflag = 'N'),
amends as (select section_urn || '::amend/' || l_partkey || '-' || l_suppkey as amendment_id, section_urn, bill_urn,
  case l_linenumber % 7 when 0 then 'insert' when 1 then 'strike' when 2 then 'replace' when 3 then 'repeal' when 4 then 'strike_and_insert' when 5 then 'add_at_end' else 'other' end as operation_type,
  case when l_suppkey % 10 <> 0 then sid end as statute_id, case l_linestatus when 'F' then 'old ' || l_suppkey end as before_text,
  case when l_suppkey % 3 = 0 then ' ' else 'new ' || l_partkey end as after_text from lines where l_returnflag = 'R')"""
