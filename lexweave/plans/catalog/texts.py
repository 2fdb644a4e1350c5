"""Text, scoring, turn and usage queries over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions import ids, text as tx
from lexweave.operators import extracts, scoring as sc, search, spans, turns, usage
from lexweave.plans.catalog import model
from lexweave.plans.catalog.registry import query


# -- documents and pages ---------------------------------------------------
@query("section_split", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
select doc_id, (n - 1)::bigint as ordinal, doc_id || '::' || n as section_id, regexp_replace(trim(line), '[ \t]+', ' ', 'g') as text_self from l where trim(line) <> ''""")
def section_split(load):
    """Lines of every document as sections with order, id and cleaned text."""
    l = load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return l.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.concat_ws("::", "doc_id", F.col("ordinal") + 1).alias("section_id"),
                    tx.clean_block("line").alias("text_self")).where("text_self != ''")


def hrefs(load):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    c = load("pages").select("page_id", F.posexplode(links).alias("n", "href"))
    return c.withColumn("cite", F.concat(F.lit("usc"), F.col("href"), F.lit("/"), F.col("page_id").cast("string"))).withColumn("c", ids.parse_cite("cite", F.lit("usc")))


_HREF = """h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) as n from pages),
p as (select *, regexp_extract('usc' || href || '/' || page_id, '^usc/([^/]+)/(.+)$', 1) as title, regexp_replace(regexp_extract('usc' || href || '/' || page_id, '^usc/([^/]+)/(.+)$', 2), '^/+|/+$', '', 'g') as section from h),
c as (select page_id, n, 'statute:us/usc/' || title || '/' || section as statute_id, title || ' U.S.C. ' || section as label from p where title <> '' and section <> '')"""


@query("href_citations", f"with {_HREF} select page_id, n::bigint as n, statute_id, label from c")
def href_citations(load):
    """Links of every page parsed as statute citations."""
    return hrefs(load).where("c is not null").select("page_id", (F.col("n") + 1).cast("long").alias("n"), "c.statute_id", "c.label")


@query("statute_dimension", f"with {_HREF} select statute_id, regexp_replace(statute_id, '/[^/]*$', '') as parent_id, '' as enum_path, arg_min(label, lpad(page_id::varchar, 12, '0') || lpad(n::varchar, 9, '0')) as canonical_citation from c group by statute_id")
def statute_dimension(load):
    """First mention of every statute across pages."""
    rows = hrefs(load).where("c is not null").select(F.col("c.statute_id").alias("statute_id"), F.col("c.label").alias("statute_label"), F.col("page_id").alias("bill_id"), F.col("n").alias("pos"))
    return extracts.statute_dimension(rows, rows.where("pos % 2 = 0"), rows.where("pos % 3 = 0"))


@query("html_strip", r"""select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) as text from pages""")
def html_strip(load):
    """Pages without tags, whitespace collapsed."""
    return load("pages").select("page_id", tx.clean_inline(tx.strip_tags("html")).alias("text"))


def operation_lines(load):
    """Sentences made of amendment phrases around the words of each line."""
    l = load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    phrase = tx.lookup((F.col("doc_id") + F.col("n")) % 11, dict(enumerate(PHRASES)))
    return l.withColumn("prose", F.concat(F.lit("Section 1 is amended "), F.replace(phrase, F.lit("@"), F.lit("“old text”")), F.lit(" x "), F.length("line").cast("string")))


PHRASES = ["by striking @ and inserting the following", "by inserting after paragraph (1)", "by adding at the end the following", "by amending it to read as follows",
           "to read as follows", "by striking @", "by redesignating (a) as (b)", "is repealed", "by inserting it", "by adding the following", "otherwise"]
_OPS = "case i when 0 then 'strike_and_insert' when 1 then 'insert' when 2 then 'add_at_end' when 3 then 'replace' when 4 then 'replace' when 5 then 'strike' when 6 then 'redesignate' when 7 then 'repeal' when 8 then 'insert' when 9 then 'add_at_end' else 'other' end"


@query("op_classify", f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents), k as (select doc_id, n, (doc_id + n) % 11 as i from l)
select doc_id, n::bigint as n, {_OPS} as operation, case when i in (0, 5) then 'old text' end as before_text from k""")
def op_classify(load):
    """Operation type and struck text of an amendment sentence per line."""
    return operation_lines(load).select("doc_id", F.col("n").cast("long").alias("n"), extracts.operation_of("prose").alias("operation"), extracts.struck_text("prose").alias("before_text"))


@query("keyword_match", r"""with q(query) as (values ('the of zzz'), ('"und der" que'), ('les AND los'))
select doc_id, query, case query when 'the of zzz' then concat_ws(',', case when contains(h, 'the') then 'the' end, case when contains(h, 'of') then 'of' end, case when contains(h, 'zzz') then 'zzz' end)
 when 'les AND los' then concat_ws(',', case when contains(h, 'les') then 'les' end, case when contains(h, 'and') then 'AND' end, case when contains(h, 'los') then 'los' end)
 else concat_ws(',', case when contains(h, 'und der') then 'und der' end, case when contains(h, 'que') then 'que' end) end as matched
from (select doc_id, lower(text) as h from documents) cross join q""")
def keyword_match(load):
    """Words of three queries found in every document."""
    q = F.explode(F.array(F.lit("the of zzz"), F.lit('"und der" que'), F.lit("les AND los")))
    d = load("documents").select("doc_id", "text", q.alias("query"))
    return d.select("doc_id", "query", F.array_join(search.matched_words("query", "text"), ",").alias("matched"))


@query("bill_mentions", r"""with b as (select doc_id, text, 'H.R. ' || doc_id || ' then S. Res. ' || n_chars || '; ' as lead, doc_id as a, n_chars as b from documents)
select doc_id, 0::integer as start, length('H.R. ' || a)::integer as "end", 'hr' as bill_type, a as bill_number from b
union all select doc_id, length('H.R. ' || a || ' then ')::integer, length('H.R. ' || a || ' then S. Res. ' || b)::integer, 'sres', b::bigint from b""")
def bill_mentions(load):
    """Bills named at the head of every document text."""
    t = F.concat(F.lit("H.R. "), F.col("doc_id").cast("string"), F.lit(" then S. Res. "), F.col("n_chars").cast("string"), F.lit("; "), "text")
    return load("documents").select("doc_id", F.inline(spans.bill_mentions(t)))


@query("mentions_resolved", rf"""with {model.BILLS}, m as (select doc_id, unnest(['s', 'hr', 'hjres', 'hr']) as bill_type, unnest([doc_id, doc_id * 4 + 1, n_chars % 9, 999999999])::bigint as bill_number from documents),
k as (select bill_type, bill_number, count(*) as n_bills, min(bill_id) as one from bills group by all)
select doc_id, bill_type, bill_number, coalesce(n_bills, 0) as n_bills, case when n_bills = 1 then one end as bill_id from m left join k using (bill_type, bill_number)""")
def mentions_resolved(load):
    """Mentions before, inside and after every document text, joined to the bills of that name."""
    n = lambda c: c.cast("string")
    half = (F.length("text") / 2).cast("int")
    t = F.concat(F.lit("S. "), n(F.col("doc_id")), F.lit("; "), F.substring(F.col("text"), F.lit(1), half), F.lit(" see H. R. "), n(F.col("doc_id") * 4 + 1), F.lit(" and "),
                 F.substr(F.col("text"), half + 1), F.lit(". H.J. Res. "), n(F.col("n_chars") % 9), F.lit(", HR 999999999"))
    m = load("documents").select("doc_id", F.inline(spans.bill_mentions(t)))
    return spans.resolved_mentions(m, model.bills(load)).select("doc_id", "bill_type", "bill_number", "n_bills", "bill_id")


PLANTED = " Sec. 4 x; (ab) y TITLE IV z. (2) PART II Subtitle B "

# RE2 has no look-ahead: the twin puts a mark before every match, splits at it and adds up the lengths.
_MARKED = f"""with t as (select doc_id, text, regexp_replace(text, '({"|".join(fixed.HEADING_MARKERS)})', chr(1) || '\\1', 'g') as h,
  regexp_replace(text, '([.;—]\\s+)(\\((?:\\d{{1,3}}|[A-Za-z]{{1,4}})\\)\\s)', '\\1' || chr(1) || '\\2', 'g') as v from documents),
p as (select doc_id, text, unnest([string_split(h, chr(1)), string_split(v, chr(1))]) as pieces from t),
o as (select doc_id, text, unnest(list_transform(generate_series(1, len(pieces) - 1), lambda i: list_sum(list_transform(pieces[1:i], lambda x: length(x))))) as o from p),
d as (select distinct doc_id, o::integer as o from o where o > 0 and o < length(text)),
g as (select doc_id, string_agg(o::varchar, ',' order by o) as offsets from d group by doc_id)"""


@query("break_offsets", f"""{_MARKED.replace("from documents)", f"from (select doc_id, replace(text, chr(10), '{PLANTED}') as text from documents))", 1)} select doc_id, coalesce(offsets, '') as head from documents left join g using (doc_id)""")
def break_offsets(load):
    """All structural breaks inside every document text whose line ends were made breaks."""
    return load("documents").select("doc_id", F.array_join(spans.break_offsets(F.replace("text", F.lit("\n"), F.lit(PLANTED))), ",").alias("head"))


@query("break_offsets_all", f"""{_MARKED} select doc_id, coalesce(offsets, '') as offsets from documents left join g using (doc_id)""")
def break_offsets_all(load):
    """All structural breaks inside every document text."""
    return load("documents").select("doc_id", F.array_join(spans.break_offsets("text"), ",").alias("offsets"))


@query("span_locate", r"""with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
select doc_id, n::bigint as n, (strpos(text, line) - 1)::integer as start, (strpos(text, line) - 1 + length(line))::integer as "end" from l where line <> ''""")
def span_locate(load):
    """Every line anchored back in its own document (exact leg)."""
    d = load("documents").select("doc_id", "text")
    anchors = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "needle")).where("needle != ''")
    located = anchors.join(d, "doc_id").withColumn("s", spans.locate_span("text", "needle"))
    return located.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "s.start", "s.end")


@query("span_rewrapped", r"""select doc_id, 0::integer as start, length(text)::integer as "end" from documents where length(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) = length(trim(text)) and text = trim(text) and length(text) >= 3 and contains(text, chr(10))""")
def span_rewrapped(load):
    """Texts re-wrapped with double blanks are still found (whitespace leg)."""
    d = load("documents").where(F.contains(F.col("text"), F.lit("\n")) & (F.col("text") == tx.strip("text")) & (F.length(tx.clean_inline("text")) == F.length("text")))
    s = spans.locate_span("text", F.regexp_replace("text", r"(?U)\s", "  "))
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.start", "s.end")


# -- answers ---------------------------------------------------------------
def answers(load):
    """Assistant turns as answers; citations, ids and abstentions are added by their numbers."""
    k = F.col("conv_id")
    c = load("conversations").where("role = 'assistant'")
    cite = F.concat(F.lit(" Sec. "), (k % 4 + 1).cast("string"), F.lit("(a)(2) of H.R. "), F.col("turn").cast("string"), F.lit(", 118th Cong. "))
    extra = F.when(k % 3 == 0, " This is not in the corpus. ").otherwise("")
    tool = F.when(k % 5 != 0, F.concat(F.lit("got Sec. "), (k % 4 + 1).cast("string"), F.lit(" of H.R. "), F.col("turn").cast("string"), F.lit(", 118th Cong. here"))).otherwise("nothing")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.when(k % 2 == 0, "even").otherwise("odd").alias("category"),
                    F.concat("text", cite, extra).alias("final_answer"), F.array(F.struct(tool.alias("response_text"))).alias("tool_calls"),
                    F.when(k % 7 == 0, "timeout").alias("error"), F.lit(False).alias("aborted"), "conv_id", "turn")


def criteria(load):
    a, none = answers(load), F.lit(None).cast("array<string>")
    k = F.col("conv_id")
    return a.select("query_id", F.array(F.lit("the"), F.lit("H.R.")).alias("answer_must_contain"), F.when(k % 4 == 0, F.array(F.lit("que"))).alias("answer_must_not_contain"),
                    none.alias("answer_must_cite"), none.alias("bill_id_min"),
                    F.when(k % 2 == 1, F.array(F.concat(F.lit("118-hr-"), F.col("turn").cast("string")), F.lit("118-hr-999"))).alias("bill_id_set_full"), (k % 6 == 0).alias("abstain"))


_ANS = """a as (select conv_id || '-' || turn as query_id, conv_id as k, turn, lower(text) as t, conv_id % 7 = 0 as broken from conversations where role = 'assistant'),
s as (select *, case when k % 2 = 0 then 'even' else 'odd' end as category, contains(t, 'the') or k % 3 = 0 as has_the, k % 4 = 0 and contains(t, 'que') as bad,
 case when not broken and k % 2 = 1 then 1.0 end as p, case when not broken and k % 2 = 1 then 0.5 end as r, case when not broken and k % 2 = 1 then 2 * 0.5 / 1.5 end as f,
 case when broken then 0 when k % 5 = 0 then 0 else 1 end as g, case when broken then 0 when k % 5 = 0 then 1 else 0 end as u from a)"""


@query("answer_checks", f"""with {_ANS} select query_id, category, has_the and not bad and k % 5 <> 0 and not broken as overall_passed,
p::double as precision, r::double as recall, round(f, 6)::double as f1, g as grounded, u as ungrounded from s""")
def answer_checks(load):
    """Scored answers: content, bill sets, grounding and the verdict."""
    s = sc.score_runs(answers(load), criteria(load))
    return s.select("query_id", "category", "overall_passed", "precision", "recall", F.round("f1", 6).alias("f1"), "grounded", "ungrounded")


@query("score_report", f"""with {_ANS}, v as (select *, has_the and not bad and k % 5 <> 0 and not broken as pass from s)
select category, count(*) as n, count(*) filter (pass) as n_passed, round(avg(pass::int), 6) as pass_rate, round(avg(p), 6)::double as mean_precision, round(avg(r), 6)::double as mean_recall,
round(avg(f), 6)::double as mean_f1, count(*) filter (r < 1) as under_coverage, count(*) filter (p < 1) as over_confidence, sum(g)::bigint as grounded, sum(u)::bigint as ungrounded,
round(sum(g) / (sum(g) + sum(u)), 6)::double as grounding_rate from v group by category""")
def score_report(load):
    """Pass rate, set scores and grounding per category."""
    return sc.report(sc.score_runs(answers(load), criteria(load)), ["category"])


def order_sets(load):
    """Per order: suppliers an answer names (flags A, N) and the true ones (A, R)."""
    l = load("lineitem").select("l_orderkey", F.concat(F.lit("118-hr-"), F.col("l_suppkey").cast("string")).alias("b"), "l_returnflag").distinct()
    pick = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag").isin(*f), F.col("b"))))
    return l.groupBy("l_orderkey").agg(pick("AN").alias("named"), pick("AR").alias("truth"))


@query("prf", """with l as (select distinct l_orderkey, l_suppkey, l_returnflag from lineitem),
f as (select l_orderkey, l_suppkey, bool_or(l_returnflag in ('A','N')) as named, bool_or(l_returnflag in ('A','R')) as true_ from l group by all),
c as (select l_orderkey, count(*) filter (named) as n, count(*) filter (true_) as t, count(*) filter (named and true_) as b from f group by 1),
p as (select *, case when t = 0 then null when n > 0 then b::double / n else 0.0 end as precision, case when t > 0 then b::double / t end as recall from c)
select l_orderkey, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) when t > 0 then 0.0 end, 6) as f1,
case when t > 0 then n - b else 0 end::integer as n_extras from p""")
def prf(load):
    """Precision, recall and F1 of the supplier set each order's answer names."""
    a = order_sets(load).withColumn("answer", F.array_join("named", " and "))
    a = a.withColumn("mentioned", sc.mentioned_bills("answer")).withColumn("found", F.filter("truth", lambda b: F.array_contains("mentioned", b)))
    a = a.withColumn("none", F.array().cast("array<string>"))
    s = sc.set_scores(a, "mentioned", "truth", "found", "none", "none")
    return s.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.size("extras").alias("n_extras"))


@query("grade_tally", """select d.source, count(*) as n, count(*) filter (quality = 1 and toxic = 0) as pass, count(*) filter (quality = 1 and toxic = 1) as partial,
count(*) filter (quality is null or quality = 0) as fail from documents d left join labels l using (doc_id) group by 1""")
def grade_tally(load):
    """Grades from the labels; documents without one fail."""
    g = load("labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 0, "FAIL").when(F.col("toxic") == 1, "PARTIAL").otherwise("PASS").alias("grade"))
    return sc.grade_tally(load("documents").select(F.col("doc_id").alias("query_id"), "source"), g, ["source"])


# -- turns -----------------------------------------------------------------
@query("turn_history", """select conv_id, turn, role, text from conversations where role in ('user', 'assistant') and trim(text) <> ''""")
def turn_history(load):
    """Turns that are replayed, in order."""
    return turns.history(load("conversations")).select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


_TOOL = {"view": "get_bill", "click": "get_citation_graph", "error": "get_section", "signup": "get_amendments", "purchase": "find_definitions_of"}


@query("mode_select", """select user_id, cast(ts as date)::varchar as day, case min(case event_type when 'purchase' then 0 when 'signup' then 1 when 'click' then 2 else 3 end)
when 0 then 'definition' when 1 then 'amendment' when 2 then 'citation' else 'structure' end as mode from events group by 1, 2""")
def mode_select(load):
    """Display mode of each user's day from the tools used."""
    e = load("events").select(F.struct("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).alias("turn"), tx.lookup("event_type", _TOOL).alias("name"))
    return turns.display_mode(e).select("turn.user_id", "turn.day", "mode")


@query("trace_rollup", """select user_id as turn, count(*) filter (event_type in ('view', 'click')) as n_iterations, count(*) filter (event_type not in ('view', 'click')) as n_tool_calls,
round(coalesce(sum(value) filter (event_type in ('view', 'click')), 0), 1) as llm_ms_total, round(coalesce(sum(value) filter (event_type not in ('view', 'click')), 0), 1) as tool_ms_total
from (select user_id, event_type, floor(value) as value from events) group by 1""")
def trace_rollup(load):
    """Model and tool time per user."""
    e = load("events").select(F.col("user_id").alias("turn"), F.when(F.col("event_type").isin("view", "click"), "llm").otherwise("tool").alias("kind"), F.floor("value").cast("double").alias("ms"))
    return turns.trace_rollup(e)


@query("response_labels", """select event_id, case when event_type = 'error' then '<unparseable response, ' || length('{' || event_id) || ' chars>' when event_type = 'view' then (event_id % 3 + 1) || ' hits'
when event_type = 'click' then 'not_found' when event_type = 'signup' then 'bill_id=118-hr-' || event_id else 'error: e' || event_id end as label from events""")
def response_labels(load):
    """Summary label of a JSON tool response per event."""
    i = F.col("event_id").cast("string")
    items = F.to_json(F.struct(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 3 + 1).alias("hits")))
    r = (F.when(F.col("event_type") == "error", F.concat(F.lit("{"), i)).when(F.col("event_type") == "view", items).when(F.col("event_type") == "click", '{"not_found": true, "bill_id": "x"}')
         .when(F.col("event_type") == "signup", F.concat(F.lit('{"bill_id": "118-hr-'), i, F.lit('"}'))).otherwise(F.concat(F.lit('{"error": "e'), i, F.lit('"}'))))
    return load("events").select("event_id", turns.response_label(r).alias("label"))


# -- usage -----------------------------------------------------------------
def calls(load):
    """Events as metered calls: the value is the input, the JSON counter the output."""
    return load("events").select(
        "event_id", "user_id", "ts", F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@x ")).alias("email"),
        (F.floor("value").cast("long") - 5).alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))


_USE = """c as (select event_id, user_id, ts, greatest(floor(value)::bigint - 5, 0) as i, (props->>'k')::bigint as o from events),
r as (select *, i + o as tokens, sum(i + o) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as total_after from c)"""


@query("usage_total", f"with {_USE} select event_id, user_id, tokens, total_after from r")
def usage_total(load):
    """Lifetime total after every call."""
    return usage.running_totals(calls(load)).select("event_id", "user_id", "tokens", "total_after")


@query("usage_cap", f"""with {_USE}, g as (select *, user_id in (3, 7) or total_after - tokens < 2000 as admitted from r)
select user_id, sum(case when admitted then tokens else 0 end)::bigint as total, count(*) filter (admitted) as n_admitted, count(*) filter (not admitted) as n_refused from g group by 1""")
def usage_cap(load):
    """Admitted and refused calls per account under a limit of 2,000 tokens."""
    return usage.charged_totals(usage.gate(calls(load), 2000, ["u3@x", "U7@X"]))


@query("account_totals", f"with {_USE} select user_id, sum(i)::bigint as total_input, sum(o)::bigint as total_output from r group by 1")
def account_totals(load):
    return usage.account_totals(calls(load))
