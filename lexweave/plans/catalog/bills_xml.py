"""Bill XML that Spark derives from ``documents``, parsed by the real extraction jobs.

Every document becomes one bill: each non-empty line a section, with a citation, a subsection, a
defined term or an amendment by its position. The SQL twins compute the outcome from the lines.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.arrays import fixed_once
from lexweave.operators import extracts, nodes, sections, tree
from lexweave.plans.catalog.registry import query
from lexweave.sources.tables import stage


def lines(load):
    clean = lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, r"[^\p{L}\p{N} .,;:-]+", " "), " +", " "))
    arr = F.filter(F.transform(F.split("text", "\n"), clean), lambda l: l != "")
    return fixed_once(load("documents"), "doc_id", lines=arr).where(F.size("lines") > 0)


def derived(load):
    """``bills`` rows and ``docs(bill_id, xml)``."""
    def section(line, n):
        i = n.cast("string")
        head = lambda h: F.concat(F.lit('<section id="S'), i, F.lit('"><enum>'), (n + 1).cast("string"), F.lit(".</enum><header>"), h, F.lit("</header><text>"))
        ref = lambda cite, t: F.concat(F.lit('<external-xref legal-doc="usc" parsable-cite="'), cite, F.lit('">'), t, i, F.lit("</external-xref>"))
        word = F.split_part(line, F.lit(" "), F.lit(1))
        means = F.when(n % 8 == 6, F.concat(F.lit(" has the meaning given such term in "), ref(F.concat(F.lit("usc/"), (n + 1).cast("string"), F.lit("/9")), F.lit("r")))).otherwise(
            F.concat(F.lit(" means "), line))
        end = F.lit("</text></section>")
        return (
            F.when(n % 4 == 0, F.concat(head(F.concat(F.lit("H"), i)), line, ref(F.concat(F.lit("usc/"), (n + 1).cast("string"), F.lit("/"), F.col("doc_id").cast("string")), F.lit("x")), end))
            .when(n % 4 == 1, F.concat(head(F.concat(F.lit("H"), i)), line, F.lit('</text><subsection id="B'), i, F.lit('"><enum>(a)</enum><text>sub '), F.length(line).cast("string"), F.lit("</text></subsection></section>")))
            .when(n % 4 == 2, F.concat(head(F.lit("Definitions")), F.lit('In this Act:</text><paragraph id="P'), i, F.lit('"><enum>(1)</enum><text>The term <quote>'), word, F.lit("</quote>"), means, F.lit("</text></paragraph></section>")))
            .otherwise(F.concat(head(F.concat(F.lit("H"), i)), line, F.lit(" by striking “old "), i, F.lit("” and inserting the following:"), ref(F.concat(F.lit("usc/"), i, F.lit("/1")), F.lit("y")),
                                F.lit('</text><quoted-block id="Q'), i, F.lit('"><text>new '), line, F.lit("</text></quoted-block></section>"))))

    body = F.array_join(F.transform("lines", section), "")
    xml = F.concat(F.lit("<bill bill-stage=\"Introduced\"><form><official-title>Doc "), F.col("doc_id").cast("string"), F.lit("</official-title></form><legis-body>"), body, F.lit("</legis-body></bill>"))
    d = lines(load)
    key = F.concat(F.lit("118-hr-"), F.col("doc_id").cast("string")).alias("bill_id")
    bills = load("documents").select(key, F.lit(118).cast("long").alias("congress"), F.lit("hr").alias("bill_type"), F.col("doc_id").alias("bill_number"))
    return bills, stage(nodes.elements(d.select(key, xml.cast("binary").alias("xml"))), "nodes")


_L = r"""raw as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(regexp_replace(l, '[^\p{L}\p{N} .,;:-]+', ' ', 'g'), ' +', ' ', 'g'))), lambda l: l <> '') as ls from documents),
l as (select '118-hr-' || doc_id as bill_id, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as n from raw),
m as (select *, split_part(line, ' ', 1) as w, case when n % 8 = 6 then 'has the meaning given such term in r' || n else 'means ' || line end as means from l),
s as (
  select bill_id, doc_id, n, 'S' || n as id, null as parent, 'section' as level, (n + 1)::varchar as enum, case when n % 4 = 2 then 'Definitions' else 'H' || n end as heading, n as ordinal,
    '' as sub, case n % 4 when 0 then line || ' x' || n when 1 then line when 2 then 'In this Act:' else line || ' by striking “old ' || n || '” and inserting the following: y' || n || ' new ' || line end as own,
    case n % 4 when 1 then chr(10) || '(a) sub ' || length(line) when 2 then chr(10) || '(1) The term ' || w || ' ' || means else '' end as rest from m
  union all select bill_id, doc_id, n, 'B' || n, 'S' || n, 'subsection', 'a', null, 0, '(a)', 'sub ' || length(line), '' from m where n % 4 = 1
  union all select bill_id, doc_id, n, 'P' || n, 'S' || n, 'paragraph', '1', null, 0, '(1)', 'The term ' || w || ' ' || means, '' from m where n % 4 = 2),
sec as (select bill_id, bill_id || '::' || id as section_id, bill_id || '::' || parent as parent_section_id, level, enum, heading, ordinal::integer as ordinal, own as text_self, own || rest as text_full,
  'Sec. ' || (n + 1) || sub || ' of H.R. ' || doc_id || ', 118th Cong.' as canonical_citation from s)"""


def parsed(load):
    bills, n = derived(load)
    return n, sections.section_table(n, bills)


@query("xml_sections", f"with {_L} select * from sec")
def xml_sections(load):
    """Section walk: ids, parents, levels, enumerators, own and full text, citations."""
    return parsed(load)[1].select("bill_id", "section_id", "parent_section_id", "level", "enum", "heading", "ordinal", "text_self", "text_full", "canonical_citation")


@query("xml_citations", f"""with {_L} select bill_id || '::S' || n as section_id, 'statute:us/usc/' || (n + 1) || '/' || doc_id as statute_id, (n + 1) || ' U.S.C. ' || doc_id as statute_label, 'x' || n as raw_text from m where n % 4 = 0
union all select bill_id || '::P' || n, 'statute:us/usc/' || (n + 1) || '/9', (n + 1) || ' U.S.C. 9', 'r' || n from m where n % 8 = 6 union all select bill_id || '::S' || n, 'statute:us/usc/' || n || '/1', n || ' U.S.C. 1', 'y' || n from m where n % 4 = 3""")
def xml_citations(load):
    """Statute references with their source sections."""
    n, s = parsed(load)
    return extracts.attach(extracts.citations(n), s).select("section_id", "statute_id", "statute_label", "raw_text")


@query("xml_terms", f"""with {_L} select bill_id || '::P' || n as section_id, w as surface_form, 'bill_local' as scope, '(1) The term ' || w || ' ' || means as definition_text,
case when n % 8 = 6 then 'by_reference' else 'direct' end as definition_type, case when n % 8 = 6 then 'statute:us/usc/' || (n + 1) || '/9' end as statute_id from m where n % 4 = 2""")
def xml_terms(load):
    """Defined terms with scope, type and target."""
    n, s = parsed(load)
    return extracts.attach(extracts.defined_terms(n), s).select("section_id", "surface_form", "scope", "definition_text", "definition_type", "statute_id")


@query("xml_amendments", f"""with {_L}, o as (select bill_id, n, line, (n + 1) || '. H' || n || ' ' || line || ' by striking “old ' || n || '” and inserting the following: y' || n as op from m where n % 4 = 3)
select bill_id || '::S' || n as section_id, row_number() over (partition by bill_id order by n) as n, op as operation_text,
case when regexp_matches(op, 'by striking .*and inserting') then 'strike_and_insert' when regexp_matches(op, 'by striking\\b') then 'strike' else 'other' end as operation_type,
nullif(regexp_extract(op, 'by striking “([^”]+)”', 1), '') as before_text, 'new ' || line as after_text, 'statute:us/usc/' || n || '/1' as statute_id from o""")
def xml_amendments(load):
    """Amendment operations with type, struck and inserted text and target."""
    n, s = parsed(load)
    return extracts.attach(extracts.amendments(n), s).select("section_id", F.col("n").cast("long").alias("n"), "operation_text", "operation_type", "before_text", "after_text", "statute_id")


@query("xml_outline", f"""with {_L} select section_id, case when parent_section_id is null then 1 else 2 end as level, regexp_extract(canonical_citation, 'Sec\\. [0-9A-Za-z()]+') as marker, coalesce(heading, '') as title from sec""")
def xml_outline(load):
    """Flat outline of every derived bill."""
    return tree.outline(parsed(load)[1]).select("section_id", "level", "marker", "title")


@query("xml_own_text", f"""with {_L} select section_id, text_self as own_text from sec""")
def xml_own_text(load):
    """Own text of every section of every derived bill."""
    return tree.own_text(parsed(load)[1]).select("section_id", "own_text")


@query("xml_metadata", f"""with {_L} select distinct bill_id, 'Doc ' || doc_id as title, 'Introduced' as bill_stage from l""")
def xml_metadata(load):
    """Thin metadata read from the documents themselves."""
    return extracts.thin_metadata(derived(load)[1]).select("bill_id", "title", "bill_stage")
