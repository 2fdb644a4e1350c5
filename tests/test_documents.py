"""Documents -> sections, citations, terms, amendments on a hand-made bill."""
import os

import pytest
from pyspark.sql import functions as F

from lexweave.operators import extracts, nodes, sections

HERE = os.path.dirname(__file__)
BILL = open(os.path.join(HERE, "data", "bill_a.xml"), encoding="utf8").read()

USLM = """<bill xmlns="http://schemas.gpo.gov/xml/uslm"><main>
<title id="T1"><num>TITLE I</num><heading>One</heading>
<section id="U1"><num>SEC. 101.</num><heading>Name</heading><content>First<p>second</p></content></section></title>
<section><num>2.</num><content>Two.</content></section></main>
<main><section id="U9"><num>9</num></section></main></bill>"""


def parse(spark, rows):
    docs = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in rows], "bill_id string, xml binary")
    bills = spark.createDataFrame(
        [(k, int(k.split("-")[0]), k.split("-")[1], int(k.split("-")[2])) for k, _ in rows],
        "bill_id string, congress long, bill_type string, bill_number long")
    return nodes.elements(docs).persist(), bills


@pytest.fixture(scope="module")
def bill(spark):
    n, bills = parse(spark, [("119-hr-9", BILL), ("119-hr-10", "<bill><bad>"), ("118-s-7", USLM), ("118-s-8", "<bill><p>no body</p></bill>")])
    return n, sections.section_table(n, bills).persist()


def test_bad_document_is_quarantined(bill):
    assert [r.bill_id for r in nodes.quarantine(bill[0]).collect()] == ["119-hr-10"]


def test_sections(bill):
    rows = bill[1].where("bill_id = '119-hr-9'").orderBy("pos").collect()
    got = [(r.section_id[10:], r.parent_section_id and r.parent_section_id[10:], r.level, r.enum, r.ordinal,
            r.canonical_citation.removesuffix(" of H.R. 9, 119th Cong."), r.text_self) for r in rows]
    assert got == [
        ("S1", None, "section", "1", 0, "Sec. 1", "This Act may be cited as the Sample Act ."),
        ("S2", None, "section", "2", 1, "Sec. 2", "In this Act:"),
        ("P1", "S2", "paragraph", "1", 0, "Sec. 2(1)",
         "The term artificial intelligence has the meaning given such term in section 5002 ( 15 U.S.C. 9401 )."),
        ("P2", "S2", "paragraph", "2", 1, "Sec. 2(2)", "The term covered model means a model—"),
        ("gen-1", "P2", "subparagraph", "A", 0, "Sec. 2(2)(A)", "that is large; and"),
        ("Q2", "P2", "subparagraph", "B", 1, "Sec. 2(2)(B)", "that is public."),
        ("S3", None, "section", "3", 2, "Sec. 3", ""),
        ("SS1", "S3", "subsection", "a", 0, "Sec. 3(a)",
         "Section 227 of the Act ( 47 U.S.C. 227 ) is amended by striking “old words” and inserting the following:"),
        ("N1", "SS1", "paragraph", "9", 0, "Sec. 3(a)(9)", "new words ( 5 U.S.C. 552 )."),
        ("SS2", "S3", "subsection", "b", 1, "Sec. 3(b)", "See Public Law 116-283 and chapter 35 of title 44 ."),
        ("SS3", "S3", "subsection", "c", 2, "Sec. 3(c)", "Funds: Line | Amount\n1 | $5"),
    ]
    full = {r.section_id[10:]: r.text_full for r in rows}
    assert full["P2"] == "The term covered model means a model—\n(A) that is large; and\n(B) that is public."
    assert full["S2"].startswith("In this Act:\n(1) Artificial intelligence The term artificial")
    assert full["S3"].startswith("(a) Section 227 of the Act")
    assert "\n(9) new words ( 5 U.S.C. 552 ).\n(b) See Public" in full["S3"]
    paths = {r.section_id[10:]: r.ancestor_path for r in rows}
    assert paths["gen-1"] == ["119-hr-9::S2", "119-hr-9::P2", "119-hr-9::gen-1"]
    assert rows[0].section_urn == "bill:us/119/hr/9::S1"


def test_namespaced_titled_bill_and_missing_body(bill):
    rows = bill[1].where("bill_id = '118-s-7'").orderBy("pos").collect()
    assert [(r.xml_id, r.enum, r.ordinal) for r in rows] == [("T1", "TITLE I", 0), ("U1", "101", 0), (None, "2", 1)]
    assert rows[1].canonical_citation == "Sec. TITLE I(101) of S. 7, 118th Cong."
    assert rows[1].text_self == "First\nsecond"
    assert rows[0].text_full == "SEC. 101. Name First\nsecond"
    assert rows[2].section_id == "118-s-7::gen-1"
    assert bill[1].where("bill_id = '118-s-8'").count() == 0


def test_tables_and_broken_nesting(spark):
    xml = """<bill><legis-body><section id="A"><table><tr><td></td><td> </td></tr><tr><th>a
 b</th><th/><td>c<b>d</b></td></tr><tr><td>e</td></tr></table><text>tail <paragraph id="X"><text>kept inline</text></paragraph></text></section>
 <list><section id="B"><quoted-block><text>plain</text></quoted-block></section></list>
 <section id="C"><quoted-block>lost<section id="D"><text>in</text></section></quoted-block></section></legis-body></bill>"""
    n, bills = parse(spark, [("118-hr-1", xml)])
    rows = {r.xml_id: r for r in sections.section_table(n, bills).collect()}
    assert set(rows) == {"A", "B", "C", "D"}  # a container inside plain text is no section
    assert rows["A"].text_self == "a b | | c d\ne tail kept inline"
    assert rows["B"].text_self == "plain" and (rows["A"].ordinal, rows["B"].ordinal, rows["C"].ordinal) == (0, 1, 1)
    assert rows["C"].text_self == "" and rows["C"].text_full == "in" and rows["D"].parent_section_id == "118-hr-1::C"


def test_parents_exist_and_paths_agree(bill):
    s = bill[1]
    orphans = s.where("parent_section_id is not null").join(
        s.select(F.col("section_id").alias("parent_section_id")), "parent_section_id", "left_anti")
    assert orphans.count() == 0
    assert s.where(F.col("ancestor_path")[F.size("ancestor_path") - 1] != F.col("section_id")).count() == 0


def test_citations(bill):
    n, s = bill
    rows = extracts.attach(extracts.citations(n), s).orderBy("pos").collect()
    assert [(r.local_id, r.statute_id, r.statute_label, r.raw_text) for r in rows] == [
        ("P1", "statute:us/usc/15/9401", "15 U.S.C. 9401", "15 U.S.C. 9401"),
        ("SS1", "statute:us/usc/47/227", "47 U.S.C. 227", "47 U.S.C. 227"),
        ("SS2", "statute:us/usc/44/35", "44 U.S.C. ch. 35", "chapter 35 of title 44"),
    ]


def test_terms(bill):
    n, s = bill
    node, defines, by_ref = extracts.term_tables(extracts.attach(extracts.defined_terms(n), s))
    a, b = node.orderBy("pos").collect()
    assert (a.local_id, a.surface_form, a.scope, a.definition_type, a.statute_id, a.term_id) == (
        "P1", "artificial intelligence", "bill_local", "by_reference", "statute:us/usc/15/9401",
        "bill:us/119/hr/9::S2::term/artificial_intelligence")
    assert (b.local_id, b.surface_form, b.definition_type, b.definition_text) == (
        "P2", "covered model", "direct",
        "(2) The term covered model means a model— (A) that is large; and (B) that is public.")
    assert defines.count() == 2 and by_ref.count() == 1


def test_amendments(bill):
    n, s = bill
    (r,) = extracts.attach(extracts.amendments(n), s).collect()
    assert (r.local_id, r.n, r.operation_type, r.before_text, r.after_text, r.statute_id) == (
        "SS1", 1, "strike_and_insert", "old words", "(9) new words ( 5 U.S.C. 552 ). .", "statute:us/usc/47/227")
    assert r.target_locator_json == '{"code":"usc","title":"47","section":"227","subdivisions":[]}'


def test_statute_dimension_first_label_wins(bill):
    n, s = bill
    got = extracts.statute_dimension(*(extracts.attach(x, s) for x in (
        extracts.citations(n), extracts.defined_terms(n), extracts.amendments(n))))
    assert {(r.statute_id, r.parent_id, r.canonical_citation) for r in got.collect()} == {
        ("statute:us/usc/15/9401", "statute:us/usc/15", "15 U.S.C. 9401"),
        ("statute:us/usc/47/227", "statute:us/usc/47", "47 U.S.C. 227"),
        ("statute:us/usc/44/35", "statute:us/usc/44", "44 U.S.C. ch. 35"),
    }


def test_thin_metadata(bill):
    r = extracts.thin_metadata(bill[0]).where("bill_id = '119-hr-9'").collect()[0]
    assert (r.title, r.short_title, r.sponsor, r.introduced_date, r.bill_stage) == (
        "To define terms.", "Sample Act", "Ms. Doe", "2025-01-13", "Introduced-in-House")


def test_small_documents_share_a_batch():
    import pyarrow as pa

    from lexweave.operators import nodes
    xml = [b"<bill><legis-body><section id='a'><text>x</text></section></legis-body></bill>", b"<broken", b"<bill><form/></bill>"]
    got = list(nodes._flatten([pa.RecordBatch.from_pydict({"bill_id": ["p", "q", "r"], "xml": xml})]))
    assert len(got) == 1
    rows = got[0].to_pylist()
    assert [(r["bill_id"], r["tag"], r["body_depth"], [p["tag"] for p in r["path"]]) for r in rows] == [
        ("p", "bill", 2, ["bill"]), ("p", "legis-body", 2, ["bill", "legis-body"]), ("p", "section", 2, ["bill", "legis-body", "section"]),
        ("p", "text", 2, ["bill", "legis-body", "section", "text"]), ("q", "unreadable", 1, ["unreadable"]), ("r", "bill", 1, ["bill"]), ("r", "form", 1, ["bill", "form"])]
    assert rows[4]["error"] and not rows[5]["has_body"]


def test_sections_build_only_what_is_asked(spark):
    """Ids alone need no text: no piece of it is gathered, and the section that owns a piece is found once, not again by a filter."""
    def plan(*columns):
        n = spark.createDataFrame([], nodes.NODE_SCHEMA)
        bills = spark.createDataFrame([], "bill_id string, congress long, bill_type string, bill_number long")
        return sections.section_table(n, bills).select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    ids, whole = plan("section_id", "xml_id"), plan("section_id", "text_full")
    assert "array_join" in whole and "array_join" not in ids
    filters = [x for x in whole.split("\n") if x.strip(" :+-").startswith("Filter")]
    assert not [x for x in filters if x.count("lambdafunction") > 2], filters
