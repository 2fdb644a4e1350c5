"""The batch build from landed files to tables, and the user questions on them."""
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lexweave.operators import lookups
from lexweave.plans.answers import Knowledge
from lexweave.plans.build import build, format_mix
from lexweave.sources import corpus

HERE = os.path.dirname(__file__)


def meta(bill, **kw):
    c, t, n = bill.split("-")
    base = {
        "bill_id": bill, "congress": int(c), "bill_type": t, "bill_number": int(n), "title": f"Title of {bill}", "sponsor": "Rep. Doe",
        "introduced_date": "2025-01-13", "latest_action": "2025-02-01: Referred: to committee", "policy_area": "Science", "tier": "A",
        "subjects": ["Models", "", "Models"], "summary_text": "About covered models",
        "versions_available": [{"package_id": f"BILLS-{c}{t}{n}ih", "version_code": "ih", "date_issued": "2025-01-13"}] * 2,
        "canonical_version": {"package_id": f"BILLS-{c}{t}{n}ih", "version_code": "ih", "date_issued": "2025-01-13"},
        "actions": [{"actionDate": "2025-01-13", "text": "Introduced"}, {"actionDate": "2025-02-01", "text": "Referred"}],
        "cosponsors": [{"bioguideId": "X1", "fullName": "Rep. One", "party": "D", "state": "NY", "sponsorshipDate": "2025-01-20", "isOriginalCosponsor": True},
                       {"bioguideId": "X1", "fullName": "Rep. One", "party": "D", "state": "NY", "sponsorshipDate": "2025-01-21"}, {"lastName": ""}],
    }
    return base | kw


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    xml = open(f"{HERE}/data/bill_a.xml", encoding="utf8").read()
    other = xml.replace("covered model", "artificial intelligence")
    for topic, bill, text, extra in [
        ("legislation", "119-hr-9", xml, {}), ("legislation", "118-s-9", other, {"topic": None, "congress": 118}),
        ("legislation", "119-hr-13", "<bill><oops>", {}), ("redistricting", "117-hr-1", xml, {"topic": "redistricting", "tier": "B"}),
        ("legislation", "119-hr-14", None, {}),
    ]:
        d = root / topic / bill
        d.mkdir(parents=True)
        (d / "metadata.json").write_text(json.dumps(meta(bill, **extra), indent=1))
        (d / "provenance.json").write_text(json.dumps({"bill_id": bill, "fetched_at": f"2025-03-0{len(bill) % 9}T00:00:00"}))
        if text is not None:
            (d / "bill.xml").write_text(text, encoding="utf8")
    out = str(tmp_path_factory.mktemp("tables"))
    build(spark, str(root), out, "2025-04-01T00:00:00")
    return Knowledge(spark, out)


def test_scan_defaults_and_quarantine(kb):
    rows = {r.bill_id: r for r in kb.bills.collect()}
    assert set(rows) == {"119-hr-9", "118-s-9", "117-hr-1"}
    assert (rows["118-s-9"].topic, rows["118-s-9"].stream, rows["117-hr-1"].topic) == ("ai_governance", "legislation", "redistricting")
    assert (rows["119-hr-9"].latest_action_date, rows["119-hr-9"].latest_action_text, rows["119-hr-9"].status) == (
        "2025-02-01", "Referred: to committee", "Referred: to committee")
    assert [r.bill_id for r in kb.quarantine.collect()] == ["119-hr-13"]
    assert {(r.source, r.last_fetched) for r in kb.source_freshness.collect()} == {
        ("govinfo", "2025-03-08T00:00:00"), ("congress.gov", "2025-03-08T00:00:00")}
    assert kb.bill_versions.count() == 3 and kb.cosponsors.count() == 3 and kb.subjects.count() == 3 and kb.actions.count() == 6
    assert {r.xml_format for r in format_mix(kb.bills).collect()} == {"pre-uslm"}
    assert {r["key"] for r in kb.corpus_meta.collect()} >= {"corpus_version", "last_updated"}


def test_topic_folder_alone_can_be_scanned(spark, kb, tmp_path):
    d = tmp_path / "118-s-5"
    d.mkdir()
    (d / "metadata.json").write_text(json.dumps(meta("118-s-5")))
    (d / "bill.xml").write_text("<bill/>")
    assert corpus.scan(spark, str(tmp_path)).count() == 1


def test_edges(kb):
    counts = {n: getattr(kb, f"edge_{n}").count() for n in ("has_version", "has_section", "parent_of", "sponsored_by", "cosponsored_by", "cites_external", "defines", "by_reference", "amends", "targets")}
    assert counts == {"has_version": 3, "has_section": 9, "parent_of": 24, "sponsored_by": 3, "cosponsored_by": 3, "cites_external": 9, "defines": 6, "by_reference": 3, "amends": 3, "targets": 3}
    assert kb.statute_sections.count() == 3 and kb.sponsors.count() == 4


def test_definitions(kb):
    hit = kb.find_bills_defining("Artificial Intelligence", by_reference_to="15/9401")
    assert {r.bill_urn for r in hit.collect()} == {"bill:us/119/hr/9", "bill:us/118/s/9", "bill:us/117/hr/1"}
    both = kb.find_bills_defining("covered model", also_match=["ARTIFICIAL INTELLIGENCE"])
    assert both.where("bill_urn = 'bill:us/119/hr/9'").count() == 2
    # both terms of the second bill share one id, so the first node stands for them
    side = lookups.definition_counts(kb.find_definitions_of("artificial intelligence"), ["congress"]).collect()
    assert {(r.congress, r.direct_count, r.by_reference_count) for r in side} == {(119, 0, 1), (118, 0, 1), (117, 0, 1)}
    terms = kb.get_defined_terms("H.R. 9 (119th Cong.)").orderBy("surface_form").collect()
    assert [(t.surface_form, t.citation, t.statute_citation) for t in terms] == [
        ("artificial intelligence", "Sec. 2(1) of H.R. 9, 119th Cong.", "15 U.S.C. 9401"), ("covered model", "Sec. 2(2) of H.R. 9, 119th Cong.", None)]
    # one congress only: the bill is found without naming it
    assert kb.get_defined_terms("S. 9").count() == 1


def test_amendments_and_citations(kb):
    assert kb.get_amendments("bill:us/119/hr/9").collect()[0].statute_citation == "47 U.S.C. 227"
    assert kb.get_amendments_targeting("47 U.S.C. § 227").count() == 3
    assert {(r.bill_urn, r.n_operations) for r in kb.find_bills_amending("47/227").collect()} == {
        ("bill:us/119/hr/9", 1), ("bill:us/118/s/9", 1), ("bill:us/117/hr/1", 1)}
    g = kb.get_citation_graph("119-hr-9::SS1", max_nodes=1).collect()
    assert [(r.target_id, r.truncated) for r in g] == [("statute:us/usc/47/227", True)]
    assert kb.get_citation_graph("119-hr-9::nope").count() == 0


def test_sections_and_citation_strings(kb):
    s = kb.get_section("119-hr-9::S2", "2024-01-01").collect()[0]
    assert s.child_section_ids == ["119-hr-9::P1", "119-hr-9::P2"] and s.version_label == "ih" and "as_of=2024-01-01" in s.notes
    assert kb.get_section("119-hr-9::P1").collect()[0].citations_out == 1
    gone = kb.get_section("119-hr-9::X").collect()[0]
    assert gone.not_found and gone.bill_id == "119-hr-9" and gone.text is None
    r = kb.resolve_citation("see Sec. 2(2)(B) of H.R. 9, 119th Cong.").collect()
    assert [(x.section_id, x.is_ambiguous) for x in r] == [("119-hr-9::Q2", False)]
    assert kb.resolve_citation("Sec. 02 of H.R. 9, 119th Cong.").collect()[0].section_id == "119-hr-9::S2"
    assert kb.resolve_citation("Sec. 4 of H.R. 9").collect()[0].section_id is None


def test_bill_card_and_coverage(kb):
    b = kb.get_bill("119-hr-9").collect()[0]
    assert b.cosponsors == ["Rep. One (D-NY)"] and b.sections == ["Short title", "Definitions", "Amendment"] and b.versions == ["ih"]
    assert b.latest_action == "2025-02-01: Referred: to committee" and b.provenance.sources[0] == "govinfo:BILLS-119hr9ih"
    c = kb.corpus_coverage().collect()[0]
    assert (c.bills, c.tier_a, c.tier_b, c.congresses) == (3, 2, 1, [117, 118, 119])
    assert c.note == "3 bills, Congress 117-119, topics: ai_governance=2, redistricting=1 (legislation stream only)"


def test_section_tree_own_text(kb):
    t = {r.section_id[10:]: r.own_text for r in kb.get_section_tree("119-hr-9").collect()}
    assert t["S2"] == "In this Act:" and t["P2"] == "The term covered model means a model—" and t["Q2"] == "that is public."


def test_blocks_fold_grouping_nodes(spark, kb):
    from lexweave.operators import tree

    rows = [("b", "A", None, 0, "Sec. 3", "T", "own", ["A"], 1), ("b", "B", "A", 0, "Sec. 3(3)", None, "", ["A", "B"], 2),
            ("b", "C", "B", 0, "Sec. 3(3)(A)", None, "x", ["A", "B", "C"], 3), ("b", "D", "B", 1, "Sec. 3(3)(B)", None, "y", ["A", "B", "D"], 4)]
    t = spark.createDataFrame(rows, "bill_id string, section_id string, parent string, ordinal int, canonical_citation string, heading string, own_text string, ancestor_path array<string>, pos int")
    t = t.withColumn("n_children", F.when(F.col("section_id").isin("A"), 1).when(F.col("section_id") == "B", 2).otherwise(0))
    got = [(r.section_id, r.depth, r.marker) for r in tree.blocks(t).orderBy("pos").collect()]
    assert got == [("C", 0, "(3)(A)"), ("D", 0, "(B)")]


def test_search(spark, kb):
    none = "cast(null as string) as tier, cast(null as string) as date_from, cast(null as string) as date_to, cast(null as array<bigint>) as congresses"
    ask = spark.sql(f"""select *, {none}, 10 as limit, 0 as offset from values (0L, 'covered model', 'ai_governance', cast(null as array<string>)), (1L, 'zebra', 'ai_governance', null),
        (2L, '"artificial intelligence"', 'redistricting', null), (3L, 'model', 'nowhere', null), (4L, 'model', 'ai_governance', array('regulatory')), (5L, 'artif* NOT zebra', 'ai_governance', null)
        as t(query_id, text, topic, streams)""")
    rows = kb.search_corpus(ask).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert by[0][0].bill_id == "119-hr-9" and set(by) == {0, 2, 5}
    assert {r.bill_id for r in by[2]} == {"117-hr-1"}  # no leak from the other topic
    assert by[0][0].complete and by[0][0].total == len(by[0])
