"""The twelve user questions over built tables, each as one DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import ids
from lexweave.operators import dense, lookups, postings, search, tree


class Knowledge:
    """Built tables by name, and the questions asked of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _urn(self, bill: str) -> DataFrame:
        one = self.spark.range(1).select(F.lit(0).alias("request_id"), ids.normalise_bill(F.lit(bill)).alias("n")).select("request_id", "n.*")
        found = ids.disambiguate(one, self.bills)
        return found.select(ids.to_bill_urn("bill_id").alias("bill_urn"), "status", "options")

    def _index(self, name: str) -> postings.Index:
        return postings.read(self.spark, f"{self.folder}/{name}")

    def search_corpus(self, requests: DataFrame, encoder=None, prefilter: bool = False) -> DataFrame:
        """Hybrid search for a batch of requests (columns as in :func:`dense.search_page`), over stems without accents.

        Each leg goes as deep as the request that needs most; ``prefilter`` applies the filters before ranking.
        """
        need = requests.agg(F.max(F.col("limit") + F.col("offset"))).first()[0] or 1
        fused_n = need * 4 + 25
        legs = fused_n * 4
        open_ = requests.join(dense.scope_gate(requests, self.bills).where("in_scope"), "query_id", "left_semi")
        encode = encoder or dense.hashed_encoder()
        asked = open_.select("query_id", "topic", dense.query_text("text").alias("text"))
        vectors = dense.encode_sections(
            asked.select(F.col("query_id").cast("string").alias("section_id"), F.lit("").alias("bill_id"), "topic", F.lit("").alias("heading"), F.col("text").alias("text_full")),
            None, "query", encode).select(F.col("section_id").cast(requests.schema["query_id"].dataType).alias("query_id"), "topic", "vector")
        sections, scores = self.section_vectors, []
        for name, depth in (("bill_index", legs), ("section_index", legs * 4)):
            index = self._index(name)
            phrases = postings.stemmed(index, search.query_phrases(open_))
            scores.append(postings.bm25(index, phrases, True) if prefilter else postings.top_hits(index, phrases, depth, True).scores)
        if prefilter:
            both = [dense.prefiltered(open_, self.bills, s, sections, vectors) for s in scores]
            scores, (_, sections, vectors) = [b[0] for b in both], both[0]
        lexical = search.lexical_leg(*scores, legs)
        fused = dense.fuse(lexical, dense.dense_leg(sections, vectors, legs), fused_n)
        return dense.search_page(fused, self.bills, open_)

    def search_answers(self, requests: DataFrame, **options) -> DataFrame:
        """One row for every request of :meth:`search_corpus`, also for empty and refused ones."""
        return dense.page_answers(self.search_corpus(requests, **options), requests, dense.scope_gate(requests, self.bills))

    def corpus_coverage(self) -> DataFrame:
        return lookups.coverage(self.bills).withColumn("k", F.lit(1)).join(lookups.coverage_note(self.bills).withColumn("k", F.lit(1)), "k").drop("k")

    def get_bill(self, bill: str) -> DataFrame:
        """The bill's card with ``status`` and ``options``; an unknown or ambiguous bill gives a row of these alone."""
        asked = self._urn(bill)
        mine = lookups.Near(asked).only(self.bills, "bill_urn")
        near = lookups.Near(mine.select("bill_id"))
        part = lambda df: near.only(df, "bill_id")
        cards = lookups.bill_cards(mine, part(self.cosponsors), part(self.sections), part(self.bill_versions))
        said = asked.select("bill_urn", "status", "options")
        return said.join(cards, cards["bill_urn"].eqNullSafe(said["bill_urn"]), "left").drop(cards["bill_urn"]) if "bill_urn" in cards.columns else (
            said.withColumn("one", F.lit(1)).join(cards.withColumn("one", F.lit(1)), "one", "left").drop("one"))

    def get_section(self, section_id: str, as_of: str | None = None) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(section_id).alias("section_id"), F.lit(as_of).cast("date").alias("as_of"))
        return lookups.section_lookup(asked, self.sections, self.bills, self.citations, as_of=True, few=True)

    def get_section_tree(self, bill: str) -> DataFrame:
        """Every section of a bill with its own text; order by ``pos``."""
        return tree.own_text(lookups.Near(self._urn(bill)).only(self.sections, "bill_urn"))

    def get_defined_terms(self, bill: str) -> DataFrame:
        return lookups.terms_of(self._urn(bill), self.defined_terms, self.sections, self.statute_sections, few=True)

    def get_amendments(self, bill: str) -> DataFrame:
        return lookups.amendments_of(self._urn(bill), self.amendments, self.sections, self.statute_sections, few=True)

    def get_citation_graph(self, section: str, direction: str = "both", types: list[str] | None = None, max_nodes: int = 50) -> DataFrame:
        root = self.spark.range(1).select(ids.to_section_urn(F.lit(section)).alias("section_urn"))
        return lookups.neighbourhood(root, self.sections, self.citations, None, direction, types, max_nodes, few=True)

    def get_amendments_targeting(self, statute: str) -> DataFrame:
        return lookups.amendments_targeting(self.amendments, self.sections, self.statute_sections, statute)

    def resolve_citation(self, text: str) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(0).alias("request_id"), F.lit(text).alias("text"))
        return lookups.resolve_citations(asked, self.bills, self.sections, few=True)

    def find_bills_defining(self, term: str, also_match: list[str] = (), definition_type: str | None = None, by_reference_to: str | None = None) -> DataFrame:
        return lookups.bills_defining(self.defined_terms, self.bills, self.sections, self.statute_sections, term, also_match, definition_type, by_reference_to)

    def find_bills_amending(self, statute: str) -> DataFrame:
        return lookups.bills_amending(self.amendments, self.bills, self.statute_sections, F.col("statute_id") == ids.normalise_statute(F.lit(statute)))

    def find_definitions_of(self, term: str) -> DataFrame:
        return lookups.definitions_of(self.defined_terms, self.bills, self.sections, self.statute_sections, term)
