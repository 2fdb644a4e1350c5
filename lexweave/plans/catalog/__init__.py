"""Queries over the shared test tables, one per operator group."""
import importlib

from lexweave.plans.catalog.registry import QUERIES, SQL

for _m in ("documents", "lookups", "curation", "graphs", "texts", "bills_xml", "corpus_jobs"):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "SQL"]
