"""Registered queries with the SQL each one is checked against."""

import importlib

GROUPS = ("ingest_queries", "column_rules", "catalog_queries", "position_queries", "trade_queries", "document_queries", "search_queries", "corpus_queries", "audit_queries")


def REGISTRIES():
    return [importlib.import_module(f"factline.plans.{g}").REG for g in GROUPS]
