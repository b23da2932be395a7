"""Importing this module registers every query of the package."""

from annolytics.llm import chat_queries, corpus_queries, dedup_queries, page_queries, quality_queries, secret_queries, trie_queries, vector_queries  # noqa: F401
from annolytics.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
