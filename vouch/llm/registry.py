"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vouch.llm import ann, bond, chat, decontaminate, jaccard, langid, packing, pii, quality, toxicity, trie, url_filter, warc

MODULES = [jaccard, chat, warc, decontaminate, langid, quality, ann, url_filter, packing, pii, trie, toxicity, bond]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
