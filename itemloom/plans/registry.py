"""All queries over the driver's tables, by name, with their DuckDB SQL."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["t1_lexical_topk"](spark, sf_dir)


for _name in ("text_queries", "search_queries", "relational_queries", "topic_queries", "ingest_queries", "paper_queries", "parse_queries"):
    if importlib.util.find_spec(f"itemloom.plans.{_name}"):
        importlib.import_module(f"itemloom.plans.{_name}")
