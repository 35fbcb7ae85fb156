"""Registry of checkable queries: Spark plan + independent DuckDB SQL.

Each entry is keyed by the inventory ID it exercises.  The Spark callable
takes (spark, sf_dir) and reads whole benchmark tables through
`sources.driver`; the SQL reads the same tables as DuckDB views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.functions.features import ts
from postingscope.plans import sqlgen as S
from postingscope.sources import driver as D

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def as_of():
    return ts(D.AS_OF)


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# Submodules register their queries on import.
from postingscope.plans import (q_scoring, q_text, q_ingest, q_sentiment,  # noqa: E402,F401
                                q_stats, q_reports, q_sources, q_streaming)
