"""Registered queries of the layout and text operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import audit
from . import audit_sql, cleaning, corpora, layout


def _audit(s: SparkSession, d: str) -> DataFrame:
    return audit.audit_pages(corpora.pages(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "audit_pages": _audit,
        "audit_summary": lambda s, d: audit.summary(_audit(s, d)),
        "audit_totals": lambda s, d: audit.totals(_audit(s, d)),
        "audit_flagged": lambda s, d: audit.flagged(_audit(s, d)),
        "audit_examples": lambda s, d: audit.examples(_audit(s, d)),
        **layout.queries(),
        "clean_rules": cleaning.repaired,
    }


def oracle_sql() -> dict[str, str]:
    return {**audit_sql.SQL, **layout.oracle_sql(), "clean_rules": cleaning.SQL}
