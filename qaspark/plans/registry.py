"""Every query of the core and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qaspark.plans import asking, curating, evaluating, grading, reporting

FLAGSHIP = "eval_dimensions"
PARTS = (evaluating, grading, asking, curating, reporting)  # each adds its queries when it is imported


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(evaluating.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(evaluating.SQL)
