"""All registered queries."""

from wellspring.plans import evaluation, preparing, scoring, storing, timeseries  # noqa: F401
from wellspring.plans.registry import QUERIES, spark_queries, sql_texts

__all__ = ["QUERIES", "spark_queries", "sql_texts"]
