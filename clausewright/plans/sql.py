"""Every query as a temporary view, so that SQL can read all operators' results."""

from __future__ import annotations

from pyspark.sql import SparkSession

from clausewright.queries import QUERIES


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Create a lazy view per query over the tables of sf_dir; the views' names."""
    for name, query in QUERIES.items():
        query(spark, sf_dir).createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in QUERIES]
