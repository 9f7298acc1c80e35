"""Queries of the core registry against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from clausewright import queries, vocabulary
from clausewright.plans import pipelines

SF = "/root/testdata/sf0.001"
SLOW = {"near_duplicates"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def shown(rows, columns):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    told = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(told.columns)
    rows = [dict(zip(told.columns, r, strict=True)) for r in told.fetchall()]
    assert shown(df.collect(), sorted(df.columns)) == shown(rows, sorted(df.columns))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1


def test_vocabularies():
    vocabulary.check_vocabularies()


def test_strict_validation_raises(spark):
    result = spark.createDataFrame([(1, "x")], "doc_id long, a string")
    issues = spark.createDataFrame([(1, "dangling_ref", "r")], "doc_id long, code string, ref string")
    assert pipelines.validated(result, issues).first().issues == 1
    assert pipelines.validated(result, issues, "off").columns == ["doc_id", "a"]
    with pytest.raises(pipelines.IntegrityError):
        pipelines.validated(result, issues, "strict")


def test_views(spark):
    from clausewright.plans.sql import register_views

    assert "cw_clause_numbers" in register_views(spark, SF, "cw_")
    assert spark.sql("SELECT count(*) AS n FROM cw_hash_split").first().n == spark.read.parquet(f"{SF}/documents.parquet").count()
