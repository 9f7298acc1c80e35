"""Queries that once read a part of their input, against the whole of it."""

import math
import re
import unicodedata
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from clausewright import queries
from clausewright.operators import datasets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def told(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("name,columns", [("integrity_issues", ("doc_id", "code", "ref")), ("evidence_verify", ("kind", "failing"))])
def test_facts_cover_all_lines(spark, duck, name, columns):
    whole = duck.sql(queries.ORACLES[name]).select(*columns).fetchall()
    assert told(queries.QUERIES[name](spark, SF).select(*columns).collect()) == told(whole)


def test_every_answer_is_a_row(spark, duck):
    whole = duck.sql(queries.ORACLES["answer_explode"]).select("doc_id", "pos", "answer", "answer_start").fetchall()
    rows = queries.QUERIES["answer_explode"](spark, SF).select("doc_id", "pos", "answer", "answer_start").collect()
    assert max(r.pos for r in rows) > 2
    assert told(rows) == told(whole)


def test_roman_values_of_all_lines(spark, duck):
    whole = duck.sql(queries.ORACLES["roman_values"]).select("word", "value", "uses").fetchall()
    assert told(queries.QUERIES["roman_values"](spark, SF).select("word", "value", "uses").collect()) == told(whole)


def brute_terms(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    words = re.findall(r"\w\w+", plain)
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def test_terms_of_one_and_two_words_in_all_documents(spark, duck):
    tfs = {i: brute_terms(t) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    dfs = Counter(t for tf in tfs.values() for t in tf)
    whole = []
    for i, tf in tfs.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(tfs)) / (1 + dfs[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        best = sorted((-round(x / norm, 9), t) for t, x in w.items())[:3]
        whole += [(i, k, t, -x) for k, (x, t) in enumerate(best, 1)]
    rows = queries.QUERIES["tfidf_top_terms"](spark, SF).select("id", "nth", "term", "weight").collect()
    assert [r[:3] for r in told(rows)] == [r[:3] for r in sorted(whole)]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(told(rows), sorted(whole), strict=True))


def test_cap_is_the_references(spark):
    large = "/root/testdata/sf0.1"
    assert queries.QUERIES["capped_negatives"](spark, large).count() == 10_000


@pytest.mark.parametrize("cap", [0, 7, 700, 5000])
def test_capped_negatives_are_the_first(spark, cap):
    df = spark.range(4000).selectExpr("(id * 7919) % 4001 AS doc_id").repartition(5)
    kept = datasets.cap_negatives(df, df.doc_id % 3 != 0, "doc_id", cap).collect()
    ids = [r.doc_id for r in df.collect()]
    assert sorted(r.doc_id for r in kept) == sorted([i for i in ids if i % 3 == 0] + sorted(i for i in ids if i % 3)[:cap])


def test_bootstrap_draws_the_references_rounds(spark, duck):
    whole = duck.sql(queries.ORACLES["bootstrap_ci"]).select("low", "high", "rounds").fetchall()[0]
    row = queries.QUERIES["bootstrap_ci"](spark, SF).first()
    assert row.rounds == 1000 and (row.low, row.high, row.rounds) == pytest.approx(whole)


def test_terms_move_twice(spark):
    """Terms are counted on their document's row: one shuffle to their df, one back, and
    those of the dfs and the number of documents, which are summed up first."""
    plan = queries.QUERIES["tfidf_top_terms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(id#\d+L, term#", plan)
    texts = ["A b. Ça ça va ça va", None, "", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", datasets.term_counts("text").alias("c")).collect()
    assert {r.i: {c.term: c.tf for c in r.c} for r in rows} == {i: dict(brute_terms(t or "")) for i, t in enumerate(texts)}
    twice = spark.createDataFrame([(1, "a1 b1"), (1, "a1"), (2, "b1")], "doc_id long, text string")
    got = {(r.id, r.term): r.weight for r in datasets.tfidf(twice, "doc_id", datasets.term_counts("text")).collect()}
    raw = {"a1": (1 + math.log(2)) * (math.log(3 / 2) + 1), "b1": 1.0, "a1 b1": math.log(3 / 2) + 1}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({(1, t): v / norm for t, v in raw.items()} | {(2, "b1"): 1.0})


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_answer_samples_equal_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    whole = c.sql(queries.ORACLES["answer_samples"]).select("question", "title", "span", "context").fetchall()
    assert told(queries.QUERIES["answer_samples"](spark, f"/root/testdata/{sf}").select("question", "title", "span", "context").collect()) == told(whole)
