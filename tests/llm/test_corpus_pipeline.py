import corpus_pipeline as cp
import pyarrow as pa
import pytest

from clausewright.llm import ngram_join, packing, quality, queries
from clausewright.llm.durable import durable
from tests.llm.test_ngram_join import brute
from tests.llm.test_secret_scan import brute as brute_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(durable(stage(spark, out[-1], SF), name))
    return out


def test_stages_in_order():
    assert [name for name, _ in cp.STAGES] == ["quality", "near_dups", "secrets", "packing"]


def test_columns(stages):
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_rejected_documents_go(spark, stages):
    model = queries.quality_model(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(stages[0], model).collect() if r.score >= quality.THRESHOLD}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, _, c in brute(rows, 5, 80) if i == c)


def test_secrets_are_masked(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert not brute_spans(after[i].text) and after[i].n_chars == len(after[i].text)
        assert ("[SECRET]" in after[i].text) or after[i].text == text


def test_packing_takes_all(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, long.upper(), "en", "a", 5), (None, None, None, None, None), (3, "", "en", "b", 0), (4, "token=abcdefghijklmnop", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4]
    clean = cp.redact_secrets(spark, kept, SF)
    assert {r.text for r in clean.collect() if r.doc_id == 4} == {"[SECRET]"}
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_row_keys_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, 1.0), (7, long + " x", 2.0), (7, long + " y", 3.0), (7, "other words", 4.0), (None, "token=abcdefghijklmnop", 5.0), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    docs = docs.withColumns({"base": docs.score, "spans": docs.score, "_row": docs.score, "predicted": docs.score, "component": docs.score, "_hash": docs.score})
    frame = docs
    for _, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.dtypes == docs.dtypes
    kept = cp.redact_secrets(spark, cp.drop_near_duplicates(spark, docs, SF), SF).collect()
    assert sorted(str(r.text)[:11] for r in kept) == sorted([long[:11], "other words", "[SECRET]", "None"])
    assert next(r for r in kept if r.text and r.text.startswith("w0")).doc_id == 7
    assert all(r.score == r.base == r.spans for r in kept)


def test_few_texts_at_a_time_go_to_python(spark, monkeypatch):
    """In every table that is made from texts, whatever the session's batches are."""
    seen = []

    def told(df, name, *sizes, write=durable, **more):
        seen.append((name, more.get("texts", False), df._jdf.queryExecution().toString()))
        return write(df, name, *sizes, **more)

    for module in (ngram_join, packing, quality):
        monkeypatch.setattr(module, "durable", told)
    docs = spark.createDataFrame([(k, f"words of text {k} " * 20, "en", "a", 1) for k in range(30)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).count()
    assert {name for name, texts, _ in seen if texts} == {name for name, _, plan in seen if "MapInArrow" in plan}

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for own, most in ((10_000, 1000), (0, 1000), (300, 300)):
        spark.conf.set(batch, str(own))
        try:
            got = [r.n for r in durable(spark.range(0, 2500, 1, 1).mapInArrow(rows, "n long"), "batches", texts=True).collect()]
            assert max(got) == most and sum(got) == 2500 and spark.conf.get(batch) == str(own)
        finally:
            spark.conf.unset(batch)
