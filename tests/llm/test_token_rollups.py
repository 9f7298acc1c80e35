import random
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausewright.llm import queries
from clausewright.llm import token_rollups as tr


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, tokens long")


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in store.totals().collect()}


def test_random_batches_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    store, held, expected = tr.Rollup(spark, str(tmp_path / "store")), {}, Counter()
    for batch in range(4):
        new = {i: (i, rng.choice(["a", "b", None]), rng.choice(["en", "fr"]), "t", rng.randint(0, 50)) for i in rng.sample(range(40), 15)}
        old = [held[i] for i in new if i in held]
        gone = [held.pop(i) for i in rng.sample(sorted(set(held) - set(new)), min(3, len(set(held) - set(new))))]
        held |= new
        delta = tr.revisions(frame(spark, old), frame(spark, list(new.values()))).unionByName(tr.deletes(frame(spark, gone)))
        assert store.commit(str(batch), delta)
        assert not store.commit(str(batch), delta)
    for _, s, la, t, n in held.values():
        expected[s, la, t, "docs"] += 1
        expected[s, la, t, "tokens"] += n
    assert totals(store) == {k[:3]: (expected[(*k[:3], "docs")], expected[(*k[:3], "tokens")]) for k in expected}
    assert store.committed() == ["0", "1", "2", "3"]


def test_a_draft_left_behind_is_no_batch(spark, tmp_path):
    store = tr.Rollup(spark, str(tmp_path / "store"))
    rows = frame(spark, [(1, "a", "en", "t", 5)])
    tr.inserts(rows).write.parquet(str(tmp_path / "store" / "_draft-x"))
    assert totals(store) == {}
    assert store.commit("x", tr.inserts(rows)) and totals(store) == {("a", "en", "t"): (1, 5)}
    store.commit("y", tr.deletes(rows))
    assert totals(store) == {}


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "s", "en", 1), (2, "", "s", "en", 2), (3, " a\tb\n é ", None, None, 3)], "doc_id long, text string, source string, lang string, tokens long")
    got = {(r.doc_id, r.tokenizer): r.tokens for r in tr.counted(docs).collect()}
    assert got == {(1, "words-1"): 0, (2, "words-1"): 0, (3, "words-1"): 3, (1, "bytes-1"): 0, (2, "bytes-1"): 0, (3, "bytes-1"): 9}
    assert tr.counted(docs.limit(0)).collect() == []


def test_compaction_keeps_totals_and_names(spark, tmp_path):
    store = tr.Rollup(spark, f"file://{tmp_path}/store")
    a, b = frame(spark, [(1, "a", "en", "t", 5), (2, None, "en", "t", 7)]), frame(spark, [(3, "a", "en", "t", 2)])
    assert store.compact() and totals(store) == {}
    store.commit("one", tr.inserts(a))
    store.commit("empty", tr.inserts(a.limit(0)))
    assert store.compact()
    store.vacuum()
    assert not list((tmp_path / "store").glob("batch=*")) and len(list((tmp_path / "store").glob("compact=*"))) == 1
    assert not store.commit("one", tr.inserts(a)) and store.committed() == ["empty", "one"]
    assert store.commit("two", tr.inserts(b)) and totals(store) == {("a", "en", "t"): (2, 7), (None, "en", "t"): (1, 7)}
    assert store.compact() and totals(store) == {("a", "en", "t"): (2, 7), (None, "en", "t"): (1, 7)}


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "store"), frame(spark, [(1, "a", "en", "t", 5)])
    first, second = tr.Rollup(spark, path), tr.Rollup(spark, path)
    monkeypatch.setattr(second, "committed", lambda: [])  # it looked before the other one committed
    assert first.commit("b", tr.inserts(rows)) and not second.commit("b", tr.inserts(rows))
    assert totals(first) == {("a", "en", "t"): (1, 5)} and not list((tmp_path / "store").glob("_draft*"))
    for odd in ("", "a/b", "..\n", "a b"):
        with pytest.raises(ValueError):
            first.commit(odd, tr.inserts(rows))


def test_stores_without_a_single_step_rename_are_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tr, "ATOMIC", ("hdfs",))
    with pytest.raises(ValueError):
        tr.Rollup(spark, str(tmp_path / "store"))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        counts = {"words-1": len(text.split()), "bytes-1": len(text.encode()), "byte-bpe-50k": len(library.encode(text, add_special_tokens=False).ids)}
        for kind, n in counts.items():
            want[r.source, r.lang, kind, 0] += 1
            want[r.source, r.lang, kind, 1] += n
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op6_token_rollups(spark, sf).collect()}
    assert got == {k[:3]: (want[(*k[:3], 0)], want[(*k[:3], 1)]) for k in want}


def test_public_counts_of_odd_texts(spark):
    count = tr.public_count(P.path("byte_bpe_50k.json"), P.PATTERN)
    df = spark.createDataFrame([(None,), ("",), ("hello world",)], "text string")
    assert [r.n for r in df.select(count(F.col("text")).alias("n")).collect()] == [0, 0, 2]
