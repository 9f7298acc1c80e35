"""What a batch of documents costs must not grow with its markers."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewright.functions import markers as mk
from clausewright.operators import segmentation as seg


def test_slices_hold_few_markers():
    sizes = [random.Random(3).randint(0, 90) for _ in range(1000)] + [50_000, 1, 0]
    runs = seg._slices(sizes)
    assert [i for b, e in runs for i in range(b, e)] == list(range(len(sizes)))
    assert all(sum(sizes[b:e]) <= seg.AT_ONCE or e == b + 1 for b, e in runs)
    assert seg._slices([]) == [(0, 0)]


@pytest.mark.parametrize("most", [1, 7, 20_000])
def test_slices_decode_alike(monkeypatch, most):
    """Slices of a batch, itself a slice with nulls, give what each document gives alone."""
    rng = random.Random(most)
    fams = [("section", "Section 1.1", [1, 1], []), ("article", "ARTICLE 1", [1], []), ("paren-lower", "(i)", [9], [1]), ("paren-lower", "(a)", [1], []), ("decimal", "2.", [2], [])]
    docs = []
    for _ in range(40):
        picked = [rng.choice(fams) for _ in range(rng.randint(0, 12))]
        docs.append([{"source_offset": 150 * i, "marker": m, "family": f, "number": {"path": p, "alt": a}, "block": i} for i, (f, m, p, a) in enumerate(picked)] if rng.random() < 0.9 else None)
    kind = pa.list_(pa.struct([("source_offset", pa.int32()), ("marker", pa.string()), ("family", pa.string()), ("number", pa.struct([("path", pa.list_(pa.int64())), ("alt", pa.list_(pa.int64()))])), ("block", pa.int32())]))
    monkeypatch.setattr(seg, "AT_ONCE", most)
    batch = pa.array([docs[0], *docs], kind).slice(1)
    got = seg.decode_arrays(batch, pa.array([5000] * len(docs), pa.int32()))
    assert got.to_pylist() == [seg.decode_markers(d, 5000) for d in docs]
    assert seg.decode_arrays(batch.slice(0, 0), pa.array([], pa.int32())).to_pylist() == []


def independent(text):
    found = sorted((m.start(), i, m[0]) for i, (_, rx) in enumerate(mk.FAMILIES) for m in re.finditer(rx, text, re.A))
    end, kept = 0, []
    for start, i, marker in found:
        if start >= end:
            kept.append((start, i, marker))
            end = start + len(marker)
    return kept


def test_markers_of_odd_texts(spark):
    """One search for all families finds what a search for each finds."""
    rng = random.Random(11)
    parts = ["ARTICLE ", "article\n", "Section ", "Clause ", "Schedule ", "Annexure ", "Exhibit ", "IV", "X", "B", "1", "12", ".", "2.3", " ", "(a)", "(ab)", "(AB)", "(7)", "(", ")", "ause ", "\x01", "\x02", "é", "😀", "1.2.3", "\t", "$0", "\\"]
    texts = ["", " ", "ARTICLE 1.2.3 x", "Schedule 1.2.3", "Exhibit Section 5.1.2. x", "ARTICLE Clause 5. x", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").repartition(4)
    got = {r.i: r for r in rows.select("i", mk.scan(F.col("text")).alias("m"), mk.block_start_marker(F.col("text")).alias("head")).collect()}
    for i, text in enumerate(texts):
        assert [tuple(m) for m in got[i].m] == independent(text), text
        lead = re.match(r"[ \t\n\x0b\f\r]*", text).end()
        heads = [(name, m[0], lead) for name, rx in mk.FAMILIES if (m := re.compile(rx, re.A).match(text, lead))]
        assert (tuple(got[i].head) if got[i].head else None) == (heads[0] if heads else None), text
    assert got[len(texts)].head is None and got[len(texts)].m is None


def test_corpus_is_that_of_its_sql(spark):
    """Items and blocks made by columns are those that the corpus' own SQL gives, lines
    without a part and orders without a customer included."""
    from clausewright.plans import corpus
    from clausewright.sources import blocks as src

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_custkey", F.expr("if(o_orderkey % 50 = 7, null, o_custkey)"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns({"l_partkey": F.expr("if(l_partkey % 9 = 1, null, l_partkey)"), "l_quantity": F.expr("if(l_suppkey % 7 = 1, null, l_quantity)")})
    lines = lines.dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).persist()  # else the SQL leaves ties open
    told = spark.sql(corpus.ITEMS_SQL, orders=orders, lineitem=lines)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(corpus.contract_items(spark, orders, lines)) == shown(told)
    assert shown(corpus.contract_blocks(orders, lines)) == shown(src.canonicalise(told))
    plan = corpus.contract_blocks(orders, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 4 and "RepartitionByExpression" in plan  # k1 twice and k2, then one for items and blocks
