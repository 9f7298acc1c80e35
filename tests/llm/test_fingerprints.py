import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clausewright.llm import fingerprints as fp


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(300)]
    base = " ".join(rng.choice(vocab) for _ in range(400))
    out = [base, base, base.replace("w7é", "other"), None, "", "   ", "one two", "one  TWO", "x" * 200_000]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 800))) for _ in range(40)]
    out += [base[: len(base) // 2] + " " + " ".join(rng.choice(vocab) for _ in range(200)) for _ in range(10)]
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("step", [1, 7])
def test_against_brute_force(spark, step):
    t = texts()
    ids = [None if i == 4 else step * i - 20 for i in range(len(t))]
    df = spark.createDataFrame([(i, x, "clash") for i, x in zip(ids, t)], "doc_id bigint, text string, edited string").repartition(5)
    got = {r.doc_id: r for r in fp.fingerprint_edits(df).collect()}
    order = sorted(range(len(t)), key=lambda k: -(10**9) if ids[k] is None else ids[k])
    assert len(got) == len(t)
    for at, k in enumerate(order):
        x, after = t[k] or "", t[order[(at + 1) % len(order)]] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + after[:half]
        r = got[ids[k]]
        assert r.n_chars == len(x)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(x), shingles(edited))) < 0.17
        assert abs(r.near_next - jaccard(shingles(x), shingles(after))) < 0.17
        n = len(shingles(x))
        assert abs(r.shingles_estimate - n) <= (0 if n < fp.K else 0.35 * n)
    assert got[ids[0]].fingerprint == got[ids[1]].fingerprint


def test_merge_equals_sketch_of_union(spark):
    t = [x for x in texts() if x]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(t)], "g int, text string")
    merged = fp.merge(df.select("g", fp.sketch(F.col("text")).alias("s")), ["g"], "s")
    got = {r.g: r.s for r in merged.collect()}
    each = df.select("g", fp.sketch(F.col("text"), 10**6).alias("s")).collect()
    for g in (0, 1):
        assert got[g] == sorted({h for r in each if r.g == g for h in r.s})[: fp.K]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert fp.fingerprint_edits(empty).collect() == []
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id bigint, text string")
    row = fp.fingerprint_edits(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    assert row.n_chars == 11 and row.near_next == 1.0


def test_containment(spark):
    row = spark.range(1).select(
        fp.containment(fp.sketch(F.lit("a b c d e f g")), fp.sketch(F.lit("x a b c d e f g y"))).alias("c"),
        fp.containment(fp.sketch(F.lit("")), fp.sketch(F.lit("a"))).alias("e"),
    ).first()
    assert row.c == 1.0 and row.e == 1.0


def test_hot_ids_and_rows_repeated_in_full(spark):
    rng = random.Random(4)
    rows = [(5, f"text {i} " + "w " * rng.randint(0, 30)) for i in range(300)] + [(None, f"none {i}") for i in range(100)]
    rows += [(5, "the same row")] * 200 + [(None, None)] * 50 + [(i, f"own {i}") for i in range(6, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_range", F.lit(1)).withColumn("h", F.lit(2)).repartition(6)
    keyed = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("t")).collect()
    order = [t for _, _, t in sorted((r.k, r.h, r.t) for r in keyed)]
    want = []
    for i, t in enumerate(order):
        half = len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + order[(i + 1) % len(order)][:half]).encode()).hexdigest())
    got = fp.fingerprint_edits(df).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 150 and sum(r.doc_id == 5 for r in got) == 500
