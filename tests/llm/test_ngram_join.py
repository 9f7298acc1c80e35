import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clausewright.llm import components, ngram_join, queries
from clausewright.llm.components import connected_components


def brute_sets(rows, size):
    out = []
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        out.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def brute(rows, size, share):
    sets = brute_sets(rows, size)
    by_token = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for t in s:
            by_token[t].add(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, s) in enumerate(sets):
        counts = defaultdict(int)
        for t in s:
            for o in by_token[t]:
                if o < k:
                    counts[o] += 1
        for o, shared in counts.items():
            if 100 * shared >= share * (len(s) + len(sets[o][1]) - shared):
                root[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if r not in least else min(least[r], i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["É", "Ä", "THE"]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 160))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        if rng.random() < 0.3:
            w = [rng.choice(vocab) for _ in range(rng.randint(5, 40))] + passage
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out + [None, "", " \n", "a", "A", "a b", "a b c d", "A  B\tC d", "x " * 5000]


@pytest.mark.parametrize("seed,size,share", [(1, 4, 85), (2, 5, 80)])
def test_against_brute_force(spark, seed, size, share, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "COUNTED_SHINGLES", 2000)
    rows = list(enumerate(corpus(seed), 10))
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id bigint, text string, n_shingles int").repartition(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, size=size, share=share).collect())
    assert got == brute(rows, size, share)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op4_ngram_join(spark, sf).collect())
    assert got == brute(rows, 4, 85)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, long), (7, long), (7, "other text of its own"), (7, long), (None, "alone here")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(df).collect())
    assert got == sorted([("None", 46, "7"), ("7", 46, "7"), ("7", 1, "7"), ("7", 46, "7"), ("None", 1, "None")])
    assert ngram_join.near_duplicates(df.limit(0)).collect() == []


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def met_rows(spark, texts, size=5, share=80):
    """Rows of the pair join for these texts, before stars have joined anything."""
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("text_hash", F.xxhash64("text")).repartition(4)
    counted = ngram_join._sets_and_counts(df, size)
    entries = ngram_join._entries(ngram_join._prefixes(df, size, share, ngram_join._frequent(counted)), share)
    return ngram_join._meetings(entries.withColumn("label", F.col("node")), share).count()


@pytest.mark.parametrize("own", [9, 30])
def test_common_passage_makes_no_pairs(spark, own):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    for n in (300, 600, 1200):
        texts = [" ".join([word() for _ in range(own + rng.randrange(3))] + passage) for _ in range(n)]
        assert met_rows(spark, texts) <= n


def test_unlike_copies_make_few_pairs(spark):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]
    for n in (200, 400, 800):
        texts = []
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(4, 7)):
                copy[rng.randrange(150)] = word()
            texts.append(" ".join(copy))
        assert met_rows(spark, texts) <= n * (n - 1) / 200


def test_hot_ids(spark):
    rng = random.Random(7)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base = words(60)
    rows = [(None if k % 2 else 5, " ".join([*base[:50], *words(k % 4)])) for k in range(200)] + [(None, " ".join(words(20))) for _ in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == 300 and sum(r.component_id == 5 for r in got) == 200
    kept = ngram_join.first_of_each_group(df.withColumn("node", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "node"] and kept.count() == 101
    assert sum(r.doc_id == 5 for r in kept.collect()) == 1


def test_kept_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long.upper()), (None, long + " x"), (None, None), (None, None), (3, ""), (4, "alone"), (4, "ALONE")]
    kept = ngram_join.first_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r.doc_id), {"alone": "a", "ALONE": "a"}.get(r.text, str(r.text))) for r in kept.collect()) == sorted([("1", long), ("None", "None"), ("None", "None"), ("3", ""), ("4", "a")])


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice((1, 5, 9, 5000)))) for _ in range(400))
    whole = ngram_join.shingle_set(text, 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    assert (ngram_join.shingle_set(text, 4) == whole).all() and len(whole) == 397


def shuffled_bytes(spark):
    """Bytes that all stages so far have written for other stages."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_of_no_pair_stay_where_they_are(spark):
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(2000)]
    texts[1] = texts[0] + " more"
    docs = spark.createDataFrame([(None if k == 1 else k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "id bigint, text string")
    docs = ngram_join.durable(docs.withColumn("text_hash", F.xxhash64("text")).repartition(4), "docs")
    nodes = [ngram_join.set_hash(ngram_join.shingle_set(t, 5)) for t in texts]
    hashes = {r.text: r.text_hash for r in docs.collect()}
    firsts = spark.createDataFrame([(n, (k == 1, None if k == 1 else k, hashes[t])) for k, (n, t) in enumerate(zip(nodes, texts, strict=True))], "node bigint, first struct<none: boolean, id: bigint, text_hash: bigint>")
    pairs = spark.createDataFrame([(nodes[1], nodes[0]), (nodes[2], nodes[0])], "a bigint, b bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        assert [tuple(r) for r in ngram_join._verified(pairs, docs, firsts, 5, 80).collect()] == [(nodes[1], nodes[0])]
        assert shuffled_bytes(spark) - before < sum(map(len, texts)) / 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bits_shared_with_others_and_spread_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_WORDS", 1)
    monkeypatch.setattr(ngram_join, "PAIRS_OF_ONE", 3)
    rows = list(enumerate(corpus(3), 10))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, size=4, share=85).collect())
    assert got == brute(rows, 4, 85)


def test_asks_only_for_sizes_that_are_offered(spark):
    entries = spark.createDataFrame([(1, 10, 100, 0, 1, 1, True, 2), (1, 11, 100, 0, 1, 1, True, 2), (1, 12, 300, 0, 1, 1, False, 2), (2, 13, 50, 0, 1, 1, False, 1), (2, 14, 50, 0, 1, 1, False, 1)], "token bigint, node bigint, n int, pos int, rank int, m int, offers boolean, met bigint")
    left, n_left, pairs = ngram_join._open_entries(entries)
    assert sorted((r.node, r.label, r.low, r.high) for r in left.collect()) == [(10, 10, 100, 100), (11, 11, 100, 100), (12, 12, 100, 100)]
    assert (n_left, pairs) == (3, 4)
    again, n_left, pairs = ngram_join._open_entries(left.withColumn("label", F.when(F.col("node") < 12, F.lit(10)).otherwise(F.col("node"))))
    assert (again.count(), n_left, pairs) == (3, 3, 2)
    assert {(r.node_a, r.node_b) for r in ngram_join._meetings(left, 85).collect()} == {(11, 10)}


@pytest.mark.parametrize("task", [None, 40])
def test_small_tables_are_few_files(spark, monkeypatch, task):
    """However many partitions shuffles have; with small tasks they are many again."""
    files = defaultdict(list)

    def told(df, name, *sizes, write=ngram_join.durable, **more):
        out = write(df, name, *((*sizes[:1], task) if task and sizes else sizes), **more)
        files[name].append(len(out.inputFiles()))
        return out

    for module in (ngram_join, components):
        monkeypatch.setattr(module, "durable", told)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = list(enumerate(corpus(4), 10))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, size=4, share=85).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows, 4, 85)
    few = {k: max(v) for k, v in files.items() if k not in ("shingle-counts", "sets")}
    assert len(few) == 13 and (max(few.values()) > 10 if task else max(few.values()) == 1)
