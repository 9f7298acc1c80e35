import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from clausewright.llm import memory, packing, queries

PATH = P.path("byte_bpe_50k.json")


@functools.lru_cache
def library():
    return Tokenizer.from_file(PATH)


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [1]


def check_places(rows, capacity=2048):
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return used


def test_tokens_equal_the_library():
    own = packing.tokens(PATH, P.PATTERN)
    rng = random.Random(2)
    texts = ["", " ", "a  b", "a \n b", "<|endoftext|> x", "it's  ", "😀 é\xa0 ü", "x" * 3000, "\x1c a \x1d", "a ", " a"]
    texts += ["".join(rng.choice("abc th\n.é'1 ") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == library_ids(t)[:-1], t


def test_query_places_every_token_once(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op7_packing(spark, sf).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == docs.keys()
    tokenizer = Tokenizer.from_file(PATH)
    for doc, text in docs.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = check_places(rows)
    total = sum(r.length for r in rows)
    assert 1 - total / (2048 * len(used)) < 0.02


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b c", 0), (2, "word " * 9000, 0)], "doc_id bigint, text string, offset int")
    rows = packing.pack_documents(df, PATH, P.PATTERN, with_ids=True).collect()
    check_places(rows)
    assert Counter(r.doc_id for r in rows if r.doc_tokens == 1) == {1: 2}
    assert sum(r.length for r in rows if r.doc_id == 2) == len(library_ids("word " * 9000))
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(df.limit(0), PATH, P.PATTERN).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_demand_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 300, 64) * (rng.random(64) < 0.7)
    plan = packing.plan_sequences(list(demand), 64)
    got = np.zeros(64, int)
    for pattern, times in plan:
        assert sum((i + 1) * n for i, n in pattern.items()) <= 64 and times > 0
        for i, n in pattern.items():
            got[i] += n * times
    assert (got == demand).all()
    cut = packing.column_generation(demand, 64)
    assert sum(t for _, t in plan) <= sum(u for _, u in cut) + len(cut)
    assert sum(t for _, t in plan) <= first_fit_decreasing(demand, 64)


def first_fit_decreasing(demand, capacity):
    room = []
    for i in range(len(demand) - 1, -1, -1):
        for _ in range(int(demand[i])):
            k = next((k for k, r in enumerate(room) if r > i), None)
            if k is None:
                room.append(capacity)
                k = len(room) - 1
            room[k] -= i + 1
    return len(room)


def test_small_plans_equal_the_least_possible():
    @functools.cache
    def least(left):
        if not any(left):
            return 0
        return 1 + min(least(after) for after in cuts(left, 10, len(left) - 1) if after != left)

    def cuts(left, room, top):
        if top < 0:
            yield left
            return
        for n in range(min(left[top], room // (top + 1)), -1, -1):
            yield from cuts(left[:top] + (left[top] - n,) + left[top + 1 :], room - n * (top + 1), top - 1)

    rng = np.random.default_rng(7)
    for _ in range(12):
        demand = tuple(int(x) for x in rng.integers(0, 3, 8))
        assert sum(t for _, t in packing.plan_sequences(list(demand) + [0, 0], 10)) <= least(demand) + 1


def test_pricing_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        prices, demand = rng.random(12), rng.integers(0, 2, 12)
        best = [0.0] * 13
        for room in range(1, 13):
            best[room] = max([best[room - 1]] + [prices[i] + best[room - i - 1] for i in range(room) if demand[i]])
        worth, pattern = packing.price_pattern(prices, demand, 12)
        assert worth == pytest.approx(best[12])
        assert sum(prices[i] * n for i, n in pattern.items()) == pytest.approx(worth)


def test_other_operators_empty_the_cache():
    nothing = lambda batches: iter(())
    packing.tokens(PATH, P.PATTERN)
    assert not list(memory.giving_back(nothing, keep="packing")(iter(()))) and packing.tokens.cache_info().currsize
    assert not list(memory.giving_back(nothing)(iter(()))) and not packing.tokens.cache_info().currsize
