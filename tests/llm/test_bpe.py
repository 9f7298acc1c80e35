import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from clausewright.llm import bpe, queries

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(P.path(NAME))
    return bpe.encoder(P.path(NAME), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    own, lib = both
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text), text[:80]
    assert own.decode(ids) == text.encode()


def test_odd_texts(both):
    for t in ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "\n", "a\xa0b", "a \xa0 b", "x\x1c y \x1fz", "don't 's we'll", "<|endoftext|>", "😀👍🏽 ü", "ｆｕｌｌ　ｗｉｄｔｈ  x", "12345 67,8.9!!", "\t\t a\t b", "a" * 5000, "ab" * 3000, " " * 500 + "x", "é" * 999]:
        same(both, t)


def test_random_texts(both):
    rng = random.Random(1)
    for alphabet in ("ab ", "abcdefghij \n", "thei nrsoa", "éàü ñthe\n\t", "01 .,!?'st", "日本語 ひらがなa"):
        for _ in range(400):
            same(both, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))))
    for _ in range(300):
        same(both, "".join(chr(rng.choice([rng.randint(1, 255), rng.randint(256, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)))


def test_documents_equal_the_library(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = np.array(both[1].encode_ordinary(r.text), "<u4")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_nulls_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "", "z")], "doc_id bigint, text string, ids string")
    rows = bpe.encode(df, P.path(NAME), P.PATTERN, decode=True).collect()
    assert sorted(len(r.ids) // 4 for r in rows) == [0, 0, 2]
    assert bpe.encode(df.limit(0), P.path(NAME), P.PATTERN).collect() == []
