import random
import re

import pytest
from pyspark.sql import functions as F

from clausewright.functions import markers, numbering
from clausewright.operators import segmentation as seg
from clausewright.operators import trust
from clausewright.sources import blocks as src
from clausewright.streaming.segments import segment_rows

B = "filler words of the clause. " * 15


def blocks(spark, *docs):
    rows = [(d, i, "text", t, 1) for d, texts in enumerate(docs) for i, t in enumerate(texts)]
    return src.canonicalise(spark.createDataFrame(rows, "doc_id long, item_index int, label string, text string, page int"))


def tree(spark, *texts):
    rows = seg.segment(blocks(spark, texts)).orderBy("ord").collect()
    return [(r.number, r.depth, r.parent_id) for r in rows]


def depths(spark, *texts):
    return [d for _, d, _ in tree(spark, *texts)]


def test_hierarchy_behind_a_table_of_contents(spark):
    found = tree(spark, "ARTICLE V", "ARTICLE IX", "ARTICLE I", "1.1 " + B, "1.2 " + B, "(a) " + B, "(b) " + B, "1.3 " + B, "ARTICLE II", "2.1 " + B)
    assert [d for _, d, _ in found] == [0, 1, 1, 2, 2, 1, 0, 1]
    assert found[0][0] == "ARTICLE I"


@pytest.mark.parametrize(
    "texts,expected",
    [
        (("ARTICLE I", "1.1 " + B, "1.3 " + B, "1.4 " + B), [0, 1, 1, 1]),
        (("ARTICLE V", "5.1 " + B, "ARTICLE VI", "6.02 " + B, "6.03 " + B), [0, 1, 0, 1, 1]),
        (("ARTICLE I", "1.01 The Merger.", "(a) " + B, "1.02 " + B), [0, 1, 2, 1]),
        (("ARTICLE I", "ARTICLE II", "ARTICLE I", "1.1 Term.", B, "1.2 Rent.", B), [0, 1, 1]),
    ],
)
def test_depths(spark, texts, expected):
    assert depths(spark, *texts) == expected


def test_no_over_nesting(spark):
    assert max(depths(spark, "ARTICLE I", "1.1 " + B, "2.1 " + B, "3.1 " + B)) <= 1


def test_letters_may_open_what_counts_on_elsewhere(spark):
    found = tree(spark, "ARTICLE I", "1.1 " + B, "(a) " + B, "(b) " + B, "2.1 " + B)
    assert found[-1][:2] == ("1.1", 3)


def test_relative_numbers_take_their_article(spark):
    found = tree(spark, "ARTICLE 1", "Section 1.01 " + B, "Section 1.02 " + B, "ARTICLE 2", "Section 1.01 " + B, "Section 1.02 " + B)
    assert [n for n, _, _ in found][-2:] == ["Section 2.01", "Section 2.02"]


def test_schedules_are_regions_of_their_own(spark):
    found = tree(spark, "ARTICLE I", "1.1 " + B, "1.2 " + B, "Schedule B", "1.1 " + B, "1.2 " + B)
    assert found[3] == ("Schedule B", 0, None) and [p for _, _, p in found[4:]] == ["cl-3", "cl-3"]


def test_spans_and_headings(spark):
    b = blocks(spark, ["ARTICLE I", "1.1. Term.", "1.2. Rent. " + B, "(a) the part"])
    doc = src.documents_of(b).first().text
    rows = seg.segment(b).orderBy("ord").collect()
    assert [r.heading for r in rows] == [None, "Term", "Rent", "the part"]
    for r in rows:
        assert doc[r.char_start : r.char_end] == r.text
    assert [(s.start, s.end) for s in rows[2].direct_spans] == [(rows[2].char_start, rows[3].char_start)]
    assert trust.tree_issues(seg.with_inclusive_ends(seg.clause_nodes(b))).collect() == []


def test_trust(spark):
    b = blocks(spark, ["ARTICLE I", "1.1 " + B, "1.2 " + B, "ARTICLE II", "2.1 " + B, "2.2 " + B], ["ARTICLE II " + B, "ARTICLE I " + B])
    rows = {r.doc_id: r for r in trust.confidence(seg.with_inclusive_ends(seg.clause_nodes(b))).collect()}
    assert rows[0].score > 0.95 and not rows[0].needs_review
    assert rows[1].article_order < 1 and rows[1].needs_review and "articles or top-level sections appear out of order" in rows[1].reasons


def brute_scan(text):
    found = sorted((m.start(), i, m.group()) for i, (_, rx) in enumerate(markers.FAMILIES) for m in re.finditer(rx, text, re.ASCII))
    out, end = [], 0
    for start, i, marker in found:
        if start >= end:
            out.append((start, i, marker))
            end = start + len(marker)
    return out


def test_scan_equals_brute_force(spark):
    rng = random.Random(4)
    parts = ["ARTICLE ", "Section ", "Schedule ", "I", "IV", "1", "2.3", ".", " ", "(a)", "(iv)", "(B)", "(12)", "1. ", "text ", "\n", "é", "😀", "clause 4.2"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", markers.scan(F.col("t")).alias("s"), markers.block_start_marker(F.col("t")).alias("b")).collect()
    for r in rows:
        own = brute_scan(texts[r.i])
        assert [(x.start, x.priority, x.marker) for x in r.s] == own
        lead = len(texts[r.i]) - len(re.sub(r"^\s+", "", texts[r.i], flags=re.ASCII))
        first = [(s, markers.FAMILIES[i][0], m) for s, i, m in own if s == lead]
        assert ([(r.b.start, r.b.family, r.b.marker)] if r.b else []) == first


@pytest.mark.parametrize("text,value", [("iv", 4), ("IX", 9), ("iiii", 4), ("ic", 99), ("xiz", None), ("", None), ("MCMXC", 1990)])
def test_roman(spark, text, value):
    assert spark.range(1).select(numbering.parse_roman(F.lit(text)).alias("v")).first().v == value


@pytest.mark.parametrize(
    "family,marker,path,alt",
    [("article", "ARTICLE III", [3], []), ("section", "Section 7.2", [7, 2], []), ("hier-decimal", "1.1.", [1, 1], []), ("paren-num", "(3)", [3], []), ("paren-upper", "(B)", [2], []), ("paren-upper", "(IV)", [], []),
     ("paren-lower", "(a)", [1], []), ("paren-lower", "(i)", [9], [1]), ("paren-lower", "(ii)", [2], []), ("region", "Schedule C", [100], []), ("region", "Schedule B", [2], []), ("region", "Schedule of", [], [])],
)
def test_parse_marker(spark, family, marker, path, alt):
    row = spark.range(1).select(numbering.parse_marker(F.lit(family), F.lit(marker)).alias("m")).first().m
    assert (row.path, row.alt) == (path, alt)


def test_stream_equals_batch(spark, tmp_path):
    docs = src.documents_of(blocks(spark, ["ARTICLE I", "1.1 " + B, "(a) " + B, "ARTICLE II", "2.1 " + B], ["1. " + B, "2. " + B], ["none"]))
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    query = segment_rows(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    query.awaitTermination(60)
    key = lambda rows: sorted((r.doc_id, r.ord, r.depth, r.number) for r in rows)
    assert key(spark.table("found").collect()) == key(segment_rows(docs).collect())
    assert len(spark.table("found").collect()) == 7


def test_ends_of_deep_clauses(spark):
    b = blocks(spark, ["ARTICLE I", "1.1 " + B, *["(a) " + B] * 15, "1.2 " + B, "ARTICLE II", "2.1 " + B])
    rows = seg.segment(b).orderBy("ord").collect()
    assert [r.depth for r in rows] == [0, 1, *range(2, 17), 1, 0, 1]
    for i, r in enumerate(rows):
        assert r.char_end == next((x.char_start for x in rows[i + 1 :] if x.depth <= r.depth), r.text_length)
    ended = seg.with_inclusive_ends(seg.clause_nodes(b))
    assert trust.tree_issues(ended).collect() == []
    assert trust.confidence(ended).first().score == 1.0


def test_large_numbers(spark):
    rows = seg.segment(blocks(spark, ["1.1 " + B, "1.12345678901 " + B, "1.12345678902 " + B, "1.99999999999999999999 " + B, "1.2 " + B])).orderBy("ord").collect()
    assert [r.path for r in rows] == [[1, 1], [1, 2]]
    rows = seg.segment(blocks(spark, ["1.12345678901 " + B, "1.12345678902 " + B])).orderBy("ord").collect()
    assert [(r.path, r.depth) for r in rows] == [([1, 12345678901], 0), ([1, 12345678902], 0)]


def brute_segments(texts, nodes):
    """Ends, own parts and pages' worth of text of placed nodes, by plain loops."""
    whole = "\n\n".join(texts)
    out = []
    for i, n in enumerate(nodes):
        end = next((x.char_start for x in nodes[i + 1 :] if x.depth <= n.depth), len(whole))
        kids = [x.char_start for x in nodes[i + 1 :] if x.parent == n.ord]
        own = min([end, *kids])
        out.append((n.ord, end, whole[n.char_start : end], [(n.char_start, own)] if own > n.char_start else []))
    return out


def test_segments_equal_brute_force(spark):
    rng = random.Random(9)
    heads = ["ARTICLE I", "ARTICLE II", "ARTICLE III", "  1.1", "1.2", "2.1", "3.1", "(a)", " (b)", "(i)", "(1)", "(2)", "Schedule A", "Section 2.2", "plain", "é 😀"]
    docs = [[f"{rng.choice(heads)} {rng.choice(['', 'x. y', B])}" for _ in range(rng.randint(1, 40))] for _ in range(30)]
    b = blocks(spark, *docs)
    got = seg.segment(b).collect()
    spans = seg.with_direct_spans(seg.with_inclusive_ends(seg.clause_nodes(b)))
    pieces = {(r.doc_id, r.ord): [tuple(s) for s in r.direct_spans] for r in spans.collect()}
    for d, texts in enumerate(docs):
        rows = sorted((r for r in got if r.doc_id == d), key=lambda r: r.ord)
        want = brute_segments(texts, rows)
        assert [(r.ord, r.char_end, r.text, [tuple(s) for s in r.direct_spans]) for r in rows] == want
        assert all(pieces[d, r.ord] == [tuple(s) for s in r.direct_spans] for r in rows)
