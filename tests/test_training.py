"""Trained models, their guards and manifests, prompts and dataset build."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright import queries
from clausewright.operators import datasets as ds
from clausewright.operators import metrics as mx
from clausewright.operators import prompts as pr
from clausewright.operators import training as tr
from clausewright.vocabulary import CLAUSE_TYPES, UNKNOWN

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def typed(spark):
    rng = random.Random(1)
    words = {"nda": "secret confidential disclose", "commercial_agreement": "price supply order", "other": "recipe news manual"}
    rows = [(i, " ".join(rng.choice((words[t] + " the of and party").split()) for _ in range(30)), t) for i, t in enumerate(["nda"] * 40 + ["commercial_agreement"] * 20 + ["other"] * 10)]
    return spark.createDataFrame(rows, "id long, text string, type string").cache()


@pytest.fixture(scope="module")
def model(typed):
    return tr.train_document_types(typed, iterations=200)


def test_the_fit_is_a_minimum(typed, model):
    """The gradient of the weighted loss and its ridge is 0, over features by hand."""
    rows = typed.collect()
    place = {t: i for i, (t, _) in enumerate(model.known)}
    x = np.zeros((len(rows), len(place)))
    docs = []
    for r in rows:
        w = r.text.split()
        docs.append([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    df = {t: sum(t in d for d in docs) for t in place}
    for i, d in enumerate(docs):
        for t in set(d):
            x[i, place[t]] = (1 + math.log(d.count(t))) * (math.log((1 + len(docs)) / (1 + df[t])) + 1)
        x[i] /= np.linalg.norm(x[i])
    y = np.array([[r.type == c for c in model.classes] for r in rows], float)
    weight = (len(rows) / (len(model.classes) * y.sum(axis=0)))[y.argmax(axis=1)]
    coefficients, intercepts = model.fitted.coefficientMatrix.toArray(), model.fitted.interceptVector.toArray()
    logits = x @ coefficients.T + intercepts
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((p - y) * weight[:, None]).T @ x / weight.sum() + coefficients / len(rows)
    assert np.abs(gradient).max() < 1e-4


def test_top_features_and_saving(spark, typed, model, tmp_path):
    top = model.top_features(3)
    assert set(top["nda"]) & {"secret", "confidential", "disclose"} and set(top["other"]) & {"recipe", "news", "manual"}
    tr.save_document_types(spark, model, f"file://{tmp_path}/m", {"dataset_hash": "x"})
    again = tr.load_document_types(spark, f"file://{tmp_path}/m")
    assert again.top_features(3) == top and tr.read_json(spark, f"file://{tmp_path}/m/manifest")["dataset_hash"] == "x"
    row = tr.evaluate_document_types(again, typed, typed, model.classes).first()
    assert row.macro_f1 > 0.95 and row.top3 == 1 and row.floor < 0.4 and row["rows"] == 70


def test_vocabulary_is_bounded_by_frequency(spark):
    terms = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["c", "b", "d"])], "id long, terms array<string>")
    assert tr.vocabulary(terms, 2) == [("a", math.log(4 / 3) + 1), ("b", math.log(4 / 3) + 1)]


def test_guards(spark):
    row = ("real_dev", "nda", "real", "verified")
    frame_ = lambda *rows: spark.createDataFrame(rows, "split string, type string, origin string, review_status string")
    tr.guard_evaluation(frame_(row), "real_dev", ["nda"])
    for rows, split, labels, least in (
        ([row], "real_test", ["nda"], 1),
        ([row], "real_dev", ["poem"], 1),
        ([row, ("train", *row[1:])], "real_dev", ["nda"], 1),
        ([row, (*row[:3], "pending")], "real_dev", ["nda"], 1),
        ([row], "real_dev", ["nda", "other"], 1),
        ([row], "real_dev", ["nda"], 2),
    ):
        with pytest.raises(tr.GuardError):
            tr.guard_evaluation(frame_(*rows), split, labels, least)
    tr.guard_evaluation(frame_(("real_test", *row[1:])), "real_test", ["nda"], allow_test=True)
    with pytest.raises(ValueError):
        mx.same_length(frame_(row), frame_(row, row))


def test_manifest_is_verified(spark, tmp_path):
    at = f"file://{tmp_path}/data"
    with pytest.raises(tr.GuardError):
        tr.verify_manifest(spark, at)
    spark.range(5).coalesce(1).write.json(f"{at}/split=train")
    tr.write_manifest(spark, at, "identity")
    assert tr.verify_manifest(spark, at)["dataset_hash"] == "identity"
    spark.range(6).coalesce(1).write.mode("append").json(f"{at}/split=train")
    with pytest.raises(tr.GuardError):
        tr.verify_manifest(spark, at)


def test_clause_models(spark, tmp_path):
    rows = [(f"the parties insure {i} goods", ["Insurance"]) for i in range(20)] + [(f"law of the state {i} governs", ["Governing Law"]) for i in range(20)] + [(f"plain words {i}", [UNKNOWN]) for i in range(20)]
    df = spark.createDataFrame([*rows, (None, [UNKNOWN])], "text string, labels array<string>")
    model = tr.train_clause_types(df, ("Governing Law", "Insurance", "Parties"))
    tr.save_clause_model(spark, model, f"file://{tmp_path}/c", 0.4, {"Insurance": 0.6})
    again, threshold, named = tr.load_clause_model(spark, f"file://{tmp_path}/c")
    assert (threshold, named) == (0.4, {"Insurance": 0.6})
    for r in again.score(df).collect():
        hit = [label for label, p in zip(model.labels, r.scores, strict=True) if p >= 0.5]
        assert hit == [x for x in r.labels if x != UNKNOWN] and r.scores[2] == 0
    places = df.select(tr.clause_features(F.col("text")).alias("f")).first().f
    logit = model.biases[1] + sum(model.weights[1, i] for i in places)
    assert abs(again.score(df).first().scores[1] - 1 / (1 + math.exp(-logit))) < 1e-9
    assert again.version(0.4, named) == f"clause-clf@clause-model|thr=per-label|features={tr.CLAUSE_FEATURES}"
    for labels in (("Parties", "Parties"), (UNKNOWN,), ("Poetry",)):
        with pytest.raises(tr.GuardError):
            tr.ClauseModel(labels, np.zeros((len(labels), 4)), np.zeros(len(labels)))
    with pytest.raises(tr.GuardError):
        again.version(1.5, {})


def test_prompts(spark):
    rows = pr.prompt_axes(spark).withColumn("prompt", pr.rendered()).collect()
    assert len(rows) == (3 + 7) * 5 * 3 * 3 * 3
    one = next(r for r in rows if r.label == "nda" and r.fmt == "plain")
    assert one.prompt.split("\n")[:7] == [
        "You are generating ONE synthetic confidentiality / non-disclosure agreement between two parties for a document-type classifier's TRAINING set.",
        f"Jurisdiction: {one.place}. Length: {one.length}. Register: {one.register}.",
        "Output format: plain text only, no Markdown formatting or heading markers.",
        "",
        "Include, where natural: definition of Confidential Information; permitted use; exclusions; term and survival; return/destruction; remedies; governing law.",
        "- mutual or one-way variants",
        "- a defined-terms section",
    ]
    other = next(r for r in rows if r.label == "other")
    assert other.prompt.split("\n")[4:7] == ["", "", "Realism rules:"] and other.prompt.endswith("Return ONLY the document text.")
    told = {r.prompt_id for r in queries.QUERIES["prompt_ids"](spark, SF).collect()}
    assert f"doctype-prompts-v1:nda:{hashlib.sha256(one.prompt.encode()).hexdigest()[:16]}" in told and len(told) == len(rows)


def test_questions_and_answers(spark):
    context = "First one. The parties shall insure it. Last\nnext line"
    qa = spark.createDataFrame(
        [("t", context, 'Find parts related to "Insurance" here', (["insure", "Last"], [context.index("insure"), context.index("Last")])), ("t", context, 'related to "Parties"', (["parties"], [context.index("parties")])),
         ("t", context, 'related to "Poetry"', (["one"], [6])), ("t", context, "what?", (["one"], [6])), ("u", context, 'related to "Parties"', ([], []))],
        "title string, context string, question string, answers struct<text: array<string>, answer_start: array<int>>",
    )
    got = {(r.doc_id, r.text, tuple(r.labels)) for r in ds.question_examples(qa).collect()}
    assert got == {("t", "The parties shall insure it.", ("Insurance", "Parties")), ("t", "Last", ("Insurance",))}
    assert {"Insurance", "Parties"} <= set(CLAUSE_TYPES)


@pytest.mark.parametrize("name", ["doctype_baseline", "clause_model_f1"])
def test_trained_queries(spark, name):
    row = queries.QUERIES[name](spark, SF).first()
    assert row.macro_f1 > (0.7 if name == "doctype_baseline" else 0)
