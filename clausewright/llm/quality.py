"""Quality classifier: ridge regression on random Fourier features of document
statistics, calibrated by isotonic regression.

Statistics of a text (lengths, shares of character classes, repetition of words and
lines) are standardised and mapped to cosines of random projections, whose inner
products approximate a Gaussian kernel. Partitions sum their normal equations; the
driver adds them up and solves for the weights. Scores of a part of the sample that
the weights did not see are calibrated to the share of label 1 by pooling adjacent
violators, with straight lines between the pools.

The model is fitted on a bounded sample of labelled texts (SAMPLE_ROWS, least hashes
of id and text first); every row is scored. Labels, ids and any other columns are no
input of a score.

Defined cases: a null text counts as empty; an empty text has all statistics 0 and a
score like any other; texts are read whole; without labelled rows every score is 0.5;
null labels do not count; an id with several labels counts once with each; a document
or label that is repeated in full counts once; equal texts have equal scores; an empty
table gives no rows; other columns pass through, whatever their names but score and
predicted, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.durable import durable
from clausewright.llm.memory import giving_back

SAMPLE_ROWS = 24_000
FEATURES = 384
#: Kernel width over standardised statistics.
WIDTH = 4.0
RIDGE = 1e-3
SEED = 7
PARTS = 16
THRESHOLD = 0.3

_WORD_END = re.compile(r"[.!?]\s")


def statistics(text: str | None) -> list[float]:
    """Statistics of one text; every one is bounded or a logarithm."""
    if not text:
        return [0.0] * STATISTICS
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = text.split("\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    shares = counts / n
    upper, lower, digits = shares[65:91].sum(), shares[97:123].sum(), shares[48:58].sum()
    marks = shares[33:48].sum() + shares[58:65].sum() + shares[91:97].sum() + shares[123:127].sum()
    used = shares[shares > 0]
    return [
        math.log1p(n),
        math.log1p(n_words),
        math.log1p(n_lines),
        upper,
        lower,
        digits,
        marks,
        shares[32],
        shares[10],
        shares[128:].sum(),
        shares[124],
        shares[33],
        shares[63],
        shares[46],
        shares[44],
        shares[60] + shares[62],
        shares[123] + shares[125] + shares[91] + shares[93],
        shares[35] + shares[36] + shares[37] + shares[38] + shares[42],
        shares[47] + shares[58] + shares[64],
        -float((used * np.log(used)).sum()),
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        math.log1p(float(lengths.max())),
        kinds / n_words,
        kinds / n_words**0.75,
        pairs / n_words,
        len(set(lines)) / n_lines,
        math.log1p(n / n_lines),
        sum(w[-1:].isalnum() for w in words) / n_words,
        sum(w.isalpha() for w in words) / n_words,
        sum(w.isupper() for w in words) / n_words,
        sum(w[:1].isupper() for w in words) / n_words,
        len(_WORD_END.findall(text)) / n_words,
    ]


STATISTICS = 33


@dataclass
class Model:
    """What a score needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), math.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Sums run over the statistics one by one, not by a matrix product, whose order
        varies: a row's score does not depend on the rows beside it."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        angles = np.tile(self.phases, (len(z), 1))
        for j in range(z.shape[1]):
            angles += z[:, j : j + 1] * self.directions[j]
        raw = self.weights[0] + (np.cos(angles) * (math.sqrt(2 / len(self.phases)) * self.weights[1:])).sum(axis=1)
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit: pools' mean scores and, with one
    added label of each kind shared by all pools, their shares of label 1."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, y in zip(scores[order], labels[order], strict=True):
        pools.append([float(y), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, count, place = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + count, pools[-1][2] + place]
    knots = np.array([place / count for _, count, place in pools])
    levels = np.array([(total + 0.5) / (count + 1) for total, count, _ in pools])
    return knots, np.maximum.accumulate(levels)


def sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """text, label and a fold of 0 (weights) or 1 (calibration) of at most rows
    different labelled texts, those with the least hashes of id and text."""
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("quality sample"))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).filter("_label is not null").distinct()
    keyed = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), order.alias("_order")).join(known, "_id")
    last = keyed.select("_order").distinct().orderBy("_order").limit(rows).agg(F.max("_order")).first()[0]
    chosen = keyed.filter(F.col("_order") <= F.lit(last)).dropDuplicates(["_order", "_label"])
    fold = (F.pmod(F.shiftright("_order", 7), F.lit(4)) == 0).cast("int")
    return chosen.select("_text", "_label", fold.alias("_fold"))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most rows labelled texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["stats", "label", "fold"])

    measured = durable(sample(df, labels, id_col, text_col, label_col, rows).mapInArrow(giving_back(measure), "stats array<double>, label double, fold int"), "quality-sample", texts=True).coalesce(PARTS)
    moments = measured.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).orderBy("pos").collect()
    if not moments:
        return None
    rng = np.random.default_rng(SEED)
    scale = np.array([r[2] for r in moments])
    model = Model(
        np.array([r[1] for r in moments]),
        np.where(scale > 1e-9, scale, 1.0),
        rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)),
        rng.uniform(0, 2 * math.pi, FEATURES),
        np.zeros(FEATURES + 1),
    )

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            for stats, y in _blocks(batch, 0):
                z = model.features(stats)
                gram += z.T @ z
                moment += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([moment.tobytes()])], names=["gram", "moment"])

    gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for part in measured.mapInArrow(giving_back(equations), "gram binary, moment binary").toLocalIterator():
        gram += np.frombuffer(part[0]).reshape(gram.shape)
        moment += np.frombuffer(part[1])
    seen = max(1.0, gram[0, 0])
    model.weights = np.linalg.solve(gram + RIDGE * seen * np.eye(len(gram)) / FEATURES + 1e-9 * np.eye(len(gram)), moment)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stats, y in _blocks(batch, 1):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(stats)), pa.array(y)], names=["raw", "label"])

    held = measured.mapInArrow(judged, "raw double, label double").collect()  # at most rows of the sample
    if held:
        model.knots, model.levels = isotonic(np.array([r[0] for r in held]), np.array([r[1] for r in held]))
    return model


def _blocks(batch: pa.RecordBatch, fold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    chosen = batch.filter(pa.compute.equal(batch.column(2), fold))
    if chosen.num_rows:
        yield np.array(chosen.column(0).to_pylist()), np.array(chosen.column(1).to_pylist(), dtype=float)


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted; columns so named are replaced."""
    from pyspark.sql.functions import arrow_udf

    if model is None:
        scored = df.withColumn("score", F.lit(0.5))
    else:

        @arrow_udf("double")
        def rate(texts: pa.Array) -> pa.Array:
            parts = []
            for start in range(0, len(texts), 200):
                stats = np.array([statistics(t) for t in texts.slice(start, 200).to_pylist()])
                parts.append(model.score(stats))
            return pa.array(np.concatenate(parts) if parts else [], pa.float64())

        scored = df.withColumn("score", rate(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is 0 mod 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
