"""Clause classification: decisions over scores, thresholds and simple baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.vocabulary import CLAUSE_TYPES, KEYWORDS, UNKNOWN

#: Global thresholds tried, and those tried per label.
GRID = tuple(round(0.05 * i, 2) for i in range(1, 11))
LABEL_GRID = tuple(round(0.05 * i, 2) for i in range(1, 19))
MIN_SUPPORT = 20


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def thresholds(labels: DataFrame, default: float, named: dict[str, float]) -> DataFrame:
    """label, idx, threshold: the label's own threshold if it is a finite number from
    0 to 1, else the default."""
    sound = {k: v for k, v in named.items() if isinstance(v, (int, float)) and 0 <= v <= 1}
    own = F.element_at(F.create_map(*[F.lit(x) for p in sound.items() for x in p]), F.col("label")) if sound else F.lit(None).cast("double")
    return labels.withColumn("threshold", F.coalesce(own, F.lit(default)))


def decide(scores: Column, limits: list[float], labels: tuple[str, ...] = CLAUSE_TYPES) -> Column:
    """struct(primary, confidence, predictions) from an array of label scores: labels
    at or above their limits, best first and then in label order; "unknown" without
    a confidence if there is none."""
    names, bound = F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(float(x)) for x in limits])
    each = F.transform(scores, lambda p, i: F.struct((-p).alias("down"), i.alias("idx"), F.get(names, i).alias("label"), F.bround(p, 4).alias("score"), (p >= F.get(bound, i)).alias("kept")))
    kept = F.transform(F.array_sort(F.filter(each, lambda x: x["kept"])), lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))
    return F.struct(
        F.coalesce(F.get(kept, F.lit(0))["label"], F.lit(UNKNOWN)).alias("primary"), F.get(kept, F.lit(0))["score"].alias("confidence"), kept.alias("predictions")
    )


def keyword_types(text: Column) -> Column:
    """Sorted clause types whose keywords the text holds, else just "unknown"."""
    low = F.lower(text)
    hits = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(t)) for k, t in KEYWORDS]), lambda t: t.isNotNull())))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(UNKNOWN)))


def label_vector(labels: Column, names: tuple[str, ...] = CLAUSE_TYPES) -> Column:
    """0/1 per label; "unknown" has no place."""
    return F.transform(F.array(*[F.lit(x) for x in names]), lambda n: F.array_contains(labels, n).cast("int"))


def _counts_by_threshold(scored: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """label, t, tp, fp, fn for scores (label, p, gold) above each threshold."""
    hit = F.col("p") > F.col("t")
    tried = scored.withColumn("t", F.explode(F.array(*[F.lit(t) for t in grid])))
    return tried.groupBy("label", "t").agg(
        F.count_if(hit & (F.col("gold") == 1)).alias("tp"), F.count_if(hit & (F.col("gold") == 0)).alias("fp"), F.count_if(~hit & (F.col("gold") == 1)).alias("fn")
    )


def _f1() -> Column:
    return F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def threshold_sweep(scored: DataFrame, labels: int, grid: tuple[float, ...] = GRID) -> DataFrame:
    """t, macro_f1 over a fixed number of labels, best (ties: the higher t)."""
    f = _counts_by_threshold(scored, grid).groupBy("t").agg((F.sum(_f1()) / labels).alias("macro_f1"))
    top = F.max(F.struct(F.round("macro_f1", 9), "t")).over(Window.partitionBy(F.lit(1)))
    return f.withColumn("best", F.col("t") == top["t"])


def label_thresholds(scored: DataFrame, default: float, min_support: int = MIN_SUPPORT, grid: tuple[float, ...] = LABEL_GRID) -> DataFrame:
    """label, support, threshold: the one with the best F1 (ties: the higher), the
    default for labels with little support."""
    f = _counts_by_threshold(scored, grid).withColumn("f1", _f1())
    best = f.groupBy("label").agg((F.max(F.col("tp") + F.col("fn"))).alias("support"), F.max(F.struct(F.round("f1", 9), "t")).alias("b"))
    return best.select("label", "support", F.when(F.col("support") < min_support, F.lit(default)).otherwise(F.col("b.t")).alias("threshold"))


def average_precision(scored: DataFrame) -> DataFrame:
    """label, ap: the sum over distinct scores, best first, of the gain in recall times
    precision; labels without gold rows are left out."""
    groups = scored.groupBy("label", "p").agg(F.sum("gold").alias("pos"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("p"))
    total = F.sum("pos").over(Window.partitionBy("label"))
    steps = groups.withColumns({"tp": F.sum("pos").over(order), "seen": F.sum("n").over(order), "total": total})
    return steps.filter("total > 0").groupBy("label").agg(F.sum(F.col("pos") / F.col("total") * F.col("tp") / F.col("seen")).alias("ap"))


def threshold_report(scored: DataFrame, default: float, labels: int, min_support: int = MIN_SUPPORT) -> DataFrame:
    """One row: macro F1 over a fixed number of labels at one threshold (before) and at
    each label's own (after), how many labels have one, and the macro average precision,
    which needs no threshold."""
    counts = _counts_by_threshold(scored, LABEL_GRID).withColumn("f1", _f1())
    own = label_thresholds(scored, default, min_support).select("label", F.col("threshold").alias("own"))
    each = counts.join(F.broadcast(own), "label")  # one row a label
    told = each.agg(
        (F.sum(F.when(F.col("t") == default, F.col("f1"))) / labels).alias("before"),
        (F.sum(F.when(F.col("t") == F.col("own"), F.col("f1"))) / labels).alias("after"),
        F.count_if((F.col("t") == F.col("own")) & (F.col("own") != default)).alias("tuned"),
    )
    return told.crossJoin(average_precision(scored).agg(F.avg("ap").alias("macro_ap")))  # one row each
