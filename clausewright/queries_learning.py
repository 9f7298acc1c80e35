"""Queries over classification, datasets, preflight checks and metrics, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators import classification as cl
from clausewright.operators import datasets as ds
from clausewright.operators import metrics as mx
from clausewright.operators import prompts as pr
from clausewright.operators import training as tr
from clausewright.queries_segmentation import _blocks
from clausewright.session import table
from clausewright.vocabulary import CLAUSE_TYPES, CRITICAL_TYPES, KEYWORDS, METADATA_TYPES, MODEL_LABELS, PROVISION_LABELS, UNKNOWN, clause_types, frame

PROVISIONS = [t for t in CLAUSE_TYPES if t not in METADATA_TYPES]
TEN = list(CLAUSE_TYPES[:10])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, gold and pred label arrays and ten scores from the embeddings: gold is
    the row's label and for every third row also the next one."""
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: cl.sigmoid(8 * x.cast("double")))
    names = F.array(*[F.lit(x) for x in TEN])
    also = F.when(F.col("vec_id") % 3 == 0, F.array(F.get(names, F.col("label")), F.get(names, (F.col("label") + 1) % 10))).otherwise(F.array(F.get(names, F.col("label"))))
    return table(spark, sf, "embeddings").select("vec_id", "label", also.alias("gold"), scores.alias("scores"))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    told = _scored(spark, sf).withColumn("d", cl.decide(F.col("scores"), [0.6] * 10, tuple(TEN)))
    pred = F.when(F.size("d.predictions") > 0, F.transform("d.predictions", lambda x: x["label"])).otherwise(F.array(F.lit(UNKNOWN)))
    return told.withColumn("pred", pred)


def _long(spark: SparkSession, sf: str) -> DataFrame:
    """label, p, gold: one row per row and label."""
    each = F.transform("scores", lambda p, i: F.struct(F.get(F.array(*[F.lit(x) for x in TEN]), i).alias("label"), p.alias("p")))
    rows = _scored(spark, sf).select("gold", F.inline(each))
    return rows.select("label", "p", F.array_contains("gold", F.col("label")).cast("int").alias("gold"))


def multilabel_decide(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("d")
    return _decided(spark, sf).select("vec_id", d["primary"].alias("primary_type"), d["confidence"].alias("confidence"), F.array_join("pred", ",").alias("predictions"))


def keyword_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(cl.keyword_types(F.col("text")), ",").alias("types"))


def all_other_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lit(UNKNOWN).alias("types"))


def clause_category(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of the types that keywords find."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(cl.keyword_types(F.col("text"))).alias("clause_type"))
    return found.join(F.broadcast(clause_types(spark)), "clause_type", "left").groupBy("category").agg(F.count(F.lit(1)).alias("clauses"))


def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("vec_id", F.array_join(cl.label_vector(F.col("gold")).cast("array<string>"), "").alias("vector"))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return cl.threshold_sweep(_long(spark, sf), len(CLAUSE_TYPES))


def per_label_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return cl.label_thresholds(_long(spark, sf), 0.5)


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return cl.average_precision(_long(spark, sf))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return mx.label_counts(_decided(spark, sf))


def label_prf(spark: SparkSession, sf: str) -> DataFrame:
    return mx.with_prf(_counts(spark, sf)).filter("support > 0")


def micro_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return mx.micro_macro(_counts(spark, sf), len(CLAUSE_TYPES))


def _single(spark: SparkSession, sf: str) -> DataFrame:
    best = F.get(mx.top_k(F.col("scores"), 1), F.lit(0))
    names = F.array(*[F.lit(x) for x in TEN])
    return _scored(spark, sf).select(F.col("vec_id").alias("id"), F.get(names, F.col("label")).alias("gold"), F.get(names, best).alias("pred"))


def weighted_f1(spark: SparkSession, sf: str) -> DataFrame:
    return mx.macro_weighted(mx.single_label(_single(spark, sf), TEN))


def per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    return mx.single_label(_single(spark, sf), TEN)


def majority_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Macro F1 of always naming the label most frequent in nine tenths of the rows,
    over the rest."""
    rows = _single(spark, sf)
    top = mx.majority_label(rows.filter("id % 10 <> 0"), "gold").withColumnRenamed("label", "pred")
    held = rows.filter("id % 10 = 0").drop("pred").crossJoin(F.broadcast(top))
    return mx.macro_weighted(mx.single_label(held, TEN)).select("macro_f1")


def topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.array_contains(mx.top_k(F.col("scores"), 3), F.col("label")).cast("double")
    return _scored(spark, sf).agg(F.avg(hit).alias("top3"))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return mx.bootstrap(_single(spark, sf), TEN, 1000)


def doc_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions that keywords find in whole texts (gold) and in their first halves."""
    docs = table(spark, sf, "documents")
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return mx.presence(docs.select(cl.keyword_types(F.col("text")).alias("gold"), cl.keyword_types(half).alias("pred")), PROVISIONS, list(CRITICAL_TYPES))


def sentence_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence around the first "the" or "de" of each text."""
    at = F.greatest(F.instr("text", " the "), F.instr("text", " de "))
    docs = table(spark, sf, "documents").withColumn("at", at).filter("at > 0")
    return docs.select("doc_id", ds.sentence_at(F.col("text"), F.col("at"), F.col("at") + 3).alias("sentence"))


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "text", cl.keyword_types(F.col("text")).alias("labels"), ds.hash_split(F.col("doc_id").cast("string")).alias("split"), "source")


def multilabel_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = _examples(spark, sf).select("source", "split", F.explode("labels").alias("label"))
    return ds.group_labels(rows, ["source", "split"], "label").select("source", "split", F.array_join("labels", ",").alias("labels"))


def capped_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = _examples(spark, sf)
    return ds.cap_negatives(rows, F.array_contains("labels", UNKNOWN), "doc_id", 15_000).select("doc_id")


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return _examples(spark, sf).select("doc_id", "split")


def dedup_across_splits(spark: SparkSession, sf: str) -> DataFrame:
    marked = _examples(spark, sf).withColumn("labels", F.array(F.concat_ws("-", "source", "split")))
    found = ds.dedup_across_splits(marked, "doc_id")
    return found.select("doc_id", "split", F.array_join("labels", ",").alias("labels"))


def label_frequency(spark: SparkSession, sf: str) -> DataFrame:
    rows = _examples(spark, sf).select(F.explode("labels").alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(12)


def split_report(spark: SparkSession, sf: str) -> DataFrame:
    multi = F.count_if(F.size("labels") > 1).alias("multi_label")
    return _examples(spark, sf).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), multi)


def provision_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Market segments stand for another corpus' labels by position; most map to none."""
    known = frame(spark, PROVISION_LABELS, "other string, clause_type string")
    segment = F.element_at(F.array(*[F.lit(a) for a, _ in PROVISION_LABELS], F.lit("Notices")), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", segment.alias("other"))
    return rows.join(F.broadcast(known), "other", "left").select("c_custkey", F.coalesce("clause_type", F.lit(UNKNOWN)).alias("clause_type"))


def answer_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Answers (text, start) of a question over each text: all its capitalised words,
    each with the first place where it reads."""
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    answers = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("answer"), (F.instr("text", w) - 1).alias("answer_start")))
    return table(spark, sf, "documents").select("doc_id", F.inline(answers))


def title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    words = frame(spark, [(w,) for w in ("th", "on", "er", "ing", "ción", "ment", "ung", "xyz")], "keyword string")
    titles = table(spark, sf, "documents").select(F.lower(F.substring_index("text", "\n", 1)).alias("title")).distinct()
    return titles.crossJoin(F.broadcast(words)).filter(F.contains("title", F.col("keyword"))).groupBy("keyword").agg(F.count(F.lit(1)).alias("titles"))


def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = ~F.array_contains("labels", UNKNOWN)
    return _examples(spark, sf).agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"), F.avg(found.cast("double")).alias("labelled_share")
    )


def _contract_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled examples with faults by id."""
    i = F.col("doc_id")
    real = i % 3 == 0
    docs = table(spark, sf, "documents")
    made = lambda rule, value: F.when(rule, value)
    rows = docs.select(
        i.cast("string").alias("id"),
        F.when(real, "real").otherwise("synthetic").alias("origin"),
        F.when(i % 50 == 1, " \n").otherwise(F.col("text")).alias("text"),
        F.when(i % 41 == 0, "poem").otherwise(F.element_at(F.array(*[F.lit(x) for x in MODEL_LABELS]), (i % 24 + 1).cast("int"))).alias("type"),
        F.when(real, F.when(i % 30 == 0, "train").otherwise("real_dev")).otherwise(F.when(i % 31 == 1, "real_test").otherwise("train")).alias("split"),
        made(~real & (i % 7 != 1), F.lit("m")).alias("generator_model"),
        made(~real, F.lit("1")).alias("generator_version"),
        made(~real, F.lit("p")).alias("prompt_id"),
        made(~real, F.lit("ok")).alias("critic_result"),
        made(~real, F.lit("free")).alias("output_license"),
        made(~real & (i % 13 != 0), F.lit(1)).alias("seed"),
        made(real & (i % 9 != 0), F.col("source")).alias("source"),
        *[made(real, F.lit("x")).alias(c) for c in ("license", "license_url", "source_ref", "raw_label", "reviewer", "guide_version")],
        made(real, F.md5("source")).alias("source_document_sha256"),
        made(real, F.when(i % 12 == 0, "pending").otherwise("verified")).alias("review_status"),
        made(real, F.lit("human_verified")).alias("label_method"),
        F.when(i % 17 == 0, "bad").when(i % 2 == 0, F.sha2("text", 256)).alias("text_sha256"),
        F.col("lang").alias("org_id"),
        F.when(i % 4 == 0, F.concat_ws("-", "lang", "source")).alias("document_family_id"),
        F.lit(None).cast("string").alias("template_cluster_id"),
    )
    return rows


def row_contract_issues(spark: SparkSession, sf: str) -> DataFrame:
    return ds.row_contract(_contract_rows(spark, sf))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ds.duplicates(table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")), "id")


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return ds.duplicates(table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_sha256")), "text_sha256")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return ds.near_duplicates(table(spark, sf, "documents"), "doc_id", "text")


def group_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return ds.group_leakage(_contract_rows(spark, sf))


def class_support(spark: SparkSession, sf: str) -> DataFrame:
    labels = frame(spark, [(x,) for x in MODEL_LABELS], "label string")
    return ds.class_support(_contract_rows(spark, sf).filter("split = 'train'"), labels, 30)


def dataset_identity(spark: SparkSession, sf: str) -> DataFrame:
    return ds.dataset_identity(table(spark, sf, "documents"), ["doc_id", "text", "lang", "source"])


def document_opening(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(ds.document_opening(F.col("text"))).alias("opening_md5"))


def text_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def split_file_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose split is not that of the file they stand in; files by id."""
    rows = _examples(spark, sf).withColumn("file", F.when(F.col("doc_id") % 19 == 0, "val").otherwise(F.col("split")))
    return rows.filter("file <> split").select("doc_id", "file", "split")


def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The three heaviest terms of one or two words of each document."""
    from pyspark.sql import Window

    weights = ds.tfidf(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ds.term_counts("text"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "term"))
    return weights.withColumn("nth", nth).filter("nth <= 3").select("id", "nth", "term", F.round("weight", 6).alias("weight"))


def prompt_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The identity of every generation prompt, a hash of its whole text."""
    rows = pr.prompt_axes(spark)
    return rows.select("label", "family", "place", "length", "register", "fmt", pr.prompt_id(F.col("label"), pr.rendered()).alias("prompt_id"))


NAMES = [*[a for a, _ in PROVISION_LABELS], "Notices"]


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document as a contract that is asked a question, answered by its
    first "the" or "de"."""
    docs = table(spark, sf, "documents").withColumn("at", F.greatest(F.instr("text", " the "), F.instr("text", " de ")))
    kind = F.when(F.col("doc_id") % 14 == 0, "Poetry").otherwise(F.get(F.array(*[F.lit(x) for x in TEN]), (F.col("doc_id") % 10).cast("int")))
    question = F.concat(F.lit('Highlight the parts of this contract related to "'), kind, F.lit('" that a lawyer should review'))
    some = F.col("at") > 0
    answers = F.struct(F.when(some, F.array(F.substring(F.col("text"), F.col("at") + 1, F.lit(3)))).otherwise(F.array().cast("array<string>")).alias("text"), F.when(some, F.array("at")).otherwise(F.array().cast("array<int>")).alias("answer_start"))
    title = F.concat(F.lit("contract-"), (F.col("doc_id") % 50).cast("string"))
    return docs.filter("doc_id % 2 = 0").select(title.alias("title"), F.col("text").alias("context"), question.alias("question"), answers.alias("answers"))


def clause_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as two corpora: every second one answers a question, the others give
    their first line a label."""
    docs = table(spark, sf, "documents")
    rows = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("idx"), F.substring_index("text", "\n", 1).alias("text"), (F.col("doc_id") % len(NAMES)).cast("int").alias("label"))
    found = ds.clause_dataset(_asked(spark, sf), rows, NAMES)
    return found.select("doc_id", "source", "split", F.md5("text").alias("text_md5"), F.array_join("labels", ",").alias("labels"))


def question_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ds.question_profile(_asked(spark, sf))


def answer_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ds.answer_samples(_asked(spark, sf))


def _typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a type by their language, which their words tell."""
    kinds = F.create_map(*[F.lit(x) for pair in (("en", "nda"), ("fr", "commercial_agreement"), ("de", "constitutional")) for x in pair])
    kind = F.coalesce(F.element_at(kinds, F.col("lang")), F.lit("other"))
    split = F.when(ds.hash_split(F.col("doc_id").cast("string")) == "train", "train").otherwise("real_dev")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", kind.alias("type"), split.alias("split"), F.lit("real").alias("origin"), F.lit("verified").alias("review_status"))


EVAL_LABELS = ["nda", "commercial_agreement", "constitutional", "other"]


def _doctype_model(spark: SparkSession, sf: str) -> tuple[tr.DocumentTypeModel, DataFrame, DataFrame]:
    rows = _typed_rows(spark, sf)
    train, held = rows.filter("split = 'train'"), rows.filter("split = 'real_dev'")
    tr.guard_evaluation(held, "real_dev", EVAL_LABELS)
    return tr.train_document_types(train), train, held


def doctype_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out scores of the document-type baseline."""
    model, train, held = _doctype_model(spark, sf)
    return tr.evaluate_document_types(model, train, held, EVAL_LABELS)


def doctype_top_features(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that speak most for each type."""
    top = _doctype_model(spark, sf)[0].top_features()
    return frame(spark, [(c, i, t) for c, terms in top.items() for i, t in enumerate(terms, 1)], "type string, nth int, term string")


def clause_model_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Clause models learnt from the contract corpus' keyword labels in the train split,
    held against those of the other splits."""
    blocks = _blocks(spark, sf)
    rows = blocks.select("text", cl.keyword_types(F.col("text")).alias("labels"), ds.hash_split(F.col("doc_id").cast("string")).alias("split"))
    model = tr.train_clause_types(rows.filter("split = 'train'"))
    scored = model.score(rows.filter("split <> 'train'")).withColumn("d", cl.decide(F.col("scores"), [0.5] * len(CLAUSE_TYPES)))
    pred = F.when(F.size("d.predictions") > 0, F.transform("d.predictions", lambda x: x["label"])).otherwise(F.array(F.lit(UNKNOWN)))
    return mx.micro_macro(mx.label_counts(scored.select(F.col("labels").alias("gold"), pred.alias("pred"))), len(CLAUSE_TYPES))


def threshold_report(spark: SparkSession, sf: str) -> DataFrame:
    """Macro F1 at one threshold and at each label's own, and the mean average precision."""
    return cl.threshold_report(_long(spark, sf), 0.5, len(CLAUSE_TYPES))


QUERIES = {
    f.__name__: f
    for f in (
        multilabel_decide, keyword_baseline, all_other_baseline, clause_category, label_vectors, threshold_sweep, per_label_thresholds, average_precision,
        label_prf, micro_macro_f1, weighted_f1, per_class_f1, majority_floor, topk_accuracy, bootstrap_ci, doc_presence, sentence_expand, multilabel_group,
        capped_negatives, hash_split, dedup_across_splits, label_frequency, split_report, provision_labels, answer_explode, title_keywords, dataset_profile,
        row_contract_issues, duplicate_ids, exact_duplicates, near_duplicates, group_leakage, class_support, dataset_identity, document_opening, text_hash,
        split_file_mismatch, tfidf_top_terms, prompt_ids, clause_dataset, question_profile, answer_samples, doctype_baseline, doctype_top_features, clause_model_f1, threshold_report,
    )
}

# --- the same in SQL ---------------------------------------------------------------


def _list(xs) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _joined(lines) -> str:  # noqa: ANN001
    return " || chr(10) || ".join(_sql(x) for x in lines)


_CLASS_ROWS = "[" + ", ".join(
    f"{{'l': {_sql(n)}, 'f': NULL, 'h': {_sql(pr.OPENING[0] + s + pr.OPENING[1])}, 't': {_joined([pr.INCLUDE[0] + p + pr.INCLUDE[1], *['- ' + x for x in rs]])}}}" for n, s, p, rs in pr.CLASSES
) + ", " + ", ".join(f"{{'l': 'other', 'f': {_sql(f)}, 'h': {_joined([pr.OTHER_OPENING[0] + f + pr.OTHER_OPENING[1], pr.OTHER_RULE])}, 't': NULL}}" for f in pr.OTHER_FAMILIES) + "]"
_FORMAT_ROWS = "[" + ", ".join(f"{{'n': {_sql(n)}, 'i': {_sql(i)}}}" for n, _, i in pr.FORMATS) + "]"
_TEN = _list(TEN)
_KEYS = "[" + ", ".join(f"CASE WHEN contains(lower({{0}}), '{k}') THEN '{t}' END" for k, t in KEYWORDS) + "]"


def _types(x: str) -> str:
    hits = f"list_sort(list_distinct(list_filter({_KEYS.replace('{0}', x)}, lambda t: t IS NOT NULL)))"
    return f"CASE WHEN len({hits}) > 0 THEN {hits} ELSE ['{UNKNOWN}'] END"


_SCORED = f"""scored AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN [({_TEN})[label + 1], ({_TEN})[(label + 1) % 10 + 1]] ELSE [({_TEN})[label + 1]] END AS gold,
    list_transform(embedding[1:10], lambda x: 1 / (1 + exp(-8 * CAST(x AS DOUBLE)))) AS scores FROM embeddings)"""
_LONG = f"{_SCORED}, long AS (SELECT ({_TEN})[i] AS label, scores[i] AS p, CAST(list_contains(gold, ({_TEN})[i]) AS INT) AS gold FROM scored, range(1, 11) r(i))"
_PRED = f"""{_SCORED}, cells AS (SELECT vec_id, i, scores[i] AS p FROM scored, range(1, 11) r(i)),
kept AS (SELECT vec_id, list(({_TEN})[i] ORDER BY p DESC, i) AS pred, max(p) AS top FROM cells WHERE p >= 0.6 GROUP BY vec_id),
decided AS (SELECT s.vec_id, s.gold, coalesce(k.pred, ['{UNKNOWN}']) AS pred, top FROM scored s LEFT JOIN kept k USING (vec_id))"""
_LABELS = f"""{_PRED}, names AS (SELECT unnest({_TEN}) AS label),
counts AS (SELECT label, count(*) FILTER (list_contains(gold, label) AND list_contains(pred, label)) AS tp, count(*) FILTER (NOT list_contains(gold, label) AND list_contains(pred, label)) AS fp,
    count(*) FILTER (list_contains(gold, label) AND NOT list_contains(pred, label)) AS fn, count(*) FILTER (list_contains(gold, label)) AS support
    FROM decided, names GROUP BY label HAVING tp + fp + fn > 0)"""
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
_P = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END"
_R = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END"
_SINGLE = f"{_SCORED}, single AS (SELECT vec_id AS id, ({_TEN})[label + 1] AS gold, ({_TEN})[(SELECT max(i) FROM range(1, 11) r(i) WHERE scores[i] = list_max(scores))] AS pred FROM scored)"


def _per(rows: str) -> str:
    return f"""SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn,
        count(*) FILTER (gold = label) AS support FROM {rows}, (SELECT unnest({_TEN}) AS label) GROUP BY label"""


def _tried(grid) -> str:  # noqa: ANN001
    return f"""{_LONG}, tried AS (SELECT label, t, count(*) FILTER (p > t AND gold = 1) AS tp, count(*) FILTER (p > t AND gold = 0) AS fp, count(*) FILTER (p <= t AND gold = 1) AS fn
        FROM long, (SELECT CAST(unnest({list(grid)}) AS DOUBLE) AS t) GROUP BY ALL)"""


_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_PART = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), {0}, 8)) AS BIGINT)"
_MOD = f"((({_PART.format(1)} + {_PART.format(9)} + {_PART.format(17)}) % 10) * 6 + {_PART.format(25)}) % 10"
_EXAMPLES = f"""examples AS (SELECT doc_id, text, source, {_types('text')} AS labels, CASE {_MOD} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents)"""
_CONTRACT = f"""rows AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 3 = 0 AS real, CASE WHEN doc_id % 50 = 1 THEN ' ' || chr(10) ELSE text END AS text,
    CASE WHEN doc_id % 41 = 0 THEN 'poem' ELSE ({_list(MODEL_LABELS)})[doc_id % 24 + 1] END AS type,
    CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 30 = 0 THEN 'train' ELSE 'real_dev' END WHEN doc_id % 31 = 1 THEN 'real_test' ELSE 'train' END AS split,
    doc_id AS i, lang, source, CASE WHEN doc_id % 17 = 0 THEN 'bad' WHEN doc_id % 2 = 0 THEN sha256(documents.text) END AS sha FROM documents)"""
_CROSS = " UNION ALL ".join(
    f"SELECT id, '{name}' AS issue FROM rows WHERE {rule}"
    for name, rule in (
        ("empty_text", f"{_COLLAPSE.replace('{0}', 'text')} = ''"),
        ("unknown_type", "type = 'poem'"),
        ("synthetic_outside_train", "NOT real AND split <> 'train'"),
        ("real_in_train", "real AND split = 'train'"),
        ("missing_generator_model", "NOT real AND i % 7 = 1"),
        ("missing_seed", "NOT real AND i % 13 = 0"),
        ("missing_source", "real AND i % 9 = 0"),
        ("not_verified", "real AND i % 12 = 0"),
        ("hash_mismatch", "sha IS NOT NULL AND sha <> sha256(text)"),
    )
)

ORACLES = {
    "multilabel_decide": f"WITH {_PRED} SELECT vec_id, pred[1] AS primary_type, round_even(top, 4) AS confidence, array_to_string(pred, ',') AS predictions FROM decided",
    "keyword_baseline": f"SELECT doc_id, array_to_string({_types('text')}, ',') AS types FROM documents",
    "all_other_baseline": f"SELECT doc_id, '{UNKNOWN}' AS types FROM documents",
    "clause_category": f"""WITH f AS (SELECT unnest({_types('text')}) AS t FROM documents)
        SELECT CASE WHEN t = '{UNKNOWN}' THEN NULL WHEN list_contains({_list(METADATA_TYPES)}, t) THEN 'metadata' ELSE 'provision' END AS category, count(*) AS clauses FROM f GROUP BY ALL""",
    "label_vectors": f"WITH {_SCORED} SELECT vec_id, array_to_string(list_transform({_list(CLAUSE_TYPES)}, lambda n: CAST(list_contains(gold, n) AS INT)), '') AS vector FROM scored",
    "threshold_sweep": f"""WITH {_tried(cl.GRID)}, f AS (SELECT t, sum({_F1}) / {len(CLAUSE_TYPES)} AS macro_f1 FROM tried GROUP BY t)
        SELECT t, macro_f1, t = (SELECT t FROM f ORDER BY round(macro_f1, 9) DESC, t DESC LIMIT 1) AS best FROM f""",
    "per_label_thresholds": f"""WITH {_tried(cl.LABEL_GRID)}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round({_F1}, 9) DESC, t DESC) AS k FROM tried)
        SELECT label, tp + fn AS support, CASE WHEN tp + fn < {cl.MIN_SUPPORT} THEN 0.5 ELSE t END AS threshold FROM r WHERE k = 1""",
    "average_precision": f"""WITH {_LONG}, g AS (SELECT label, p, sum(gold) AS pos, count(*) AS n FROM long GROUP BY ALL),
        s AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY label) AS total FROM g WINDOW w AS (PARTITION BY label ORDER BY p DESC))
        SELECT label, sum(pos / total * tp / seen) AS ap FROM s WHERE total > 0 GROUP BY label""",
    "label_prf": f"WITH {_LABELS} SELECT label, tp, fp, fn, support, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM counts WHERE support > 0",
    "micro_macro_f1": f"""WITH {_LABELS}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum({_F1}) / {len(CLAUSE_TYPES)} AS macro_f1 FROM counts)
        SELECT {_P} AS precision, {_R} AS recall, {_F1} AS f1, macro_f1 FROM s""",
    "weighted_f1": f"WITH {_SINGLE}, c AS ({_per('single')}) SELECT avg({_F1}) AS macro_f1, sum({_F1} * support) / sum(support) AS weighted_f1 FROM c",
    "per_class_f1": f"WITH {_SINGLE}, c AS ({_per('single')}) SELECT label, tp, fp, fn, support, {_F1} AS f1 FROM c",
    "majority_floor": f"""WITH {_SINGLE}, top AS (SELECT gold AS t FROM single WHERE id % 10 <> 0 GROUP BY gold ORDER BY count(*) DESC, gold LIMIT 1),
        held AS (SELECT gold, (SELECT t FROM top) AS pred FROM single WHERE id % 10 = 0), c AS ({_per('held')}) SELECT avg({_F1}) AS macro_f1 FROM c""",
    "topk_accuracy": f"""WITH {_SCORED}, r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY scores[i] DESC, i DESC) AS k FROM scored, range(1, 11) r(i))
        SELECT avg(CAST(hit AS DOUBLE)) AS top3 FROM (SELECT vec_id, max(CAST(i - 1 = label AND k <= 3 AS INT)) AS hit FROM r GROUP BY vec_id)""",
    "bootstrap_ci": f"""WITH {_SINGLE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY id) - 1 AS pos FROM single), sizes AS (SELECT gold, count(*) AS n FROM single GROUP BY gold),
        draws AS (SELECT gold, rd, CAST('0x' || substr(md5(rd || ':' || gold || ':' || i), 1, 7) AS BIGINT) % n AS pos FROM sizes, range(1, 1001) a(rd), LATERAL (SELECT unnest(range(0, n)) AS i)),
        drawn AS (SELECT rd, d.gold, pred FROM draws d JOIN ranked r ON r.gold = d.gold AND r.pos = d.pos),
        per AS (SELECT rd, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn
            FROM drawn, (SELECT unnest({_TEN}) AS label) GROUP BY ALL),
        m AS (SELECT rd, sum({_F1}) / 10 AS macro_f1 FROM per GROUP BY rd)
        SELECT quantile_cont(macro_f1, 0.025) AS low, quantile_cont(macro_f1, 0.975) AS high, count(*) AS rounds FROM m""",
    "doc_presence": f"""WITH t AS (SELECT list_filter({_types('text')}, lambda x: list_contains({_list(PROVISIONS)}, x)) AS g,
            list_filter({_types('substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT))')}, lambda x: list_contains({_list(PROVISIONS)}, x)) AS p FROM documents),
        s AS (SELECT sum(len(list_intersect(g, p))) AS tp, sum(len(list_filter(p, lambda x: NOT list_contains(g, x)))) AS fp, sum(len(list_filter(g, lambda x: NOT list_contains(p, x)))) AS fn,
            sum(len(list_intersect(list_intersect(g, {_list(CRITICAL_TYPES)}), p))) AS ch, sum(len(list_intersect(g, {_list(CRITICAL_TYPES)}))) AS ct FROM t)
        SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(ch AS BIGINT) AS critical_hit, CAST(ct AS BIGINT) AS critical_total, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM s""",
    "sentence_expand": f"""WITH d AS (SELECT doc_id, text, greatest(strpos(text, ' the '), strpos(text, ' de ')) AS at0 FROM documents),
        c AS (SELECT *, substr(text, 1, at0) AS head, substr(text, at0 + 4) AS tail FROM d WHERE at0 > 0),
        b AS (SELECT *, strpos(reverse(head), ' .') AS dot, strpos(reverse(head), chr(10)) AS nl, strpos(tail, '. ') AS td, strpos(tail, chr(10)) AS tn FROM c),
        e AS (SELECT *, greatest(CASE WHEN dot > 0 THEN length(head) - dot + 1 ELSE 0 END, CASE WHEN nl > 0 THEN length(head) - nl + 1 ELSE 0 END) AS l,
            coalesce(at0 + 3 + least(CASE WHEN td > 0 THEN td END, CASE WHEN tn > 0 THEN tn END), length(text)) AS r FROM b)
        SELECT doc_id, {_COLLAPSE.replace('{0}', 'substr(text, l + 1, r - l)')} AS sentence FROM e""",
    "multilabel_group": f"""WITH {_EXAMPLES}, f AS (SELECT source, split, unnest(labels) AS label FROM examples)
        SELECT source, split, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY ALL""",
    "capped_negatives": f"""WITH {_EXAMPLES}, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM examples WHERE list_contains(labels, '{UNKNOWN}'))
        SELECT doc_id FROM examples WHERE NOT list_contains(labels, '{UNKNOWN}') UNION ALL SELECT doc_id FROM n WHERE k <= 15000""",
    "hash_split": f"WITH {_EXAMPLES} SELECT doc_id, split FROM examples",
    "dedup_across_splits": f"""WITH {_EXAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, doc_id) AS k FROM examples),
        l AS (SELECT text, string_agg(DISTINCT source || '-' || split, ',' ORDER BY source || '-' || split) AS labels FROM examples GROUP BY text)
        SELECT doc_id, split, l.labels FROM r JOIN l ON r.text = l.text WHERE k = 1""",
    "label_frequency": f"WITH {_EXAMPLES}, f AS (SELECT unnest(labels) AS label FROM examples) SELECT label, count(*) AS n FROM f GROUP BY label ORDER BY n DESC, label LIMIT 12",
    "split_report": f"WITH {_EXAMPLES} SELECT split, source, count(*) AS n, count(*) FILTER (len(labels) > 1) AS multi_label FROM examples GROUP BY ALL",
    "provision_labels": "SELECT c_custkey, CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(PROVISION_LABELS)) + f" ELSE '{UNKNOWN}' END AS clause_type FROM customer",
    "answer_explode": """WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM documents),
        e AS (SELECT doc_id, text, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos, unnest(w) AS answer FROM a) SELECT doc_id, pos, answer, CAST(strpos(text, answer) - 1 AS INT) AS answer_start FROM e""",
    "title_keywords": """WITH t AS (SELECT DISTINCT lower(string_split(text, chr(10))[1]) AS title FROM documents), k AS (SELECT unnest(['th', 'on', 'er', 'ing', 'ción', 'ment', 'ung', 'xyz']) AS keyword)
        SELECT keyword, count(*) AS titles FROM t, k WHERE contains(title, keyword) GROUP BY keyword""",
    "dataset_profile": f"""WITH {_EXAMPLES} SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts,
        avg(CAST(NOT list_contains(labels, '{UNKNOWN}') AS DOUBLE)) AS labelled_share FROM examples""",
    "row_contract_issues": f"WITH {_CONTRACT} {_CROSS}",
    "duplicate_ids": "SELECT l_orderkey || ':' || l_linenumber AS id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "exact_duplicates": "SELECT sha256(text) AS text_sha256, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1",
    "near_duplicates": f"""WITH n AS (SELECT doc_id, text, {_COLLAPSE.replace('{0}', 'lower(text)')} AS s FROM documents),
        sh AS (SELECT doc_id, text, list_distinct(list_transform(range(1, greatest(length(s) - 4, 1) + 1), lambda i: hash(substr(s, i, 5)))) AS g FROM n),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.g) AS na, len(b.g) AS nb, len(list_intersect(a.g, b.g)) AS c FROM sh a JOIN sh b
            ON a.doc_id < b.doc_id AND a.text <> b.text AND 100 * least(len(a.g), len(b.g)) >= 90 * greatest(len(a.g), len(b.g)))
        SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)""",
    "group_leakage": f"""WITH {_CONTRACT}, k AS (SELECT split, 'org_id' AS key, lang AS value FROM rows UNION ALL SELECT split, 'document_family_id', CASE WHEN i % 4 = 0 THEN lang || '-' || source END FROM rows
        UNION ALL SELECT split, 'source_document_sha256', CASE WHEN real THEN md5(source) END FROM rows)
        SELECT key, value, count(DISTINCT split) AS splits FROM k WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1""",
    "class_support": f"""WITH {_CONTRACT}, l AS (SELECT unnest({_list(MODEL_LABELS)}) AS label), c AS (SELECT type AS label, count(*) AS n FROM rows WHERE split = 'train' GROUP BY ALL)
        SELECT label, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 30 THEN 'low' ELSE 'ok' END AS status FROM l LEFT JOIN c USING (label)""",
    "dataset_identity": """WITH h AS (SELECT sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'text': text}) AS VARCHAR)) AS h FROM documents),
        p AS (SELECT substr(h, 1, 3) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL) SELECT sha256(string_agg(h, chr(10) ORDER BY part)) AS identity FROM p""",
    "document_opening": f"SELECT doc_id, md5(array_to_string(string_split({_COLLAPSE.replace('{0}', 'text')}, ' ')[1:512], ' ')) AS opening_md5 FROM documents",
    "text_hash": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "split_file_mismatch": f"WITH {_EXAMPLES} SELECT doc_id, 'val' AS file, split FROM examples WHERE doc_id % 19 = 0 AND split <> 'val'",
    "tfidf_top_terms": """WITH l AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS words FROM documents),
        w AS (SELECT id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM l), t AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS docs FROM documents),
        r AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n),
        x AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS INT) AS nth FROM x) SELECT id, nth, term, round(weight, 6) AS weight FROM k WHERE nth <= 3""",
    "prompt_ids": f"""WITH k AS (SELECT unnest({_CLASS_ROWS}) AS k), p AS (SELECT unnest({_list(pr.PLACES)}) AS place), n AS (SELECT unnest({_list(pr.LENGTHS)}) AS length),
        r AS (SELECT unnest({_list(pr.REGISTERS)}) AS register), f AS (SELECT unnest({_FORMAT_ROWS}) AS f),
        t AS (SELECT k.l AS label, k.f AS family, place, length, register, f.n AS fmt, k.h || chr(10) || 'Jurisdiction: ' || place || '. Length: ' || length || '. Register: ' || register || '.' || chr(10)
            || 'Output format: ' || f.i || chr(10) || coalesce(chr(10) || k.t, '') || chr(10) || {_joined(pr.RULES)} AS prompt FROM k, p, n, r, f)
        SELECT label, family, place, length, register, fmt, '{pr.REGISTRY}:' || label || ':' || substr(sha256(prompt), 1, 16) AS prompt_id FROM t""",
    "clause_dataset": f"""WITH d AS (SELECT doc_id, text, greatest(strpos(text, ' the '), strpos(text, ' de ')) AS at0 FROM documents),
        c AS (SELECT *, substr(text, 1, at0) AS head, substr(text, at0 + 4) AS tail FROM d WHERE at0 > 0 AND doc_id % 2 = 0 AND doc_id % 14 <> 0),
        b AS (SELECT *, strpos(reverse(head), ' .') AS dot, strpos(reverse(head), chr(10)) AS nl, strpos(tail, '. ') AS td, strpos(tail, chr(10)) AS tn FROM c),
        e AS (SELECT *, greatest(CASE WHEN dot > 0 THEN length(head) - dot + 1 ELSE 0 END, CASE WHEN nl > 0 THEN length(head) - nl + 1 ELSE 0 END) AS l,
            coalesce(at0 + 3 + least(CASE WHEN td > 0 THEN td END, CASE WHEN tn > 0 THEN tn END), length(text)) AS r FROM b),
        s AS (SELECT 'contract-' || doc_id % 50 AS doc_id, {_COLLAPSE.replace('{0}', 'substr(text, l + 1, r - l)')} AS text, ({_TEN})[doc_id % 10 + 1] AS label FROM e),
        q AS (SELECT doc_id, 'questions' AS source, text, label FROM s WHERE text <> ''),
        m AS (SELECT doc_id, string_split(text, chr(10))[1] AS text, CASE doc_id % {len(NAMES)} {" ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(PROVISION_LABELS))} ELSE '{UNKNOWN}' END AS label FROM documents WHERE doc_id % 2 = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY label = '{UNKNOWN}' ORDER BY doc_id) AS k FROM m),
        every AS (SELECT * FROM q UNION ALL SELECT 'labelled-' || doc_id, 'labelled', text, label FROM o WHERE label <> '{UNKNOWN}' OR k <= {ds.OTHER_MOST}),
        w AS (SELECT *, CASE {_MOD.replace('CAST(doc_id AS VARCHAR)', 'doc_id')} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM every),
        first AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, doc_id) AS k FROM w),
        labels AS (SELECT text, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM w GROUP BY text)
        SELECT doc_id, source, split, md5(first.text) AS text_md5, labels FROM first JOIN labels ON first.text = labels.text WHERE k = 1""",
    "question_profile": """WITH q AS (SELECT doc_id % 50 AS title, CASE WHEN doc_id % 14 = 0 THEN -1 ELSE doc_id % 10 END AS kind, greatest(strpos(text, ' the '), strpos(text, ' de ')) > 0 AS answered FROM documents WHERE doc_id % 2 = 0)
        SELECT count(*) AS rows, count(DISTINCT title) AS contracts, count(DISTINCT kind) AS types, count(*) FILTER (answered) AS answered, avg(CAST(answered AS DOUBLE)) AS answered_share FROM q""",
    "answer_samples": f"""WITH q AS (SELECT 'contract-' || doc_id % 50 AS title, text, greatest(strpos(text, ' the '), strpos(text, ' de ')) AS at0,
            'Highlight the parts of this contract related to "' || CASE WHEN doc_id % 14 = 0 THEN 'Poetry' ELSE ({_TEN})[doc_id % 10 + 1] END || '" that a lawyer should review' AS question FROM documents WHERE doc_id % 2 = 0),
        k AS (SELECT *, count(*) OVER (PARTITION BY question, title, at0, substr(text, at0 + 1, 3)) AS same FROM q WHERE at0 > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY title, at0, substr(text, at0 + 1, 3)) AS n FROM k),
        c AS (SELECT question, title, substr(text, at0 + 1, 3) AS span, substr(text, greatest(at0 - 100, 0) + 1, at0 - greatest(at0 - 100, 0)) || '⟦' || substr(text, at0 + 1, 3) || '⟧' || substr(text, at0 + 4, 100) AS context FROM r WHERE n <= 4),
        f AS (SELECT question, title, span, {_COLLAPSE.replace('{0}', 'context')} AS flat FROM c)
        SELECT question, title, {_COLLAPSE.replace('{0}', 'span')} AS span, substr(flat, 1, 320) || CASE WHEN length(flat) > 320 THEN '…' ELSE '' END AS context FROM f""",
    "threshold_report": f"""WITH {_tried(cl.LABEL_GRID)}, f AS (SELECT *, {_F1} AS f1 FROM tried),
        best AS (SELECT label, CASE WHEN max(tp + fn) < {cl.MIN_SUPPORT} THEN 0.5 ELSE arg_max(t, (round(f1, 9), t)) END AS t FROM f GROUP BY label),
        b AS (SELECT sum(f1) / {len(CLAUSE_TYPES)} AS before FROM f WHERE t = 0.5), a AS (SELECT sum(f1) / {len(CLAUSE_TYPES)} AS after, count(*) FILTER (f.t <> 0.5) AS tuned FROM f JOIN best ON f.label = best.label AND f.t = best.t),
        g AS (SELECT label, p, sum(gold) AS pos, count(*) AS n FROM long GROUP BY ALL),
        s AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY label) AS total FROM g WINDOW w AS (PARTITION BY label ORDER BY p DESC)),
        v AS (SELECT label, sum(pos / total * tp / seen) AS ap FROM s WHERE total > 0 GROUP BY label)
        SELECT before, after, tuned, (SELECT avg(ap) FROM v) AS macro_ap FROM b, a""",
}
