"""Building and checking labelled datasets."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.vocabulary import CLAUSE_TYPES, MODEL_LABELS, PROVISION_LABELS, SPLITS, UNKNOWN, frame

# What a row of each origin must state.
REQUIRED_SYNTHETIC = ("generator_model", "generator_version", "prompt_id", "critic_result", "output_license")
REQUIRED_REAL = ("source", "license", "license_url", "source_ref", "raw_label", "reviewer", "guide_version", "source_document_sha256")
# Fixed value: how a question names the clause type that it asks for.
ASKED = 'related to "(.+?)"'
OTHER_MOST = 15_000
#: One over the relative error of the percentile that bounds what a cap ranks.
ACCURACY = 10_000
GROUP_KEYS = ("org_id", "document_family_id", "source_document_sha256", "template_cluster_id")


def md5_mod_10(text: Column) -> Column:
    """The MD5 of a text as a number, modulo 10. 16 ** 8 is 6 modulo 10, and so is each
    of its powers, so four parts of 32 bits suffice."""
    digest = F.md5(text)
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
    return ((part(0) % 10 + part(1) % 10 + part(2) % 10) * 6 + part(3)) % 10


def hash_split(key: Column) -> Column:
    bucket = md5_mod_10(key)
    return F.when(bucket == 0, "test").when(bucket == 1, "val").otherwise("train")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentence_at(text: Column, start: Column, end: Column) -> Column:
    """The sentence around [start, end): from behind the last ". " or line end before
    it to the first one after, blanks collapsed."""
    head = F.substring(text, F.lit(1), start)
    back = F.reverse(head)
    dot, line = F.locate(" .", back), F.locate("\n", back)
    after_dot = F.when(dot > 0, F.length(head) - dot + 1).otherwise(0)
    after_line = F.when(line > 0, F.length(head) - line + 1).otherwise(0)
    left = F.greatest(after_dot, after_line)
    tail = F.substring(text, end + 1, F.length(text))
    ends = F.filter(F.array(F.locate(". ", tail), F.locate("\n", tail)), lambda x: x > 0)
    right = F.coalesce(end + F.array_min(ends), F.length(text))
    return collapse(F.substring(text, left + 1, right - left))


def group_labels(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys and their sorted distinct labels."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def cap_negatives(df: DataFrame, is_negative: Column, order: str, cap: int) -> DataFrame:
    """All positives and the first negatives in a numeric order. A percentile whose
    error is known bounds the candidates for the cap, so few more than cap are ranked."""
    negatives = df.filter(is_negative)
    n = negatives.count()
    if n > cap:
        share = min(1.0, cap / n + 2 / ACCURACY)
        last = negatives.agg(F.percentile_approx(order, share, ACCURACY)).first()[0]
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
        negatives = negatives.filter(F.col(order).isNull() | (F.col(order) <= last)).withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")
    return df.filter(~is_negative).unionByName(negatives)


def dedup_across_splits(df: DataFrame, order: str) -> DataFrame:
    """One row per text: of the best split (train, val, test), there the first in
    order, with the labels of all its duplicates."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    rest = [c for c in df.columns if c not in ("text", "labels")]
    best = F.min_by(F.struct(*rest), F.struct(rank, F.col(order))).alias("best")
    labels = F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels")
    return df.groupBy("text").agg(best, labels).select("text", "labels", "best.*")


def clause_type_of(question: Column) -> Column:
    """The clause type that a question asks for; null if it names none that is known."""
    named = F.regexp_extract(question, ASKED, 1)
    return F.when(named.isin(*CLAUSE_TYPES, UNKNOWN), named)


def answer_rows(qa: DataFrame) -> DataFrame:
    """title, clause_type, sentence: one row per answer to a question of known type, as
    the sentence around it. qa: title, context, question, answers struct<text
    array<string>, answer_start array<int>>."""
    asked = qa.withColumn("clause_type", clause_type_of(F.col("question"))).filter("clause_type is not null")
    each = asked.select("title", "clause_type", "context", F.inline(F.arrays_zip(F.col("answers.text").alias("answer"), F.col("answers.answer_start").alias("start"))))
    told = each.select("title", "clause_type", sentence_at(F.col("context"), F.col("start"), F.col("start") + F.length("answer")).alias("sentence"))
    return told.filter("sentence <> ''")


def oneline(text: Column, limit: int) -> Column:
    """White space collapsed, cut to a limit with a mark where something is missing."""
    flat = collapse(text)
    return F.concat(F.substring(flat, 1, limit), F.when(F.length(flat) > limit, "…").otherwise(""))


def answer_samples(qa: DataFrame, per_type: int = 4, around: int = 100) -> DataFrame:
    """question, title, span, context of each question's first contracts by name that
    answer it: the first answer, marked in the text around it. Of answers that title,
    place and span do not tell apart, that of the last text by name comes first."""
    told = qa.filter(F.size("answers.text") > 0).withColumns({"_span": F.get("answers.text", F.lit(0)), "_at": F.get("answers.answer_start", F.lit(0))})
    nth = F.row_number().over(Window.partitionBy("question").orderBy("title", "_at", "_span", F.desc("context")))
    kept = told.withColumn("_nth", nth).filter(F.col("_nth") <= per_type)
    first = F.greatest(F.col("_at") - around, F.lit(0))
    after = F.col("_at") + F.length("_span") + 1
    context = F.concat(F.substring(F.col("context"), first + 1, F.col("_at") - first), F.lit("⟦"), "_span", F.lit("⟧"), F.substring(F.col("context"), after, F.lit(around)))
    return kept.select("question", oneline(F.col("title"), 60).alias("title"), oneline(F.col("_span"), 200).alias("span"), oneline(context, 320).alias("context"))


def question_profile(qa: DataFrame) -> DataFrame:
    """One row: questions asked of contracts, contracts, types asked for, and those with
    an answer."""
    named = F.regexp_extract("question", ASKED, 1)
    kind = F.when(named != "", named).otherwise(F.substring("question", 1, 40))
    answered = F.size("answers.text") > 0
    return qa.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("title").alias("contracts"), F.count_distinct(kind).alias("types"), F.count_if(answered).alias("answered"), F.avg(answered.cast("double")).alias("answered_share")
    )


def question_examples(qa: DataFrame) -> DataFrame:
    """doc_id, text, labels, source: sentences of a contract with all types asked of them."""
    rows = group_labels(answer_rows(qa), ["title", "sentence"], "clause_type")
    return rows.select(F.col("title").alias("doc_id"), F.col("sentence").alias("text"), "labels", F.lit("questions").alias("source"))


def labelled_examples(rows: DataFrame, names: list[str], most: int = OTHER_MOST) -> DataFrame:
    """doc_id, text, labels, source from rows (idx, text, label): a label's name is its
    place in names, its clause type the one that stands for it here, else unknown, of
    which the first most rows are kept."""
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("label"))
    known = frame(rows.sparkSession, PROVISION_LABELS, "name string, clause_type string")
    typed = rows.withColumn("name", name).join(F.broadcast(known), "name", "left").withColumn("clause_type", F.coalesce("clause_type", F.lit(UNKNOWN)))
    kept = cap_negatives(typed, F.col("clause_type") == UNKNOWN, "idx", most)
    return kept.select(F.concat(F.lit("labelled-"), F.col("idx").cast("string")).alias("doc_id"), "text", F.array("clause_type").alias("labels"), F.lit("labelled").alias("source"))


def clause_dataset(qa: DataFrame, rows: DataFrame, names: list[str], most: int = OTHER_MOST) -> DataFrame:
    """Both corpora in one, split by source document, each text in one split only."""
    both = question_examples(qa).unionByName(labelled_examples(rows, names, most))
    return dedup_across_splits(both.withColumn("split", hash_split(F.col("doc_id"))), "doc_id")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values of key that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def char_shingles(text: Column, n: int = 5) -> Column:
    """Hashes of distinct runs of n characters of the lower-cased, collapsed text (the
    whole text, if shorter)."""
    chars = F.transform(F.array(F.split(collapse(F.lower(text)), "")), lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(s, i, n))))
    return F.array_distinct(chars[0])


def near_duplicates(df: DataFrame, id_col: str, text_col: str, percent: int = 90) -> DataFrame:
    """Pairs (a, b) of ids with different texts whose character shingles are alike to
    at least percent. Each text looks up only its rarest shingles, of which alike texts
    share one; what lies behind the last shared one bounds how alike a pair can be, so
    few pairs have their sets compared."""
    sets = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), char_shingles(F.col(text_col)).alias("s")).withColumn("n", F.size("s"))
    each = sets.select("id", "h", "n", F.explode("s").alias("t"))
    counts = each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rare = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    prefix = each.join(counts, "t").withColumn("pos", alone + rare).filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    names = ("id", "n", "h", "pos")
    a, b = (prefix.select("t", *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "ab")
    rest = "least(n_a - pos_a, n_b - pos_b)"
    enough = f"{100 + percent} * ({{}} + {rest}) >= {percent} * (n_a + n_b)"
    fits = f"id_a < id_b and h_a <> h_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {enough.format('least(pos_a, pos_b)')}"
    met = a.join(b, "t").filter(fits).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("shared"), *[F.max(c).alias(c) for c in ("pos_a", "pos_b", "n_a", "n_b")])
    pairs = met.filter(enough.format("shared")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return met.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def group_leakage(df: DataFrame, keys: tuple[str, ...] = GROUP_KEYS) -> DataFrame:
    """key, value, splits: values of grouping keys that occur in several splits."""
    each = df.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])))
    return each.filter("value is not null").groupBy("key", "value").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def class_support(df: DataFrame, labels: DataFrame, min_support: int = 20) -> DataFrame:
    """label, n, status of every expected label: missing, low or ok."""
    counts = df.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    told = labels.join(counts, "label", "left").fillna({"n": 0})
    return told.select("label", "n", F.when(F.col("n") == 0, "missing").when(F.col("n") < min_support, "low").otherwise("ok").alias("status"))


def dataset_identity(df: DataFrame, columns: list[str]) -> DataFrame:
    """A hash of all rows that their order does not change: rows' hashes are sorted and
    hashed within 4096 parts, then over the parts, so no task holds all rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("identity"))


def document_opening(text: Column, words: int = 512) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, words), " ")


def row_contract(df: DataFrame) -> DataFrame:
    """id, issue: one row per broken rule of a labelled example."""
    blank = F.length(collapse(F.coalesce("text", F.lit("")))) == 0
    real, made = F.col("origin") == "real", F.col("origin") == "synthetic"
    rules = [
        ("empty_text", blank),
        ("unknown_type", ~F.coalesce(F.col("type").isin(*MODEL_LABELS), F.lit(False))),
        ("synthetic_outside_train", made & (F.col("split") != "train")),
        ("real_in_train", real & ~F.col("split").isin(*SPLITS[1:])),
        *[(f"missing_{c}", made & F.col(c).isNull()) for c in (*REQUIRED_SYNTHETIC, "seed")],
        *[(f"missing_{c}", real & F.col(c).isNull()) for c in REQUIRED_REAL],
        ("not_verified", real & ~F.coalesce(F.col("review_status") == "verified", F.lit(False))),
        ("not_human_verified", real & ~F.coalesce(F.col("label_method") == "human_verified", F.lit(False))),
        ("hash_mismatch", F.col("text_sha256").isNotNull() & (F.col("text_sha256") != F.sha2("text", 256))),
    ]
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return df.select("id", F.explode(found).alias("issue"))


def _plain_words(text: str | None) -> list[str]:
    low = (text or "").lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return re.findall(r"\b\w\w+\b", low)


@F.arrow_udf(T.ArrayType(T.StringType()))
def plain_words(texts: pa.Array) -> pa.Array:
    """Words of two characters or more, lower-cased and without accents."""
    return pa.array([_plain_words(t) for t in texts.to_pylist()], pa.list_(pa.string()))


_COUNTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


@F.arrow_udf(_COUNTED)
def term_counts(texts: pa.Array) -> pa.Array:
    """Words as plain_words has them and each two that follow one another, with how
    often they occur; text by text, so that few are Python objects at a time."""
    offsets, terms, tfs = [0], [], []
    done = []
    for n, text in enumerate(texts, 1):
        words = _plain_words(text.as_py())
        found = Counter(words)
        found.update(map(" ".join, pairwise(words)))
        terms += found.keys()
        tfs += found.values()
        offsets.append(len(terms))
        if len(terms) >= 200_000 or n == len(texts):
            counted = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
            done.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), counted))
            offsets, terms, tfs = [0], [], []
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))


def with_pairs(words: Column) -> Column:
    """words and each two that follow one another."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def tfidf(df: DataFrame, id_col: str, counts: Column) -> DataFrame:
    """id, term, weight: (1 + ln tf) * (ln((1 + docs) / (1 + df)) + 1), each document
    scaled to length 1. counts: a row's distinct terms with their tf. They are counted on
    the row, so terms move twice, to meet their df and back; only where rows share an id
    (the ids are counted first) are their terms summed up before."""
    terms = df.select(F.col(id_col).alias("id"), F.inline(counts))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(id_col).alias("named"), F.count_distinct(id_col).alias("docs")).first()
    if seen.named > seen.docs or seen.rows > seen.named + 1:
        terms = terms.groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    dfs = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = terms.join(dfs, "term").select("id", "term", ((1 + F.log("tf")) * (F.log(F.lit(1 + seen.docs) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))
