"""Secret scans: fixed patterns, and character Markov models for the rest.

Three patterns always count: assignments to secret-like names, access key ids and
long hexadecimal runs. Other long runs of key characters are judged by two first-order
Markov models over characters, one trained on random strings, one on ordinary
identifiers: a run whose log-likelihood ratio is above a threshold is a secret too.
The models learn from labelled samples: words of a bounded sample of documents,
labelled random where a pattern found them and ordinary elsewhere, beside generated
random strings. They reach the scan as one literal table of transitions.

All of it is column functions; a scan is a row-local projection.

Defined cases: a null or empty text has no spans; texts are scanned whole; without
ordinary samples (an empty table) the models know only random strings and smoothing;
spans of one kind never overlap, spans of several patterns may; a model's span never
overlaps a pattern's: of a run that a pattern meets, the parts outside are judged
together, and those likelier random are spans; repeated rows are scanned alike; an empty table
gives no rows; other columns pass through redaction, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns and least lengths that always count as secrets.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Natural logarithm of the odds from which a run is a secret.
THRESHOLD = 12.0
#: Transitions' weight of the characters' own shares, for those seldom seen.
BACK_OFF = 20.0
#: Documents whose words train the models, those with the least hashes.
SAMPLE_DOCUMENTS = 2000
RANDOM_STRINGS = 4000
#: Sample texts that must share a word before it counts as an ordinary one.
RECURS = 3

SPANS = "array<struct<start:int,end:int,kind:int>>"


def _empty() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def _located(text: Column, pattern: str, matches: Column, kept: Column, kind: int) -> Column:
    """Spans of a pattern's matches in text, code points, end exclusive; kept: a
    boolean for each match. Places follow from the lengths of what lies between."""
    pieces = F.split(text, pattern, -1)
    each = F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m"), kept.alias("k")), lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("len"), x["k"].alias("keep")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("pos"), F.when(x["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.exists(kept, lambda k: k), F.aggregate(each, F.struct(F.lit(0).alias("pos"), _empty().alias("out")), step, lambda a: a["out"])).otherwise(_empty())


def with_pattern_spans(df: DataFrame, text_col: str, out: str = "_base") -> DataFrame:
    """df with the spans of the three patterns, ordered by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = F.exists(F.array(*[F.contains(low, F.lit(n)) for n in NAMES]), lambda x: x)
    none = F.expr("cast(array() as array<string>)")
    found = df.withColumns(
        {
            "_m0": F.when(named, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))).otherwise(none),
            "_v0": F.when(named, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(none),
            "_m1": F.when(F.contains(text, F.lit("AKIA")), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(none),
            "_m2": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
        }
    )
    always = lambda m: F.transform(F.col(m), lambda x: F.lit(True))
    spans = F.concat(
        _located(text, ASSIGN, F.col("_m0"), F.transform("_v0", lambda v: F.length(v) >= ASSIGN_LENGTH), 0),
        _located(text, ACCESS, F.col("_m1"), always("_m1"), 1),
        _located(text, HEX, F.col("_m2"), always("_m2"), 2),
    )
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.withColumn(out, ordered).drop("_m0", "_v0", "_m1", "_m2")


def random_samples(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Generated random strings: base64, hexadecimal and upper-case alphanumeric."""
    seed = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    kinds = F.array(
        F.translate(F.base64(F.unhex(seed)), "=", ""),
        F.substring(seed, 1, 40),
        F.translate(F.upper(F.base64(F.unhex(seed))), "+/=", ""),
        F.translate(F.base64(F.unhex(seed)), "+/=", "-_"),
    )
    return spark.range(n).select(kinds[F.pmod("id", F.lit(4)).cast("int")].alias("word"), F.lit(1).alias("random"))


def document_samples(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct words of SAMPLE_DOCUMENTS documents, those with the least hashes of id and text; one
    that is repeated in full counts once. Words are random where a pattern found
    them, ordinary where RECURS different texts hold them, else left out, as what
    stands in one text alone may be a secret that no pattern knows."""
    keyed = df.select(F.xxhash64(id_col, text_col, F.lit("secret samples")).alias("_order"), F.col(text_col).alias("_text"))
    last = keyed.select("_order").distinct().orderBy("_order").limit(SAMPLE_DOCUMENTS).agg(F.max("_order")).first()[0]
    chosen = keyed.filter(F.col("_order") <= F.lit(last)).dropDuplicates(["_order"])
    spans = with_pattern_spans(chosen.select("_text"), "_text")
    inside = F.array_join(F.transform("_base", lambda s: F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"])), " ")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = lambda t, label: F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit(label).alias("random")))
    told_apart = spans.select(F.xxhash64("_text").alias("doc"), F.inline(F.concat(words(F.coalesce(rest, F.lit("")), 0), words(inside, 1))))
    by_word = told_apart.groupBy("word").agg(F.max("random").alias("random"), F.count_distinct("doc").alias("docs"))
    return by_word.filter((F.col("random") == 1) | (F.col("docs") >= RECURS)).select("word", "random")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, indexed by from * (n + 1) + to; index 0
    is the start of a run. samples: word string, random 0 or 1. At most
    2 * (n + 1) ** 2 counts reach the driver."""
    size = len(ALPHABET) + 1
    chars = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = samples.select("random", F.filter(F.concat(F.array(F.lit(0)), chars), lambda c: c >= 0).alias("codes"))
    steps = codes.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.get("codes", i - 1) * size + F.get("codes", i))).alias("step"))
    counts = {(r[0], r[1]): r[2] for r in steps.groupBy("random", "step").count().collect()}
    table = [[0.0] * size**2, [0.0] * size**2]
    for random in (0, 1):
        seen = [sum(counts.get((random, a * size + b), 0) for a in range(size)) + 0.5 for b in range(size)]
        for a in range(size):
            row = [counts.get((random, a * size + b), 0) for b in range(size)]
            for b, n in enumerate(row):
                share = (n + BACK_OFF * seen[b] / sum(seen)) / (sum(row) + BACK_OFF)
                table[random][a * size + b] = math.log(share)
    return [round(r - o, 4) for r, o in zip(table[1], table[0], strict=True)]


def log_likelihood_ratio(word: Column, model: list[float]) -> Column:
    """How many times likelier, in natural logarithms, random strings make a word."""
    size = len(ALPHABET) + 1
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        codes, zero, lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.get(ratios, acc["last"] * size + c)).alias("sum")), lambda acc: acc["sum"]
    )


def _outside(run: Column, base: Column) -> Column:
    """[start, end) of the parts of a run that no span of base, ordered by start, covers."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    part = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] > acc["at"], F.concat(acc["out"], part(acc["at"], b["start"]))).otherwise(acc["out"]).alias("out"))

    met = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    rest = lambda acc: F.when(acc["at"] < run["end"], F.concat(acc["out"], part(acc["at"], run["end"]))).otherwise(acc["out"])
    return F.aggregate(met, F.struct(run["start"].alias("at"), none.alias("out")), step, rest)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """df with base and spans: arrays of (start, kind, end) in code points, end
    exclusive, ordered by start, then kind; kind indexes KINDS."""
    if model is None:
        samples = document_samples(df, id_col, text_col).unionByName(random_samples(df.sparkSession))
        model = train(samples)
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = with_pattern_spans(df.drop("base", "spans"), text_col)
    runs = based.withColumn("_runs", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    judged = runs.withColumn("_likely", F.transform("_runs", lambda w: (F.size("_base") > 0) | (log_likelihood_ratio(w, model) >= THRESHOLD)))
    located = judged.withColumn("_found", _located(text, CANDIDATE, F.col("_runs"), F.col("_likely"), 3))
    ratio = lambda x: log_likelihood_ratio(F.substring(text, x["start"] + 1, x["end"] - x["start"]), model)
    parts = F.transform("_found", lambda s: F.transform(_outside(s, F.col("_base")), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"), ratio(x).alias("ratio"))))
    random = located.withColumn("_parts", parts).withColumn("_random", F.transform("_parts", lambda run: F.filter(run, lambda x: x["ratio"] > 0)))
    likely = F.filter("_random", lambda run: F.aggregate(run, F.lit(0.0), lambda acc, x: acc + x["ratio"]) >= THRESHOLD)
    added = F.transform(F.flatten(likely), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return random.withColumns({"base": F.col("_base"), "spans": F.array_sort(F.concat(F.col("_base"), added))}).drop("_base", "_runs", "_likely", "_found", "_parts", "_random")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by mark."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with every secret in its texts replaced; length_col follows if named."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct("*").alias("_row"))
    clean = scan(rows, "_id", "_text").withColumn("_text", redacted(F.col("_text"), F.col("spans")))
    told = {text_col: F.col("_text")} | ({length_col: F.length("_text").cast(df.schema[length_col].dataType)} if length_col else {})
    return clean.select(*[told.get(c, F.col("_row")[c]).alias(c) for c in df.columns])
