"""The queries over the training-data operators, and the SQL of those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import bpe, fingerprints, neighbours, ngram_join, packing, quality, secret_scan, sharding, token_rollups, url_filters
from clausewright.llm.durable import durable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bottom-k sketch, its edited text's, and both likenesses."""
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, sizes near equal."""
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# The rules of the query's contract as (host, path, verdict).
CONTRACT_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by host rules first, then by blocked words."""
    rules = [url_filters.host_rule(*r) for r in CONTRACT_RULES] + [url_filters.word_rule(w) for w in url_filters.BLOCKED_WORDS]
    judged = url_filters.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    fixed = F.col("rule").isin([h + p for h, p, _ in CONTRACT_RULES])
    return judged.select("page_id", "host", "path", F.when(fixed, F.col("rule")).alias("rule"), "verdict")


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, counted by words, by bytes and by a
    public tokenizer: all enter as "draft" counts of one language; revisions give their
    true groups; one batch is replayed, before and after compaction; documents whose id
    ends in 3 leave and enter again."""
    import public_tokenizers

    kinds = token_rollups.TOKENIZERS | {"byte-bpe-50k": token_rollups.public_count(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)}
    rows = durable(token_rollups.counted(_table(spark, sf_dir, "documents"), kinds), "token-counts")
    drafts = rows.withColumn("lang", F.lit("und")).withColumn("tokens", F.col("tokens") + 1)
    some = rows.filter(F.pmod("doc_id", F.lit(10)) == 3)
    store = token_rollups.Rollup(spark)
    store.commit("1-insert", token_rollups.inserts(drafts))
    store.commit("2-revise", token_rollups.revisions(drafts, rows))
    store.commit("2-revise", token_rollups.revisions(drafts, rows))
    store.compact()
    store.commit("2-revise", token_rollups.revisions(drafts, rows))
    store.commit("3-delete", token_rollups.deletes(some))
    store.commit("4-insert", token_rollups.inserts(some))
    return store.totals()


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are 85 % alike."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), size=4, share=85)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, packed; the digest form of the packing operator."""
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(_table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model | None:
    """The classifier, from labelled rows outside the held-out fold."""
    return quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts by pattern and all spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secret_scan.told(F.col("base")), 256).alias("base_sha256"),
        secret_scan.told(F.col("spans")).alias("spans"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again."""
    import public_tokenizers

    coded = bpe.encode(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True
    )
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_sharding": op2_sharding,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_join": op4_ngram_join,
    "op5_neighbours": op5_neighbours,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_secret_scan": op9_secret_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op6_token_rollups": op6_token_rollups,
}

_HOST = "lower_az(regexp_extract(after, '^[^/?#]*', 0))".replace("lower_az(", "translate(").replace(", 0))", ", 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p, _ in sorted(CONTRACT_RULES, key=lambda r: -len(r[0] + r[1]))
)
_VERDICTS = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in CONTRACT_RULES)
_WORDS = "(^|[^A-Za-z0-9])(" + "|".join(url_filters.BLOCKED_WORDS) + ")([^A-Za-z0-9]|$)"

ORACLES = {
    "op3_url_filters": f"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
        parts AS (SELECT page_id, {_HOST} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM parts)
        SELECT page_id, host, path, rule,
               CASE {_VERDICTS} WHEN regexp_matches(host || path, '{_WORDS}', 'i') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
}
