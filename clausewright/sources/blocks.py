"""Documents as blocks: one canonical text per document, exact code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"

# A parser's item labels and the block types they stand for.
ITEM_LABELS = (
    ("text", "paragraph"),
    ("paragraph", "paragraph"),
    ("title", "heading"),
    ("section_header", "heading"),
    ("list_item", "list_item"),
    ("table", "table"),
    ("page_header", "page_header"),
    ("page_footer", "page_footer"),
    ("caption", "caption"),
)


def block_type(label: Column) -> Column:
    """A parser label's block type; other labels are "other"."""
    pairs = F.create_map(*[F.lit(x) for pair in ITEM_LABELS for x in pair])
    return F.coalesce(F.element_at(pairs, label), F.lit("other"))


def page_range(items: DataFrame, first: int, last: int) -> DataFrame:
    """Items of pages first to last; apply before canonicalise, so that the filter
    reaches the scan."""
    return items.filter(F.col("page").between(first, last))


def filled(text: Column) -> Column:
    """Whether a text has a character that is no white space."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def canonicalise(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks from items (key, item_index, label, text, page): blank items go, ids keep
    the item's index, and a block starts after all earlier ones and separators."""
    order = Window.partitionBy(key).orderBy("item_index")
    size = F.length("text") + len(SEPARATOR)
    counted = items.filter(filled(F.col("text"))).withColumns(
        {"ord": (F.row_number().over(order) - 1).cast("int"), "_end": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    )
    return blocks_of(counted, key, F.col("label"), F.coalesce("page", F.lit(1)).cast("int"), size)


def blocks_of(counted: DataFrame, key: str, label: Column, page: Column, size: Column) -> DataFrame:
    """Blocks from items with their ord and _end, the sum of sizes up to them."""
    return counted.select(
        key,
        "ord",
        F.concat(F.lit("b"), F.col("item_index").cast("string")).alias("block_id"),
        block_type(label).alias("type"),
        "text",
        page.alias("page"),
        (F.col("_end") - size).cast("int").alias("char_start"),
        (F.col("_end") - len(SEPARATOR)).cast("int").alias("char_end"),
    )


def documents_of(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, page_count, n_blocks: blocks joined again in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy(key).agg(
        F.array_join(F.transform(listed, lambda b: b["text"]), SEPARATOR).alias("text"),
        F.max("page").alias("page_count"),
        F.count(F.lit(1)).cast("int").alias("n_blocks"),
    )


def line_items(documents: DataFrame, key: str = "doc_id", lines_per_page: int = 50) -> DataFrame:
    """Items from plain text: a line is a paragraph, a page a fixed number of lines."""
    lines = documents.select(key, F.posexplode(F.split("text", "\n", -1)).alias("item_index", "text"))
    return lines.select(
        key, "item_index", F.lit("text").alias("label"), "text", (F.floor(F.col("item_index") / lines_per_page) + 1).cast("int").alias("page")
    )


TAG = r"(?is)<(p|h[1-6]|li|td|title|figcaption)\b[^>]*>(.*?)</\1>"


def html_items(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Items from HTML: the text of headings, paragraphs, list items, cells and
    captions; scripts and styles go, entities of markup are read."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", "")
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(1))
    inner = F.regexp_extract_all(html, F.lit(TAG), F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("inner"))).alias("item_index", "item"))
    rows = rows.withColumn("item", F.struct(F.lower("item.tag").alias("tag"), F.col("item.inner").alias("inner")))
    label = F.when(F.col("item.tag").rlike("^h[1-6]$"), "section_header").otherwise(
        F.element_at(F.create_map(*[F.lit(x) for p in (("p", "text"), ("li", "list_item"), ("td", "table"), ("title", "title"), ("figcaption", "caption")) for x in p]), F.col("item.tag"))
    )
    return rows.select(key, "item_index", label.alias("label"), F.trim(plain_text(F.col("item.inner"))).alias("text"), F.lit(1).alias("page"))


def plain_text(html: Column) -> Column:
    """HTML without tags, with the five predefined entities and blanks read."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_by_split(rows: DataFrame, path: str, kind: str = "json") -> None:
    """One folder per split."""
    rows.write.partitionBy("split").format(kind).mode("overwrite").save(path)


def read_files(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Files below path with a suffix of any case: path, content and its SHA-256."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Section inventories: source and one row per clause, in order."""
    schema = "source string, page_range array<int>, note string, clauses array<struct<number: string, depth: int, heading: string>>"
    gold = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return gold.select("source", F.posexplode("clauses").alias("ord", "clause")).select("source", "ord", "clause.*")
