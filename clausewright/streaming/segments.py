"""Segmentation of documents as they arrive. A document's blocks are an array on its
row, so the stream needs no state; batch and stream share the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.markers import block_start_marker
from clausewright.functions.numbering import parse_marker
from clausewright.operators.segmentation import decode, number, role
from clausewright.sources.blocks import SEPARATOR

DOCUMENT = "doc_id bigint, text string"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def segment_rows(documents: DataFrame) -> DataFrame:
    """Clauses of (doc_id, text) rows whose blocks stand apart by an empty line."""
    pieces = F.split("text", SEPARATOR, -1)

    def step(acc, piece):  # noqa: ANN001, ANN202
        marker = block_start_marker(piece)
        entry = F.struct((acc["at"] + marker["start"]).alias("source_offset"), marker["marker"].alias("marker"), marker["family"].alias("family"), acc["block"].alias("block"))
        return F.struct((acc["at"] + F.length(piece) + len(SEPARATOR)).alias("at"), (acc["block"] + 1).alias("block"), F.when(marker.isNotNull(), F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<source_offset: int, marker: string, family: string, block: int>>)")
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(0).alias("block"), none.alias("out")), step, lambda a: a["out"])
    told = F.transform("found", lambda m: F.struct(m["source_offset"].alias("source_offset"), m["marker"].alias("marker"), m["family"].alias("family"), parse_marker(m["family"], m["marker"]).alias("number"), m["block"].alias("block")))
    rows = documents.withColumn("found", found).select("doc_id", F.length("text").alias("text_length"), told.alias("markers"))
    nodes = rows.select("doc_id", F.inline(decode("markers", "text_length")))
    return nodes.select("doc_id", "ord", "depth", "parent", role(F.col("family")).alias("role"), number(F.col("marker"), F.col("path")).alias("number"), "char_start")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by type and tumbling window, with a bound on lateness; batch frames are
    counted alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )
