"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch is a set of signed rows: an insert adds a document's count, a delete takes
it away, a revision does both (old count out, new count in). A batch is summed to
one row per group before it is written, so the store grows with groups, never with
documents. Totals are the sum of all committed batches: addition commutes, so the
order of batches does not matter. Compaction sums all batches committed so far into
one table that also keeps their names; vacuum then removes their folders.

A batch is written to a folder of its writer's own and commits by one rename that
fails where the name is taken: of two writers of a batch one commits. Replaying a
committed batch, compacted or not, changes nothing; a writer that died left only an
unnamed folder, and its batch can run again. Only file systems whose rename is one
step are accepted.

Defined cases: null source, language or version form groups of their own; a null
text counts no tokens; texts of any length are counted whole; an empty batch commits
nothing but its name, which has letters, digits, ".", "_" and "-" only; rows repeated
in full count as often as they occur; groups whose documents all left stay out of
the totals. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.durable import new_path
from clausewright.llm.packing import tokens

#: File systems whose rename is one step.
ATOMIC = ("file", "hdfs", "viewfs")
GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def word_count(text: Column) -> Column:
    """Tokenizer "words-1": runs of anything but blank, tab and line ends."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def byte_count(text: Column) -> Column:
    """Tokenizer "bytes-1": UTF-8 bytes."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")


def public_count(path: str, pattern: str):
    """The count of a public tokenizer's ids, from a file that every executor has."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        own = tokens(path, pattern)
        return pa.array([len(own.ids(t)) // 4 for t in texts.to_pylist()], pa.int64())

    return count


TOKENIZERS = {"words-1": word_count, "bytes-1": byte_count}


def counted(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: one row per document and version.
    A tokenizer is any function from a text column to a count column."""
    kinds = tokenizers or TOKENIZERS
    told = docs.select("doc_id", "source", "lang", *[f(F.col("text")).alias(f"_{i}") for i, f in enumerate(kinds.values())])
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.col(f"_{i}").alias("tokens")) for i, k in enumerate(kinds)])
    return told.select("doc_id", "source", "lang", F.inline(each))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(1).alias("documents"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The counts of old leave, those of new enter; groups may differ."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """A store of committed batches under one folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or new_path(spark, "rollup")
        fs = spark._jvm.org.apache.hadoop.fs
        self._jpath = fs.Path
        root = self._jpath(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getScheme() not in ATOMIC:
            raise ValueError(f"a rename is no single step on {self._fs.getScheme()}")
        self._fs.mkdirs(root)
        self._context = fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), spark._jsc.hadoopConfiguration())
        self._never_over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _names(self, kind: str) -> list[str]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(self.path))]
        return sorted(n.removeprefix(kind) for n in found if n.startswith(kind))

    def _publish(self, draft: str, name: str) -> bool:
        """Give a finished folder its name; False, and no folder, where it is taken."""
        source = self._fs.makeQualified(self._jpath(draft))
        try:
            self._context.rename(source, self._fs.makeQualified(self._jpath(self._at(name))), self._never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(source, True)
            return False
        return True

    def _compacted(self) -> tuple[str | None, set[str]]:
        """The newest compacted table and the batches that it holds."""
        found = self._names("compact=")
        if not found:
            return None, set()
        newest = self._at(f"compact={found[-1]}")
        return newest, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{newest}/names").collect()}

    def committed(self) -> list[str]:
        return sorted({*self._names("batch="), *self._compacted()[1]})

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Apply a batch once; False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"a batch's name has letters, digits, '.', '_' and '-': {batch!r}")
        if batch in self.committed():
            return False
        draft = self._at(f"_draft-{batch}-{uuid.uuid4().hex}")
        self._summed(delta).write.parquet(draft)
        return self._publish(draft, f"batch={batch}")

    def compact(self) -> bool:
        """Sum what is committed into one table; False if another did so meanwhile."""
        names, number = self.committed(), self._names("compact=")
        draft = self._at(f"_draft-compact-{uuid.uuid4().hex}")
        self._read(names).coalesce(1).write.parquet(f"{draft}/rows")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{draft}/names")
        return self._publish(draft, f"compact={int(number[-1]) + 1 if number else 1:08d}")

    def vacuum(self) -> None:
        """Remove what the newest compacted table replaces. Readers that began before
        its compaction should have ended."""
        newest, names = self._compacted()
        for old in [f"batch={n}" for n in self._names("batch=") if n in names] + [f"compact={n}" for n in self._names("compact=")]:
            if self._at(old) != newest:
                self._fs.delete(self._jpath(self._at(old)), True)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def _read(self, names: list[str]) -> DataFrame:
        newest, held = self._compacted()
        paths = [self._at(f"batch={n}") for n in names if n not in held] + ([f"{newest}/rows"] if newest else [])
        return self._summed(self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        """One row per group that still holds documents."""
        return self._read(self.committed()).filter(F.col("documents") != 0)
