"""Tables that outlive an executor: written once to the shared folder and reread."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that go to a Python worker at a time.
BATCH_TEXTS = 1000
#: Narrow rows that one task may as well read as several.
TASK_ROWS = 100_000
_local: list[str] = []
_lock = threading.Lock()
_inside: dict[tuple[int, str], tuple[int, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares: spark.checkpoint.dir, else (unset) a temporary
    folder where driver and executors are one process, as in tests. On a cluster it has
    to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="clausewright-"))
        return _local[0]
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """An option has this value inside. The option is the session's: the first of
    several writes at a time sets it, and the last one puts it back."""
    at = id(spark._jsparkSession), key
    with _lock:
        inside, before = _inside.get(at, (0, None))
        if not inside:
            before = spark.conf.get(key, None)
            spark.conf.set(key, value)
        _inside[at] = inside + 1, before
    try:
        yield
    finally:
        with _lock:
            inside, before = _inside[at]
            if inside == 1:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)
                del _inside[at]
            else:
                _inside[at] = inside - 1, before


def durable(df: DataFrame, name: str, reads: int | None = None, each: int = TASK_ROWS, texts: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a
    lost executor costs no recomputation. reads: what the last step reads, where it is
    known; that step then has a task for each so many at most, as every task writes a
    file, and a file can cost a process or more. texts: whole texts go to Python, few
    at a time, as either side holds a batch several times over. Shuffle files of the
    step go when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if reads is not None:
        df = df.coalesce(max(1, -(-reads // each)))
    rows = int(spark.conf.get(BATCH))
    fewer = texts and not 0 < rows <= BATCH_TEXTS
    with _held(spark, CLEANUP, "true"), _held(spark, BATCH, str(BATCH_TEXTS)) if fewer else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    jvm = spark._jvm
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
