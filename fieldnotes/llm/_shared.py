"""What the training-data operators share: table access, shared-storage tables, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D, as a regular expression of Java, Python and DuckDB.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"

_own: list[str] = []
#: Tables saved since the outermost once() began, oldest first.
_made: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of this process, but only in local mode: no other machine can see it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="fieldnotes-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def tasks(*tables: DataFrame, each: int = 4_000_000, least: int = 1) -> int:
    """How many tasks tables of save() are worth, by their bytes on disk."""
    total = 0
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        total += p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(least, -(-total // each))


def save(df: DataFrame, n: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation before it.

    n: tasks that the last step is worth; it gets no more than that. The shuffle files of the
    step go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        (df if n is None or n >= partitions(spark) else df.coalesce(n)).write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _made.append(out)
    return out


def once(make: Callable[[], DataFrame]) -> DataFrame:
    """The saved result of make(); the tables that were saved on the way are dropped."""
    mark = len(_made)
    out = save(make())
    drop(*_made[mark:-1])
    _made[mark:] = [out]
    return out


def packed(columns: list[str]) -> Column:
    """The columns as one struct of fields c0, c1, ..., so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]) if columns else F.lit(None).cast("int")


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(columns)]


def drop(*tables: DataFrame) -> None:
    """Delete tables of save() that no later step reads."""
    for df in tables:
        if at := getattr(df, "_saved_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(conf).delete(p, True)


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        give(0)


def releasing(run):
    """For mapInArrow: give freed memory back when a task ends, since the worker stays and idles beside the steps that follow."""

    def task(batches):
        yield from run(batches)
        trim()

    return task


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times in body: a lambda variable can't be inlined by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, f"[{WS_CLASS}]+"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that clash with those an operator adds."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
