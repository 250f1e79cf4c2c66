"""Tables in files (OP-01, 02, 07 to 12, 15)."""

from __future__ import annotations

import atexit
import logging
import tempfile
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null

log = logging.getLogger("tidewright")


_written: list[tuple[SparkSession, str]] = []
_mine = threading.local()  # paths that this thread has named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session's tasks share (``spark.checkpoint.dir``); ``release`` deletes it.

    Where that is unset, a session on one machine takes a folder of that machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    _mine.paths = [*getattr(_mine, "paths", []), path]
    return path


def named() -> int:
    """How many paths ``scratch`` has named in this thread; for ``discard_since``."""
    return len(getattr(_mine, "paths", []))


def discard_since(spark: SparkSession, mark: int, *kept: str) -> None:
    """Deletes what ``scratch`` has named in this thread since ``mark``, but for ``kept``, once nothing else is read any more."""
    for path in getattr(_mine, "paths", [])[mark:]:
        if path not in kept:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``scratch`` has named, once nothing reads from it any more."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended
        pass


def release() -> None:
    """Deletes what ``scratch`` has named in this process, also at its end. Results that still read from it must have been taken before."""
    while _written:
        discard(*_written.pop())


atexit.register(release)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """OP-01, 02: a CSV file with a header and a given schema; empty fields and NaN are NULL."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """OP-08."""
    df.write.mode("overwrite").option("header", True).csv(path)


#: Spark's setting by which a query's shuffle files go as soon as it has ended; else they stay until the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, path: str, tidy: bool = False) -> DataFrame:
    """OP-09: writes a stage's result and goes on from what was written. With ``tidy`` the shuffle files that led to it are deleted."""
    spark = df.sparkSession
    before = spark.conf.get(_TIDY)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def required(read: Callable[[], DataFrame], what: str) -> DataFrame:
    """OP-10: an input that must exist; ends the program with status 1 if it doesn't."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        log.error("missing input: %s", what)
        raise SystemExit(1) from e


class SourceError(Exception):
    """A source that gives no answer; what openers and readers of sources raise, so that ``optional`` can tell it from other failures."""


#: Conditions by which Spark says that a source isn't there or can't be read.
SOURCE_CONDITIONS = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "DATA_SOURCE_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "PYTHON_DATA_SOURCE_ERROR")
_SOURCE_TEXTS = ("SourceError", "java.io.FileNotFoundException", "java.net.", "java.io.EOFException", "is not a Parquet file")


def is_source_error(e: BaseException) -> bool:
    """Whether a failure is a source's: it is missing, unreadable or doesn't answer. Bugs, memory and wrong queries aren't."""
    if isinstance(e, SourceError | OSError):
        return True
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    if condition and condition.startswith(SOURCE_CONDITIONS):
        return True
    return isinstance(e, PySparkException | Py4JJavaError) and not isinstance(e, AnalysisException) and any(t in str(e) for t in _SOURCE_TEXTS)


def optional(df: DataFrame, add: Callable[[DataFrame], DataFrame], column: str, run: bool = False) -> DataFrame:
    """OP-07: adds a column from a source; where the source won't open, the column is NULL throughout. Other failures are raised.

    With ``run`` the result is computed and written here, so that a source that fails while it is read counts as missing too.
    """
    try:
        return stage(add(df), scratch(df.sparkSession, "optional")) if run else add(df)
    except Exception as e:
        if not is_source_error(e):
            raise
        log.warning("%s is missing: %s", column, e)
        return df.withColumn(column, F.lit(None).cast("double"))


def write_threshold(spark: SparkSession, path: str, threshold: float, **notes: float) -> None:
    """OP-12: ``key=value`` lines of six decimals after a comment."""
    lines = ["# decision threshold", f"threshold={threshold:.6f}", *[f"{k}={v:.6f}" for k, v in notes.items()]]
    spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in lines])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_threshold(spark: SparkSession, path: str, default: float = 0.5) -> DataFrame:
    """OP-12: one row with the first threshold of the file, or the default."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.range(0).select(F.lit("").alias("value"))
    found = lines.where(F.col("value").startswith("threshold=")).select(F.split("value", "=")[1].cast("double").alias("t"))
    return found.agg(F.coalesce(F.first("t"), F.lit(default)).alias("threshold"))


def report(df: DataFrame, title: str) -> DataFrame:
    """OP-15: logs a small report table and hands it on."""
    log.info("%s\n%s", title, "\n".join("  ".join(map(str, r)) for r in df.limit(200).collect()))
    return df
