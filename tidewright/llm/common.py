"""Shared pieces of the corpus operators: tables in the shared folder, Arrow buffers, hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a regex class body (Java and Python agree on it) and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\v\f\r"

_written: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB where the session has the default of 64 MB: texts are long, and each task holds several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (str(64 << 20), f"{64 << 20}b", "64MB", "64m"):
        spark.conf.set(key, "4m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the session is on one machine, as in tests, a folder of this machine is taken.
    """
    bound_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy", row_group: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage is cut and survives lost executors.

    ``row_group``: bytes of a row group, where rows are large; a reader holds one at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path, compression=compression)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables that ``materialize`` has written in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may have ended
            continue


atexit.register(release)


def byte_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    return byte_list(batch.column(name))


def byte_list(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def as_struct(docs: DataFrame, name: str) -> Column:
    """All columns of ``docs`` in one, so that names of an operator's own can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def free_names(taken: list[str], wanted: tuple[str, ...]) -> list[str]:
    """``wanted``, with underscores put before a name until no column has it, whatever its case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def pieces(batches, rows: int = 1000):
    """The same rows in batches of at most ``rows``, so that few texts are held as Python objects at a time."""
    for b in batches:
        if b.num_rows <= rows:
            yield b
        else:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    give_back()


def gather(batches, most: int):
    """Consecutive batches put together to about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers stay on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_kept: dict = {}


def kept(owner: str, key, make):
    """What ``make`` made for this owner and key in this worker. One operator's things at a time: workers are reused, their memory is shared."""
    if (owner, key) not in _kept:
        _kept.clear()
        _kept[owner, key] = make()
    return _kept[owner, key]


def chunks(sizes: list[int], most: int):
    """Slices of consecutive rows whose sizes sum to about ``most``; a larger row stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in all workers."""
    return np.fromiter(map(kept("words", 0, _WordHashes).__getitem__, words), np.uint64, len(words))
