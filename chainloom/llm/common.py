"""Shared pieces of the training-data operators: scratch tables, Arrow maps and hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.sources.scratch import discard, materialize, shared_dir

#: Rows and bytes in one Arrow batch at most (a longer row is a batch of its own); texts of a batch are in a worker's memory at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

__all__ = ["arrow_map", "batch", "discard", "doc_table", "fold", "materialize", "mix64", "most_frequent", "read", "shared_dir", "ship", "words"]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to executors that can't import it from PYTHONPATH or the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in paths or os.path.realpath(os.getcwd()) == os.path.realpath(root):
        return
    _SHIPPED.add(app)
    target = os.path.join(tempfile.mkdtemp(), "chainloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        top = os.path.join(root, "chainloom")
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after which the worker gives free memory back: workers stay for later tasks of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only GNU's C library has it
            pass

    return run


def most_frequent(counts: DataFrame, column: str, bound: int) -> list:
    """Rows with the largest ``column`` (a count), ``bound`` at most, all with a count over some limit.

    The limit comes from a histogram of the counts by eighths of powers of two, so no task sends rows that are not kept."""
    step = F.floor(F.log2(F.col(column)) * 8).cast("int")
    taken, limit = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        taken += r["count"]
        if taken > bound:
            break
        limit = r["step"]
    return [] if limit is None else counts.where(step >= limit).collect()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches. Spark has only settings of the session for their size."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(released(fn), schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def doc_table(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) with null texts as empty; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(column: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def words(text: str) -> list[bytes]:
    """Lower-cased A-Z, split at the ASCII white space \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x + _MUL
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
