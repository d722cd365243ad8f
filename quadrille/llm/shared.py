"""Scratch tables in the folder all executors share, and batch plumbing for Arrow functions."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_root() -> str:
    root = tempfile.mkdtemp(prefix="quadrille-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return "file://" + root


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one of our own, but only if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or _own_root()).rstrip("/")


#: Every file costs a writer, a listing entry and, on some file systems, processes for its permissions.
ROWS_A_FILE = 5000

#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1


class Scratch:
    """Intermediate tables of one run. A table in the shared folder cuts lineage and outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None, per_file: int = ROWS_A_FILE) -> DataFrame:
        """rows: a bound of how many there are, where one is known; a small table then takes few tasks and files."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_file)))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self, wait: float = 0.0) -> None:
        """Let go of what no plan refers to any more: generated classes, broadcasts and shuffle files, which Spark's cleaner only sees after a collection. wait: for it to finish."""
        for _ in range(2 if wait else 1):  # the first collection queues what the second one finds unreachable
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(wait)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names of our own for columns beside those of df."""
    taken = {c.lower() for c in df.columns}
    mark = next(k for k in range(1, len(taken) + 2) if not any(n + "_" * k in taken for n in names))
    return [n + "_" * mark for n in names]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None]], schema: str) -> DataFrame:
    """Apply a per-batch function; ``make`` runs once in each task, so state is set up there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch) or ()

    return df.mapInArrow(run, schema)


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def doc_ranges(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text makes a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_slices(df: DataFrame) -> DataFrame:
    """Just what text operators read, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
