"""Incremental graph loads: a stream of N-Quads files into a table, each quad once, resuming from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.operators.quads import KEYS
from quadrille.sources.nquads import parse_nquads


def load_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Process what is new in ``source`` and stop. A batch that is tried again overwrites its own part of the target."""

    def write(batch: DataFrame, i: int) -> None:
        parse_nquads(batch).distinct().write.mode("overwrite").parquet(f"{target}/batch={i:08d}")

    query = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """The graph so far, a set of quads."""
    return spark.read.parquet(target).select(KEYS).distinct()
