"""Exact duplicates by a stream whose keyed state lives on disk.

Texts are equal when they are equal without the characters [\\x20\\x09-\\x0D]. Each document's digest, id and length
stream into RocksDB state keyed by digest. The state has no watermark and never expires; it holds the number of
documents, the stable identifier (the least doc_id among the longest originals) and the locator of the content that
hits are held against (the least doc_id of all). Partial sums before the shuffle bring a digest's copies down to one
row a task, however many there are. On every hit the full normalised bytes are then compared with those at the
locator; should a digest ever stand for two texts, its documents are grouped anew by their bytes.

Null text counts as empty, and empty texts are equal. A null doc_id counts as larger than any other. Rows repeating a
doc_id are counted each; those with equal texts share a verdict, and ``drop_exact`` keeps one of them (the longest
original, then the least by the other columns' hash). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import NO_ID, ROWS_A_FILE, Scratch, own_names

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
KEYS_A_FILE = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _best(*more: Column) -> list[Column]:
    # the longest original first, then the smallest id
    return [F.count("*").alias("n"), F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus_id"))).alias("best"), *more]


def stream_state(keys: DataFrame, scratch: Scratch, files_per_batch: int = 64) -> DataFrame:
    """Run the stored table ``keys`` (digest, doc_id, n_points) through keyed state; returns the state: (digest, n, keep_id, locator)."""
    spark, source, out = keys.sparkSession, scratch.path("keys"), scratch.path("state")
    # one memory bound for all stores of an executor, each closed after its task; no preallocated log files, of which
    # many small stores would hold gigabytes; a checkpoint that any Hadoop file system can hold
    streaming = "spark.sql.streaming."
    rocks = streaming + "stateStore.rocksdb."
    conf = {streaming + "stateStore.providerClass": ROCKS, rocks + "boundedMemoryUsage": "true", rocks + "maxMemoryUsageMB": "200", rocks + "allowFAllocate": "false", rocks + "changelogCheckpointing.enabled": "true", streaming + "stateStore.unloadOnCommit": "true", streaming + "checkpointFileManagerClass": FILES}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        counted = stream.groupBy("digest").agg(*_best(F.min("doc_id").alias("locator")))

        def emit(batch: DataFrame, i: int) -> None:
            batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i:06d}")

        query = counted.writeStream.outputMode("update").option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        batches = query.lastProgress["batchId"] + 1 if query.lastProgress else 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, n long, best struct<n_points:int,minus_id:bigint>, locator long"
    said = ("digest", "n", "-best.minus_id AS keep_id", "locator")
    if not batches:
        return spark.createDataFrame([], schema).selectExpr(*said)
    # a digest's row of the latest batch is its state
    rows = spark.read.schema(f"{schema}, batch int").parquet(*[f"{out}/batch={i:06d}" for i in range(batches)])
    if batches == 1:
        return rows.selectExpr(*said)
    last = rows.groupBy("digest").agg(F.max("n").alias("n"), F.max("best").alias("best"), F.min("locator").alias("locator"))
    return scratch.save(last.selectExpr(*said), "groups")


def _groups(docs: DataFrame, digest, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, digest, n, keep_id) of every document, NO_ID for null; the stored keys and their number. Digests of a clash are drawn out by the text."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    body = texts.select("doc_id", normalised(F.col("text")).alias("norm"), F.char_length("text").alias("n_points"))
    keys = scratch.save(body.select(digest(F.col("norm")).alias("digest"), "doc_id", "n_points"), "keys")
    rows = keys.count()
    state = stream_state(keys, scratch)
    multi = state.where("n > 1").select("digest", "keep_id", "locator")
    # merge joins: a digest with a large share of all rows is split by adaptive execution
    hits = scratch.save(keys.join(multi.hint("merge"), "digest").select("doc_id", "digest").distinct(), "hits", rows, KEYS_A_FILE)
    norms = body.select("doc_id", "norm")
    # full bytes of each hit against those at its digest's locator
    located = norms.join(multi.select("digest", F.col("locator").alias("doc_id")), "doc_id").where(digest(F.col("norm")) == F.col("digest"))
    located = located.select("digest", F.col("norm").alias("kept_norm")).dropDuplicates(["digest"])
    seen = hits.join(norms, "doc_id").where(digest(F.col("norm")) == F.col("digest")).join(located.hint("merge"), "digest")
    clash = scratch.save(seen.where("norm <> kept_norm").select("digest").distinct(), "clash", rows, KEYS_A_FILE)
    placed = keys.join(state.select("digest", "n", "keep_id").hint("merge"), "digest").select("doc_id", "digest", "n", "keep_id")
    if clash.isEmpty():
        return placed, keys, rows
    again = body.withColumn("digest", digest(F.col("norm"))).join(clash, "digest", "left_semi").withColumn("digest", F.concat("digest", F.lit(":"), "norm"))
    again = scratch.save(again.select("doc_id", "digest", "n_points"), "again")
    regrouped = again.groupBy("digest").agg(*_best()).selectExpr("digest", "n", "-best.minus_id AS keep_id")
    return placed.join(clash, "digest", "left_anti").unionByName(again.join(regrouped, "digest").select("doc_id", "digest", "n", "keep_id")), keys, rows


def exact_groups(docs: DataFrame, digest=sha256_of, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every document. ``digest`` maps normalised text to a string."""
    out, _, _ = _groups(docs, digest, scratch or Scratch(docs.sparkSession, "exact-dedup"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(known("doc_id"), known("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.substring_index("digest", ":", 1).alias("digest"))


def exact_report(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).withColumnRenamed("digest", "text_sha256")


def drop_exact(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """docs without the rows that another one stands for. Rows are told by doc_id and text, so that one doc_id may have several texts."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    groups, keys, rows = _groups(docs, digest, scratch)
    i, d, t, n, row = own_names(docs, "id", "digest", "text", "n", "row")
    gone = scratch.save(groups.where("doc_id <> keep_id").select(F.col("doc_id").alias(i), F.col("digest").alias(d)).distinct(), "gone", rows, KEYS_A_FILE)
    repeated = scratch.save(keys.groupBy(F.col("doc_id").alias(i), F.col("digest").alias(d)).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n), "repeated", rows, KEYS_A_FILE)
    clashed = F.instr(F.col(d), ":") > 0
    norm = normalised(F.col("text"))
    out = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(d, digest(norm)).join(gone.where(~clashed), [i, d], "left_anti")
    if not gone.where(clashed).isEmpty():
        out = out.withColumn(t, F.concat(d, F.lit(":"), norm)).join(gone.where(clashed).withColumnRenamed(d, t), [i, t], "left_anti")
    if not repeated.isEmpty():
        order = F.struct(F.char_length(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns))
        one = out.join(repeated, [i, d], "left_semi").groupBy(i, d, norm.alias(t)).agg(F.max_by(F.struct(*docs.columns), order).alias(row))
        out = out.join(repeated, [i, d], "left_anti").select(docs.columns).unionByName(one.select(f"{row}.*"))
    return out.select(docs.columns).coalesce(max(1, -(-rows // ROWS_A_FILE)))
