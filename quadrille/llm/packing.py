"""Packing token sequences by non-negative least squares on the length histogram.

Each document becomes ids with an end id. Full windows are sequences of their own. Lengths of what remains are
counted in bins of ``step`` ids (256 numbers, whatever the corpus); combinations of up to three bins that fill a
window exactly are enumerated, repeat counts are solved against the histogram by non-negative least squares and
rounded down, and documents take the slots of their bin in order of a salted rank. What the solution leaves over
is packed greedily: laid end to end and cut at every window. Only the last of these windows may be short; it is
padded unless its length is a power of two, as are the gaps of less than ``step`` ids a slot.

Ranks and running sums come from salted groups whose totals are summed apart, so no key gathers in one task.
Null and empty texts are one end id. Rows repeating a doc_id are packed one by one; extra columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.shared import ROWS_A_FILE, Scratch, arrow_map, text_slices
from quadrille.llm.tokens import encoder, public_path

LEAST_SALTS, ROWS_A_SALT, PIECES_A_FILE = 64, 100_000, 20_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        if not len(pull) or pull.max() <= tol:
            break
        free[int(pull.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                break
            low = z <= 0
            now = x[at]
            share = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            x[at] = now + share * (z - now)
            free[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            x[~free] = 0
            if not free.any():
                z, at = np.zeros(0), np.zeros(0, int)
                break
        x[:] = 0
        x[at] = z
    return x


def shallow_mixes(bins: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Every combination of one to three of the present bins (1 .. bins) whose sum is ``bins``, largest first."""
    has = set(np.flatnonzero(present[1:]) + 1)
    out = [(bins,)] if bins in has else []
    for a in sorted(has, reverse=True):
        if (bins - a) in has and bins - a <= a:
            out.append((a, bins - a))
        for b in sorted(x for x in has if x <= a):
            c = bins - a - b
            if 0 < c <= b and c in has:
                out.append((a, b, c))
    return out


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, times) that together use no bin more often than counts[bin]."""
    bins = len(counts) - 1
    mixes = shallow_mixes(bins, counts > 0)
    if not mixes:
        return []
    a = np.zeros((bins, len(mixes)))
    for j, m in enumerate(mixes):
        for b in m:
            a[b - 1, j] += 1
    scale = max(1.0, float(counts.max()))
    x = nnls(a, counts[1:] / scale) * scale
    left, out = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        need = np.bincount(mixes[j], minlength=bins + 1)
        used = np.flatnonzero(need)
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // need[used]).min()))
        if times > 0:
            left -= times * need
            out.append((mixes[j], times))
    return out


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def make():
        enc = encoder(path, end_id)

        def step(b):
            for i in range(0, b.num_rows, 500):
                raw = enc.encode(b.column(1).slice(i, 500).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([_narrow(r) for r in raw], pa.binary())], ["doc_id", "n", "ids"])

        return step

    return arrow_map(text_slices(docs), make, "doc_id long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def _narrow(raw: bytes) -> bytes:
    """Ids as 16 bits where all fit, marked by a leading byte."""
    ids = np.frombuffer(raw, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) and ids.max() < 1 << 16 else b"\4" + raw


def ids_of(stored: bytes, start: int, length: int) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", length, 1 + stored[0] * start).astype("<u4")


def _running(df: DataFrame, value: str, name: str, key: str = "row") -> DataFrame:
    """Adds the sum of ``value`` over all rows before each, in the order (salt, key)."""
    w = Window.partitionBy("salt").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("salt").agg(F.sum(value).alias("all"))
    before = totals.select("salt", F.coalesce(F.sum("all").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return df.join(F.broadcast(before), "salt").withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("before")).drop("before")


def assign(lengths: DataFrame, window: int, step: int, salts: int) -> DataFrame:
    """lengths: row, n. Pieces (row, start, length, sequence_id, offset)."""
    spark = lengths.sparkSession
    bins = window // step
    rows = lengths.select("row", "n", F.floor(F.col("n") / window).alias("full"), (F.col("n") % window).alias("rest"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    rows = _running(rows, "full", "full_before")
    whole = rows.where("full > 0").select("row", F.posexplode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("k", "_"), "full_before")
    whole = whole.select("row", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_full = rows.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    tails = rows.where("rest > 0").select("row", "salt", "n", "rest", F.ceil(F.col("rest") / step).cast("int").alias("bin"))
    counts = np.zeros(bins + 1, np.int64)
    by_salt = tails.groupBy("bin", "salt").agg(F.count("*").alias("c"))
    for r in by_salt.groupBy("bin").agg(F.sum("c").alias("c")).collect():  # at most window / step rows
        counts[r["bin"]] = r["c"]
    slots, taken, sequence = [], np.zeros(bins + 1, np.int64), int(n_full)
    for mix, times in plan(counts):
        for slot, b in enumerate(mix):
            slots.append((int(b), int(taken[b]), int(taken[b] + times), sequence, slot))
            taken[b] += times
        sequence += times
    table = spark.createDataFrame(slots, "bin int, first long, past long, sequence long, slot int")

    # the rank of a row in its bin: within its salt, plus the salts before
    offsets = by_salt.select("bin", "salt", F.coalesce(F.sum("c").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = tails.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("row")))
    ranked = ranked.join(F.broadcast(offsets), ["bin", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    hit = ranked.join(F.broadcast(table), (ranked["bin"] == table["bin"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left")
    hit = hit.select("row", "salt", "n", "rest", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "slot")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = hit.where("slot IS NOT NULL").withColumn("offset", F.coalesce(F.sum("rest").over(inside), F.lit(0)))
    packed = packed.select("row", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), "sequence_id", "offset")

    over = _running(hit.where("slot IS NULL").select("row", "salt", "n", "rest"), "rest", "at")
    over = over.withColumn("w", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("rest") - 1) / window))))
    begin, end = F.greatest("at", F.col("w") * window), F.least(F.col("at") + F.col("rest"), (F.col("w") + 1) * window)
    cut = over.select("row", (F.col("n") - F.col("rest") + begin - F.col("at")).alias("start"), (end - begin).alias("length"), (F.col("w") + sequence).alias("sequence_id"), (begin - F.col("w") * window).alias("offset"))
    return whole.unionByName(packed).unionByName(cut)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, window: int = 4096, step: int = 16, salts: int | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded[, ids]).

    padded: what the piece's sequence is padded to: its own length if that is a power of two, else the window.
    """
    if window % step:
        raise ValueError("step must divide the window")
    scratch = Scratch(docs.sparkSession, "packing")
    stored = scratch.save(_encoded(docs, vocabulary or public_path("word_bpe_49k.json"), end_id), "ids")
    lengths = stored.select("row", "n")  # two columns of the stored table
    rows, windows = lengths.agg(F.count("*"), F.coalesce(F.sum(F.floor(F.col("n") / window)), F.lit(0))).first()
    salts = salts or max(LEAST_SALTS, -(-rows // ROWS_A_SALT))
    # a document has its full windows and a rest, which at most one more window cuts
    pieces = scratch.save(assign(lengths, window, step, salts), "pieces", windows + 2 * rows, PIECES_A_FILE)
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    padded = F.when(F.col("filled").bitwiseAND(F.col("filled") - 1) == 0, F.col("filled")).otherwise(F.lit(window))
    placed = pieces.join(filled.select("sequence_id", padded.cast("long").alias("padded")), "sequence_id")
    per_row = placed.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "padded")).alias("pieces"))
    joined = stored.join(per_row, "row").select("doc_id", "n", "ids", "pieces").coalesce(max(1, -(-rows // ROWS_A_FILE)))

    def make():
        def step(b):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded", "ids")}
            for doc_id, n, ids, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = ids.as_py()
                for p in sorted(ps, key=lambda p: p["start"]):
                    part = ids_of(raw, p["start"], p["length"])
                    for k, v in (("doc_id", doc_id), ("doc_tokens", n), ("ids_crc32", zlib.crc32(part.tobytes())), ("ids", part.astype(np.int32) if with_ids else None), *p.items()):
                        out[k].append(v)
            names = [k for k in out if with_ids or k != "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k in names], names)

        return step

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"
    return arrow_map(joined, make, schema + ", ids array<int>" * with_ids)
