"""Near duplicates of embeddings: spherical k-means cells, blocked cosines, one representative a group.

Only vectors of one label (and one dimension) are compared. Identical vectors are one point with a weight. Unit
centroids are fitted on a hashed sample of about ``fit_rows`` points; every point is owned by its nearest cell. If
x is owned by cell i and y by cell j, and their cosine reaches the threshold, then |x - y| <= d with
d = sqrt(2 - 2 * threshold), so y . (c_j - c_i) <= d * |c_j - c_i|. A point is therefore also a guest in each cell i
below its own that meets this, and two points that link meet once: in their cell, or in the lower one of their two,
where the link counts for both. Nothing is lost. Cells are cut into tiles, and a task multiplies one tile of owners
with one of members, in double precision; it returns link counts and a spanning forest of the links it saw, not the
pairs.

Vectors that are null, empty, zero or hold a null or non-finite component, and vectors without a label, link with
nothing. Equal rows count as copies of each other; different vectors under one vec_id act as one vertex. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.graph import components
from quadrille.llm.shared import Scratch, arrow_map

TILE = 1024

#: A table of cells up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000


def fit_cells(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; starts are spread over the rows, empty cells keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def local_forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n vertices over the edges (rows, cols)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, rows, low[cols])
        np.minimum.at(new, cols, low[rows])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_vectors(vectors: DataFrame, threshold: float = 0.98, fit_rows: int = 20000, points_per_cell: int = 1024, max_cells: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embed-dedup")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda e: e + 0.0))).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    rows = scratch.save(rows, "rows")
    points = rows.where("h IS NOT NULL").groupBy("label", "h", "v").agg(F.min("vec_id").alias("point"), F.count("*").alias("weight"))
    points = scratch.save(points, "points")
    n_points = points.count()
    dim = points.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1_000_000, max(1, fit_rows * 1_000_000 // max(1, n_points)))
    sample = points.where((F.size("v") == dim["dim"]) & (F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1_000_000)) < share)).select("v").orderBy("v").collect()
    x = np.array([r["v"] for r in sample], float).reshape(len(sample), dim["dim"])
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    k = max(1, min(max_cells, n_points // points_per_cell, len(x)))
    centres = spark.sparkContext.broadcast(fit_cells(x, k) if len(x) and k > 1 else np.zeros((1, dim["dim"])))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def place():
        c = centres.value
        gap = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) * reach

        def step(b):
            v = [np.array(r, float) for r in b.column("v").to_pylist()]
            label, point, weight = (b.column(n).to_pylist() for n in ("label", "point", "weight"))
            out: list[list] = [[], [], [], [], [], []]
            for i, r in enumerate(v):
                r = r / np.abs(r).max()
                r = r / np.sqrt(r @ r)
                cells, own = [0], 0
                if len(r) == c.shape[1] and len(c) > 1:
                    near = c @ r
                    own = int(near.argmax())
                    cells = np.flatnonzero((near - near[own] + gap[own])[: own + 1] >= 0).tolist()
                for cell in cells:
                    for o, val in zip(out, (f"{label[i]}\0{len(r)}", cell, cell == own, point[i], weight[i], r.tobytes()), strict=True):
                        o.append(val)
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], ["kind", "cell", "own", "point", "weight", "u"])

        return step

    placed = scratch.save(arrow_map(points.select("label", "point", "weight", "v"), place, "kind string, cell int, own boolean, point long, weight long, u binary"), "placed")
    size = placed.groupBy("kind", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tm"), F.ceil(F.sum(F.col("own").cast("int")) / TILE).cast("int").alias("to")).where("to > 0")
    size = scratch.save(size, "sizes")
    tiled = placed.join(F.broadcast(size) if size.count() <= BROADCAST_ROWS else size, ["kind", "cell"])
    tile = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
    asks = tiled.where("own").select("kind", "cell", tile("to").alias("o"), F.explode(F.sequence(F.lit(0), F.col("tm") - 1)).alias("m"), F.lit(True).alias("ask"), "own", "point", "weight", "u")
    told = tiled.select("kind", "cell", F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("o"), tile("tm").alias("m"), F.lit(False).alias("ask"), "own", "point", "weight", "u")

    def compare(group: pa.Table) -> pa.Table:
        ask = group.column("ask").to_numpy()
        point, weight = group.column("point").to_numpy(), group.column("weight").to_numpy()
        u = np.frombuffer(b"".join(group.column("u").to_pylist()), float).reshape(len(point), -1)
        a, b = np.flatnonzero(ask), np.flatnonzero(~ask)
        i, j = np.nonzero(u[a] @ u[b].T >= threshold)
        ids, back = np.unique(point, return_inverse=True)
        x, y = back[a][i], back[b][j]
        guest = ~group.column("own").to_numpy()[b][j]  # asks nowhere itself for these links
        n = np.bincount(x, weights=weight[b][j], minlength=len(ids)) + np.bincount(y[guest], weights=weight[a][i][guest], minlength=len(ids))
        return pa.table({"point": ids, "n": n.astype(np.int64), "low": ids[local_forest(x, y, len(ids))]})

    tiles = asks.unionByName(told).repartition("kind", "cell", "o", "m")  # else all tiles of a cell may stay where its join put them
    seen = scratch.save(tiles.groupBy("kind", "cell", "o", "m").applyInArrow(compare, "point long, n long, low long"), "seen")
    counts = seen.groupBy("point").agg((F.sum("n") - 1).alias("n_links"))
    reach_of = components(seen.where("point <> low").select(F.col("point").alias("a"), F.col("low").alias("b")), scratch, "links").toDF("point", "component_id")
    named = points.select("label", "h", "v", "point").join(counts, "point").join(reach_of, "point", "left")
    named = named.select(F.col("label").alias("l"), F.col("h").alias("g"), F.col("v").alias("w"), "n_links", F.coalesce("component_id", "point").alias("component_id"))
    out = rows.join(named, (F.col("h") == F.col("g")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
