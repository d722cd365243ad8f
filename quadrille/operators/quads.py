"""The quad model: patterns over (s, p, o, g, o_kind), and graph updates as functions that return a new table."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import TYPE, iri

SCHEMA = "s string, p string, o string, g string, o_kind string, o_dt string, o_lang string"
KEYS = ["s", "p", "o", "g", "o_kind", "o_dt", "o_lang"]


class Graph:
    """Quads by predicate: a pattern reads, or makes, the quads of its predicate alone.

    ``rows(p, objects)`` gives quads (KEYS) that include all of predicate p (an IRI; None for any) whose object is one of
    ``objects`` (None for any); it may give more, which patterns filter again.
    """

    def __init__(self, spark, rows: Callable[[str | None, tuple[str, ...] | None], DataFrame]):
        self.sparkSession, self._rows = spark, rows

    def rows(self, p: str | None = None, objects: tuple[str, ...] | None = None) -> DataFrame:
        out = self._rows(p, objects)
        out = out if p is None else out.where(F.col("p") == p)
        return out if objects is None else out.where(F.col("o").isin(list(objects)))

    @property
    def df(self) -> DataFrame:
        return self.rows()


Quads = DataFrame | Graph


def p_code(p: str) -> str:
    """The name of the part that a snapshot keeps a predicate in."""
    found = re.search(r"([^/#]+)$", p)
    return re.sub(r"[^A-Za-z0-9_]", "_", found[1] if found else "")


def rows_of(quads: Quads, p: str | None = None, objects: tuple[str, ...] | None = None) -> DataFrame:
    """The quads of a predicate; of a snapshot, one part is read."""
    if isinstance(quads, Graph):
        return quads.rows(p, objects)
    out = quads if p is None else quads.where(F.col("p") == p)
    if p is not None and "p_code" in quads.columns:
        out = out.where(F.col("p_code") == p_code(p))
    out = out if objects is None else out.where(F.col("o").isin(list(objects)))
    return out.select(KEYS)


def plus(*parts: Quads) -> Graph:
    """The quads of all parts; still by predicate."""
    return Graph(parts[0].sparkSession, lambda p, objects: functools.reduce(DataFrame.unionByName, [rows_of(x, p, objects) for x in parts]))


def name_of(p: str) -> str:
    return iri(p) if ":" in p and "//" not in p else p


def triples(quads: Quads) -> DataFrame:
    """The default graph: the merge of all graphs, each triple once."""
    return rows_of(quads).select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct()


def edges(quads: Quads, p: str, s: str = "s", o: str = "o", graph: bool = False) -> DataFrame:
    """A pattern whose rows may repeat: for the far side of ``having`` and ``without`` and under distinct counts."""
    return rows_of(quads, name_of(p)).select(F.col("s").alias(s), F.col("o").alias(o), *(["g"] if graph else []))


def pattern(quads: Quads, p: str, s: str = "s", o: str = "o", graph: bool = False) -> DataFrame:
    return edges(quads, p, s, o, graph).distinct()


def instances(quads: Quads, *classes: str, name: str = "s") -> DataFrame:
    """typed, with rows that may repeat."""
    return rows_of(quads, TYPE, tuple(iri(c) for c in classes)).select(F.col("s").alias(name))


def typed(quads: Quads, *classes: str, name: str = "s") -> DataFrame:
    return instances(quads, *classes, name=name).distinct()


def without(rows: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    return rows.join(other.select(*on), list(on), "left_anti")


def having(rows: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    return rows.join(other.select(*on), list(on), "left_semi")


def ask(rows: DataFrame, name: str = "answer") -> DataFrame:
    """One row, one boolean; reads no more than one row of each partition."""
    return rows.limit(1).agg((F.count("*") > 0).alias(name))


def insert(quads: Quads, new: DataFrame) -> DataFrame:
    return rows_of(quads).unionByName(new.select(KEYS)).distinct()


def new_only(new: DataFrame, quads: Quads, *predicates: str) -> DataFrame:
    """What an idempotent insert would add. predicates: those of ``new``, where they are known; only these are read."""
    old = [rows_of(quads, name_of(p)) for p in predicates] or [rows_of(quads)]
    old = functools.reduce(DataFrame.unionByName, old)
    return without(new.distinct(), old, "s", "p", "o", "g").select(new.columns)


def drop_graph(quads: Quads, g: str) -> DataFrame:
    return rows_of(quads).where(F.col("g") != g)


def clear(quads: Quads) -> DataFrame:
    return rows_of(quads).limit(0)


def replace_objects(quads: Quads, targets: DataFrame, p: str, value: Column, add_missing: bool = True) -> DataFrame:
    """targets (s, g): their objects of p become value; a target without one gains it if add_missing."""
    t = targets.select("s", "g").distinct()
    all_rows = rows_of(quads)
    rest, old = all_rows.where(F.col("p") != p), all_rows.where(F.col("p") == p)
    null = F.lit(None).cast("string")
    hit = t if add_missing else having(t, old, "s", "g")
    made = hit.select("s", F.lit(p).alias("p"), value.alias("o"), "g", F.lit("lit").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    return rest.unionByName(without(old, t, "s", "g").select(KEYS)).unionByName(made)


def rewrite(quads: Quads, p: str, values: DataFrame, places: DataFrame) -> DataFrame:
    """The quads of p after a change. values (s, value): the only object of s from now on, in every graph that held one and
    in those where s stands in ``places`` (s, g), so that a node without one gains it."""
    old = rows_of(quads, p)
    at = having(places.select("s", "g"), values, "s").unionByName(having(old.select("s", "g"), values, "s")).distinct()
    null = F.lit(None).cast("string")
    made = at.join(values, "s").select("s", F.lit(p).alias("p"), F.col("value").alias("o"), "g", F.lit("lit").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    return without(old, values, "s").select(KEYS).unionByName(made)


def graph_overview(quads: Quads) -> DataFrame:
    return rows_of(quads).groupBy("g").agg(F.count("*").alias("n_triples"), F.countDistinct("s").alias("n_subjects"))


def made_rows(rows: DataFrame, graph: str, specs: list, p: str | None = None, objects: tuple[str, ...] | None = None) -> DataFrame | None:
    """Quads from each row by (subject, predicate, object, kind[, condition]) in one pass, or None if no spec can give predicate p
    with one of these objects. An object given as a string is that string."""
    made = []
    for s, edge, o, kind, *cond in specs:
        if (p is not None and iri(edge) != p) or (objects is not None and isinstance(o, str) and o not in objects):
            continue
        value = F.lit(o) if isinstance(o, str) else o
        q = F.struct(s.alias("s"), F.lit(iri(edge)).alias("p"), value.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
        made.append(F.when(cond[0], q) if cond else q)
    if not made:
        return None
    out = rows.select(F.explode(F.array(*made)).alias("q")).where("q IS NOT NULL AND q.s IS NOT NULL AND q.o IS NOT NULL")
    null = F.lit(None).cast("string")
    return out.select("q.s", "q.p", "q.o", F.lit(graph).alias("g"), "q.o_kind", null.alias("o_dt"), null.alias("o_lang"))


def quad_rows(rows: DataFrame, graph: str, *specs: tuple) -> DataFrame:
    return made_rows(rows, graph, list(specs))


def made_graph(spark, *groups: tuple[Callable[[], DataFrame], str, list]) -> Graph:
    """A graph from groups of (rows, graph IRI, specs); a pattern makes what its predicate needs and nothing else."""

    def rows(p, objects):
        parts = [made_rows(make(), g, specs, p, objects) for make, g, specs in groups if made_rows_any(specs, p, objects)]
        return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA).select(KEYS)

    return Graph(spark, rows)


def made_rows_any(specs: list, p: str | None, objects: tuple[str, ...] | None) -> bool:
    return any((p is None or iri(e) == p) and (objects is None or not isinstance(o, str) or o in objects) for _, e, o, *_ in specs)
