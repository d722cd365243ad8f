"""Redaction: who is protected, what is replaced, and the checks that close it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import tables
from quadrille.functions.terms import LABEL, TYPE, VALUE, iri
from quadrille.operators.quads import Graph, Quads, edges, having, rewrite, rows_of, without
from quadrille.sources.nquads import restore, snapshot
from quadrille.sources.scratch import stored

REDACTED = "redacted"
FLAG = iri("bodi:redactedInformation")


def entities(q: Quads) -> DataFrame:
    """(e, is_record, g) of every Record and RecordSet."""
    record, record_set = iri("rico:Record"), iri("rico:RecordSet")
    return rows_of(q, TYPE, (record, record_set)).select(F.col("s").alias("e"), (F.col("o") == record).alias("is_record"), "g").distinct()


def work_entities(q: Quads) -> DataFrame:
    """(e) of the Records and RecordSets that a work is related to."""
    works = rows_of(q, TYPE, (iri("lrmoo:F1_Work"),)).select(F.col("s").alias("w"))
    return having(having(edges(q, "rico:isRelatedTo", "w", "e"), works, "w"), entities(q), "e").select("e").distinct()


def classify(rows: DataFrame, works: DataFrame, allow: DataFrame, deny: DataFrame, near: DataFrame | None = None, default: str = "anonymise") -> DataFrame:
    """rows: e, is_record. Works and the allow list protect; what is denied or near a work is redacted unless protected; other Records follow ``default``."""
    protected = works.select("e").unionByName(allow.select("e")).distinct().withColumn("_p", F.lit(True))
    wanted = deny.select("e") if near is None else deny.select("e").unionByName(near.select("e"))
    rows = rows.join(protected, "e", "left").join(wanted.distinct().withColumn("_c", F.lit(True)), "e", "left")
    otherwise = F.when(F.col("is_record"), F.lit(default)).otherwise(F.lit("protect"))
    verdict = F.when(F.col("_p").isNotNull(), "protect").when(F.col("_c").isNotNull(), "anonymise").otherwise(otherwise)
    return rows.select("e", "is_record", verdict.alias("verdict"))


def neighbours(seeds: DataFrame, included: DataFrame) -> DataFrame:
    """One hop up or down from the seeds (e), without them. included: child, parent."""
    up = included.join(seeds.select(F.col("e").alias("child")), "child").select(F.col("parent").alias("e"))
    down = included.join(seeds.select(F.col("e").alias("parent")), "parent").select(F.col("child").alias("e"))
    return without(up.unionByName(down).distinct(), seeds, "e")


def of_types(q: Quads, labels: list[str]) -> DataFrame:
    """(s) metadata whose type bears one of the labels; may repeat."""
    kinds = edges(q, "rdfs:label", "t", "l").where(F.col("l").isin(labels)).select("t").distinct()
    return having(edges(q, "bodi:hasTechnicalMetadataType", "s", "t"), kinds, "t").select("s")


def changes(q: Quads, verdicts: DataFrame, author_types: list[str] | None = None, acceptable: Callable[[Column], Column] | None = None) -> DataFrame:
    """(s, p, value): what a redaction puts in place of the objects of p. Labels of redacted entities, of their titles and
    instantiations; labels and values of author metadata below them, and below protected entities where value and label
    together aren't ``acceptable``; a flag on every entity."""
    types = tables.AUTHORS if author_types is None else author_types
    verdicts = verdicts.select(F.col("e").alias("s"), "verdict").distinct()
    hit = verdicts.where("verdict = 'anonymise'").select("s")
    below = edges(q, "rico:hasOrHadInstantiation", "e", "i").join(verdicts.withColumnRenamed("s", "e"), "e").select("i", "verdict").distinct()
    title = having(edges(q, "rico:hasOrHadTitle", "e", "s"), hit.toDF("e"), "e").select("s")
    tm = edges(q, "bodi:hasTechnicalMetadata", "i", "s").join(below, "i").select("s", "verdict").distinct()
    tm = having(tm, of_types(q, types), "s")
    authors = tm.where("verdict = 'anonymise'").select("s")
    if acceptable is not None:
        theirs = tm.where("verdict = 'protect'").select("s")
        said = theirs.join(edges(q, "rdf:value", "s", "v"), "s").join(edges(q, "rdfs:label", "s", "l").groupBy("s").agg(F.max("l").alias("l")), "s", "left")
        authors = authors.unionByName(said.where((F.col("v") != REDACTED) & ~acceptable(F.concat_ws(" ", "v", "l"))).select("s"))
    put = lambda rows, p, word: rows.select("s", F.lit(p).alias("p"), F.lit(word).alias("value"))
    labels = hit.unionByName(title).unionByName(below.where("verdict = 'anonymise'").select(F.col("i").alias("s"))).unionByName(authors)
    flags = verdicts.select("s", F.lit(FLAG).alias("p"), F.when(F.col("verdict") == "anonymise", F.lit("yes")).otherwise(F.lit("no")).alias("value"))
    return put(labels, LABEL, REDACTED).unionByName(put(authors, VALUE, REDACTED)).unionByName(flags).distinct()


def apply(q: Quads, changed: DataFrame) -> Graph:
    """The graph with these changes (s, p, value). Only labels, values and flags are made anew; any other predicate is read as it was."""
    anew = [LABEL, VALUE, FLAG]

    def one(p):
        return rewrite(q, p, changed.where(F.col("p") == p).select("s", "value"), rows_of(q, TYPE))

    def rows(p, objects):
        if p is not None:
            return one(p) if p in anew else rows_of(q, p, objects)
        rest = rows_of(q).where(~F.col("p").isin(anew))
        for p in anew:
            rest = rest.unionByName(one(p))
        return rest

    return Graph(q.sparkSession, rows)


def redact(q: Quads, verdicts: DataFrame, folder: str, author_types: list[str] | None = None, acceptable: Callable[[Column], Column] | None = None) -> Graph:
    """The graph after redaction; its changes are worked out once and written below ``folder``."""
    return apply(q, stored(changes(q, verdicts, author_types, acceptable), f"{folder}/changes"))


def open_titles(q: Quads) -> DataFrame:
    """(title) of entities flagged as redacted whose titles still say something, in any graph."""
    gone = flagged(q, "yes")
    t = having(edges(q, "rico:hasOrHadTitle", "e", "title"), gone, "e").select("title").distinct()
    return having(t, edges(q, "rdfs:label", "title", "l").where(F.col("l") != REDACTED), "title")


def close_titles(q: Quads, folder: str) -> Graph:
    """The graph with those titles redacted."""
    return apply(q, stored(open_titles(q).select(F.col("title").alias("s"), F.lit(LABEL).alias("p"), F.lit(REDACTED).alias("value")), f"{folder}/titles"))


def flagged(q: Quads, word: str) -> DataFrame:
    return rows_of(q, FLAG, (word,)).select(F.col("s").alias("e")).distinct()


def redacted_work_entities(q: Quads, works: DataFrame) -> DataFrame:
    """Must be empty: entities of works that are flagged as redacted."""
    return having(flagged(q, "yes"), works, "e")


def redacted_metadata(q: Quads, protected_types: list[str] | None = None) -> DataFrame:
    """Must be empty: redacted values of types that stay."""
    return having(rows_of(q, VALUE, (REDACTED,)).select("s").distinct(), of_types(q, tables.PROTECTED if protected_types is None else protected_types), "s")


def protect(q: Quads, works: DataFrame, allow: DataFrame, deny: DataFrame, folder: str, acceptable: Callable[[Column], Column] | None = None, default: str = "anonymise", author_types: list[str] | None = None) -> tuple[Graph, DataFrame]:
    """The whole of it: classify, redact, close titles, and one row of checks; ok if no work is redacted and no protected metadata.

    works, allow, deny: e. Verdicts and the redacted graph are written below ``folder`` (shared by all executors); q stays as it is.
    """
    spark = q.sparkSession
    included = edges(q, "rico:isOrWasIncludedIn", "child", "parent").distinct()
    linked = stored(work_entities(q).unionByName(works.select("e")).distinct(), f"{folder}/works")
    verdicts = stored(classify(entities(q).select("e", "is_record").distinct(), linked, allow, deny, neighbours(linked, included), default), f"{folder}/verdicts")
    snapshot(redact(q, verdicts, folder, author_types, acceptable), f"{folder}/redacted")
    out = close_titles(restore(spark, f"{folder}/redacted"), folder)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    checks = n(redacted_work_entities(out, linked), "redacted_works").crossJoin(n(redacted_metadata(out), "redacted_protected")).crossJoin(n(open_titles(out), "open_titles"))  # one row each
    return out, checks.withColumn("ok", (F.col("redacted_works") == 0) & (F.col("redacted_protected") == 0))
