"""Enrichment: links, dates, titles, equivalences, metadata sets and media types, each as the quads it would add."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import tables
from quadrille.functions.scalars import clean_mime, date_in_words, normalize_date
from quadrille.functions.terms import PREFIX, iri
from quadrille.operators.quads import Quads, edges, having, instances, new_only, pattern, quad_rows, without

GRAPH = PREFIX["ex"] + "graph/updated_relations"
SIXTY_FOUR = "^[a-fA-F0-9]{64}$"


def _hashes(q: Quads) -> DataFrame:
    """(i, hash, g) of Instantiations with a well-formed hash, within one graph."""
    h = edges(q, "bodi:hasHashCode", "i", "f", graph=True).join(edges(q, "rdf:value", "f", "hash", graph=True), ["f", "g"])
    return h.where(F.col("hash").rlike(SIXTY_FOUR)).select("i", "hash", "g").distinct()


def same_hash_links(q: Quads, pairs: bool = False) -> DataFrame:
    """(a, b) of Instantiations with one hash in one graph. By default each of a group and its least member, both ways, so that a
    hash of n files gives 2 (n - 1) links that connect the same; ``pairs``: every ordered pair, n (n - 1)."""
    h = _hashes(q)
    if pairs:
        other = h.select(F.col("i").alias("b"), "hash", "g")
        return h.select(F.col("i").alias("a"), "hash", "g").join(other, ["hash", "g"]).where("a <> b").select("a", "b").distinct()
    least = h.groupBy("hash", "g").agg(F.min("i").alias("m"), F.count("*").alias("n")).where("n > 1").select("hash", "g", "m")
    star = h.join(least, ["hash", "g"]).where("i <> m").select("i", "m")
    return star.select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("m").alias("b")), F.struct(F.col("m").alias("a"), F.col("i").alias("b")))).alias("x")).select("x.*").distinct()


def same_hash_groups(q: Quads) -> DataFrame:
    """What the links say, without a row a pair: each hash with its members and number of ordered links."""
    n = _hashes(q).groupBy("hash").agg(F.countDistinct("i").alias("n")).where("n > 1")
    return n.select("hash", "n", (F.col("n") * (F.col("n") - 1)).alias("links"))


def fields_of(q: Quads, *labels: str) -> DataFrame:
    """(i, label, raw): values of the metadata fields with these labels."""
    kinds = edges(q, "rdfs:label", "t", "label").where(F.col("label").isin(list(labels))).distinct()
    of_kind = edges(q, "bodi:hasTechnicalMetadataType", "tm", "t").join(F.broadcast(kinds), "t")  # no more rows than types bear these labels
    rows = of_kind.join(edges(q, "rdf:value", "tm", "raw"), "tm").join(edges(q, "bodi:hasTechnicalMetadata", "i", "tm"), "tm")
    return rows.select("i", "label", "raw")


def dates(q: Quads, field: str, owner: str | None = None, through: str | None = "rico:hasOrHadInstantiation") -> DataFrame:
    """(entity, raw, day): normalised values of a metadata field, of instantiations or of what stands above them."""
    tm = fields_of(q, field)
    rows = tm.join(edges(q, through, "entity", "i"), "i") if through else tm.withColumn("entity", F.col("i"))
    rows = having(rows, instances(q, owner, name="entity"), "entity") if owner else rows
    return rows.select("entity", "raw", normalize_date(F.col("raw")).alias("day")).where("day IS NOT NULL").distinct()


def fallback_dates(q: Quads, field: str = "st_mtime", preferred: str = "dcterms:modified") -> DataFrame:
    """Dates of the file system for what has no preferred field on any instantiation."""
    told = fields_of(q, preferred).join(edges(q, "rico:hasOrHadInstantiation", "entity", "i"), "i")
    return without(dates(q, field), told, "entity")


def date_quads(found: DataFrame, edge: str, inverse: str, source: str | None = None) -> DataFrame:
    """One Date node a day, both edges to each entity."""
    d = F.concat(F.lit(PREFIX["ex"] + "date/"), F.replace("day", F.lit("-"), F.lit("")))
    days = found.select("day").distinct()
    specs = [(d, "rdf:type", iri("rico:Date"), "iri"), (d, "rico:normalizedDateValue", F.col("day"), "lit"), (d, "rico:expressedDate", date_in_words(F.col("day")), "lit")]
    if source:
        specs.append((d, "rico:type", f"Derived from {source} metadata", "lit"))
    links = quad_rows(found.select("entity", "day").distinct(), GRAPH, (F.col("entity"), edge, d, "iri"), (d, inverse, F.col("entity"), "iri"))
    return links.unionByName(quad_rows(days, GRAPH, *specs))


def titles(q: DataFrame) -> DataFrame:
    """Title nodes of labelled Records and RecordSets."""
    rows = having(pattern(q, "rdfs:label", "e", "label"), instances(q, "rico:Record", "rico:RecordSet", name="e"), "e")
    t = F.concat("e", F.lit("_title"))
    return quad_rows(rows, GRAPH, (F.col("e"), "rico:hasOrHadTitle", t, "iri"), (t, "rico:isOrWasTitleOf", F.col("e"), "iri"), (t, "rdf:type", F.lit(iri("rico:Title")), "iri"), (t, "rdfs:label", F.col("label"), "lit")).distinct()


def equivalence_table(spark: SparkSession, groups: list[list[str]] | None = None) -> DataFrame:
    """(group_id, label); read.csv of the same shape does as well."""
    return spark.createDataFrame([(k, x) for k, g in enumerate(tables.EQUIVALENT if groups is None else groups) for x in g], "group_id int, label string")


def equivalent_types(q: Quads, groups: DataFrame) -> DataFrame:
    """owl:sameAs pairs (a < b) of types whose labels share a group. groups: group_id, label; the least IRI stands for a label."""
    one = having(edges(q, "rdfs:label", "t", "label"), instances(q, "bodi:TechnicalMetadataType", name="t"), "t").groupBy("label").agg(F.min("t").alias("t"))
    named = one.join(groups, "label")
    return named.select("group_id", F.col("t").alias("a")).join(named.select("group_id", F.col("t").alias("b")), "group_id").where("a < b").select("a", "b").distinct()


def set_iri(name: Column) -> Column:
    return F.concat(F.lit(PREFIX["ex"] + "metadataset/"), name)


def set_nodes(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(tables.SETS, "name string, label string")
    return quad_rows(rows, GRAPH, (set_iri(F.col("name")), "rdf:type", iri("bodi:TechnicalMetadataTypeSet"), "iri"), (set_iri(F.col("name")), "rdfs:label", F.col("label"), "lit"))


def field_set(fields: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """fields: label. sets: field, set, priority. The set of the least priority that lists the field; st_* are the file
    system's, the rest Other. Without a table, parts of the name tell (tables.SET_RULES)."""
    system = F.startswith("label", F.lit("st_"))
    if sets is None:
        kind = F.lit("Other")
        for name, rx in reversed(tables.SET_RULES):
            kind = F.when(F.col("label").rlike(rx), F.lit(name)).otherwise(kind)
        return fields.select("label", F.when(system, F.lit("FileSystemMetadata")).otherwise(kind).alias("set"))
    best = sets.groupBy("field").agg(F.min_by("set", "priority").alias("set"))
    out = fields.join(best, F.col("label") == F.col("field"), "left")
    return out.select("label", F.when(system, F.lit("FileSystemMetadata")).otherwise(F.coalesce("set", F.lit("Other"))).alias("set"))


def set_membership(q: Quads, sets: DataFrame | None = None) -> DataFrame:
    """Each type of metadata in its set, both ways, unless it is in one already."""
    kinds = having(pattern(q, "rdfs:label", "t", "label"), instances(q, "bodi:TechnicalMetadataType", name="t"), "t")
    kinds = without(kinds, edges(q, "rico:isOrWasPartOf", "t", "x"), "t")
    rows = kinds.join(field_set(kinds.select("label").distinct(), sets), "label")
    x = set_iri(F.col("set"))
    return quad_rows(rows, GRAPH, (F.col("t"), "rico:isOrWasPartOf", x, "iri"), (x, "rico:hasOrHadPart", F.col("t"), "iri"))


def media_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tables.MEDIA_LABELS, "mime string, label string")


def media_types(q: Quads, labels: DataFrame, fields: tuple[str, ...] = ("Content-Type",)) -> DataFrame:
    """(inst, mime, label): the first clean media type of each instantiation, in order of field, then value."""
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("label"))
    rows = fields_of(q, *fields).select(F.col("i").alias("inst"), order.alias("rank"), clean_mime(F.col("raw")).alias("mime")).where("mime IS NOT NULL")
    first = rows.groupBy("inst").agg(F.min(F.struct("rank", "mime")).alias("m")).select("inst", "m.mime")
    return first.join(labels.select(F.col("mime"), F.col("label")), "mime", "left").select("inst", "mime", F.coalesce("label", F.lit("Unknown file")).alias("label"))


def media_type_quads(q: Quads, labels: DataFrame, fields: tuple[str, ...] = ("Content-Type",)) -> DataFrame:
    """rico:type of Instantiations that have none yet."""
    rows = without(media_types(q, labels, fields), edges(q, "rico:type", "inst", "x"), "inst")
    return quad_rows(rows, GRAPH, (F.col("inst"), "rico:type", F.col("label"), "lit"))


def link_quads(pairs: DataFrame, edge: str) -> DataFrame:
    return quad_rows(pairs, GRAPH, (F.col("a"), edge, F.col("b"), "iri"))


DATED = ("rico:hasCreationDate", "rico:isCreationDateOf"), ("rico:hasModificationDate", "rico:isModificationDateOf")


def enrich(q: Quads, only: set[str] | None = None, equivalences: DataFrame | None = None, sets: DataFrame | None = None, labels: DataFrame | None = None, pairs: bool = False) -> DataFrame:
    """All quads the operators would add and the graph lacks; adding them twice adds nothing."""
    spark = q.sparkSession
    created, modified = DATED
    ops = {
        "hashes": lambda: link_quads(same_hash_links(q, pairs), "owl:sameAs"),
        "creation": lambda: date_quads(dates(q, "dcterms:created", "rico:Record"), *created, "embedded"),
        "modification": lambda: date_quads(dates(q, "dcterms:modified", "rico:Record"), *modified, "embedded"),
        "fallback": lambda: date_quads(fallback_dates(q), *modified, "file system"),
        "recordsets": lambda: date_quads(dates(q, "st_mtime", "rico:RecordSet"), *modified),
        "instantiations": lambda: date_quads(dates(q, "st_mtime", "rico:Instantiation", None), *modified),
        "titles": lambda: titles(q),
        "sameas": lambda: link_quads(equivalent_types(q, equivalence_table(spark) if equivalences is None else equivalences), "owl:sameAs"),
        "sets": lambda: set_nodes(spark),
        "membership": lambda: set_membership(q, sets),
        "media": lambda: media_type_quads(q, media_labels(spark) if labels is None else labels),
    }
    parts = [op() for name, op in ops.items() if only is None or name in only]
    if not parts:
        raise ValueError(f"none of {sorted(ops)} is asked for")
    wanted = functools.reduce(DataFrame.unionByName, parts)
    return new_only(wanted, q, "owl:sameAs", *created, *modified, "rdf:type", "rico:normalizedDateValue", "rico:expressedDate", "rico:type", "rico:hasOrHadTitle", "rico:isOrWasTitleOf", "rdfs:label", "rico:isOrWasPartOf", "rico:hasOrHadPart")


def first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
