"""Structure, integrity, works and registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.scalars import ancestors, record_iri, record_kind, share, title_key
from quadrille.functions.terms import iri, kind_of_id
from quadrille.operators.quads import Graph, Quads, instances, made_graph, quad_rows, rows_of

# structure

def ordinals(entries: DataFrame) -> DataFrame:
    """entries: parent, name, is_dir. The place of each among the files, or the folders, of its parent by name without case."""
    w = Window.partitionBy("parent", "is_dir").orderBy(F.lower("name"), "name")
    return entries.withColumn("ordinal", F.row_number().over(w))


def child_ids(entries: DataFrame, parent_id: str = "parent_id") -> DataFrame:
    """Adds id: the parent's id with _R<n> for files and _RS<n> for folders."""
    return ordinals(entries).withColumn("id", F.concat(F.col(parent_id), F.when(F.col("is_dir"), F.lit("_RS")).otherwise(F.lit("_R")), F.col("ordinal").cast("string")))


def tree_ids(entries: DataFrame, root_id: str, root: str = "") -> DataFrame:
    """entries: path, is_dir, of all that lies below the folder ``root``, folders too. Adds name, parent, depth, id and parent_id.

    Ordinals are taken within each folder at once, and an id puts together those of the folders above: one join over the
    exploded ancestors, however deep the tree.
    """
    p = F.col("path")
    named = entries.select("*", F.substring_index(p, "/", -1).alias("name"), F.regexp_replace(p, "/[^/]*$", "").alias("parent"))
    placed = ordinals(named).withColumn("part", F.concat(F.when(F.col("is_dir"), F.lit("RS")).otherwise(F.lit("R")), F.col("ordinal").cast("string")))
    folders = placed.where("is_dir").select(F.col("path").alias("up"), "part")
    above = placed.select("path", F.explode(F.filter(ancestors(p), lambda a: F.length(a) > len(root))).alias("up"))
    chain = above.join(folders, "up").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.length("up").alias("n"), "part"))).alias("c"))  # as many as the path is deep
    out = placed.join(chain, "path", "left")
    ups = F.coalesce(F.transform("c", lambda x: x["part"]), F.array().cast("array<string>"))
    parent_id = F.concat_ws("_", F.lit(root_id), ups)
    return out.select(*[c for c in placed.columns if c not in ("ordinal", "part")], F.size(ups).alias("above"), parent_id.alias("parent_id"), F.concat_ws("_", parent_id, "part").alias("id")).withColumn("depth", F.col("above") + 1).drop("above")


def set_type(entry_id: Column, roots: tuple[str, ...] = ()) -> Column:
    """(name, label) of a RecordSet's type."""
    kind = lambda a, b: F.when(entry_id == "RS1", F.lit(a[0])).when(entry_id.isin(list(roots)) if roots else F.lit(False), F.lit(a[1])).otherwise(F.lit(b))
    return F.struct(kind(("archive-container", "root-container"), "folder").alias("name"), kind(("Archive Container", "Root Container"), "Folder").alias("label"))


def structure_specs(base: str, roots: dict[str, str] | None = None, made: str = "2025-01-01T00:00:00") -> list:
    """Specs over entries (id, parent_id, name, path, is_dir, depth, sha256): both trees, identifiers, types, locations, depths, hashes
    with their Activity and Algorithm, and all inverses. roots: id -> label of the media's containers; made: when hashes were taken."""
    roots = roots or {}
    x = lambda k, col="id": F.concat(F.lit(f"{base}{k}/"), F.col(col))
    one = lambda name: f"{base}{name}"
    rec, inst, up, up_inst, loc, fix, ident, act, day = (x("record"), x("inst"), x("record", "parent_id"), x("inst", "parent_id"), x("location"), x("fixity"), x("identifier"), x("hashing"), x("hashdate"))
    has, hashed, folder = F.col("parent_id").isNotNull(), F.col("sha256").isNotNull(), F.col("is_dir")
    label = F.col("name")
    for k, text in roots.items():
        label = F.when(F.col("id") == k, F.lit(text)).otherwise(label)
    kind = set_type(F.col("id"), tuple(roots))
    kind_iri = F.concat(F.lit(f"{base}recordSetType/"), kind["name"])
    at_root = F.col("id").isin(list(roots)) if roots else F.lit(False)
    store, medium = x("storage_location"), x("storage_medium")
    spoken = F.date_format(F.to_timestamp(F.lit(made)), "dd MMMM yyyy 'at' HH:mm")
    return [
        (rec, "rdf:type", F.when(folder, F.lit(iri("rico:RecordSet"))).otherwise(F.lit(iri("rico:Record"))), "iri"), (rec, "rdfs:label", label, "lit"),
        (rec, "rico:hasRecordSetType", kind_iri, "iri", folder), (kind_iri, "rico:isRecordSetTypeOf", rec, "iri", folder),
        (kind_iri, "rdf:type", iri("rico:RecordSetType"), "iri", folder), (kind_iri, "rdfs:label", kind["label"], "lit", folder),
        (rec, "rico:hasOrHadIdentifier", ident, "iri"), (ident, "rdf:type", iri("rico:Identifier"), "iri"), (ident, "rdfs:label", F.col("id"), "lit"), (ident, "rico:hasIdentifierType", one("idType/unique-id"), "iri"),
        (F.lit(one("idType/unique-id")), "rdf:type", iri("rico:IdentifierType"), "iri"), (F.lit(one("idType/unique-id")), "rdfs:label", "Unique identifier", "lit"),
        (inst, "rdf:type", iri("rico:Instantiation"), "iri"), (inst, "rdfs:label", label, "lit"),
        (rec, "rico:hasOrHadInstantiation", inst, "iri"), (inst, "rico:isOrWasInstantiationOf", rec, "iri"),
        (rec, "rico:isOrWasIncludedIn", up, "iri", has), (up, "rico:includesOrIncluded", rec, "iri", has),
        (inst, "rico:isOrWasPartOf", up_inst, "iri", has), (up_inst, "rico:hasOrHadPart", inst, "iri", has),
        (inst, "prov:atLocation", loc, "iri"), (loc, "rdf:type", iri("prov:Location"), "iri"), (loc, "rdfs:label", F.col("path"), "lit"),
        (inst, "bodi:hierarchyDepth", F.col("depth"), "lit"),
        (inst, "premis:storedAt", store, "iri", at_root), (store, "rdf:type", iri("premis:StorageLocation"), "iri", at_root), (store, "premis:medium", medium, "iri", at_root), (medium, "rdf:type", iri("premis:StorageMedium"), "iri", at_root),
        (fix, "rdf:type", iri("premis:Fixity"), "iri", hashed), (fix, "rdf:value", F.col("sha256"), "lit", hashed),
        (fix, "bodi:isHashCodeOf", inst, "iri", hashed), (inst, "bodi:hasHashCode", fix, "iri", hashed),
        (fix, "rico:hasCreator", one("algorithm/sha256"), "iri", hashed),
        (fix, "bodi:generatedBy", act, "iri", hashed), (act, "bodi:hasGenerated", fix, "iri", hashed),
        (act, "rdf:type", iri("rico:Activity"), "iri", hashed), (act, "rdfs:label", "Hash generation using SHA-256", "lit", hashed),
        (act, "rico:occurredAtDate", day, "iri", hashed), (day, "rico:isDateOfOccurrenceOf", act, "iri", hashed),
        (day, "rdf:type", iri("rico:Date"), "iri", hashed), (day, "rico:normalizedDateValue", made, "lit", hashed), (day, "rico:expressedDate", spoken, "lit", hashed),
        (act, "rico:isOrWasPerformedBy", one("algorithm/sha256"), "iri", hashed), (F.lit(one("algorithm/sha256")), "rico:performsOrPerformed", act, "iri", hashed),
        (F.lit(one("algorithm/sha256")), "rdf:type", iri("bodi:Algorithm"), "iri", hashed), (F.lit(one("algorithm/sha256")), "rdfs:label", "SHA-256", "lit", hashed), (F.lit(one("algorithm/sha256")), "rico:hasTechnicalCharacteristic", "SHA-256", "lit", hashed),
    ]


def structure_graph(entries: DataFrame, graph: str, base: str, roots: dict[str, str] | None = None, made: str = "2025-01-01T00:00:00") -> Graph:
    """The structure by predicate; shared nodes may repeat in its rows."""
    return made_graph(entries.sparkSession, (lambda: entries, graph, structure_specs(base, roots, made)))


def structure_quads(entries: DataFrame, graph: str, base: str, roots: dict[str, str] | None = None, made: str = "2025-01-01T00:00:00") -> DataFrame:
    return quad_rows(entries, graph, *structure_specs(base, roots, made)).distinct()


def root_container(spark: SparkSession, label: str, children: list[str]) -> DataFrame:
    """Entries for RS1 and, below it, the media's containers, to be united with theirs."""
    rows = [("RS1", None, label, "/", True, 0, None), *((c, "RS1", c, f"/{c}", True, 1, None) for c in children)]
    return spark.createDataFrame(rows, "id string, parent_id string, name string, path string, is_dir boolean, depth int, sha256 string")


def id_conflicts(entries: DataFrame) -> DataFrame:
    """Entries whose id says another kind than is_dir; there must be none."""
    return entries.where((kind_of_id(F.col("id")) == "RecordSet") != F.col("is_dir"))


def structure_balance(entries: DataFrame, q: Quads) -> DataFrame:
    """One row: entries, Records and RecordSets of the graph made from them, and whether they agree."""
    made = instances(q, "rico:Record", "rico:RecordSet").agg(F.countDistinct("s").alias("made"))
    return entries.agg(F.count("*").alias("expected")).crossJoin(made).withColumn("same", F.col("expected") == F.col("made"))  # one row each


# integrity

def recursive_counts(files: DataFrame) -> DataFrame:
    """files: path. How many files each directory holds at any depth, without a prefix join."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def check_counts(expected: DataFrame, counted: DataFrame) -> DataFrame:
    both = expected.toDF("dir", "expected").join(counted.toDF("dir", "counted"), "dir", "full_outer")
    both = both.where("NOT (coalesce(expected, 0) = 0 AND coalesce(counted, 0) = 0)")
    status = F.when(F.col("expected").isNull(), "ONLY_GRAPH").when(F.col("counted").isNull(), "MISSING").when(F.col("expected") == F.col("counted"), "MATCH").otherwise("DISCREPANCY")
    return both.withColumn("status", status)


def check_hashes(manifest: DataFrame, graph: DataFrame) -> DataFrame:
    """(path, sha256) on both sides; a manifest row without a hash is CORRUPTED."""
    m, g = manifest.select("path", F.col("sha256").alias("expected"), F.lit(True).alias("listed")), graph.select("path", F.col("sha256").alias("found"), F.lit(True).alias("there"))
    both = m.join(g, "path", "full_outer")
    status = F.when(F.col("listed").isNull(), "EXTRA").when(F.col("expected").isNull(), "CORRUPTED").when(F.col("there").isNull(), "MISSING").when(F.lower("expected") == F.lower("found"), "MATCH").otherwise("MISMATCH")
    return both.select("path", status.alias("status"))


def hash_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed, missing and new files; COMPROMISED needs a changed or missing one."""
    both = before.select("path", F.col("sha256").alias("original_hash")).join(after.select("path", F.col("sha256").alias("current_hash")), "path", "full_outer")
    kind = F.when(F.col("current_hash").isNull(), "MISSING").when(F.col("original_hash").isNull(), "NEW").when(F.col("original_hash") != F.col("current_hash"), "CHANGED")
    return both.withColumn("kind", kind).where("kind IS NOT NULL")


def count_verdict(checked: DataFrame) -> DataFrame:
    """One row: whether no directory is missing or differs; those only in the graph are borne."""
    bad = F.sum(F.col("status").isin("MISSING", "DISCREPANCY").cast("long"))
    return checked.agg(F.count("*").alias("directories"), F.coalesce(bad, F.lit(0)).alias("bad")).withColumn("ok", F.col("bad") == 0)


def integrity_verdict(checked: DataFrame) -> DataFrame:
    """One row: files of each status, the share that matches, and whether no hash differs; missing files are borne."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s.lower())
    out = checked.agg(F.count("*").alias("files"), *map(n, ("MATCH", "MISMATCH", "MISSING", "EXTRA", "CORRUPTED")))
    return out.select("*", share(F.col("match"), F.col("files")).alias("percent"), (F.col("mismatch") == 0).alias("ok"))


def drift_verdict(drift: DataFrame) -> DataFrame:
    """One row: COMPROMISED with changed or missing files, PARTIAL with new ones only, else OK."""
    n = F.coalesce(F.sum(F.col("kind").isin("CHANGED", "MISSING").cast("long")), F.lit(0))
    return drift.agg(F.count("*").alias("issues"), n.alias("bad")).withColumn("verdict", F.when(F.col("bad") > 0, "COMPROMISED").when(F.col("issues") > 0, "PARTIAL").otherwise("OK"))


# works

def work_parts(edges: DataFrame) -> DataFrame:
    """edges: parent, child titles. Part-of both ways, each once; a work may be part of itself."""
    e = edges.distinct()
    return e.selectExpr("child AS s", "'isPartOf' AS edge", "parent AS o").unionByName(e.selectExpr("parent AS s", "'hasPart' AS edge", "child AS o")).distinct()


def work_iri(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), title_key(title))


def work_quads(links: DataFrame, edges_of_works: DataFrame, base: str, records: str, graph: str) -> DataFrame:
    """links (work_title, record_identifier) and edges (parent, child titles) as quads: works, their parts and what they are
    related to, both ways."""
    e = edges_of_works.distinct()
    titles = links.select(F.col("work_title").alias("t")).unionByName(e.select(F.col("parent").alias("t"))).unionByName(e.select(F.col("child").alias("t"))).distinct()
    w = lambda c: work_iri(F.col(c), base)
    rec = record_iri(F.col("record_identifier"), records)
    named = quad_rows(titles, graph, (w("t"), "rdf:type", iri("lrmoo:F1_Work"), "iri"), (w("t"), "rdfs:label", F.col("t"), "lit"))
    parts = quad_rows(e, graph, (w("parent"), "lrmoo:R67_has_part", w("child"), "iri"), (w("child"), "lrmoo:R67i_forms_part_of", w("parent"), "iri"))
    related = quad_rows(links, graph, (w("work_title"), "rico:isRelatedTo", rec, "iri"), (rec, "rico:isRelatedTo", w("work_title"), "iri"))
    return named.unionByName(parts).unionByName(related).distinct()


def related_quads(links: DataFrame, base: str, graph: str) -> DataFrame:
    """links (work, entity), a work's title and an IRI, both ways; of ``propagate``'s result."""
    w = work_iri(F.col("work"), base)
    return quad_rows(links.distinct(), graph, (w, "rico:isRelatedTo", F.col("entity"), "iri"), (F.col("entity"), "rico:isRelatedTo", w, "iri")).distinct()


def record_sets(q: Quads, entities: DataFrame) -> DataFrame:
    """entities (entity) with is_set: typed as a RecordSet, or, if the graph has no type for it, named like one."""
    types = rows_of(q, iri("rdf:type"), (iri("rico:Record"), iri("rico:RecordSet"))).groupBy(F.col("s").alias("entity")).agg(F.max(F.col("o") == iri("rico:RecordSet")).alias("typed"))
    return entities.join(types, "entity", "left").select("entity", F.coalesce("typed", record_kind(F.col("entity")) == "RecordSet").alias("is_set"))


def graph_size(q: Quads, g: str) -> DataFrame:
    """One row: how many quads the graph g holds."""
    return rows_of(q).where(F.col("g") == g).agg(F.count("*").alias("n"))


def propagate(links: DataFrame, included: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """links (work, entity) extended one hop to what the entity includes (child, parent), then to parent works by title."""
    down = links.unionByName(links.join(included.toDF("child", "entity"), "entity").select("work", F.col("child").alias("entity")))
    if edges is None:
        return down.distinct()
    key = lambda c: F.lower(F.trim(F.col(c)))
    ups = down.join(edges.select(key("child").alias("k"), F.col("parent").alias("up")), key("work") == F.col("k")).select(F.col("up").alias("work"), "entity")
    return down.unionByName(ups).distinct()


# registry

def graph_registry(quads: Quads) -> DataFrame:
    """Each graph once, with the structure graph it describes."""
    g = rows_of(quads).select("g").distinct()
    return g.select("g", F.when(F.endswith("g", F.lit("/metadata")), F.regexp_replace("g", "/metadata$", "/structure")).alias("describes"))


def registry_quads(graphs: DataFrame, media: dict[str, str], base: str) -> DataFrame:
    """graphs: g, medium. The base hierarchy archive > structure > RS1 > each medium's id, and each medium's id to its metadata graphs."""
    spark, g, top = graphs.sparkSession, base + "/NGRegistry", base + "/structure"
    steps = [(base, top), (top, top + "/RS1"), *((top + "/RS1", f"{top}/{i}") for i in sorted(set(media.values())))]
    tree = quad_rows(spark.createDataFrame(steps, "a string, b string"), g, (F.col("a"), "dc:hasPart", F.col("b"), "iri"))
    ids = spark.createDataFrame(list(media.items()), "medium string, id string")
    described = graphs.where(~F.endswith("g", F.lit("structure"))).distinct().join(F.broadcast(ids), "medium")  # one row a medium
    return tree.unionByName(quad_rows(described, g, (F.concat(F.lit(top + "/"), "id"), "rico:isRelatedTo", F.col("g"), "iri")))
