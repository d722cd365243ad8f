"""Lifts of the driver's tables to quads, with seeded violations so that every check has something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import PREFIX
from quadrille.operators.quads import Graph, made_graph

EX, STRUCT, META = PREFIX["ex"], PREFIX["ex"] + "graph/structure", PREFIX["ex"] + "graph/metadata"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, *cols: str):
    return F.concat(F.lit(f"{EX}{kind}/"), F.concat_ws("_", *[F.col(c).cast("string") for c in cols]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).df


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents as Records with Instantiations in folders root / language / source; labelled ones have metadata."""
    plain = lambda: table(spark, sf_dir, "documents")
    known = lambda: plain().select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id"), "doc_id")
    leaves = lambda: plain().select("lang", "source").distinct()
    langs = lambda: plain().select("lang").distinct()
    return made_graph(spark, (plain, STRUCT, _structure()), (known, META, _metadata()), (leaves, STRUCT, _leaves()), (langs, STRUCT, _tops()), (lambda: spark.range(1), STRUCT, _shared()))


def m(n: int):
    return F.col("doc_id") % n == 0


def c(prefix: str, name: str) -> str:
    return PREFIX[prefix] + name


def _structure() -> list:
    rec, inst, fix, fix2, hashing = (node(k, "doc_id") for k in ("record", "inst", "fixity", "fixity2", "hashing"))
    folder, folder_inst, sha = node("set", "lang", "source"), node("setinst", "lang", "source"), F.sha2("text", 256)
    loc = F.when(m(97), F.lit(EX + "location/shared")).otherwise(node("location", "doc_id"))
    path = F.when(m(97), F.lit("/shared")).otherwise(F.concat(F.when(m(89), F.lit("")).otherwise(F.lit("/")), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))))
    second = m(83) | m(79)
    return [
        (rec, "rdf:type", c("rico", "Record"), "iri"),
        (rec, "rdfs:label", F.concat(F.lit("Record "), F.col("doc_id").cast("string")), "lit", ~m(50)),
        (rec, "rico:hasOrHadInstantiation", inst, "iri", ~m(71)),
        (inst, "rico:isOrWasInstantiationOf", rec, "iri"),
        (inst, "rdf:type", c("rico", "Instantiation"), "iri"),
        (inst, "rdfs:label", F.col("doc_id").cast("string"), "lit"),
        (rec, "rico:isOrWasIncludedIn", folder, "iri"),
        (folder, "rico:includesOrIncluded", rec, "iri"),
        (rec, "rico:includesOrIncluded", inst, "iri", m(61)),
        (inst, "rico:isOrWasPartOf", folder_inst, "iri"),
        (inst, "bodi:hierarchyDepth", F.when(m(67), 9).otherwise(3), "lit"),
        (inst, "prov:atLocation", loc, "iri"),
        (inst, "prov:atLocation", node("location2", "doc_id"), "iri", m(73)),
        (loc, "rdf:type", c("prov", "Location"), "iri"),
        (loc, "rdfs:label", path, "lit"),
        (fix, "rdf:type", c("premis", "Fixity"), "iri"),
        (fix, "rdf:value", sha, "lit"),
        (fix, "bodi:isHashCodeOf", inst, "iri"),
        (inst, "bodi:hasHashCode", fix, "iri"),
        (fix, "rico:hasCreator", F.when(m(47), F.lit(EX + "algorithm/md5")).otherwise(F.lit(EX + "algorithm/sha256")), "iri", ~m(10)),
        (hashing, "rdf:type", c("rico", "Activity"), "iri", m(3)),
        (hashing, "rdfs:label", "Hash generation using SHA-256", "lit", m(3)),
        (fix2, "rdf:type", c("premis", "Fixity"), "iri", second),
        (fix2, "rdf:value", F.when(m(83), F.lit("not-a-hash")).otherwise(F.sha2(sha, 256)), "lit", second),
        (inst, "bodi:hasHashCode", fix2, "iri", m(79)),
        (fix2, "rico:hasCreator", EX + "algorithm/sha256", "iri", second),
        (rec, "rico:hasOrHadIdentifier", node("identifier", "doc_id"), "iri"),
        (node("identifier", "doc_id"), "rdf:type", c("rico", "Identifier"), "iri"),
        (node("identifier", "doc_id"), "rdfs:label", F.concat(F.lit("RS1_R"), F.col("doc_id").cast("string")), "lit"),
    ]


def _fields() -> list:
    """(metadata node, type, value, condition); dates in several spellings, so that their operators have something to read."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    text = lambda fmt: F.date_format(day, fmt)
    spelt = F.when(m(2), text("d/M/yyyy")).otherwise(F.concat(text("yyyy-MM-dd"), F.lit("T23:30:00-05:00")))
    return [
        ("tm_size", "filesystem_st_size", F.col("n_chars").cast("string"), None),
        ("tm_mime", "exiftool_MIMEType", F.concat(F.lit("text/"), "source"), None),
        ("tm_type", "apachetika_Content_Type", F.concat(F.lit("Text/"), "lang", F.lit("; charset=utf-8")), None),
        ("tm_created", "apachetika_created", spelt, m(2) | m(3)),
        ("tm_modified", "apachetika_modified", spelt, m(3)),
        ("tm_mtime", "filesystem_st_mtime", F.concat(F.lit("1.7040672E9")), m(5)),
        ("tm_author", "apachetika_author", F.when(m(4), F.lit("Admin user")).otherwise(F.lit("Somebody Else")), m(7)),
    ]


def _metadata() -> list:
    inst, act = node("inst", "doc_id"), F.concat(node("activity", "doc_id"), F.lit("_metaextr"))
    out = [
        (act, "rdf:type", c("rico", "Activity"), "iri"),
        (act, "rdfs:label", "metaextr", "lit", ~m(53)),
        (act, "bodi:hasOrHadSupervisor", EX + "person/operator", "iri", ~m(11)),
        (act, "rico:occurredAtDate", EX + "date/20250101", "iri", ~m(13)),
    ]
    for name, kind, value, when in _fields():
        tm = node(name, "doc_id")
        on = F.lit(True) if when is None else when
        out += [
            (tm, "rdf:type", c("bodi", "TechnicalMetadata"), "iri", on),
            (tm, "rdf:value", value, "lit", on),
            (inst, "bodi:hasTechnicalMetadata", tm, "iri", on),
            (tm, "bodi:hasTechnicalMetadataType", f"{EX}type/{kind}", "iri", on & ~m(17) if name == "tm_type" else on),
            (tm, "bodi:generatedBy", act, "iri", on & ~m(19) if name == "tm_size" else on),
        ]
    # the same type and value once more, under another node
    again = node("tm_again", "doc_id")
    return [*out, (again, "rdf:type", c("bodi", "TechnicalMetadata"), "iri", m(23)), (again, "rdf:value", F.col("n_chars").cast("string"), "lit", m(23)), (inst, "bodi:hasTechnicalMetadata", again, "iri", m(23)), (again, "bodi:hasTechnicalMetadataType", f"{EX}type/filesystem_st_size", "iri", m(23)), (again, "bodi:generatedBy", act, "iri", m(23))]


def _leaves() -> list:
    leaf, inst = node("set", "lang", "source"), node("setinst", "lang", "source")
    return [
        (leaf, "rdf:type", c("rico", "RecordSet"), "iri"),
        (leaf, "rdfs:label", F.col("source"), "lit"),
        (leaf, "rico:isOrWasIncludedIn", node("set", "lang"), "iri"),
        (leaf, "rico:hasOrHadInstantiation", inst, "iri"),
        (inst, "rdf:type", c("rico", "Instantiation"), "iri"),
        (inst, "bodi:hierarchyDepth", F.lit(2), "lit"),
        (inst, "rico:isOrWasPartOf", node("setinst", "lang"), "iri"),
        (node("set", "lang"), "rico:isOrWasIncludedIn", leaf, "iri", F.col("source") == "src1"),
        # folders have a time in the file system and nothing else
        (inst, "bodi:hasTechnicalMetadata", node("tm_setmtime", "lang", "source"), "iri"),
        (node("tm_setmtime", "lang", "source"), "rdf:type", c("bodi", "TechnicalMetadata"), "iri"),
        (node("tm_setmtime", "lang", "source"), "rdf:value", "1706745600", "lit"),
        (node("tm_setmtime", "lang", "source"), "bodi:hasTechnicalMetadataType", EX + "type/filesystem_st_mtime", "iri"),
        (node("tm_setmtime", "lang", "source"), "bodi:generatedBy", EX + "activity/folders_metaextr", "iri"),
    ]


def _tops() -> list:
    top, inst = node("set", "lang"), node("setinst", "lang")
    return [
        (top, "rdf:type", c("rico", "RecordSet"), "iri"),
        (top, "rico:isOrWasIncludedIn", EX + "set/root", "iri"),
        (top, "rico:isOrWasIncludedIn", top, "iri", F.col("lang") == "fr"),
        (top, "rico:hasOrHadInstantiation", inst, "iri"),
        (inst, "rdf:type", c("rico", "Instantiation"), "iri"),
        (inst, "bodi:hierarchyDepth", F.lit(1), "lit"),
        (inst, "rico:isOrWasPartOf", EX + "setinst/root", "iri"),
    ]


TYPES = [("filesystem_st_size", "st_size"), ("exiftool_MIMEType", "MIMEType"), ("apachetika_Content_Type", "Content-Type"), ("apachetika_created", "dcterms:created"), ("apachetika_modified", "dcterms:modified"), ("filesystem_st_mtime", "st_mtime"), ("apachetika_author", "Author"), ("apachetika_unused", None)]


def _shared() -> list:
    x = lambda n: F.lit(EX + n)
    out = [
        (x("set/root"), "rdf:type", c("rico", "RecordSet"), "iri"),
        (x("set/root"), "rdfs:label", "root", "lit"),
        (x("set/root"), "rico:hasOrHadIdentifier", EX + "identifier/root", "iri"),
        (x("identifier/root"), "rdf:type", c("rico", "Identifier"), "iri"),
        (x("identifier/root"), "rdfs:label", "RS1", "lit"),
        (x("set/root"), "rico:hasOrHadInstantiation", EX + "setinst/root", "iri"),
        (x("setinst/root"), "rdf:type", c("rico", "Instantiation"), "iri"),
        (x("setinst/root"), "bodi:hierarchyDepth", F.lit(0), "lit"),
        *(q for name, label in (("sha256", "SHA-256"), ("md5", "MD5")) for q in ((x(f"algorithm/{name}"), "rdf:type", c("bodi", "Algorithm"), "iri"), (x(f"algorithm/{name}"), "rdfs:label", label, "lit"), (x(f"algorithm/{name}"), "rico:hasTechnicalCharacteristic", label, "lit"))),
        (x("person/operator"), "rdf:type", c("rico", "Person"), "iri"),
        (x("software/tools"), "rdf:type", c("bodi", "Software"), "iri"),
        (x("software/tools"), "rdfs:label", "tools", "lit"),
    ]
    for k, label in TYPES:
        out += [(x(f"type/{k}"), "rdf:type", c("bodi", "TechnicalMetadataType"), "iri"), (x(f"type/{k}"), "bodi:generatedBy", EX + "software/tools", "iri")]
        out += [(x(f"type/{k}"), "rdfs:label", label, "lit")] if label else []
    return out
