"""The validation suite: each check is a plan over quads, with a rule that turns its result into a verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scalars import share
from quadrille.functions.terms import PREFIX, TYPE
from quadrille.operators.quads import Quads, ask, edges, having, instances, pattern, rows_of, triples, typed, without

Check = Callable[[Quads], DataFrame]

#: name -> class whose instances are counted
COUNTED = {
    "v03_record_count": "rico:Record",
    "v04_recordset_count": "rico:RecordSet",
    "v05_instantiation_count": "rico:Instantiation",
    "v06_identifier_count": "rico:Identifier",
    "v07_identifiertype_count": "rico:IdentifierType",
    "v08_technical_metadata_count": "bodi:TechnicalMetadata",
    "v09_person_count": "rico:Person",
    "v10_technical_metadata_type_count": "bodi:TechnicalMetadataType",
    "v11_activity_count": "rico:Activity",
    "v12_fixity_count": "premis:Fixity",
    "v13_location_count": "prov:Location",
    "v14_extent_count": "rico:Extent",
    "v15_software_stack_count": "bodi:SoftwareStack",
    "v16_software_count": "bodi:Software",
    "v17_software_component_count": "bodi:SoftwareComponent",
    "v18_algorithm_count": "bodi:Algorithm",
}
LABELLED = {
    "v19_record_without_label_ask": "rico:Record",
    "v20_recordset_without_label_ask": "rico:RecordSet",
    "v21_instantiation_without_label_ask": "rico:Instantiation",
    "v22_technicalmetadatatype_without_label_ask": "bodi:TechnicalMetadataType",
    "v23_activity_without_label_ask": "rico:Activity",
    "v24_person_without_label_ask": "rico:Person",
}


def _n(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("count"))


def without_label(q: Quads, cls: str) -> DataFrame:
    return without(typed(q, cls), edges(q, "rdfs:label"), "s")


def composition(q: Quads) -> DataFrame:
    t = rows_of(q, TYPE, tuple(PREFIX["rico"] + c for c in ("Record", "RecordSet", "Instantiation")))
    n = lambda c: F.countDistinct(F.when(F.col("o") == PREFIX["rico"] + c, F.col("s")))
    return t.agg(n("Record").alias("records"), n("RecordSet").alias("recordsets"), n("Instantiation").alias("instantiations"))


def roots(q: Quads, ids: tuple[str, ...] = ("RS1",)) -> DataFrame:
    """RecordSets with a root identifier, and whether each has a parent."""
    named = pattern(q, "rico:hasOrHadIdentifier", "s", "i").join(pattern(q, "rdfs:label", "i", "identifier").where(F.col("identifier").isin(list(ids))), "i")
    parents = pattern(q, "rico:isOrWasIncludedIn").select("s").distinct().withColumn("has", F.lit(True))
    return having(named, instances(q, "rico:RecordSet"), "s").join(parents, "s", "left").select("s", "identifier", F.coalesce("has", F.lit(False)).alias("has_parent"))


def self_inclusion(q: Quads) -> DataFrame:
    return pattern(q, "rico:isOrWasIncludedIn").unionByName(pattern(q, "rico:isOrWasPartOf")).where("s = o")


def two_cycles(q: Quads) -> DataFrame:
    e = pattern(q, "rico:isOrWasIncludedIn").where("s <> o")
    return e.join(e.select(F.col("s").alias("o"), F.col("o").alias("s")), ["s", "o"]).where("s < o")


def cycles(q: Quads) -> DataFrame:
    """Nodes on an inclusion cycle of any length: reachability squared, kept distinct, until it no longer grows."""
    reach = pattern(q, "rico:isOrWasIncludedIn").persist()
    n, before = reach.count(), -1
    while n != before:
        longer = reach.toDF("s", "m").join(reach.toDF("m", "o"), "m").select("s", "o")
        reach, last = reach.unionByName(longer).distinct().persist(), reach
        before, n = n, reach.count()
        last.unpersist()
    return reach.where("s = o").select("s")


def depth_gaps(q: Quads, edge: str = "rico:isOrWasPartOf") -> DataFrame:
    d = pattern(q, "bodi:hierarchyDepth")
    rows = pattern(q, edge).join(d.toDF("s", "child_depth"), "s").join(d.toDF("o", "parent_depth"), "o")
    return rows.select("s", (F.col("child_depth").cast("long") - F.col("parent_depth").cast("long")).alias("gap")).where("gap <> 1")


def more_than_one(q: Quads, p: str) -> DataFrame:
    return pattern(q, p).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")


def orphan_instantiations(q: Quads) -> DataFrame:
    return without(typed(q, "rico:Instantiation"), edges(q, "rico:hasOrHadInstantiation", "x", "s"), "s")


def orphan_records(q: Quads) -> DataFrame:
    rows = having(typed(q, "rico:Record", "rico:RecordSet"), edges(q, "rico:isOrWasIncludedIn"), "s")
    return without(rows, edges(q, "rico:hasOrHadInstantiation"), "s")


def shared_locations(q: Quads) -> DataFrame:
    return pattern(q, "prov:atLocation").groupBy("o").agg(F.count("*").alias("n")).where("n > 1").select(F.col("o").alias("location"), "n")


def metadata_stats(q: Quads, token: str = "metaextr") -> DataFrame:
    """Distinct metadata, types, and extraction Activities, whose IRI holds the token."""
    meta, kind, act = PREFIX["bodi"] + "TechnicalMetadata", PREFIX["bodi"] + "TechnicalMetadataType", PREFIX["rico"] + "Activity"
    n = lambda cond: F.countDistinct(F.when(cond, F.col("s")))
    is_a = lambda cls: F.col("o") == cls
    return rows_of(q, TYPE, (meta, kind, act)).agg(n(is_a(meta)).alias("metadata"), n(is_a(kind)).alias("types"), n(is_a(act) & F.col("s").contains(token)).alias("activities"))


def incomplete_activities(q: Quads, token: str = "metaextr") -> DataFrame:
    """Extraction Activities without a supervisor or without a date."""
    whole = having(edges(q, "bodi:hasOrHadSupervisor"), edges(q, "rico:occurredAtDate"), "s")
    return without(typed(q, "rico:Activity").where(F.col("s").contains(token)), whole, "s")


def metadata_of_tool(q: Quads, token: str) -> DataFrame:
    return _n(pattern(q, "bodi:hasTechnicalMetadataType").where(F.col("o").contains(token)))


def value_distribution(q: Quads, label: str = "MIMEType") -> DataFrame:
    kinds = pattern(q, "rdfs:label", "t", "l").where(F.col("l") == label).select("t")
    rows = having(edges(q, "bodi:hasTechnicalMetadataType", "s", "t"), kinds, "t")
    return rows.select("s").distinct().join(pattern(q, "rdf:value", "s", "value"), "s").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def hashes_without_algorithm(q: Quads) -> DataFrame:
    made = having(edges(q, "rico:hasCreator", "s", "a"), instances(q, "bodi:Algorithm", name="a"), "a")
    return without(typed(q, "premis:Fixity"), made, "s")


def algorithms(q: Quads) -> DataFrame:
    """How many Fixities each (algorithm, characteristic) made."""
    made = having(pattern(q, "rico:hasCreator", "s", "algorithm"), instances(q, "premis:Fixity"), "s")
    said = pattern(q, "rico:hasTechnicalCharacteristic", "algorithm", "characteristic")
    return made.join(said, "algorithm").groupBy("algorithm", "characteristic").agg(F.count("*").alias("n"))


def hash_values(q: Quads) -> DataFrame:
    return having(pattern(q, "rdf:value", "s", "hash"), instances(q, "premis:Fixity"), "s")


def duplicate_hashes(q: Quads) -> DataFrame:
    h = edges(q, "bodi:hasHashCode", "i", "s").join(edges(q, "rdf:value", "s", "hash"), "s")
    return h.groupBy("hash").agg(F.countDistinct("i").alias("n")).where("n > 1").orderBy(F.desc("n"), "hash")


def odd_paths(q: Quads) -> DataFrame:
    return having(pattern(q, "rdfs:label", "s", "path"), instances(q, "prov:Location"), "s").where(~F.startswith("path", F.lit("/")))


def metadata_types(q: Quads) -> DataFrame:
    """Each type of metadata with its label, its software and how many instances it has."""
    used = pattern(q, "bodi:hasTechnicalMetadataType", "tm", "type").groupBy("type").agg(F.count("*").alias("n"))
    kinds = having(pattern(q, "rdfs:label", "type", "type_label"), instances(q, "bodi:TechnicalMetadataType", name="type"), "type")
    made = having(pattern(q, "bodi:generatedBy", "type", "w"), instances(q, "bodi:Software", name="w"), "w").join(pattern(q, "rdfs:label", "w", "software"), "w")
    return kinds.join(made, "type").join(used, "type").select("type", "type_label", "software", "n").orderBy(F.desc("n"), "software", "type_label", "type")


def duplicate_metadata(q: Quads) -> DataFrame:
    rows = pattern(q, "bodi:hasTechnicalMetadata", "i", "tm").join(pattern(q, "bodi:hasTechnicalMetadataType", "tm", "t"), "tm").join(pattern(q, "rdf:value", "tm", "v"), "tm")
    return rows.groupBy("i", "t", "v").agg(F.count("*").alias("n")).where("n > 1")


#: name -> (plan, verdict rule)
CHECKS: dict[str, tuple[Check, str]] = {
    "v01_total_triples": (lambda q: _n(triples(q)), "info"),
    "v02_entity_composition": (composition, "balance"),
    **{name: ((lambda q, c=c: _n(typed(q, c))), "some") for name, c in COUNTED.items()},
    **{name: ((lambda q, c=c: ask(without_label(q, c))), "false") for name, c in LABELLED.items()},
    "v25_root_nodes": (roots, "roots"),
    "v26_self_inclusion_ask": (lambda q: ask(self_inclusion(q)), "false"),
    "v27_circular_hierarchy_ask": (lambda q: ask(two_cycles(q)), "false"),
    "v28_hierarchy_depth_gaps": (depth_gaps, "none_warn"),
    "v29_files_with_children_ask": (lambda q: ask(having(instances(q, "rico:Record"), edges(q, "rico:includesOrIncluded"), "s")), "false"),
    "v30_orphan_instantiations_ask": (lambda q: ask(orphan_instantiations(q)), "false"),
    "v31_orphan_records_ask": (lambda q: ask(orphan_records(q)), "false"),
    "v32_shared_locations": (shared_locations, "none_warn"),
    "v33_orphan_records": (lambda q: _n(orphan_records(q)), "zero"),
    "v34_instantiation_without_metadata": (lambda q: _n(without(typed(q, "rico:Instantiation"), pattern(q, "bodi:hasTechnicalMetadata"), "s")), "zero"),
    "v35_metadata_stats": (metadata_stats, "info"),
    "v36_incomplete_activities": (lambda q: _n(incomplete_activities(q)), "zero"),
    "v37_metadata_without_activity": (lambda q: _n(without(typed(q, "bodi:TechnicalMetadata"), edges(q, "bodi:generatedBy"), "s")), "zero"),
    "v38_exiftool_metadata": (lambda q: metadata_of_tool(q, "exiftool"), "info"),
    "v39_tika_metadata": (lambda q: metadata_of_tool(q, "apachetika"), "info"),
    "v40_filesystem_metadata": (lambda q: metadata_of_tool(q, "filesystem"), "info"),
    "v41_metadata_without_type": (lambda q: _n(without(typed(q, "bodi:TechnicalMetadata"), edges(q, "bodi:hasTechnicalMetadataType"), "s")), "zero"),
    "v42_unused_metadata_types": (lambda q: _n(without(typed(q, "bodi:TechnicalMetadataType"), pattern(q, "bodi:hasTechnicalMetadataType", "x", "s"), "s")), "zero"),
    "v43_mime_distribution": (value_distribution, "spread"),
    "v44_hash_without_algorithm_ask": (lambda q: ask(hashes_without_algorithm(q)), "false"),
    "v45_hash_missing_algorithm": (hashes_without_algorithm, "none_fail"),
    "v46_algorithm_consistency": (algorithms, "sha256"),
    "v47_hash_format_invalid": (lambda q: _n(hash_values(q).where(~F.col("hash").rlike("^[a-fA-F0-9]{64}$"))), "zero"),
    "v48_multiple_hashes": (lambda q: _n(more_than_one(q, "bodi:hasHashCode")), "zero"),
    "v49_duplicate_hash_analysis": (duplicate_hashes, "none_info"),
    "v50_path_format_invalid": (lambda q: _n(odd_paths(q)), "zero"),
    "v51_multiple_paths": (lambda q: _n(more_than_one(q, "prov:atLocation")), "zero"),
    "v52_metadata_types_csv": (metadata_types, "info"),
    "v53_mime_csv": (lambda q: value_distribution(q).orderBy("value"), "info"),
}
BASIC = [n for n in CHECKS if n < "v34"]


def verdict(rule: str, rows: list, roots_wanted: int = 1) -> str:
    """rows: at most a few rows of the check's result."""
    first = rows[0].asDict() if rows else {}
    count, answer = first.get("count"), first.get("answer")
    if rule == "info":
        return "INFO"
    if rule == "balance":
        return "FAIL" if not first else "WARNING" if first["instantiations"] < first["records"] + first["recordsets"] else "INFO"
    if rule == "some":
        return "PASS" if count else "WARNING"
    if rule == "false":
        return "FAIL" if answer else "PASS"
    if rule == "zero":
        return "WARNING" if count is None else "FAIL" if count else "PASS"
    if rule == "roots":
        return "PASS" if len(rows) >= roots_wanted else "FAIL"
    if rule == "sha256":
        names = {r["characteristic"] for r in rows}
        return "PASS" if names == {"SHA-256"} else "WARNING" if names else "FAIL"
    if rule == "spread":
        return "INFO" if rows else "WARNING"
    return "PASS" if not rows else {"none_warn": "WARNING", "none_fail": "FAIL", "none_info": "INFO"}[rule]


def overall(statuses: list[str], broken: bool = False) -> str:
    if broken:
        return "PARTIAL_EXECUTION"
    if "FAIL" in statuses:
        return "CRITICAL_ISSUES"
    warnings = statuses.count("WARNING")
    return "NEEDS_ATTENTION" if warnings > 5 else "GOOD_WITH_WARNINGS" if warnings else "EXCELLENT"


def size_class(n: int) -> str:
    return "very large" if n > 1_000_000 else "large" if n > 100_000 else "medium" if n > 10_000 else "small"


def validate(quads: Quads, level: str = "full", details: int = 5) -> tuple[DataFrame, str]:
    """Run the suite; (query_name, status, rows_seen, error_message), at most ``details`` rows fetched of each check."""
    spark, out, broken = quads.sparkSession, [], False
    for name in CHECKS if level == "full" else BASIC:
        plan, rule = CHECKS[name]
        try:
            rows = plan(quads).limit(details).collect()
            out.append((name, verdict(rule, rows), len(rows), None))
        except Exception as e:  # one failing check never stops the rest; its status says so
            broken = True
            out.append((name, "FAIL", 0, str(e)[:500]))
    return spark.createDataFrame(out, "query_name string, status string, rows_seen long, error_message string"), overall([r[1] for r in out], broken)


# checks beyond the suite

def statuses(report: DataFrame) -> DataFrame:
    """How many checks ended in each status."""
    return report.groupBy("status").agg(F.count("*").alias("n"))


def with_share(rows: DataFrame, n: str = "n", most: int | None = None) -> DataFrame:
    """Adds each row's percentage of all; ``most``: the largest so many, ties by the other columns."""
    total = rows.agg(F.sum(n).alias("_total"))
    others = [c for c in rows.columns if c != n]
    out = rows.crossJoin(F.broadcast(total)).select(*rows.columns, share(F.col(n), F.col("_total")).alias("percent"))  # a table of one row
    return out if most is None else out.orderBy(F.desc(n), *others).limit(most)


def repeated_ids(q: Quads, p: str = "rico:hasOrHadIdentifier") -> DataFrame:
    """Identifier labels that several entities bear, with how many and the least of them."""
    rows = pattern(q, p, "entity", "i").join(pattern(q, "rdfs:label", "i", "identifier"), "i")
    return rows.groupBy("identifier").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("example")).where("n > 1")


def error_kinds(errors: DataFrame, column: str = "error") -> DataFrame:
    """Errors by what stands before their first colon."""
    return errors.where(F.col(column).isNotNull()).groupBy(F.trim(F.substring_index(F.col(column), ":", 1)).alias("kind")).agg(F.count("*").alias("n"))


def unused_types(q: Quads) -> DataFrame:
    """Types of metadata that no metadata has."""
    return without(typed(q, "bodi:TechnicalMetadataType"), edges(q, "bodi:hasTechnicalMetadataType", "x", "s"), "s")
