"""Technical metadata: tool output as rows, and the types, values, Activities, exceptions and software it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import tables
from quadrille.functions.scalars import basename, counter, documentation, field_key, software_key, tool_short
from quadrille.functions.terms import iri
from quadrille.operators.quads import quad_rows

MAP = "map<string,string>"


def _lists(m: Column) -> Column:
    """A JSON object's values as arrays of strings: of a list its members, of anything else itself."""
    member = lambda v: F.when(F.startswith(F.ltrim(v), F.lit("[")), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))
    return F.transform_values(m, lambda k, v: member(v))


def read_exiftool(rows: DataFrame) -> DataFrame:
    """rows: value, each the JSON text of a list of objects with SourceFile. (path, meta) of every object; version fields go."""
    one = rows.select(F.explode(F.from_json("value", f"array<{MAP}>")).alias("m")).where("m IS NOT NULL")
    kept = F.map_filter("m", lambda k, v: ~k.isin(["SourceFile", *tables.VERSIONS]))
    return one.select(F.try_element_at("m", F.lit("SourceFile")).alias("path"), _lists(kept).alias("meta"), F.coalesce(*[F.try_element_at("m", F.lit(v)) for v in tables.VERSIONS[:6]]).alias("version"))


def read_tika(rows: DataFrame) -> DataFrame:
    """rows: path, value (the JSON text of one object). (path, meta), control fields too: ``extraction`` reads them."""
    return rows.select("path", _lists(F.from_json("value", MAP)).alias("meta"))


def read_stat(spark: SparkSession, root: str) -> DataFrame:
    """(path, meta) of the files below a folder, as far as Spark's file source tells: size and time of change."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    one = lambda c: F.array(c.cast("string"))
    fields = F.create_map(F.lit("st_size"), one(F.col("length")), F.lit("st_mtime"), one(F.unix_seconds("modificationTime")), F.lit("file_type"), F.array(F.lit("file")))
    return raw.select(F.regexp_replace("path", "^file:", "").alias("path"), fields.alias("meta"))


def _spread(maps: DataFrame) -> DataFrame:
    rows = maps.select("inst", "tool", F.explode("meta").alias("field", "vals")).select("inst", "tool", "field", F.explode("vals").alias("value"))
    return rows.where("value IS NOT NULL AND trim(value) <> ''")


def metadata_values(maps: DataFrame, denied: list[str] | None = None) -> DataFrame:
    """maps: inst, tool, meta map<string, array<string>>. One row a value that isn't blank; denied fields (control, warning and
    version fields) have none."""
    denied = [*tables.CONTROL, *tables.WARNINGS, *tables.VERSIONS] if denied is None else denied
    rows = _spread(maps)
    return (rows.where(~F.col("field").isin(denied)) if denied else rows).distinct()


def metadata_type_ids(values: DataFrame) -> DataFrame:
    """A number for each (tool, field), in that order.

    Numbers run within a tool; those of the tools before are added from a table of one row a tool.
    """
    kinds = values.select("tool", "field").distinct()
    per = kinds.groupBy("tool").agg(F.count("*").alias("n"))
    before = per.select("tool", F.coalesce(F.sum("n").over(Window.orderBy("tool").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = kinds.withColumn("own", F.row_number().over(Window.partitionBy("tool").orderBy("field")))
    return ranked.join(F.broadcast(before), "tool").select("tool", "field", (F.col("own") + F.col("before")).alias("type_no"))


def metadata_instance_ids(values: DataFrame) -> DataFrame:
    """A number for each (field, value) within its instantiation; tools share it."""
    return values.select("inst", "field", "value").distinct().withColumn("instance_no", F.row_number().over(Window.partitionBy("inst").orderBy("field", "value")))


def value_quads(values: DataFrame, graph: str, base: str, software: dict[str, str] | None = None) -> DataFrame:
    """values (inst, tool, field, value) as quads: types with their software, values with label and links, all both ways.

    inst is an id; a type's IRI comes from tool and field, a value's from its instantiation, field and value.
    """
    x = lambda kind, *cols: F.concat(F.lit(f"{base}{kind}/"), F.concat_ws("_", *cols))
    inst = x("inst", F.col("inst").cast("string"))
    tm = x("tm", F.col("inst").cast("string"), F.substring(F.sha2(F.concat_ws("\0", field_key(F.col("field")), "value"), 256), 1, 16))
    kind = x("type", F.col("tool"), field_key(F.col("field")))
    act = F.concat(x("activity", F.col("inst").cast("string"), tool_short(F.col("tool"))), F.lit("_metaextr"))
    program = x("software", software_key(F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in (software or {"": ""}).items() for y in kv]), F.col("tool")), "tool")))
    per_value = quad_rows(
        values, graph,
        (tm, "rdf:type", iri("bodi:TechnicalMetadata"), "iri"), (tm, "rdf:value", F.col("value"), "lit"), (tm, "rdfs:label", F.concat("field", F.lit(": "), "value"), "lit"),
        (tm, "bodi:hasTechnicalMetadataType", kind, "iri"), (kind, "bodi:isTechnicalMetadataTypeOf", tm, "iri"),
        (tm, "bodi:generatedBy", act, "iri"), (act, "bodi:hasGenerated", tm, "iri"),
        (inst, "bodi:hasTechnicalMetadata", tm, "iri"), (tm, "bodi:isTechnicalMetadataOf", inst, "iri"),
    )
    per_type = quad_rows(
        values.select("tool", "field").distinct(), graph,
        (kind, "rdf:type", iri("bodi:TechnicalMetadataType"), "iri"), (kind, "rdfs:label", F.col("field"), "lit"), (kind, "bodi:generatedBy", program, "iri"), (program, "bodi:hasGenerated", kind, "iri"),
    )
    return per_value.distinct().unionByName(per_type.distinct())


def exceptions(maps: DataFrame) -> DataFrame:
    """(inst, tool, field, messages, exception_no): one for each warning field of an instantiation and tool, numbered by field."""
    rows = _spread(maps).where(F.col("field").isin(tables.WARNINGS)).groupBy("inst", "tool", "field").agg(F.array_sort(F.collect_set("value")).alias("messages"))  # one file's warnings
    return rows.withColumn("exception_no", F.row_number().over(Window.partitionBy("inst", "tool").orderBy("field")))


def exception_quads(found: DataFrame, graph: str, base: str) -> DataFrame:
    stem = F.concat_ws("_", F.col("inst").cast("string"), tool_short(F.col("tool")))
    x, act = F.concat(F.lit(f"{base}exception/"), stem, F.lit("_exc"), counter(F.col("exception_no"))), F.concat(F.lit(f"{base}activity/"), stem, F.lit("_metaextr"))
    rows = found.withColumn("message", F.explode("messages"))
    return quad_rows(rows, graph, (x, "rdf:type", iri("bodi:Exception"), "iri"), (x, "bodi:exceptionMessage", F.col("message"), "lit"), (x, "bodi:generatedBy", act, "iri"), (act, "bodi:hasGenerated", x, "iri")).distinct()


def components(maps: DataFrame) -> DataFrame:
    """(inst, tool, component): the tool itself and the parsers it says it used."""
    parsers = F.coalesce(F.try_element_at("meta", F.lit("X-TIKA:Parsed-By")), F.array().cast("array<string>"))
    return maps.select("inst", "tool", F.explode(F.array_distinct(F.concat(F.array("tool"), parsers))).alias("component")).where("component IS NOT NULL").distinct()


def stacks(parts: DataFrame) -> DataFrame:
    """parts: owner, component. Owners with the same distinct components share a stack; how many do."""
    sets = parts.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set("component")), "|").alias("stack"))
    return sets.groupBy("stack").agg(F.count("*").alias("owners"))


def stack_key(parts: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(parts)), "|"), 256), 1, 16)


def software_quads(used: DataFrame, graph: str, base: str, programs: list[str], versions: dict[str, str] | None = None) -> DataFrame:
    """used (inst, tool, component): a stack for each distinct set of components, Software for ``programs``, a SoftwareComponent for
    anything else, which belongs to the program in its stack; documentation and versions where known."""
    x = lambda kind, c: F.concat(F.lit(f"{base}{kind}/"), c)
    sets = used.groupBy("inst", "tool").agg(F.array_sort(F.collect_set("component")).alias("parts")).select("tool", "parts").distinct()
    stack, is_program = x("stack", stack_key(F.col("parts"))), F.col("component").isin(programs)
    node = F.when(is_program, x("software", software_key(F.col("component")))).otherwise(x("component", software_key(F.col("component"))))
    rows = sets.withColumn("component", F.explode("parts"))
    main, version = x("software", software_key(F.col("tool"))), F.lit(None).cast("string")
    for name, v in (versions or {}).items():
        version = F.when(F.col("component") == name, F.lit(v)).otherwise(version)
    part_of_main = ~is_program & F.col("tool").isin(programs)
    return quad_rows(
        rows, graph,
        (stack, "rdf:type", iri("bodi:SoftwareStack"), "iri"), (stack, "rdfs:label", F.concat(F.lit("Software Stack: "), F.array_join("parts", ", ")), "lit"),
        (stack, "rico:hasOrHadPart", node, "iri"), (node, "rico:isOrWasPartOf", stack, "iri"),
        (node, "rdf:type", F.when(is_program, F.lit(iri("bodi:Software"))).otherwise(F.lit(iri("bodi:SoftwareComponent"))), "iri"), (node, "rdfs:label", F.col("component"), "lit"),
        (node, "bodi:hasDocumentation", documentation(F.col("component")), "iri"), (node, "premis:version", version, "lit"),
        (main, "bodi:hasSoftwareComponent", node, "iri", part_of_main), (node, "bodi:isSoftwareComponentOf", main, "iri", part_of_main),
    ).distinct()


def extraction(maps: DataFrame, graph: str, base: str, person: str, when: str) -> DataFrame:
    """An Activity for each instantiation and tool: supervisor, date, software stack, and how long it took where the tool says so."""
    x = lambda kind, c: F.concat(F.lit(f"{base}{kind}/"), c)
    used = components(maps).groupBy("inst", "tool").agg(F.collect_set("component").alias("parts"))
    took = F.element_at(F.try_element_at("meta", F.lit("X-TIKA:parse_time_millis")), 1)
    rows = maps.groupBy("inst", "tool").agg(F.max(took).alias("took")).join(used, ["inst", "tool"])
    stem = F.concat_ws("_", F.col("inst").cast("string"), tool_short(F.col("tool")))
    act, stack, extent = x("activity", F.concat(stem, F.lit("_metaextr"))), x("stack", stack_key(F.col("parts"))), x("extent", stem)
    kind, timed = x("extentType", F.concat(tool_short(F.col("tool")), F.lit("ParsingTime"))), F.col("took").isNotNull()
    who, day = base + "person/" + person, base + "date/" + "".join(c for c in when if c.isalnum())
    return quad_rows(
        rows, graph,
        (act, "rdf:type", iri("rico:Activity"), "iri"), (act, "rdfs:label", F.concat(F.lit("Metadata extraction using "), "tool"), "lit"),
        (act, "bodi:hasOrHadSupervisor", who, "iri"), (F.lit(who), "bodi:isOrWasSupervisorOf", act, "iri"),
        (act, "rico:occurredAtDate", day, "iri"), (F.lit(day), "rico:isDateOfOccurrenceOf", act, "iri"),
        (act, "rico:isOrWasPerformedBy", stack, "iri"), (stack, "rico:performsOrPerformed", act, "iri"),
        (act, "rico:hasExtent", extent, "iri", timed), (extent, "rico:isExtentOf", act, "iri", timed), (extent, "rdf:type", iri("rico:Extent"), "iri", timed), (extent, "rdf:value", F.concat("took", F.lit(" milliseconds")), "lit", timed),
        (extent, "rico:hasExtentType", kind, "iri", timed), (kind, "rico:isExtentTypeOf", extent, "iri", timed), (kind, "rdf:type", iri("rico:ExtentType"), "iri", timed), (kind, "rdfs:label", F.concat("tool", F.lit(" parsing time")), "lit", timed),
    ).distinct()


def shared_quads(spark: SparkSession, graph: str, base: str, person: str, when: str) -> DataFrame:
    """The supervisor and the date of a run, once."""
    who, day = F.lit(base + "person/" + person), F.lit(base + "date/" + "".join(c for c in when if c.isalnum()))
    return quad_rows(spark.range(1), graph, (who, "rdf:type", iri("rico:Person"), "iri"), (who, "rdfs:label", person, "lit"), (day, "rdf:type", iri("rico:Date"), "iri"), (day, "rico:normalizedDateValue", when, "lit"), (day, "rico:expressedDate", F.date_format(F.to_timestamp(F.lit(when)), "dd MMMM yyyy 'at' HH:mm"), "lit"))


def name_quads(files: DataFrame, graph: str, base: str) -> DataFrame:
    """files: inst, path. A label from the file's name."""
    return quad_rows(files, graph, (F.concat(F.lit(f"{base}inst/"), F.col("inst").cast("string")), "rdfs:label", F.nullif(F.trim(basename(F.col("path"))), F.lit("")), "lit")).distinct()


def metadata_quads(maps: DataFrame, graph: str, base: str, person: str, when: str, programs: list[str]) -> DataFrame:
    """All quads of one extraction run."""
    parts = [value_quads(metadata_values(maps), graph, base), exception_quads(exceptions(maps), graph, base), extraction(maps, graph, base, person, when), software_quads(components(maps), graph, base, programs), shared_quads(maps.sparkSession, graph, base, person, when)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()
