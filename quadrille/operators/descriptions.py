"""Descriptions of files: what is described, from which metadata, by which generator, and the quads of a description."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import tables
from quadrille.functions.scalars import clean_description, model_label, model_page
from quadrille.functions.terms import iri
from quadrille.operators.quads import Quads, edges, having, instances, pattern, quad_rows, without
from quadrille.operators.redaction import flagged

MIME_FIELDS = ("Content-Type", "Content-Type-Parser-Override", "MIMEType")
SIZE_FIELDS = ("st_size", "File Size", "FileSize", "Content-Length")


def describable(q: Quads) -> DataFrame:
    """(inst, rec, path): Instantiations of Records that aren't redacted, with the least of their locations."""
    rows = having(pattern(q, "rico:isOrWasInstantiationOf", "inst", "rec"), instances(q, "rico:Record", name="rec"), "rec")
    rows = without(rows, flagged(q, "yes").toDF("rec"), "rec")
    at = edges(q, "prov:atLocation", "inst", "l").join(edges(q, "rdfs:label", "l", "path"), "l").groupBy("inst").agg(F.min("path").alias("path"))
    return rows.join(at, "inst", "left")


def metadata_maps(q: Quads) -> DataFrame:
    """inst, meta: field -> sorted values."""
    named = edges(q, "bodi:hasTechnicalMetadataType", "tm", "t").join(edges(q, "rdfs:label", "t", "field").distinct(), "t")
    rows = named.join(edges(q, "rdf:value", "tm", "v"), "tm").join(edges(q, "bodi:hasTechnicalMetadata", "inst", "tm"), "tm")
    vals = rows.groupBy("inst", "field").agg(F.array_sort(F.collect_set("v")).alias("vals"))
    return vals.groupBy("inst").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "vals")))).alias("meta"))


def hashes(q: Quads) -> DataFrame:
    """inst, hash: the least hash of each Instantiation."""
    return edges(q, "bodi:hasHashCode", "inst", "f").join(edges(q, "rdf:value", "f", "v"), "f").groupBy("inst").agg(F.min("v").alias("hash"))


def first_of(meta: str, *fields: str) -> Column:
    return F.coalesce(*[F.element_at(F.try_element_at(F.col(meta), F.lit(f)), 1) for f in fields])


def prompt(meta: str = "meta", hash_of: str | None = None, most: int = 3000, others: int = 10) -> Column:
    """Media type, size and the hash's beginning; leading fields in their order, then as many ``others`` in order of name; cut at ``most`` characters."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = [line("MIME Type", first_of(meta, *MIME_FIELDS)), line("File Size", first_of(meta, *SIZE_FIELDS))]
    if hash_of:
        head.append(F.concat(F.lit("Hash: "), F.left(F.col(hash_of), F.lit(16)), F.lit("...")))
    head += [line(f, first_of(meta, f)) for f in tables.LEADING]
    rest = F.filter(F.map_entries(meta), lambda e: ~e["key"].isin(tables.LEADING) & (F.size(e["value"]) > 0))
    rest = F.transform(F.slice(rest, 1, others), lambda e: F.concat(e["key"], F.lit(": "), F.element_at(e["value"], 1)))
    text = F.array_join(F.concat(F.filter(F.array(*head), lambda x: x.isNotNull()), rest), "\n")
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def prompts(q: Quads) -> DataFrame:
    """inst, path, prompt of what can be described and has metadata."""
    rows = describable(q).join(metadata_maps(q), "inst").join(hashes(q), "inst", "left")
    return rows.select("inst", "path", prompt("meta", "hash").alias("prompt"))


def described(q: Quads) -> DataFrame:
    return edges(q, "bodi:hasTechnicalDescription", "inst", "x").select("inst").distinct()


def template(text: str) -> str:
    """A generator without a model: the first lines of the prompt in one sentence."""
    return "File with " + ", ".join(text.split("\n")[:3])


def describe(rows: DataFrame, generator: Callable[[str], str] = template, done: DataFrame | None = None) -> DataFrame:
    """rows (inst, prompt) to (inst, description), one call a row; those in ``done`` (inst) are skipped, so that a run that is
    tried again goes on where the last one wrote. A generator's failure is raised, not dropped."""
    left = rows if done is None else without(rows, done, "inst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"inst": b["inst"], "description": b["prompt"].map(generator)})

    return left.select("inst", "prompt").mapInPandas(run, "inst string, description string").select("inst", clean_description(F.col("description")).alias("description"))


def write_descriptions(rows: DataFrame, path: str, generator: Callable[[str], str] = template) -> int:
    """Describe what the table at ``path`` lacks and add it; the number of rows added."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select("inst")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    before = 0 if done is None else done.count()
    describe(rows, generator, done).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def description_quads(found: DataFrame, graph: str, base: str, model: str, person: str, when: str) -> DataFrame:
    """found (inst, description): the description, its Activity, software, supervisor and date, all both ways. Ids follow from the instantiation."""
    key = F.substring(F.sha2(F.concat_ws("\0", "inst", F.lit(model)), 256), 1, 16)
    text, act = F.concat(F.lit(f"{base}description/"), key), F.concat(F.lit(f"{base}generation/"), key)
    name = "".join(c if c.isalnum() else "_" for c in model.lower())
    program, who, day = f"{base}software/{name}", f"{base}person/{person}", base + "date/" + "".join(c for c in when if c.isalnum())
    per_file = quad_rows(
        found, graph,
        (text, "rdf:type", iri("bodi:TechnicalDescription"), "iri"), (text, "rdf:value", F.col("description"), "lit"), (text, "bodi:hasHumanValidation", "false", "lit"),
        (text, "bodi:generatedBy", act, "iri"), (act, "bodi:hasGenerated", text, "iri"),
        (act, "rdf:type", iri("rico:Activity"), "iri"), (act, "rdfs:label", "Text generation", "lit"),
        (act, "rico:occurredAtDate", day, "iri"), (F.lit(day), "rico:isDateOfOccurrenceOf", act, "iri"),
        (act, "bodi:hasOrHadSupervisor", who, "iri"), (F.lit(who), "bodi:isOrWasSupervisorOf", act, "iri"),
        (act, "rico:isOrWasPerformedBy", program, "iri"), (F.lit(program), "rico:performsOrPerformed", act, "iri"),
        (F.col("inst"), "bodi:hasTechnicalDescription", text, "iri"), (text, "bodi:isTechnicalDescriptionOf", F.col("inst"), "iri"),
    )
    boolean = "http://www.w3.org/2001/XMLSchema#boolean"
    per_file = per_file.withColumn("o_dt", F.when(F.col("p") == iri("bodi:hasHumanValidation"), F.lit(boolean)))
    d, w, p = F.lit(day), F.lit(who), F.lit(program)
    shared = quad_rows(
        found.sparkSession.range(1), graph,
        (d, "rdf:type", iri("rico:Date"), "iri"), (d, "rico:normalizedDateValue", when, "lit"), (d, "rico:expressedDate", F.date_format(F.to_timestamp(F.lit(when)), "dd MMMM yyyy 'at' HH:mm"), "lit"),
        (w, "rdf:type", iri("rico:Person"), "iri"), (w, "rdfs:label", person, "lit"),
        (p, "rdf:type", iri("bodi:Software"), "iri"), (p, "rdfs:label", model_label(F.lit(model)), "lit"), (p, "bodi:hasDocumentation", model_page(F.lit(model)), "iri"),
    )
    return per_file.unionByName(shared)
