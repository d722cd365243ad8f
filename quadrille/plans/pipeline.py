"""From folders to a checked graph: configuration, steps and their verdicts, snapshots with rotation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import PREFIX
from quadrille.operators import archive as A
from quadrille.operators import metadata as M
from quadrille.operators.quads import edges, plus
from quadrille.sources import nquads
from quadrille.sources.scratch import stored

SECTIONS = ("media", "output")
#: Steps whose failure fails the run, and steps that check.
CRITICAL = ("count", "hash", "structure", "load", "metadata", "registry")
CHECKING = ("check_counts", "check_integrity", "check_drift")


@dataclass
class Config:
    """media: name -> {path, id, label}; output: a folder that all executors share."""

    media: dict[str, dict[str, str]]
    output: str
    base: str = PREFIX["ex"]
    person: str = "operator"
    when: str = "2025-01-01T00:00:00"
    programs: list[str] = field(default_factory=lambda: ["Apache Tika", "ExifTool"])
    keep: int = 10

    @classmethod
    def load(cls, name: str, start: str = ".", levels: int = 3) -> Config:
        """From a JSON file in ``start`` or up to so many folders above it."""
        here = Path(start).resolve()
        for folder in [here, *here.parents][: levels + 1]:
            if (folder / name).is_file():
                raw = json.loads((folder / name).read_text())
                lacking = [s for s in SECTIONS if s not in raw]
                if lacking:
                    raise ValueError(f"{folder / name} lacks {', '.join(lacking)}")
                for medium, about in raw["media"].items():
                    if not {"path", "id"} <= set(about):
                        raise ValueError(f"medium {medium} needs path and id")
                return cls(**raw)
        raise FileNotFoundError(f"{name} is neither in {here} nor in {levels} folders above it")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Complete snapshots below a folder, newest first by name."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    done = [n for n in names if fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[0])]
    return sorted(done, reverse=True)


def rotate(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all but the newest ``keep`` snapshots; the names of those deleted."""
    gone = list_snapshots(spark, folder)[keep:]
    for n in gone:
        p, fs = _fs(spark, f"{folder}/{n}")
        fs.delete(p, True)
    return gone


def restore_latest(spark: SparkSession, folder: str, name: str | None = None) -> tuple[DataFrame, int]:
    """The newest snapshot, or the one named, and its number of quads."""
    found = list_snapshots(spark, folder)
    if not found or (name and name not in found):
        raise FileNotFoundError(f"no snapshot {name or ''} below {folder}")
    quads = nquads.restore(spark, f"{folder}/{name or found[0]}")
    return quads, quads.count()


def run_pipeline(spark: SparkSession, config: Config, maps=None, dry_run: bool = False) -> DataFrame:
    """Run every step for every medium; a report (medium, step, ok, detail) of them, written to output/report too.

    maps: a function of (spark, medium's files) to (inst, tool, meta), what tools said of them; by default what the file
    system says. dry_run: the steps that would run.
    """
    steps = ("count", "hash", "structure", "load", "check_counts", "check_integrity", "metadata", "check_drift", "registry", "snapshot")
    schema = "medium string, step string, ok boolean, detail string"
    if dry_run:
        return spark.createDataFrame([(m, s, None, "would run") for m in config.media for s in steps], schema)
    out, graphs, parts = [], [], []
    for medium, about in config.media.items():
        root, here, top = about["path"].removeprefix("file:").rstrip("/"), f"{config.output}/{medium}", f"{config.base}graph/{medium}"
        say = lambda step, ok, detail, m=medium: out.append((m, step, bool(ok), str(detail)))
        rel = lambda df, r=root: df.withColumn("path", F.substring("path", len(r) + 1, 1_000_000))
        census = stored(rel(nquads.read_census(spark, root)), f"{here}/census")
        counts = A.recursive_counts(census.where("NOT is_dir"))
        nquads.write_count_manifest(counts.select("dir", "n"), f"{here}/counts", "/", config.when)
        say("count", True, census.where("NOT is_dir").count())
        nquads.write_hash_manifest(rel(nquads.hash_files(spark, root)), f"{here}/hashes")
        manifest = nquads.read_hash_manifest(spark, f"{here}/hashes/part-*")
        say("hash", True, manifest.count())

        entries = A.tree_ids(census.select("path", "is_dir"), about["id"]).join(manifest.select("path", "sha256"), "path", "left")
        own = spark.createDataFrame([(about["id"], None, about.get("label", medium), "/", True, 0, None)], "id string, parent_id string, name string, path string, is_dir boolean, depth int, sha256 string")
        entries = stored(entries.select(own.columns).unionByName(own), f"{here}/entries")
        wrong = A.id_conflicts(entries).count()
        say("structure", not wrong, f"{wrong} conflicts")
        structure = A.structure_quads(entries, f"{top}/structure", config.base, {about["id"]: about.get("label", medium)}, config.when)
        nquads.snapshot(structure, f"{here}/structure")
        graph = nquads.restore(spark, f"{here}/structure")
        balance = A.structure_balance(entries, graph).first()
        say("load", balance["same"], f"{balance['made']} of {balance['expected']} entities")

        found = edges(graph, "prov:atLocation", "inst", "l").join(edges(graph, "rdfs:label", "l", "path"), "l").join(edges(graph, "bodi:hasHashCode", "inst", "f"), "inst").join(edges(graph, "rdf:value", "f", "sha256"), "f").select("path", "sha256")
        checked = A.count_verdict(A.check_counts(nquads.read_count_manifest(spark, f"{here}/counts").where("path <> '/'"), A.recursive_counts(found))).first()
        say("check_counts", checked["ok"], f"{checked['bad']} of {checked['directories']} differ")
        whole = A.integrity_verdict(A.check_hashes(manifest, found)).first()
        say("check_integrity", whole["ok"], f"{whole['match']} of {whole['files']} match")

        told = maps(spark, entries) if maps else rel(M.read_stat(spark, root)).join(entries.select("path", "id"), "path").select(F.col("id").alias("inst"), F.lit("Python os").alias("tool"), "meta")
        nquads.snapshot(M.metadata_quads(told, f"{top}/metadata", config.base, config.person, config.when, config.programs), f"{here}/metadata")
        meta = nquads.restore(spark, f"{here}/metadata")
        say("metadata", True, meta.count())
        drift = A.drift_verdict(A.hash_drift(manifest, rel(nquads.hash_files(spark, root)))).first()
        say("check_drift", drift["verdict"] == "OK", drift["verdict"])
        parts += [graph, meta]
        graphs += [(f"{top}/structure", medium), (f"{top}/metadata", medium)]
    registry = A.registry_quads(spark.createDataFrame(graphs, "g string, medium string"), {m: a["id"] for m, a in config.media.items()}, config.base + "registry")
    out.append(("all", "registry", True, str(registry.count())))
    name = "".join(c for c in config.when if c.isalnum())
    everything = plus(*parts, registry)
    nquads.snapshot(everything, f"{config.output}/snapshots/{name}")
    same = nquads.verify_snapshot(everything, f"{config.output}/snapshots/{name}", spark).first()
    out.append(("all", "snapshot", same["same"], f"{same['snapshot_quads']} quads"))
    rotate(spark, f"{config.output}/snapshots", config.keep)
    report = spark.createDataFrame(out, schema)
    nquads.write_report(report, f"{config.output}/report")
    return report


def succeeded(report: DataFrame) -> bool:
    """Whether no critical and no checking step failed."""
    return report.where(F.col("step").isin([*CRITICAL, *CHECKING]) & ~F.col("ok")).isEmpty()
