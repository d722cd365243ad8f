"""Invariants of the graph engine on small literal graphs."""

from pyspark.sql import functions as F

from quadrille.functions.terms import LABEL
from quadrille.operators import archive, enrich
from quadrille.operators.quads import SCHEMA, insert, new_only, replace_objects
from quadrille.operators.validate import overall, validate, verdict
from quadrille.sources import nquads
from quadrille.streaming.incremental import load_stream, loaded

G, RICO, RDF = "http://g", "https://www.ica.org/standards/RiC/ontology#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def graph(spark, *rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def test_nquads_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("http://s", "http://p", 'a "b" \\ \n\t\\n é', G, "lit", None, "en"), ("http://s", "http://p", "5", G, "lit", "http://www.w3.org/2001/XMLSchema#integer", None), ("_:b", "http://p", "http://o", "", "iri", None, None)], SCHEMA)
    nquads.write_nquads(q, str(tmp_path / "nq"))
    assert sorted(map(tuple, nquads.read_nquads(spark, str(tmp_path / "nq")).collect()), key=str) == sorted(map(tuple, q.collect()), key=str)
    lines = spark.createDataFrame([("# note",), ("",), ("broken",), ("<s> <p> <o> .",)], "value string")
    assert nquads.parse_nquads(lines).count() == 1
    load_stream(spark, str(tmp_path / "nq"), str(tmp_path / "t"), str(tmp_path / "c"))
    load_stream(spark, str(tmp_path / "nq"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert loaded(spark, str(tmp_path / "t")).count() == 3
    nquads.snapshot(q, str(tmp_path / "snap"))
    assert nquads.restore(spark, str(tmp_path / "snap")).count() == 3


def test_enrichment_is_idempotent(spark):
    q = graph(spark, ("r1", RDF + "type", RICO + "Record", G, "iri"), ("r1", LABEL, "A", G, "lit"))
    new = enrich.enrich(q, {"titles"})
    assert new.count() == 4
    assert new_only(enrich.titles(q), insert(q, new)).count() == 0


def test_update_replaces_and_adds(spark):
    q = graph(spark, ("a", LABEL, "x", G, "lit"), ("a", LABEL, "y", G, "lit"), ("b", "p", "z", G, "lit"))
    out = replace_objects(q, spark.createDataFrame([("a", G), ("b", G)], "s string, g string"), LABEL, F.lit("n")).collect()
    assert sorted((r["s"], r["p"], r["o"]) for r in out) == sorted([("a", LABEL, "n"), ("b", "p", "z"), ("b", LABEL, "n")])


def test_verdicts(spark):
    q = graph(spark, ("r1", RDF + "type", RICO + "Record", G, "iri"))
    report, state = validate(q, "basic")
    by = {r["query_name"]: r["status"] for r in report.collect()}
    assert by["v19_record_without_label_ask"] == "FAIL" and by["v03_record_count"] == "PASS" and by["v07_identifiertype_count"] == "WARNING" and state == "CRITICAL_ISSUES"
    assert overall(["PASS", "WARNING"]) == "GOOD_WITH_WARNINGS" and overall(["PASS"]) == "EXCELLENT" and verdict("none_warn", []) == "PASS"


def test_ids_and_paths(spark):
    rows = spark.createDataFrame([("/m", "b", False, "RS1"), ("/m", "A", False, "RS1"), ("/m", "c", True, "RS1")], "parent string, name string, is_dir boolean, parent_id string")
    assert {r["name"]: r["id"] for r in archive.child_ids(rows).collect()} == {"A": "RS1_R1", "b": "RS1_R2", "c": "RS1_RS1"}
    files = spark.createDataFrame([("/a/b/f",), ("/a/bc/f",)], "path string")
    assert {r["dir"]: r["n"] for r in archive.recursive_counts(files).collect()} == {"/a": 2, "/a/b": 1, "/a/bc": 1}
