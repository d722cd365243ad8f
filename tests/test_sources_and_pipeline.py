"""Text forms, scalars in two zones, pruned plans, tool output, and a run over a small folder."""

import json

from pyspark.sql import functions as F

from quadrille.functions import scalars as S
from quadrille.functions import tables
from quadrille.operators import descriptions, metadata, redaction, validate
from quadrille.operators.quads import SCHEMA, pattern
from quadrille.plans import pipeline
from quadrille.plans.catalog import DATE_CASES, DATE_WANT
from quadrille.sources import lift, nquads


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_escapes_and_graphs(spark):
    lines = [r'<s> <p> "café \U0001F600 \\u00e9 \b" <g> .', "<s> <p> <o> _:g .", "<s> <p> <o> <g> . # a note", "broken", "# note", " "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(r["o"], r["g"]) for r in nquads.parse_nquads(df).collect()]
    assert got == [("café 😀 \\u00e9 \b", "g"), ("o", "_:g"), ("o", "g")]
    assert [r["value"] for r in nquads.rejected_lines(df).collect()] == ["broken"]
    back = nquads.parse_nquads(nquads.format_nquads(nquads.parse_nquads(df)))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, nquads.parse_nquads(df).collect()), key=str)


def test_dates_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(x,) for x in DATE_CASES], "raw string").select(S.normalize_date(F.col("raw")).alias("day"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r["day"] for r in df.collect()] == DATE_WANT
            assert one(spark, S.normalize_date, "1752278400") == "2025-07-12"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_small_scalars(spark):
    say = lambda f, x: one(spark, f, x)
    assert say(S.title_key, "Škoda  Łódź - Ő (due)") == "skoda_łodz_o_due" and say(S.title_key, "!?") == "untitled" and say(S.title_key, "a" * 99 + "_b") == "a" * 99
    assert say(S.title_key, "Il male è qui: parte/prima") == "il_male_e_qui_parte_prima"
    assert say(S.media_category, "Image/PNG; x=1") == "image" and say(S.media_category, "text/plain") is None
    assert say(lambda c: S.record_iri(c, "b/"), " <http://x> ") == "http://x" and say(lambda c: S.record_iri(c, "b/"), " RS1 ") == "b/RS1"
    assert [say(S.record_kind, "http://x/" + i) for i in ("RS1_R3", "RS1_RS2", "thing", "recordset9")] == ["Record", "RecordSet", "Record", "RecordSet"]
    assert say(S.instantiation_id, "http://x/a b:c") == "a_b_c" and say(S.instantiation_id, "x#y") == "y" and say(S.instantiation_id, "none") is None
    assert tuple(say(S.activity_parts, "http://x/RS1_R2_inst_os_metaextr")) == ("RS1_R2_inst", "os") and tuple(say(S.activity_parts, "x")) == ("unknown_inst", "unknown_tool")
    assert [say(S.tool_source, t) for t in ("ExifTool", "Python os", "Apache Tika", None)] == ["exiftool", "os", "tika", "tika"]
    assert [say(S.tool_short, t) for t in ("Apache Tika", "ExifTool", "Python os", "My-Tool 1.2")] == ["apachetika", "exiftool", "os", "mytool12"]
    assert say(lambda c: S.main_software(c, "CPython 3"), "os") == "CPython 3" and say(S.documentation, "Apache Tika 2").startswith("https://tika") and say(S.documentation, "other") is None
    assert say(S.model_label, "llama3.2:1b") == "Llama 3.2:1b" and say(S.model_label, "qwen:7b") == "Qwen" and say(S.model_page, "Mistral:7b").endswith("/mistral")
    assert say(lambda c: S.counter(c.cast("int")), "7") == "0007" and say(lambda c: S.counter(c.cast("int")), "12345") == "12345"
    assert say(lambda c: S.same_name(c, F.lit("FLOPPY")), "Floppy") and say(lambda c: S.share(c.cast("int"), F.lit(3)), "1") == 33.33
    assert say(S.clean_description, ' "a  b" ') == "a b." and say(lambda c: S.permissions(c.cast("int")), "33188") == "0o644"
    assert len(tables.EQUIVALENT) == 86 and len(tables.MEDIA_LABELS) == 85


def test_snapshot_reads_one_part(spark, tmp_path):
    q = spark.createDataFrame([("a", f"http://p/{k}", "o", "g", "iri", None, None) for k in ("x", "y")] * 2, SCHEMA)
    nquads.snapshot(q, str(tmp_path / "s"))
    back = nquads.restore(spark, str(tmp_path / "s"))
    rows = pattern(back, "http://p/x")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1 and "PartitionFilters: [isnotnull(p_code" in plan and back.count() == 2
    assert nquads.verify_snapshot(q, str(tmp_path / "s"), spark).first()["same"]


def test_a_pattern_makes_its_predicate_alone(spark, sf):
    plan = pattern(lift.graph(spark, sf), "rico:isOrWasIncludedIn")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "quality" not in plan


def test_hash_manifests(spark, tmp_path):
    h = "ab" * 32
    entry = {"path": "a\\b", "sha256": h.upper(), "size": 1}
    for name, doc in (("list", {"file_hashes": [entry, {"path": "x/.DS_Store", "sha256": h}]}), ("named", {"hash_files": {"a/b": h}}), ("plain", {"a/b": h})):
        (tmp_path / name).write_text(json.dumps(doc))
        assert [(r["path"], r["sha256"]) for r in nquads.read_hash_manifest(spark, str(tmp_path / name)).collect()] == [("a/b", h)], name


def test_tool_output(spark):
    exif = spark.createDataFrame([(json.dumps([{"SourceFile": "/a", "Version": "12", "Size": 3, "Tags": ["x", "y"]}]),), ("not json",)], "value string")
    got = metadata.read_exiftool(exif).collect()
    assert [(r["path"], r["meta"], r["version"]) for r in got] == [("/a", {"Size": ["3"], "Tags": ["x", "y"]}, "12")]
    tika = spark.createDataFrame([("/a", json.dumps({"X-TIKA:Parsed-By": ["p"], "t": "[odd"}))], "path string, value string")
    assert metadata.read_tika(tika).first()["meta"] == {"X-TIKA:Parsed-By": ["p"], "t": ["[odd"]}


def test_descriptions_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "a\nb"), ("i2", "c")], "inst string, prompt string")
    path = str(tmp_path / "d")
    assert descriptions.write_descriptions(rows.where("inst = 'i1'"), path) == 1
    assert descriptions.write_descriptions(rows, path) == 1 and descriptions.write_descriptions(rows, path) == 0
    assert {r["inst"]: r["description"] for r in spark.read.parquet(path).collect()} == {"i1": "File with a, b.", "i2": "File with c."}


def test_protection_of_works(spark, sf, tmp_path):
    none = spark.createDataFrame([], "e string")
    works = spark.createDataFrame([(lift.EX + "record/1",)], "e string")
    out, checks = redaction.protect(lift.graph(spark, sf), works, none, none, str(tmp_path / "p"))
    assert checks.first()["ok"] and redaction.flagged(out, "no").where(F.col("e") == lift.EX + "record/1").count() == 1


def test_run_over_a_folder(spark, tmp_path):
    src = tmp_path / "in"
    for name in ("a/x.txt", "a/b/y.txt", "A2/z.txt", "top.txt"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(name[-5:])
    (tmp_path / "c.json").write_text(json.dumps({"media": {"disk": {"path": str(src), "id": "RS1_RS1", "label": "Disk"}}, "output": str(tmp_path / "out")}))
    (tmp_path / "deep" / "er").mkdir(parents=True)
    config = pipeline.Config.load("c.json", str(tmp_path / "deep" / "er"))
    assert pipeline.run_pipeline(spark, config, dry_run=True).count() == 10
    report = pipeline.run_pipeline(spark, config)
    assert pipeline.succeeded(report), report.collect()
    quads, n = pipeline.restore_latest(spark, str(tmp_path / "out" / "snapshots"))
    assert n > 50 and pattern(quads, "rico:isOrWasIncludedIn").count() == 7
    assert validate.orphan_instantiations(quads).count() == 0
    assert pipeline.rotate(spark, str(tmp_path / "out" / "snapshots"), 0) and not pipeline.list_snapshots(spark, str(tmp_path / "out" / "snapshots"))
