"""Registered queries of the graph engine and their oracle SQL over the base tables.

Each query runs an operator over a lift of a driver table; its SQL says the same of the base table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import scalars as S
from quadrille.functions import tables
from quadrille.functions.terms import PREFIX
from quadrille.operators import archive as A
from quadrille.operators import descriptions as N
from quadrille.operators import enrich as E
from quadrille.operators import metadata as M
from quadrille.operators import redaction as R
from quadrille.operators import validate as V
from quadrille.operators.quads import graph_overview, pattern, plus, rows_of, typed
from quadrille.operators.validate import CHECKS, COUNTED, LABELLED, cycles, duplicate_metadata
from quadrille.sources import lift
from quadrille.sources.nquads import format_nquads, parse_nquads
from quadrille.sources.scratch import workdir

EX = PREFIX["ex"]

#: d: documents with labels; leaf: (lang, source); fx: every Fixity; tm: every metadata node of a file
BASE = """
WITH d AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic, l.quality IS NOT NULL AS known FROM documents d LEFT JOIN labels l USING (doc_id)),
leaf AS (SELECT DISTINCT lang, source FROM d),
fx AS (SELECT doc_id, sha256(text) AS hash, doc_id % 10 <> 0 AS algo, CASE WHEN doc_id % 47 = 0 THEN 'md5' ELSE 'sha256' END AS alg FROM d UNION ALL
       SELECT doc_id, CASE WHEN doc_id % 83 = 0 THEN 'not-a-hash' ELSE sha256(sha256(text)) END, true, 'sha256' FROM d WHERE doc_id % 83 = 0 OR doc_id % 79 = 0),
k AS (SELECT *, strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') AS day FROM d WHERE known),
sp AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN strftime(CAST(day AS DATE), '%-d/%-m/%Y') ELSE day || 'T23:30:00-05:00' END AS spelt FROM k),
tm AS (SELECT doc_id, 'tm_size' AS node, 'filesystem_st_size' AS kind, 'st_size' AS label, CAST(n_chars AS VARCHAR) AS v, true AS typed FROM sp
       UNION ALL SELECT doc_id, 'tm_mime', 'exiftool_MIMEType', 'MIMEType', 'text/' || source, true FROM sp
       UNION ALL SELECT doc_id, 'tm_type', 'apachetika_Content_Type', 'Content-Type', 'Text/' || lang || '; charset=utf-8', doc_id % 17 <> 0 FROM sp
       UNION ALL SELECT doc_id, 'tm_created', 'apachetika_created', 'dcterms:created', spelt, true FROM sp WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
       UNION ALL SELECT doc_id, 'tm_modified', 'apachetika_modified', 'dcterms:modified', spelt, true FROM sp WHERE doc_id % 3 = 0
       UNION ALL SELECT doc_id, 'tm_mtime', 'filesystem_st_mtime', 'st_mtime', '1.7040672E9', true FROM sp WHERE doc_id % 5 = 0
       UNION ALL SELECT doc_id, 'tm_author', 'apachetika_author', 'Author', CASE WHEN doc_id % 4 = 0 THEN 'Admin user' ELSE 'Somebody Else' END, true FROM sp WHERE doc_id % 7 = 0
       UNION ALL SELECT doc_id, 'tm_again', 'filesystem_st_size', 'st_size', CAST(n_chars AS VARCHAR), true FROM sp WHERE doc_id % 23 = 0)
"""


def _count(where: str, table: str = "d") -> str:
    return f"{BASE} SELECT count(*) AS count FROM {table} WHERE {where}"


def _ask(where: str, table: str = "d") -> str:
    return f"{BASE} SELECT count(*) > 0 AS answer FROM {table} WHERE {where}"


def _const(n: int) -> str:
    return f"SELECT CAST({n} AS BIGINT) AS count"


N_SETS = "(SELECT count(*) FROM leaf) + (SELECT count(DISTINCT lang) FROM leaf) + 1"
MIME = "SELECT 'text/' || source AS value, count(*) AS n FROM d WHERE known GROUP BY 1"

#: (entity, field's metadata) of Records: those whose instantiation hangs on them
OWNED = "doc_id % 71 <> 0"

VALIDATION_SQL = {
    "v02_entity_composition": f"{BASE} SELECT (SELECT count(*) FROM d) AS records, {N_SETS} AS recordsets, (SELECT count(*) FROM d) + {N_SETS} AS instantiations",
    "v03_record_count": _count("true"),
    "v04_recordset_count": f"{BASE} SELECT {N_SETS} AS count",
    "v05_instantiation_count": f"{BASE} SELECT (SELECT count(*) FROM d) + {N_SETS} AS count",
    "v06_identifier_count": f"{BASE} SELECT count(*) + 1 AS count FROM d",
    "v07_identifiertype_count": _const(0),
    "v08_technical_metadata_count": f"{BASE} SELECT (SELECT count(*) FROM tm) + (SELECT count(*) FROM leaf) AS count",
    "v09_person_count": _const(1),
    "v10_technical_metadata_type_count": _const(8),
    "v11_activity_count": f"{BASE} SELECT count(*) FILTER (known) + count(*) FILTER (doc_id % 3 = 0) AS count FROM d",
    "v12_fixity_count": _count("true", "fx"),
    "v13_location_count": f"{BASE} SELECT count(DISTINCT CASE WHEN doc_id % 97 = 0 THEN -1 ELSE doc_id END) AS count FROM d",
    "v14_extent_count": _const(0),
    "v15_software_stack_count": _const(0),
    "v16_software_count": _const(1),
    "v17_software_component_count": _const(0),
    "v18_algorithm_count": _const(2),
    "v19_record_without_label_ask": _ask("doc_id % 50 = 0"),
    "v20_recordset_without_label_ask": _ask("true", "leaf"),
    "v21_instantiation_without_label_ask": _ask("true", "leaf"),
    "v22_technicalmetadatatype_without_label_ask": "SELECT true AS answer",
    "v23_activity_without_label_ask": _ask("known AND doc_id % 53 = 0"),
    "v24_person_without_label_ask": "SELECT true AS answer",
    "v25_root_nodes": f"SELECT '{EX}set/root' AS s, 'RS1' AS identifier, false AS has_parent",
    "v26_self_inclusion_ask": _ask("lang = 'fr'", "leaf"),
    "v27_circular_hierarchy_ask": _ask("source = 'src1'", "leaf"),
    "v28_hierarchy_depth_gaps": f"{BASE} SELECT '{EX}inst/' || doc_id AS s, CAST(7 AS BIGINT) AS gap FROM d WHERE doc_id % 67 = 0",
    "v29_files_with_children_ask": _ask("doc_id % 61 = 0"),
    "v30_orphan_instantiations_ask": _ask("doc_id % 71 = 0"),
    "v31_orphan_records_ask": _ask("doc_id % 71 = 0"),
    "v32_shared_locations": f"{BASE} SELECT '{EX}location/shared' AS location, count(*) AS n FROM d WHERE doc_id % 97 = 0 HAVING count(*) > 1",
    "v33_orphan_records": _count("doc_id % 71 = 0"),
    "v34_instantiation_without_metadata": f"{BASE} SELECT (SELECT count(*) FROM d WHERE NOT known) + {N_SETS} - (SELECT count(*) FROM leaf) AS count",
    "v35_metadata_stats": f"{BASE} SELECT (SELECT count(*) FROM tm) + (SELECT count(*) FROM leaf) AS metadata, CAST(8 AS BIGINT) AS types, (SELECT count(*) FROM k) AS activities",
    "v36_incomplete_activities": _count("known AND (doc_id % 11 = 0 OR doc_id % 13 = 0)"),
    "v37_metadata_without_activity": _count("known AND doc_id % 19 = 0"),
    "v38_exiftool_metadata": _count("known"),
    "v39_tika_metadata": _count("typed AND kind LIKE 'apachetika%'", "tm"),
    "v40_filesystem_metadata": f"{BASE} SELECT (SELECT count(*) FROM tm WHERE kind LIKE 'filesystem%') + (SELECT count(*) FROM leaf) AS count",
    "v41_metadata_without_type": _count("known AND doc_id % 17 = 0"),
    "v42_unused_metadata_types": _const(1),
    "v43_mime_distribution": f"{BASE} {MIME}",
    "v44_hash_without_algorithm_ask": _ask("NOT algo", "fx"),
    "v45_hash_missing_algorithm": f"{BASE} SELECT '{EX}fixity/' || doc_id AS s FROM fx WHERE NOT algo",
    "v46_algorithm_consistency": f"{BASE} SELECT '{EX}algorithm/' || alg AS algorithm, CASE alg WHEN 'md5' THEN 'MD5' ELSE 'SHA-256' END AS characteristic, count(*) AS n FROM fx WHERE algo GROUP BY alg",
    "v47_hash_format_invalid": _count("doc_id % 83 = 0"),
    "v48_multiple_hashes": _count("doc_id % 79 = 0"),
    "v49_duplicate_hash_analysis": f"{BASE} SELECT hash, count(*) AS n FROM (SELECT DISTINCT doc_id, hash FROM fx WHERE hash = (SELECT sha256(text) FROM d WHERE d.doc_id = fx.doc_id) OR doc_id % 79 = 0) GROUP BY hash HAVING count(*) > 1",
    "v50_path_format_invalid": _count("doc_id % 89 = 0 AND doc_id % 97 <> 0"),
    "v51_multiple_paths": _count("doc_id % 73 = 0"),
    "v52_metadata_types_csv": f"{BASE} SELECT '{EX}type/' || kind AS type, label AS type_label, 'tools' AS software, count(*) AS n FROM (SELECT kind, label FROM tm WHERE typed UNION ALL SELECT 'filesystem_st_mtime', 'st_mtime' FROM leaf) GROUP BY kind, label",
    "v53_mime_csv": f"{BASE} {MIME}",
}
# a simpler way to say which hashes hang on an instantiation: the text's own, and the second one where doc_id % 79 = 0
VALIDATION_SQL["v49_duplicate_hash_analysis"] = f"""{BASE}, h AS (SELECT doc_id, sha256(text) AS hash FROM d UNION SELECT doc_id, CASE WHEN doc_id % 83 = 0 THEN 'not-a-hash' ELSE sha256(sha256(text)) END FROM d WHERE doc_id % 79 = 0)
SELECT hash, count(*) AS n FROM h GROUP BY hash HAVING count(*) > 1"""

DATE_CASES = ["1.75233369117012E9", "1752333691.17012", "1752333691", "2020-01-01T23:00:00-05:00", "2020-01-02T03:04:05Z", "03/04/2020", "3-4-2020", "3.4.2020", "2020/4/3", "2020", "20200102", "9999999999999", "2020:01:31 10:00:00", "2020-13-45", "", "n/a", " 2020-02-29 ", "2021-02-29"]
DATE_WANT = ["2025-07-12", "2025-07-12", "2025-07-12", "2020-01-01", "2020-01-02", "2020-04-03", "2020-04-03", "2020-04-03", "2020-04-03", "2020-01-01", "2020-01-02", None, None, None, None, None, "2020-02-29", None]


def _values(rows: list[tuple], *names: str) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({', '.join(names)})"


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _docs(f):
    return lambda spark, sf_dir: f(lift.graph(spark, sf_dir))


def _entities(spark, sf_dir):
    d = lift.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("e"), F.lit(True).alias("is_record"))
    lab = lift.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("e"), "quality", "toxic")
    return d, lab


def _classify(default):
    def run(spark, sf_dir):
        d, lab = _entities(spark, sf_dir)
        out = R.classify(d, lab.where("quality = 1 AND toxic = 0 AND e % 2 = 0").select("e"), lab.where("quality = 1").select("e"), lab.where("toxic = 1").select("e"), default=default)
        return out.select(F.col("e").alias("doc_id"), "verdict")

    return run


def _redacted(spark, sf_dir, author_types=None, acceptable=None, titles=False):
    q = lift.graph(spark, sf_dir)
    d, lab = _entities(spark, sf_dir)
    name = lambda df: df.select(F.concat(F.lit(EX + "record/"), F.col("e").cast("string")).alias("e"))
    verdicts = R.classify(name(d).withColumn("is_record", F.lit(True)), name(d.limit(0)), name(lab.where("quality = 1")), name(lab.where("toxic = 1")))
    return R.redact(plus(q, E.titles(q)) if titles else q, verdicts, workdir(spark, "redaction"), author_types, acceptable)


def _said(spark, sf_dir, p, **options):
    """(s) whose object of p is the redacted word."""
    return rows_of(_redacted(spark, sf_dir, **options), p, (R.REDACTED,)).select("s")


def _protected(spark, sf_dir):
    """The closing checks of a whole redaction."""
    _, lab = _entities(spark, sf_dir)
    name = lambda df: df.select(F.concat(F.lit(EX + "record/"), F.col("e").cast("string")).alias("e"))
    q = lift.graph(spark, sf_dir)
    return R.protect(plus(q, E.titles(q)), name(lab.where("e % 9 = 0")), name(lab.where("quality = 1")), name(lab.where("toxic = 1")), workdir(spark, "redaction"))[1]


def _open_titles(spark, sf_dir):
    """Titles that a redaction without titles leaves open: the titles come after it."""
    out = _redacted(spark, sf_dir)
    return R.open_titles(plus(out, E.titles(lift.graph(spark, sf_dir))))


def _file_maps(spark, sf_dir):
    """Pages as what two tools say of a file: control, warning and version fields, blanks and lists among them."""
    p = lift.table(spark, sf_dir, "pages").select(F.col("page_id").alias("inst"), "url", "html")
    text = lambda c: F.array(c.cast("string"))
    lang = F.regexp_extract("html", r'<html[^>]*lang="([^"]*)"', 1)
    k = F.col("inst")
    tika = F.create_map(
        F.lit("dc:language"), text(lang), F.lit("X-TIKA:Parsed-By"), F.when(k % 2 == 0, F.array(F.lit("parser.Html"), F.lit("parser.Default"))).otherwise(F.array(F.lit("parser.Default"))),
        F.lit("X-TIKA:parse_time_millis"), text(k % 50), F.lit("X-TIKA:EXCEPTION:warn"), F.when(k % 5 == 0, F.array(F.lit("a: first"), F.lit("b"))).otherwise(F.array(F.lit(" "))),
        F.lit("Content-Type"), F.array(F.lit("text/html"), F.lit("text/html")),
    )
    exif = F.create_map(F.lit("FileSize"), text(F.length("html")), F.lit("dc:language"), text(lang), F.lit("Version"), F.array(F.lit("12")), F.lit("Warning"), F.when(k % 7 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")))
    return p.select("inst", F.lit("Apache Tika").alias("tool"), tika.alias("meta")).unionByName(p.select("inst", F.lit("ExifTool").alias("tool"), exif.alias("meta")))


def _tree(spark, sf_dir):
    """Documents as a tree of folders and files."""
    d = lift.table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("/"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))).alias("path"), F.lit(False).alias("is_dir"), F.sha2("text", 256).alias("sha256"))
    dirs = d.select(F.explode(F.array(F.concat(F.lit("/"), "lang"), F.concat(F.lit("/"), F.concat_ws("/", "lang", "source")))).alias("path")).distinct()
    return files.unionByName(dirs.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("sha256")))


TREE_SQL = """WITH d AS (SELECT doc_id, lang, source, text, CAST(doc_id AS VARCHAR) AS f FROM documents),
l AS (SELECT lang, 'RS1_RS' || row_number() OVER (ORDER BY lower(lang), lang) AS lid FROM (SELECT DISTINCT lang FROM d)),
g AS (SELECT s.lang, s.source, l.lid, l.lid || '_RS' || row_number() OVER (PARTITION BY s.lang ORDER BY lower(s.source), s.source) AS sid FROM (SELECT DISTINCT lang, source FROM d) s JOIN l USING (lang)),
t AS (SELECT '/' || d.lang || '/' || d.source || '/' || f AS path, g.sid || '_R' || row_number() OVER (PARTITION BY d.lang, d.source ORDER BY lower(f), f) AS id, g.sid AS parent_id, 3 AS depth, sha256(text) AS sha FROM d JOIN g ON g.lang = d.lang AND g.source = d.source
      UNION ALL SELECT '/' || lang || '/' || source, sid, lid, 2, NULL FROM g UNION ALL SELECT '/' || lang, lid, 'RS1', 1, NULL FROM l)"""


def _structured(spark, sf_dir):
    return A.structure_graph(A.tree_ids(_tree(spark, sf_dir), "RS1"), EX + "graph/structure", EX, {"RS1_RS1": "First disk"})


def _works(spark, sf_dir):
    """Parts as works, each related to a document."""
    p = lift.table(spark, sf_dir, "part")
    links = p.where("p_partkey % 20 = 0").select(F.col("p_name").alias("work_title"), F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("<http://x/"), F.col("p_partkey").cast("string"), F.lit(">"))).otherwise(F.concat(F.lit(" RS1_R"), F.col("p_partkey").cast("string"))).alias("record_identifier"))
    return A.work_quads(links, p.select(F.col("p_type").alias("parent"), F.col("p_brand").alias("child")), EX + "work/", EX, EX + "graph/works")


def _event_dates(spark, sf_dir):
    e = lift.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k, f = F.col("event_id") % 6, lambda x: F.date_format("ts", x)
    secs = F.unix_seconds("ts")
    raw = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))).when(k == 2, secs.cast("string")).when(k == 3, F.concat(secs.cast("double").cast("string"))).when(k == 4, f("d/M/yyyy")).otherwise(f("yyyy"))
    return e.select("event_id", S.normalize_date(raw).alias("day"))


EVENT_DAY = "CASE WHEN event_id % 6 = 5 THEN strftime(ts, '%Y') || '-01-01' ELSE strftime(ts, '%Y-%m-%d') END"


def _page_values(spark, sf_dir):
    p = lift.table(spark, sf_dir, "pages").select("page_id", "html")
    got = lambda rx: F.filter(F.array(F.regexp_extract("html", rx, 1)), lambda x: x != "")
    meta = F.create_map(F.lit("title"), got("(?s)<title>(.*?)</title>"), F.lit("language"), got(r'<html[^>]*lang="([^"]*)"'), F.lit("blank"), F.array(F.lit(" "), F.lit(None)))
    return M.metadata_values(p.select(F.col("page_id").alias("inst"), F.lit("html").alias("tool"), meta.alias("meta")))


PAGE_VALUES = """WITH p AS (SELECT page_id AS inst, 'title' AS field, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS value FROM pages UNION ALL SELECT page_id, 'language', regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) FROM pages), v AS (SELECT DISTINCT inst, field, value FROM p WHERE trim(value) <> '')"""


def _paths(spark, sf_dir):
    d = lift.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("/"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))).alias("path"), F.sha2("text", 256).alias("sha256"))


def _i1(spark, sf_dir):
    files = _paths(spark, sf_dir)
    want = files.where("doc_id % 2 = 0 OR doc_id % 7 <> 0").select("path")
    return A.check_counts(A.recursive_counts(want).where("dir <> '/es'"), A.recursive_counts(files)).selectExpr("dir", "expected", "counted", "status")


def _i2_rows(spark, sf_dir):
    p = _paths(spark, sf_dir)
    manifest = p.where("doc_id % 31 <> 0").select("path", F.when(F.col("doc_id") % 37 == 0, F.lit(None)).when(F.col("doc_id") % 41 == 0, F.sha2("sha256", 256)).otherwise(F.upper("sha256")).alias("sha256"))
    return A.check_hashes(manifest, p.where("doc_id % 43 <> 0"))


def _i2(spark, sf_dir):
    return _i2_rows(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def _i3(spark, sf_dir):
    p = _paths(spark, sf_dir)
    after = p.where("doc_id % 31 <> 0").select("path", F.when(F.col("doc_id") % 41 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return A.hash_drift(p.where("doc_id % 43 <> 0"), after).select("path", "kind")


def _ordinals(spark, sf_dir):
    c = lift.table(spark, sf_dir, "customer")
    return A.ordinals(c.select(F.col("c_nationkey").cast("string").alias("parent"), F.col("c_name").alias("name"), F.lit(False).alias("is_dir"))).select("parent", "name", F.col("ordinal").cast("long").alias("ordinal"))


def _work_edges(spark, sf_dir):
    return lift.table(spark, sf_dir, "part").select(F.col("p_type").alias("parent"), F.col("p_brand").alias("child"))


def _propagated(spark, sf_dir):
    n = lift.table(spark, sf_dir, "nation")
    links = n.where("n_nationkey % 5 = 0").select(F.concat(F.lit("Work "), F.col("n_regionkey").cast("string")).alias("work"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity"))
    inc = lift.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    edges = _frame(spark, [("Cycle", " work 0 "), ("Cycle", "WORK 1"), ("Cycle", "Cycle")], "parent string, child string")
    return A.propagate(links, inc, edges)


PROPAGATED = """WITH l AS (SELECT 'Work ' || n_regionkey AS work, 'n' || n_nationkey AS entity, n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey % 5 = 0),
x AS (SELECT work, entity, r FROM l UNION SELECT work, 'c' || c_custkey, r FROM l JOIN customer ON c_nationkey = k)
SELECT work, entity FROM x UNION SELECT 'Cycle', entity FROM x WHERE r IN (0, 1)"""


def _authors(spark, sf_dir):
    c = lift.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.author_acceptable(F.col("role"), ["user", "syst"]).alias("ok"))


def _prompts(spark, sf_dir):
    q = lift.graph(spark, sf_dir)
    rows = N.metadata_maps(q).join(N.hashes(q), "inst", "left")
    return rows.select("inst", N.prompt("meta", "hash").alias("prompt"), N.first_of("meta", *N.MIME_FIELDS).alias("mime"), N.first_of("meta", *N.SIZE_FIELDS).alias("size"))


MIME_LABEL_ROWS = [("text/en", "English text"), ("text/de", "German text")]
INST, REC = f"'{EX}inst/' || doc_id", f"'{EX}record/' || doc_id"
FIELD_SETS = [("Password", "SecurityMetadata", 2), ("Password", "CompressedFileMetadata", 8), ("ImageWidth", "ImageMetadata", 3), ("PageCount", "DocumentContentMetadata", 9), ("MIMEType", "DocumentContentMetadata", 9)]

DOMAIN = {
    "e1_same_hash_groups": (_docs(E.same_hash_groups), f"{BASE}, h AS (SELECT doc_id, sha256(text) AS hash FROM d UNION SELECT doc_id, sha256(sha256(text)) FROM d WHERE doc_id % 79 = 0 AND doc_id % 83 <> 0) SELECT hash, count(*) AS n, count(*) * (count(*) - 1) AS links FROM h GROUP BY hash HAVING count(*) > 1"),
    "e2_event_dates": (_event_dates, f"SELECT event_id, {EVENT_DAY} AS day FROM events"),
    "e1_same_hash_links": (_docs(lambda q: E.same_hash_links(q)), f"""{BASE}, h AS (SELECT {INST} AS i, sha256(text) AS hash FROM d UNION SELECT {INST}, sha256(sha256(text)) FROM d WHERE doc_id % 79 = 0 AND doc_id % 83 <> 0), m AS (SELECT hash, min(i) AS m FROM h GROUP BY hash HAVING count(*) > 1), s AS (SELECT i, m FROM h JOIN m USING (hash) WHERE i <> m)
        SELECT i AS a, m AS b FROM s UNION SELECT m, i FROM s"""),
    "e2_creation_dates": (_docs(lambda q: E.dates(q, "dcterms:created", "rico:Record").select("entity", "day")), f"{BASE} SELECT {REC} AS entity, day FROM k WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND {OWNED}"),
    "e2_creation_date_quads": (_docs(lambda q: E.date_quads(E.dates(q, "dcterms:created", "rico:Record"), *E.DATED[0], "embedded").select("s", "p", "o")), f"""{BASE}, x AS (SELECT {REC} AS e, day, '{EX}date/' || replace(day, '-', '') AS dt FROM k WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND {OWNED}), y AS (SELECT DISTINCT day, dt FROM x)
        SELECT e AS s, '{PREFIX["rico"]}hasCreationDate' AS p, dt AS o FROM x UNION ALL SELECT dt, '{PREFIX["rico"]}isCreationDateOf', e FROM x UNION ALL SELECT dt, '{PREFIX["rdf"]}type', '{PREFIX["rico"]}Date' FROM y
        UNION ALL SELECT dt, '{PREFIX["rico"]}normalizedDateValue', day FROM y UNION ALL SELECT dt, '{PREFIX["rico"]}expressedDate', strftime(CAST(day AS DATE), '%d %B %Y') FROM y UNION ALL SELECT dt, '{PREFIX["rico"]}type', 'Derived from embedded metadata' FROM y"""),
    "e3_modification_dates": (_docs(lambda q: E.dates(q, "dcterms:modified", "rico:Record").select("entity", "day")), f"{BASE} SELECT {REC} AS entity, day FROM k WHERE doc_id % 3 = 0 AND {OWNED}"),
    "e4_fallback_dates": (_docs(lambda q: E.fallback_dates(q).select("entity", "day")), f"{BASE} SELECT {REC} AS entity, '2024-01-01' AS day FROM k WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0 AND {OWNED} UNION ALL SELECT '{EX}set/' || lang || '_' || source, '2024-02-01' FROM leaf"),
    "e5_recordset_dates": (_docs(lambda q: E.dates(q, "st_mtime", "rico:RecordSet").select("entity", "day")), f"{BASE} SELECT '{EX}set/' || lang || '_' || source AS entity, '2024-02-01' AS day FROM leaf"),
    "e6_instantiation_dates": (_docs(lambda q: E.dates(q, "st_mtime", "rico:Instantiation", None).select("entity", "day")), f"{BASE} SELECT {INST} AS entity, '2024-01-01' AS day FROM k WHERE doc_id % 5 = 0 UNION ALL SELECT '{EX}setinst/' || lang || '_' || source, '2024-02-01' FROM leaf"),
    "e12_enriched_counts": (_docs(lambda q: E.enrich(q, {"creation", "titles", "media"}).groupBy("p").agg(F.count("*").alias("n"))), f"""{BASE}, x AS (SELECT doc_id, day FROM k WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND {OWNED}), y AS (SELECT count(DISTINCT day) AS days, count(*) AS links FROM x), t AS (SELECT (SELECT count(*) FROM d WHERE doc_id % 50 <> 0) + (SELECT count(*) FROM leaf) + 1 AS titles)
        SELECT '{PREFIX["rico"]}' || p AS p, n FROM (SELECT 'hasCreationDate' AS p, links AS n FROM y UNION ALL SELECT 'isCreationDateOf', links FROM y UNION ALL SELECT 'normalizedDateValue', days FROM y UNION ALL SELECT 'expressedDate', days FROM y
        UNION ALL SELECT 'type', days + (SELECT count(*) FROM k WHERE doc_id % 17 <> 0) FROM y UNION ALL SELECT 'hasOrHadTitle', titles FROM t UNION ALL SELECT 'isOrWasTitleOf', titles FROM t)
        UNION ALL SELECT '{PREFIX["rdf"]}type', days + titles FROM y, t UNION ALL SELECT '{PREFIX["rdfs"]}label', titles FROM t"""),
    "e7_titles": (_docs(lambda q: pattern(E.titles(q), "rico:hasOrHadTitle", "entity", "title")), f"{BASE} SELECT '{EX}record/' || doc_id AS entity, '{EX}record/' || doc_id || '_title' AS title FROM d WHERE doc_id % 50 <> 0 UNION ALL SELECT '{EX}set/' || lang || '_' || source, '{EX}set/' || lang || '_' || source || '_title' FROM leaf UNION ALL SELECT '{EX}set/root', '{EX}set/root_title'"),
    "e8_equivalent_types": (lambda s, d: E.equivalent_types(lift.graph(s, d), E.equivalence_table(s)), _values([(f"{EX}type/apachetika_Content_Type", f"{EX}type/exiftool_MIMEType")], "a", "b")),
    "e9_set_nodes": (lambda s, d: pattern(E.set_nodes(s), "rdfs:label", "s", "label").select("label"), _values([(n,) for _, n in tables.SETS], "label")),
    "e10_field_sets": (lambda s, d: E.field_set(_frame(s, [("st_size",), ("st_odd",), ("Password",), ("MIMEType",), ("whatever",)], "label string"), _frame(s, FIELD_SETS, "field string, set string, priority int")).withColumnRenamed("set", "set_name"), _values([("st_size", "FileSystemMetadata"), ("st_odd", "FileSystemMetadata"), ("Password", "SecurityMetadata"), ("MIMEType", "DocumentContentMetadata"), ("whatever", "Other")], "label", "set_name")),
    "e10_set_membership": (lambda s, d: pattern(E.set_membership(lift.graph(s, d)), "rico:isOrWasPartOf", "type", "set_node"), _values([(f"{EX}type/{k}", f"{EX}metadataset/{n}") for k, n in (("filesystem_st_size", "FileSystemMetadata"), ("filesystem_st_mtime", "FileSystemMetadata"), ("exiftool_MIMEType", "DocumentContentMetadata"), ("apachetika_Content_Type", "DocumentContentMetadata"), ("apachetika_created", "DocumentContentMetadata"), ("apachetika_modified", "DocumentContentMetadata"), ("apachetika_author", "DocumentContentMetadata"))], "type", "set_node")),
    "e11_media_types": (lambda s, d: E.media_types(lift.graph(s, d), _frame(s, MIME_LABEL_ROWS, "mime string, label string")), f"{BASE} SELECT {INST} AS inst, 'text/' || lang AS mime, CASE lang WHEN 'en' THEN 'English text' WHEN 'de' THEN 'German text' ELSE 'Unknown file' END AS label FROM d WHERE known AND doc_id % 17 <> 0"),
    "e11_media_type_quads": (lambda s, d: pattern(E.media_type_quads(lift.graph(s, d), E.media_labels(s), ("Content-Type", "MIMEType")), "rico:type", "inst", "label"), f"{BASE} SELECT {INST} AS inst, 'Unknown file' AS label FROM k"),
    "i1_count_check": (_i1, """WITH p AS (SELECT doc_id, lang, source FROM documents), f AS (SELECT '/' || lang AS dir, doc_id FROM p UNION ALL SELECT '/' || lang || '/' || source, doc_id FROM p),
        c AS (SELECT dir, count(*) AS counted FROM f GROUP BY dir), e AS (SELECT dir, count(*) AS expected FROM f WHERE (doc_id % 2 = 0 OR doc_id % 7 <> 0) AND dir <> '/es' GROUP BY dir)
        SELECT dir, expected, counted, CASE WHEN expected IS NULL THEN 'ONLY_GRAPH' WHEN counted IS NULL THEN 'MISSING' WHEN expected = counted THEN 'MATCH' ELSE 'DISCREPANCY' END AS status FROM c FULL JOIN e USING (dir)"""),
    "i2_integrity_check": (_i2, "SELECT CASE WHEN doc_id % 31 = 0 THEN 'EXTRA' WHEN doc_id % 37 = 0 THEN 'CORRUPTED' WHEN doc_id % 43 = 0 THEN 'MISSING' WHEN doc_id % 41 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status, count(*) AS n FROM documents WHERE NOT (doc_id % 31 = 0 AND doc_id % 43 = 0) GROUP BY 1"),
    "i3_hash_drift": (_i3, "SELECT '/' || lang || '/' || source || '/' || doc_id AS path, CASE WHEN doc_id % 31 = 0 THEN 'MISSING' WHEN doc_id % 43 = 0 THEN 'NEW' ELSE 'CHANGED' END AS kind FROM documents WHERE NOT (doc_id % 31 = 0 AND doc_id % 43 = 0) AND (doc_id % 31 = 0 OR doc_id % 43 = 0 OR doc_id % 41 = 0)"),
    "a13_recursive_counts": (lambda s, d: A.recursive_counts(_paths(s, d)), "SELECT dir, count(*) AS n FROM (SELECT '/' || lang AS dir FROM documents UNION ALL SELECT '/' || lang || '/' || source FROM documents) GROUP BY dir"),
    "b12_metadata_values": (lambda s, d: _page_values(s, d).select("inst", "field", "value"), f"{PAGE_VALUES} SELECT inst, field, value FROM v"),
    "b13_metadata_types": (lambda s, d: M.metadata_type_ids(_page_values(s, d)).select("tool", "field", F.col("type_no").cast("long").alias("type_no")), f"{PAGE_VALUES} SELECT 'html' AS tool, field, dense_rank() OVER (ORDER BY field) AS type_no FROM (SELECT DISTINCT field FROM v)"),
    "b14_metadata_instances": (lambda s, d: M.metadata_instance_ids(_page_values(s, d)).select("inst", "field", "value", F.col("instance_no").cast("long").alias("instance_no")), f"{PAGE_VALUES} SELECT inst, field, value, row_number() OVER (PARTITION BY inst ORDER BY field, value) AS instance_no FROM v"),
    "b17_software_stacks": (lambda s, d: M.stacks(lift.table(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("component"))), "SELECT stack, count(*) AS owners FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS stack FROM lineitem GROUP BY 1) GROUP BY stack"),
    "w1_ordinals": (_ordinals, "SELECT CAST(c_nationkey AS VARCHAR) AS parent, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_name) AS ordinal FROM customer"),
    "l1_work_parts": (lambda s, d: A.work_parts(_work_edges(s, d)), "SELECT DISTINCT p_brand AS s, 'isPartOf' AS edge, p_type AS o FROM part UNION SELECT p_type, 'hasPart', p_brand FROM part"),
    "l3_propagated_works": (_propagated, PROPAGATED),
    "x2_work_entities": (lambda s, d: _propagated(s, d).groupBy("work").agg(F.countDistinct("entity").alias("n")), f"SELECT work, count(DISTINCT entity) AS n FROM ({PROPAGATED}) GROUP BY work"),
    "x3_neighbours": (lambda s, d: _neighbours(s, d), "SELECT DISTINCT 'c' || c_custkey AS e FROM customer WHERE c_nationkey % 5 = 0 UNION SELECT DISTINCT 'r' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0"),
    "x4_classify_anonymise": (_classify("anonymise"), f"{BASE} SELECT doc_id, CASE WHEN quality = 1 THEN 'protect' ELSE 'anonymise' END AS verdict FROM d"),
    "x4_classify_protect": (_classify("protect"), f"{BASE} SELECT doc_id, CASE WHEN quality = 1 THEN 'protect' WHEN toxic = 1 THEN 'anonymise' ELSE 'protect' END AS verdict FROM d"),
    "x1_entities": (_docs(lambda q: R.entities(q).groupBy("is_record", "g").agg(F.count("*").alias("n"))), f"{BASE} SELECT true AS is_record, '{EX}graph/structure' AS g, count(*) AS n FROM d UNION ALL SELECT false, '{EX}graph/structure', {N_SETS}"),
    "x5_redacted_labels": (lambda s, d: _said(s, d, PREFIX["rdfs"] + "label"), f"{BASE} SELECT {REC} AS s FROM d WHERE coalesce(quality, 0) <> 1 UNION ALL SELECT {INST} FROM d WHERE coalesce(quality, 0) <> 1 AND doc_id % 71 <> 0 UNION ALL SELECT '{EX}tm_author/' || doc_id FROM d WHERE quality = 0 AND doc_id % 71 <> 0 AND doc_id % 7 = 0"),
    "x6_redacted_titles": (lambda s, d: _said(s, d, PREFIX["rdfs"] + "label", titles=True).where(F.endswith("s", F.lit("_title"))), f"{BASE} SELECT {REC} || '_title' AS s FROM d WHERE coalesce(quality, 0) <> 1 AND doc_id % 50 <> 0"),
    "x8_redacted_values": (lambda s, d: _said(s, d, PREFIX["rdf"] + "value"), f"{BASE} SELECT '{EX}tm_author/' || doc_id AS s FROM d WHERE quality = 0 AND doc_id % 71 <> 0 AND doc_id % 7 = 0"),
    "x9_open_titles": (_open_titles, f"{BASE} SELECT {REC} || '_title' AS title FROM d WHERE coalesce(quality, 0) <> 1 AND doc_id % 50 <> 0"),
    "x10_protected_metadata_left": (lambda s, d: R.redacted_metadata(_redacted(s, d, author_types=["MIMEType"])).agg(F.count("*").alias("n")), f"{BASE} SELECT count(*) AS n FROM d WHERE quality = 0 AND doc_id % 71 <> 0"),
    "x11_flags": (lambda s, d: rows_of(_redacted(s, d), R.FLAG).groupBy(F.col("o").alias("flag")).agg(F.count("*").alias("n")), f"{BASE} SELECT CASE WHEN quality = 1 THEN 'no' ELSE 'yes' END AS flag, count(*) AS n FROM d GROUP BY 1"),
    "x12_author_check": (_authors, "SELECT conv_id, turn, trim(coalesce(role, '')) = '' OR contains(lower(role), 'user') OR contains(lower(role), 'syst') AS ok FROM conversations"),
    "x12_protected_authors": (lambda s, d: _said(s, d, PREFIX["rdf"] + "value", acceptable=lambda c: S.author_acceptable(c, ["admin"])), f"{BASE} SELECT '{EX}tm_author/' || doc_id AS s FROM d WHERE doc_id % 71 <> 0 AND doc_id % 7 = 0 AND (quality = 0 OR quality = 1 AND doc_id % 4 <> 0)"),
    "x13_work_protection": (lambda s, d: R.redacted_work_entities(_redacted(s, d), lift.table(s, d, "documents").where("doc_id % 9 = 0").select(F.concat(F.lit(EX + "record/"), F.col("doc_id").cast("string")).alias("e"))), f"{BASE} SELECT {REC} AS e FROM d WHERE doc_id % 9 = 0 AND coalesce(quality, 0) <> 1"),
    "x14_protection_checks": (_protected, "SELECT CAST(0 AS BIGINT) AS redacted_works, CAST(0 AS BIGINT) AS redacted_protected, CAST(0 AS BIGINT) AS open_titles, true AS ok"),
    "n1_describable": (lambda s, d: N.describable(_redacted(s, d)).select("inst"), f"{BASE} SELECT {INST} AS inst FROM d WHERE quality = 1"),
    "n2_prompts": (_prompts, f"""{BASE}, v AS (SELECT doc_id, max(v) FILTER (node = 'tm_size') AS size, max(v) FILTER (node = 'tm_mime') AS mime, max(v) FILTER (node = 'tm_type' AND typed) AS ctype, max(v) FILTER (node = 'tm_author') AS author, max(v) FILTER (node = 'tm_created') AS created, max(v) FILTER (node = 'tm_modified') AS modified, max(v) FILTER (node = 'tm_mtime') AS mtime FROM tm GROUP BY doc_id),
        h AS (SELECT doc_id, min(hash) AS hash FROM (SELECT doc_id, sha256(text) AS hash FROM d UNION ALL SELECT doc_id, CASE WHEN doc_id % 83 = 0 THEN 'not-a-hash' ELSE sha256(sha256(text)) END FROM d WHERE doc_id % 79 = 0) GROUP BY doc_id)
        SELECT '{EX}inst/' || doc_id AS inst, concat_ws(chr(10), 'MIME Type: ' || coalesce(ctype, mime), 'File Size: ' || size, 'Hash: ' || left(hash, 16) || '...', 'Author: ' || author, 'dcterms:created: ' || created, 'dcterms:modified: ' || modified, 'Content-Type: ' || ctype, 'MIMEType: ' || mime, 'st_mtime: ' || mtime, 'st_size: ' || size) AS prompt,
        coalesce(ctype, mime) AS mime, size FROM v JOIN h USING (doc_id) UNION ALL SELECT '{EX}setinst/' || lang || '_' || source, 'st_mtime: 1706745600', NULL, NULL FROM leaf"""),
    "n5_descriptions": (lambda s, d: N.describe(N.prompts(lift.graph(s, d)).where(F.col("path") != "/shared")), f"""{BASE}, h AS (SELECT doc_id, min(hash) AS hash FROM (SELECT doc_id, sha256(text) AS hash FROM d UNION ALL SELECT doc_id, CASE WHEN doc_id % 83 = 0 THEN 'not-a-hash' ELSE sha256(sha256(text)) END FROM d WHERE doc_id % 79 = 0) GROUP BY doc_id)
        SELECT {INST} AS inst, 'File with MIME Type: ' || CASE WHEN doc_id % 17 <> 0 THEN 'Text/' || lang || '; charset=utf-8' ELSE 'text/' || source END || ', File Size: ' || n_chars || ', Hash: ' || left(hash, 16) || '...' AS description FROM k JOIN h USING (doc_id) WHERE doc_id % 97 <> 0"""),
    "n6_description_quads": (lambda s, d: N.description_quads(lift.table(s, d, "pages").select(F.concat(F.lit(EX + "inst/"), F.col("page_id").cast("string")).alias("inst"), F.col("url").alias("description")), EX + "graph/descriptions", EX, "llama3.2:1b", "Operator", "2025-01-01T00:00:00").groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("o").alias("objects")).where("n > 8").select("p", "n"), f"""WITH n AS (SELECT count(*) AS n FROM pages) SELECT p, k * n + e AS n FROM n, (VALUES ('{PREFIX["rdf"]}type', 2, 3), ('{PREFIX["rdf"]}value', 1, 0), ('{PREFIX["bodi"]}hasHumanValidation', 1, 0), ('{PREFIX["bodi"]}generatedBy', 1, 0), ('{PREFIX["bodi"]}hasGenerated', 1, 0), ('{PREFIX["rdfs"]}label', 1, 2),
        ('{PREFIX["rico"]}occurredAtDate', 1, 0), ('{PREFIX["rico"]}isDateOfOccurrenceOf', 1, 0), ('{PREFIX["bodi"]}hasOrHadSupervisor', 1, 0), ('{PREFIX["bodi"]}isOrWasSupervisorOf', 1, 0), ('{PREFIX["rico"]}isOrWasPerformedBy', 1, 0), ('{PREFIX["rico"]}performsOrPerformed', 1, 0), ('{PREFIX["bodi"]}hasTechnicalDescription', 1, 0), ('{PREFIX["bodi"]}isTechnicalDescriptionOf', 1, 0)) t(p, k, e)"""),
    "b1_structure_ids": (lambda s, d: A.tree_ids(_tree(s, d), "RS1").select("path", "id", "parent_id", "depth"), f"{TREE_SQL} SELECT path, id, parent_id, depth FROM t"),
    "b2_set_types": (lambda s, d: pattern(_structured(s, d), "rico:hasRecordSetType", "s", "o").groupBy("o").agg(F.count("*").alias("n")), f"{TREE_SQL} SELECT '{EX}recordSetType/' || CASE WHEN id = 'RS1_RS1' THEN 'root-container' ELSE 'folder' END AS o, count(*) AS n FROM t WHERE sha IS NULL GROUP BY 1"),
    "b3_locations": (lambda s, d: pattern(_structured(s, d), "prov:atLocation", "inst", "l").join(pattern(_structured(s, d), "rdfs:label", "l", "path"), "l").select("inst", "path"), f"{TREE_SQL} SELECT '{EX}inst/' || id AS inst, path FROM t"),
    "b4_storage": (lambda s, d: pattern(_structured(s, d), "premis:storedAt", "inst", "store"), f"SELECT '{EX}inst/RS1_RS1' AS inst, '{EX}storage_location/RS1_RS1' AS store"),
    "b5_hierarchy": (lambda s, d: pattern(_structured(s, d), "rico:isOrWasPartOf", "inst", "up"), f"{TREE_SQL} SELECT '{EX}inst/' || id AS inst, '{EX}inst/' || parent_id AS up FROM t"),
    "b7_hash_activities": (lambda s, d: pattern(_structured(s, d), "bodi:hasGenerated", "act", "fix").join(pattern(_structured(s, d), "rdf:value", "fix", "hash"), "fix").select("act", "hash"), f"{TREE_SQL} SELECT '{EX}hashing/' || id AS act, sha AS hash FROM t WHERE sha IS NOT NULL"),
    "b10_structure_labels": (lambda s, d: pattern(_structured(s, d), "rdfs:label", "s", "label").where(F.startswith("s", F.lit(EX + "record/"))), f"{TREE_SQL} SELECT '{EX}record/' || id AS s, CASE WHEN id = 'RS1_RS1' THEN 'First disk' ELSE regexp_extract(path, '[^/]*$') END AS label FROM t"),
    "b11_structure_balance": (lambda s, d: A.structure_balance(A.tree_ids(_tree(s, d), "RS1"), _structured(s, d)), f"{TREE_SQL} SELECT count(*) AS expected, count(*) AS made, true AS same FROM t"),
    "b12_value_quads": (lambda s, d: M.value_quads(M.metadata_values(_file_maps(s, d)), EX + "graph/metadata", EX).groupBy("p").agg(F.count("*").alias("n")), f"""WITH p AS (SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages), v AS (SELECT count(*) FILTER (trim(lang) <> '') AS l, count(*) AS n FROM p), x AS (SELECT l + 2 * n AS nodes, 2 * l + 2 * n AS links, CASE WHEN l > 0 THEN 4 ELSE 2 END AS kinds FROM v)
        SELECT p, n FROM (SELECT '{PREFIX["rdf"]}type' AS p, nodes + kinds AS n FROM x UNION ALL SELECT '{PREFIX["rdf"]}value', nodes FROM x UNION ALL SELECT '{PREFIX["rdfs"]}label', nodes + kinds FROM x UNION ALL SELECT '{PREFIX["bodi"]}hasTechnicalMetadataType', links FROM x UNION ALL SELECT '{PREFIX["bodi"]}isTechnicalMetadataTypeOf', links FROM x
        UNION ALL SELECT '{PREFIX["bodi"]}generatedBy', links + kinds FROM x UNION ALL SELECT '{PREFIX["bodi"]}hasGenerated', links + kinds FROM x UNION ALL SELECT '{PREFIX["bodi"]}hasTechnicalMetadata', nodes FROM x UNION ALL SELECT '{PREFIX["bodi"]}isTechnicalMetadataOf', nodes FROM x)"""),
    "b15_exceptions": (lambda s, d: M.exceptions(_file_maps(s, d)).select("inst", "tool", "field", F.array_join("messages", "|").alias("messages"), F.col("exception_no").cast("long").alias("exception_no")), "SELECT page_id AS inst, 'Apache Tika' AS tool, 'X-TIKA:EXCEPTION:warn' AS field, 'a: first|b' AS messages, CAST(1 AS BIGINT) AS exception_no FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'ExifTool', 'Warning', 'odd', 1 FROM pages WHERE page_id % 7 = 0"),
    "b16_extraction_extents": (lambda s, d: pattern(M.extraction(_file_maps(s, d), EX + "graph/metadata", EX, "operator", "2025-01-01T00:00:00"), "rdf:value", "extent", "took"), f"SELECT '{EX}extent/' || page_id || '_apachetika' AS extent, (page_id % 50) || ' milliseconds' AS took FROM pages"),
    "b17_stack_parts": (lambda s, d: pattern(M.software_quads(M.components(_file_maps(s, d)), EX + "graph/metadata", EX, ["Apache Tika", "ExifTool"]), "rdfs:label", "s", "label").select("label"), "SELECT DISTINCT unnest(CASE WHEN page_id % 2 = 0 THEN ['Software Stack: Apache Tika, parser.Default, parser.Html', 'parser.Html', 'parser.Default', 'Apache Tika', 'ExifTool', 'Software Stack: ExifTool'] ELSE ['Software Stack: Apache Tika, parser.Default', 'parser.Default', 'Apache Tika', 'ExifTool', 'Software Stack: ExifTool'] END) AS label FROM pages"),
    "b20_unused_types": (_docs(V.unused_types), f"SELECT '{EX}type/apachetika_unused' AS s"),
    "a6_media_share": (_docs(lambda q: V.with_share(V.value_distribution(q), most=5)), f"{BASE}, x AS ({MIME}) SELECT value, n, round(100.0 * n / sum(n) OVER (), 2) AS percent FROM x ORDER BY n DESC, value LIMIT 5"),
    "a10_repeated_ids": (lambda s, d: V.repeated_ids(plus(lift.graph(s, d), _again(s, d))), f"{BASE} SELECT 'RS1_R' || doc_id AS identifier, CAST(2 AS BIGINT) AS n, '{EX}other/' || doc_id AS example FROM d WHERE doc_id % 29 = 0"),
    "a11_error_kinds": (lambda s, d: V.error_kinds(lift.table(s, d, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit("Kind"), (F.col("event_id") % 3).cast("string"), F.lit(": event "), F.col("event_id").cast("string"))).alias("error"))), "SELECT 'Kind' || (event_id % 3) AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"),
    "i2_verdict": (lambda s, d: A.integrity_verdict(_i2_rows(s, d)), """WITH c AS (SELECT CASE WHEN doc_id % 31 = 0 THEN 'EXTRA' WHEN doc_id % 37 = 0 THEN 'CORRUPTED' WHEN doc_id % 43 = 0 THEN 'MISSING' WHEN doc_id % 41 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM documents WHERE NOT (doc_id % 31 = 0 AND doc_id % 43 = 0))
        SELECT count(*) AS files, count(*) FILTER (status = 'MATCH') AS "match", count(*) FILTER (status = 'MISMATCH') AS mismatch, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'EXTRA') AS extra, count(*) FILTER (status = 'CORRUPTED') AS corrupted, round(100.0 * count(*) FILTER (status = 'MATCH') / count(*), 2) AS percent, count(*) FILTER (status = 'MISMATCH') = 0 AS ok FROM c"""),
    "l2_work_quads": (lambda s, d: pattern(_works(s, d), "rico:isRelatedTo", "a", "b").where(F.startswith("a", F.lit(EX + "work/"))), f"SELECT DISTINCT '{EX}work/' || replace(lower(p_name), ' ', '_') AS a, CASE WHEN p_partkey % 40 = 0 THEN 'http://x/' || p_partkey ELSE '{EX}RS1_R' || p_partkey END AS b FROM part WHERE p_partkey % 20 = 0"),
    "l6_record_sets": (lambda s, d: A.record_sets(lift.graph(s, d), lift.table(s, d, "documents").where("doc_id % 6 = 0").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("http://x/RS1_RS"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit(EX + "record/"), F.col("doc_id").cast("string"))).alias("entity"))), f"SELECT CASE WHEN doc_id % 4 = 0 THEN 'http://x/RS1_RS' || doc_id ELSE '{EX}record/' || doc_id END AS entity, doc_id % 4 = 0 AS is_set FROM documents WHERE doc_id % 6 = 0"),
    "l8_graph_size": (lambda s, d: A.graph_size(_works(s, d), EX + "graph/works").selectExpr("n > 0 AS some"), "SELECT count(*) > 0 AS some FROM part"),
    "r3_registry_quads": (lambda s, d: A.registry_quads(rows_of(lift.graph(s, d)).select("g", F.lit("disk").alias("medium")).distinct(), {"disk": "RS1_RS1", "floppy": "RS1_RS3"}, EX + "registry").select("s", "p", "o"), _values([(f"{EX}registry", f"{PREFIX['dc']}hasPart", f"{EX}registry/structure"), (f"{EX}registry/structure", f"{PREFIX['dc']}hasPart", f"{EX}registry/structure/RS1"), (f"{EX}registry/structure/RS1", f"{PREFIX['dc']}hasPart", f"{EX}registry/structure/RS1_RS1"), (f"{EX}registry/structure/RS1", f"{PREFIX['dc']}hasPart", f"{EX}registry/structure/RS1_RS3"), (f"{EX}registry/structure/RS1_RS1", f"{PREFIX['rico']}isRelatedTo", f"{EX}graph/metadata")], "s", "p", "o")),
    "r3_graph_registry": (_docs(A.graph_registry), _values([(f"{EX}graph/structure", None), (f"{EX}graph/metadata", f"{EX}graph/structure")], "g", "describes")),
    "d_duplicate_metadata": (_docs(lambda q: duplicate_metadata(q).select(F.col("i").alias("inst"), F.col("v").alias("value"), "n")), f"{BASE} SELECT {INST} AS inst, CAST(n_chars AS VARCHAR) AS value, CAST(2 AS BIGINT) AS n FROM k WHERE doc_id % 23 = 0"),
    "c_inclusion_cycles": (_docs(cycles), f"{BASE} SELECT '{EX}set/' || lang AS s FROM leaf WHERE source = 'src1' OR lang = 'fr' UNION SELECT '{EX}set/' || lang || '_' || source FROM leaf WHERE source = 'src1'"),
    "f1_date_spellings": (lambda s, d: _frame(s, [(x,) for x in DATE_CASES], "raw string").select("raw", S.normalize_date(F.col("raw")).alias("day")), _values(list(zip(DATE_CASES, DATE_WANT, strict=True)), "raw", "day")),
    "f7_clean_mime": (lambda s, d: _frame(s, [("Text/HTML; charset=x",), (" image/png ",), ("model/x",), ("text",), ("text/a b",), ("",)], "raw string").select("raw", S.clean_mime(F.col("raw")).alias("mime")), _values([("Text/HTML; charset=x", "text/html"), (" image/png ", "image/png"), ("model/x", None), ("text", None), ("text/a b", None), ("", None)], "raw", "mime")),
    "f8_title_keys": (lambda s, d: lift.table(s, d, "part").select("p_partkey", S.title_key(F.col("p_name")).alias("key")), "SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[ /\\\\-]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_'), 100), ''), 'untitled') AS key FROM part"),
    "k1_nquads_round_trip": (lambda s, d: _round_trip(s, d), "SELECT doc_id, text FROM documents"),
    "a8_status_histogram": (lambda s, d: _i3(s, d).groupBy("kind").agg(F.count("*").alias("n")), "SELECT CASE WHEN doc_id % 31 = 0 THEN 'MISSING' WHEN doc_id % 43 = 0 THEN 'NEW' ELSE 'CHANGED' END AS kind, count(*) AS n FROM documents WHERE NOT (doc_id % 31 = 0 AND doc_id % 43 = 0) AND (doc_id % 31 = 0 OR doc_id % 43 = 0 OR doc_id % 41 = 0) GROUP BY 1"),
}
#: quads and subjects of each graph, as the lift makes them
GRAPHS = f"""{BASE}, m AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 97 = 0) AS shared, count(*) FILTER (doc_id % 83 = 0 OR doc_id % 79 = 0) AS second, count(*) FILTER (doc_id % 3 = 0) AS hashing,
       CAST(sum(18 + CAST(doc_id % 50 <> 0 AS INT) + CAST(doc_id % 71 <> 0 AS INT) + CAST(doc_id % 61 = 0 AS INT) + CAST(doc_id % 73 = 0 AS INT) + CAST(doc_id % 10 <> 0 AS INT) + 2 * CAST(doc_id % 3 = 0 AS INT) + 3 * CAST(doc_id % 83 = 0 OR doc_id % 79 = 0 AS INT) + CAST(doc_id % 79 = 0 AS INT)) AS BIGINT) AS quads FROM d),
f AS (SELECT count(*) AS leaves, count(DISTINCT lang) AS langs, count(*) FILTER (source = 'src1') + count(DISTINCT lang) FILTER (lang = 'fr') AS cycles FROM leaf),
a AS (SELECT count(*) AS n, CAST(sum(4 - CAST(doc_id % 53 = 0 AS INT) - CAST(doc_id % 11 = 0 AS INT) - CAST(doc_id % 13 = 0 AS INT) - CAST(doc_id % 17 = 0 AS INT) - CAST(doc_id % 19 = 0 AS INT)) AS BIGINT) AS quads FROM k), t AS (SELECT count(*) AS n FROM tm)
SELECT '{EX}graph/structure' AS g, quads + 12 * leaves + 6 * langs + cycles + 40 AS n_triples, 5 * n - shared + least(1, shared) + hashing + second + 3 * leaves + 2 * langs + 15 AS n_subjects FROM m, f
UNION ALL SELECT '{EX}graph/metadata', a.quads + 5 * t.n, 2 * a.n + t.n FROM a, t WHERE a.n > 0"""


#: a location that several files share is one triple less for each of them but one, twice
TOTAL = f"SELECT CAST(sum(n_triples) - 2 * (SELECT greatest(count(*) - 1, 0) FROM documents WHERE doc_id % 97 = 0) AS BIGINT) AS count FROM ({GRAPHS})"


def _again(spark, sf_dir):
    """Other entities that bear a Record's identifier."""
    d = lift.table(spark, sf_dir, "documents").where("doc_id % 29 = 0")
    null = F.lit(None).cast("string")
    return d.select(F.concat(F.lit(EX + "other/"), F.col("doc_id").cast("string")).alias("s"), F.lit(PREFIX["rico"] + "hasOrHadIdentifier").alias("p"), F.concat(F.lit(EX + "identifier/"), F.col("doc_id").cast("string")).alias("o"), F.lit(EX + "g").alias("g"), F.lit("iri").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))


def _round_trip(spark, sf_dir):
    d = lift.table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    q = d.select(F.concat(F.lit(EX), F.col("doc_id").cast("string")).alias("s"), F.lit(PREFIX["rdf"] + "value").alias("p"), F.col("text").alias("o"), F.lit(EX + "g").alias("g"), F.lit("lit").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    back = parse_nquads(format_nquads(q))
    return back.select(F.substring_index("s", "/", -1).cast("long").alias("doc_id"), F.col("o").alias("text"))


def _neighbours(spark, sf_dir):
    n, c = lift.table(spark, sf_dir, "nation"), lift.table(spark, sf_dir, "customer")
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    inc = n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).unionByName(c.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")))
    return R.neighbours(n.where("n_nationkey % 5 = 0").select(name("n", "n_nationkey").alias("e")), inc)


def queries():
    out = {name: _docs(plan) for name, (plan, _) in CHECKS.items()}
    out |= {name: q for name, (q, _) in DOMAIN.items()}
    return out | {"g_graph_overview": _docs(graph_overview), "g_graph_triples": _docs(graph_overview)}


def oracle_sql():
    return VALIDATION_SQL | {name: sql for name, (_, sql) in DOMAIN.items()} | {"g_graph_overview": GRAPHS, "g_graph_triples": GRAPHS, "v01_total_triples": TOTAL}


__all__ = ["COUNTED", "LABELLED", "oracle_sql", "queries", "typed"]
