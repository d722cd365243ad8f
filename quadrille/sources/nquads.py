"""N-Quads text, hash and count manifests, IRI lists and CSV works as DataFrames, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.scalars import ancestors
from quadrille.functions.terms import escape_literal, unescape_literal
from quadrille.operators.quads import KEYS, Quads, rows_of

#: One statement: subject, predicate, object (IRI, blank node or literal with type or tag), graph. The literal is
#: all between its first quote and the last one that a type, tag, graph or dot can follow: no repeated group, whose
#: matching would need stack for each character.
LINE = r'(?s)^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|".*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:[^\s.]\S*)?\s*\.\s*(?:#[^"]*)?$'
LITERAL = r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$'
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


def parse_nquads(lines: DataFrame, default_graph: str = "") -> DataFrame:
    """lines: value. Blank lines, comments and malformed lines give no quad; ``rejected_lines`` shows the last."""
    v = F.col("value")
    rows = lines.where(v.rlike(LINE))
    s, o = F.regexp_extract(v, LINE, 1), F.regexp_extract(v, LINE, 3)
    term = lambda c: F.when(F.startswith(c, F.lit("<")), F.regexp_extract(c, "^<(.*)>$", 1)).otherwise(c)
    literal = F.startswith(o, F.lit('"'))
    dt = F.nullif(F.regexp_extract(o, LITERAL, 2), F.lit(""))
    return rows.select(
        term(s).alias("s"),
        F.regexp_extract(v, LINE, 2).alias("p"),
        F.when(literal, unescape_literal(F.regexp_extract(o, LITERAL, 1))).otherwise(term(o)).alias("o"),
        F.coalesce(F.nullif(term(F.regexp_extract(v, LINE, 4)), F.lit("")), F.lit(default_graph)).alias("g"),
        F.when(literal, F.lit("lit")).when(F.startswith(o, F.lit("_:")), F.lit("bnode")).otherwise(F.lit("iri")).alias("o_kind"),
        F.when(literal & (dt != XSD_STRING), dt).alias("o_dt"),
        F.when(literal, F.nullif(F.regexp_extract(o, LITERAL, 3), F.lit(""))).alias("o_lang"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines that are neither statements nor blank nor comments."""
    v = F.col("value")
    return lines.where(~v.rlike(LINE) & ~v.rlike(r"^\s*(#.*)?$"))


def read_nquads(spark: SparkSession, path: str, default_graph: str = "") -> DataFrame:
    return parse_nquads(spark.read.text(path), default_graph)


def format_nquads(quads: DataFrame) -> DataFrame:
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tag = F.when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(F.lit(""))
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), tag)).otherwise(node(F.col("o")))
    g = F.when(F.coalesce("g", F.lit("")) == "", F.lit("")).otherwise(F.concat(node(F.col("g")), F.lit(" ")))
    return quads.select(F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), o, F.lit(" "), g, F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str, mode: str = "overwrite") -> None:
    format_nquads(quads).write.mode(mode).text(path)


def graph_of_file(lines: DataFrame) -> DataFrame:
    """The graph of the first statement."""
    return parse_nquads(lines.where(F.col("value").rlike(LINE)).limit(1)).select("g")


def profile_nquads(lines: DataFrame, marks: dict[str, str]) -> DataFrame:
    """How many lines hold each mark, and how many are statements."""
    counts = [F.sum(F.col("value").contains(m).cast("long")).alias(n) for n, m in marks.items()]
    return lines.agg(F.sum(F.col("value").rlike(LINE).cast("long")).alias("n_statements"), *counts)


#: Field names of the manifests that other tools read and write.
ENTRY = "struct<path:string,sha256:string,hash:string,size:bigint,modified:string,error:string>"
HASHES = f"file_hashes array<{ENTRY}>, hash_files map<string,string>, file_hash map<string,string>, files map<string,string>"
COUNTS = "sottocartelle array<struct<path:string,file_count:bigint>>"


def read_hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, error) of a manifest in any of its layouts: a list of entries, a map under one of three names, or a
    plain map of path to hash; or of a folder of entries, one a line (``write_hash_manifest``)."""
    raw = spark.read.text(path, wholetext=True).select("value", F.from_json("value", HASHES).alias("j"), F.from_json("value", "map<string,string>").alias("top"))
    null = F.lit(None)
    pair = lambda e: F.struct(e["key"].alias("path"), e["value"].alias("sha256"), null.cast("string").alias("hash"), null.cast("long").alias("size"), null.cast("string").alias("modified"), null.cast("string").alias("error"))
    maps = F.coalesce(F.col("j.hash_files"), F.col("j.file_hash"), F.col("j.files"), F.map_filter("top", lambda k, v: F.length(v) >= 32))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.from_json(x, ENTRY)), lambda e: e["path"].isNotNull())
    one = F.when(F.size(lines) > 0, lines).when(F.size("j.file_hashes") > 0, F.col("j.file_hashes")).otherwise(F.transform(F.map_entries(maps), pair))
    rows = raw.select(F.explode(one).alias("f"))
    rows = rows.select(F.trim(F.replace("f.path", F.lit("\\"), F.lit("/"))).alias("path"), F.lower(F.coalesce("f.sha256", "f.hash")).alias("sha256"), "f.size", "f.error")
    return rows.where(~F.endswith("path", F.lit(".DS_Store")))


def read_count_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTS).json(path, multiLine=True).select(F.explode("sottocartelle").alias("f")).select("f.path", "f.file_count")


def read_iri_list(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    u = F.regexp_replace(F.trim(F.col(f"`{raw.columns[0]}`")), "^<|>$", "")
    return raw.select(u.alias("uri")).where(F.startswith("uri", F.lit("http"))).distinct()


def read_works(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.toDF("work_title", "record_identifier", *raw.columns[2:]).select(F.trim("work_title").alias("work_title"), F.trim("record_identifier").alias("record_identifier")).dropna()


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def read_census(spark: SparkSession, root: str, folders: bool = True) -> DataFrame:
    """What lies below a folder: path, name, parent_path, is_dir, size; with ``folders``, those that hold files at any depth.

    Hidden files are left out, as Spark's sources do. Order is no property of a table: sort by lower(name), name, or by size.
    """
    p = F.col("path")
    names = [F.substring_index(p, "/", -1).alias("name"), F.regexp_replace(p, "/[^/]*$", "").alias("parent_path")]
    files = _files(spark, root).select("path", "length").select("path", *names, F.lit(False).alias("is_dir"), F.col("length").alias("size"))
    if not folders:
        return files
    top = root.removeprefix("file:").rstrip("/")
    dirs = subfolders(files).where(F.length("path") > len(top)).select("path", *names, F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"))
    return files.unionByName(dirs)


def subfolders(files: DataFrame) -> DataFrame:
    """files: path. Every folder that holds one at any depth."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def largest_first(files: DataFrame, n: int, size: str = "size") -> DataFrame:
    """Files dealt over n tasks in turn by size, so that no task has all large ones; largest first in each."""
    w = Window.partitionBy("_salt").orderBy(F.desc(size), "path")
    dealt = files.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(64))).withColumn("_turn", F.pmod(F.row_number().over(w) + F.col("_salt"), F.lit(n)))
    return dealt.repartition(n, "_turn").sortWithinPartitions(F.desc(size)).drop("_salt", "_turn")


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, size, error) of the files below a folder. A file whose bytes can't be read ends the job: nothing is left out."""
    return _files(spark, root).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.lit(None).cast("string").alias("error"))


def write_hash_manifest(hashes: DataFrame, path: str) -> None:
    """Entries, one a line, in as many files as there are tasks."""
    have = [c for c in ("path", "sha256", "size", "modified", "error") if c in hashes.columns]
    hashes.select(*have).write.mode("overwrite").json(path)


def write_count_manifest(counts: DataFrame, path: str, folder: str, when: str) -> None:
    """counts (dir, n) of all folders as one document; a folder's own count is the total. One row holds all folders."""
    entry = F.struct(F.col("dir").alias("path"), F.col("n").alias("file_count"))
    total = F.coalesce(F.max(F.when(F.col("dir") == folder, F.col("n"))), F.lit(0))
    doc = counts.agg(total.alias("conteggio_totale"), F.array_sort(F.collect_list(entry)).alias("sottocartelle"))
    doc.select(F.lit(folder).alias("directory_principale"), "conteggio_totale", F.lit(True).alias("modalita_ricorsiva"), F.lit(when).alias("data_analisi"), "sottocartelle").coalesce(1).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    w = rows.write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).csv(path)


def snapshot(quads: Quads, path: str) -> None:
    """Full export that keeps graphs, each quad once, laid out by predicate for pruning."""
    code = F.regexp_replace(F.regexp_extract("p", "([^/#]+)$", 1), "[^A-Za-z0-9_]", "_")
    rows_of(quads).distinct().withColumn("p_code", code).write.mode("overwrite").partitionBy("p_code").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's quads with p_code, by which patterns read the part of their predicate alone."""
    return spark.read.parquet(path)


def verify_snapshot(quads: Quads, path: str, spark: SparkSession) -> DataFrame:
    """One row: quads and a sum over their hashes, of the graph and of its snapshot, and whether both agree."""
    mark = F.sum(F.xxhash64(*[F.coalesce(c, F.lit("")) for c in KEYS]).cast("decimal(38,0)"))
    told = lambda df, n: df.select(KEYS).distinct().agg(F.count("*").alias(f"{n}_quads"), mark.alias(f"{n}_mark"))
    both = told(rows_of(quads), "graph").crossJoin(told(restore(spark, path), "snapshot"))  # one row each
    return both.select("graph_quads", "snapshot_quads", ((F.col("graph_quads") == F.col("snapshot_quads")) & F.col("graph_mark").eqNullSafe(F.col("snapshot_mark"))).alias("same"))
