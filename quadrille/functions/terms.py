"""RDF terms: one IRI per prefix, N-Quads text, and names made from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespaces of the vocabularies in use.
PREFIX = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rico": "https://www.ica.org/standards/RiC/ontology#",
    "bodi": "http://w3id.org/bodi#",
    "premis": "http://www.loc.gov/premis/rdf/v3/",
    "prov": "http://www.w3.org/ns/prov#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "lrmoo": "http://iflastandards.info/ns/lrm/lrmoo/",
    "dc": "http://purl.org/dc/terms/",
    "ex": "http://example.org/archive/",
}


def iri(name: str) -> str:
    p, _, local = name.partition(":")
    return PREFIX[p] + local


TYPE, LABEL, VALUE = iri("rdf:type"), iri("rdfs:label"), iri("rdf:value")


def escape_literal(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape_literal(c: Column) -> Column:
    """Undo every escape of N-Quads, \\uXXXX and \\UXXXXXXXX too."""
    hidden = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for safe, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        hidden = F.replace(hidden, F.lit(safe), F.lit(raw))
    return F.replace(F.when(hidden.rlike(CODE), _decoded(hidden)).otherwise(hidden), F.lit("\u0000"), F.lit("\\"))


CODE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"


def _decoded(c: Column) -> Column:
    """Numbered characters, by way of UTF-32; the text between them stays as it is."""
    codes, between = F.regexp_extract_all(c, F.lit(f"({CODE})"), F.lit(1)), F.split(c, CODE)
    char = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
    return F.array_join(F.flatten(F.zip_with(between, codes, lambda t, x: F.array(t, F.coalesce(char(x), F.lit(""))))), "")


def tail(c: Column, sep: str = "/") -> Column:
    return F.substring_index(c, sep, -1)


def kind_of_id(c: Column) -> Column:
    """Record for ids that end in _R<n>, RecordSet for RS<n> and all else."""
    return F.when(c.rlike(r"_R[0-9]+$"), F.lit("Record")).otherwise(F.lit("RecordSet"))
