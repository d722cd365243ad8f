"""Scalar functions of the archive workflow as native expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MIME_PREFIXES = ["image/", "video/", "audio/", "text/", "application/"]


def _day(text: Column, fmt: str) -> Column:
    return F.date_format(F.try_to_timestamp(text, F.lit(fmt)), "yyyy-MM-dd")


def normalize_date(c: Column, exif: bool = False) -> Column:
    """Any of the spellings of FIXTURES A6 as yyyy-MM-dd; NULL if none fits or the day doesn't exist.

    Epoch seconds count in UTC up to 2100; a date written with an offset keeps its written day.
    """
    t = F.trim(c)
    number = t.rlike(r"^[+]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$")
    epoch = number & (t.rlike("[eE]") | (F.length(F.replace(t, F.lit("."), F.lit(""))) >= 10))
    seconds = t.try_cast("double")
    days = F.floor(F.when(seconds.between(0, 4102444800), seconds) / 86400).cast("int")
    as_day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")  # of UTC, whatever the session's zone
    part = lambda i, n: F.lpad(F.regexp_extract(t, r"^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)", i), n, "0")
    ymd, dmy = F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), F.concat_ws("-", part(3, 4), part(2, 2), part(1, 2))
    out = (
        F.when(t.rlike(r"^[0-9]{8}$"), _day(t, "yyyyMMdd"))
        .when(epoch, as_day)
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), _day(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"), _day(ymd, "yyyy-MM-dd"))
        .when(t.rlike(r"^[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}$"), _day(dmy, "yyyy-MM-dd"))
        .when(t.rlike(r"^[0-9]{4}$"), F.concat(t, F.lit("-01-01")))
    )
    return out.when(t.rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2}( .*)?$"), _day(F.replace(F.substring(t, 1, 10), F.lit(":"), F.lit("-")), "yyyy-MM-dd")) if exif else out


def date_in_words(day: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "dd MMMM yyyy"), day)


def clean_mime(c: Column) -> Column:
    """Lower-cased type/subtype without parameters, or NULL where it isn't one of the usual kinds."""
    m = F.lower(F.trim(F.substring_index(c, ";", 1)))
    ok = m.contains("/") & (F.length(m) >= 3) & ~m.rlike(r"[ \n\t]") & F.exists(F.array(*map(F.lit, MIME_PREFIXES)), lambda p: F.startswith(m, p))
    return F.when(ok, m)


@functools.cache
def _folds() -> tuple[str, str, str]:
    """Characters whose decomposition is one character and combining marks, that character, and the combining marks."""
    pairs, marks = [], []
    for x in range(0xA0, 0x3000):
        c = chr(x)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        base = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
        if len(base) == 1 and base[0] != c:
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), "".join(marks)


def title_key(c: Column, most: int = 100) -> Column:
    """A title as a name for an IRI: accents folded, blanks, slashes and hyphens to underscores, listed signs dropped, the rest kept."""
    odd, plain, marks = _folds()
    t = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, odd + marks, plain)).otherwise(c)  # what has no counterpart goes
    t = F.lower(F.translate(t, " /\\-.,:;!?\"'()[]", "____"))
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(t, F.lit(most)), "_+$", ""), F.lit("")), F.lit("untitled"))


def normalize_path(c: Column, base: str | None = None) -> Column:
    p = F.trim(F.replace(c, F.lit("\\"), F.lit("/")))
    if base:
        p = F.when((p == base) | F.startswith(p, F.lit(base.rstrip("/") + "/")), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(p, "^/+", "")))
    return F.regexp_replace(p, "/+$", "")


def is_subpath(a: Column, b: Column) -> Column:
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All proper ancestor directories of /a/b/c: /a, /a/b."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def basename(c: Column) -> Column:
    return F.element_at(F.filter(F.split(c, "/"), lambda x: x != ""), -1)


def field_key(c: Column) -> Column:
    return F.regexp_replace(c, "[ :/-]", "_")


def software_key(c: Column) -> Column:
    return F.translate(c, "/: .-;", "__")


def permissions(mode: Column) -> Column:
    return F.concat(F.lit("0o"), F.lower(F.conv(mode.bitwiseAND(4095).cast("string"), 10, 8)))


def author_acceptable(text: Column, tokens: list[str], whole_words: bool = False) -> Column:
    """Empty, or holding one of the tokens (anywhere, or as a word)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [low.rlike(rf"\b{t}\b") if whole_words else low.contains(t) for t in tokens]
    out = F.trim(low) == ""
    for h in hits:
        out = out | h
    return out


def clean_description(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    t = F.trim(F.regexp_replace(t, "^[\"']|[\"']$", ""))
    return F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def media_category(c: Column) -> Column:
    """image, video or audio for the media types that are listed, else NULL."""
    known = F.create_map(*[F.lit(x) for kind, names in MEDIA_CATEGORIES.items() for n in names for x in (f"{kind}/{n}", kind)])
    return F.try_element_at(known, F.lower(F.trim(F.substring_index(c, ";", 1))))


def record_iri(identifier: Column, base: str) -> Column:
    """<iri> as it is, anything else below ``base``."""
    t = F.trim(identifier)
    return F.when(F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")), F.regexp_replace(t, "^<|>$", "")).otherwise(F.concat(F.lit(base), t))


def record_kind(iri_or_id: Column) -> Column:
    """Record or RecordSet by the id at the end; ids of no known form are Records unless they name a record set."""
    last = F.regexp_extract(iri_or_id, r"([^/#]+)$", 1)
    low = F.lower(iri_or_id)
    guess = F.when(low.contains("recordset") | (F.size(F.split(low, "_")) > 5), F.lit("RecordSet")).otherwise(F.lit("Record"))
    return F.when(last.rlike(r"_R[0-9]+$"), F.lit("Record")).when(last.rlike(r"(^|_)RS[0-9]+$"), F.lit("RecordSet")).otherwise(guess)


def instantiation_id(c: Column) -> Column:
    """What follows the last slash, or else the last hash sign; NULL without either."""
    found = F.coalesce(F.nullif(F.regexp_extract(c, r"/([^/]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"#([^#]+)$", 1), F.lit("")))
    return F.translate(found, " :/", "___")


def activity_parts(c: Column) -> Column:
    """(inst, tool) of an extraction Activity's IRI .../<inst>_<tool>_metaextr."""
    rx = r"/([^/]+)_([^_/]+)_metaextr"
    part = lambda i, other: F.coalesce(F.nullif(F.regexp_extract(c, rx, i), F.lit("")), F.lit(other))
    return F.struct(part(1, "unknown_inst").alias("inst"), part(2, "unknown_tool").alias("tool"))


def tool_source(tool: Column) -> Column:
    """The tool that a type of metadata comes from: exiftool, os, or else tika."""
    t = F.lower(F.coalesce(tool, F.lit("")))
    return F.when(t.contains("exif"), F.lit("exiftool")).when(t.contains("os") | t.contains("python"), F.lit("os")).otherwise(F.lit("tika"))


def tool_short(tool: Column) -> Column:
    """The tool's short name in IRIs."""
    t = F.lower(tool)
    return F.when(t.contains("apache tika"), F.lit("apachetika")).when(t.contains("exiftool"), F.lit("exiftool")).when(t.contains("os"), F.lit("os")).otherwise(F.translate(t, " -.", ""))


def main_software(tool: Column, python: str) -> Column:
    """The Software that a tool belongs to; ``python`` names the interpreter behind the file system's values."""
    source = tool_source(tool)
    return F.when(source == "exiftool", F.lit("ExifTool")).when(source == "os", F.lit(python)).otherwise(F.lit("Apache Tika"))


def documentation(software: Column) -> Column:
    """Where a program is documented, or NULL."""
    name = F.lower(F.trim(software))
    out = F.lit(None).cast("string")
    for part, url in reversed(DOCUMENTATION):
        out = F.when(name.contains(part), F.lit(url)).otherwise(out)
    return out


def model_label(model: Column) -> Column:
    """A language model's name as it is written, its version kept if the name is known."""
    low = F.lower(F.trim(model))
    base, version = F.substring_index(low, ":", 1), F.when(low.contains(":"), F.concat(F.lit(":"), F.element_at(F.split(low, ":"), 2))).otherwise(F.lit(""))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in MODELS for x in pair]), base)
    return F.when(known.isNotNull(), F.concat(known, version)).otherwise(F.concat(F.upper(F.left(base, F.lit(1))), F.substring(base, 2, 1000)))


def model_page(model: Column, base: str = "https://ollama.com/library/") -> Column:
    return F.concat(F.lit(base), F.substring_index(F.lower(F.trim(model)), ":", 1))


def counter(n: Column, width: int = 4) -> Column:
    """A number with leading zeros; longer ones stay whole."""
    t = n.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def same_name(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(b)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent; NULL of nothing."""
    return F.when(whole != 0, F.round(100.0 * part / whole, digits))


#: Media types with a category of their own.
MEDIA_CATEGORIES = {
    "image": ["jpeg", "png", "tiff", "gif", "bmp", "webp", "heic", "heif", "svg+xml", "x-icon"],
    "video": ["mp4", "quicktime", "x-msvideo", "x-matroska", "mpeg", "webm", "x-flv", "3gpp"],
    "audio": ["mpeg", "wav", "x-wav", "ogg", "flac", "mp4", "aac", "webm", "x-ms-wma", "x-aiff"],
}

#: Part of a program's name, and its documentation.
DOCUMENTATION = [("apache tika", "https://tika.apache.org/"), ("exiftool", "https://exiftool.org/"), ("python os", "https://docs.python.org/3/library/os.html")]

#: Language models and how their names are written.
MODELS = [("llama3.2", "Llama 3.2"), ("llama3.1", "Llama 3.1"), ("llama3", "Llama 3"), ("llama2", "Llama 2"), ("mistral", "Mistral"), ("codellama", "Code Llama"), ("phi3", "Phi-3"), ("gemma", "Gemma")]
