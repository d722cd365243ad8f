"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one separator. N-grams of one to three characters fall into
``2**bits`` buckets. The fit reads a bounded sample: about ``fit_rows`` labelled documents of each language,
chosen by a hash of doc_id among those whose crc32(doc_id) mod 3 is not 1; its counts per language and bucket are
summed before they leave a task, and the log-probability matrix (buckets x languages) is broadcast. Whole texts
are scored, as a sparse product of n-gram counts and matrix.

Null texts and texts without a letter are ``und`` with score 1. With nothing to learn from every text is ``und``
with score 0. Ties go to the language first in order. Extra columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import arrow_map, doc_ranges, string_buffer

ORDERS, CHUNK = (1, 2, 3), 1 << 19
_fold: dict[int, np.ndarray] = {}


def _folding() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter; built once a worker from the Unicode data."""
    if 0 not in _fold:
        table = np.zeros(0x110000, np.uint32)
        for c in (*range(0x20000), *range(0x20000, 0x32400)):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold[0] = table
    return _fold[0]


def _grams(data: np.ndarray, off: np.ndarray, i: int, j: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram of texts i..j, the text each belongs to (not falling), and the letters of each text."""
    points = np.frombuffer(data[off[i] : off[j]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    heads = np.concatenate(([0], np.cumsum((data[off[i] : off[j]] & 0xC0) != 0x80)))[off[i : j + 1] - off[i]]
    c = _folding()[points]
    doc = np.repeat(np.arange(j - i), np.diff(heads))
    letters = np.bincount(doc[c > 0], minlength=j - i)
    h, parts, docs = c.copy(), [], []
    for n in ORDERS:
        if n > 1:
            same = doc[n - 1 :] == doc[: len(doc) - n + 1]
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            use = same & ((c[n - 1 :] > 0) | (c[: len(c) - n + 1] > 0))
        else:
            use = c > 0
        x = (h[use] + np.uint32(n)) * np.uint32(0x9E3779B1)
        parts.append((x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits))
        docs.append(doc[: len(use)][use])
    return parts, docs, letters


def fit(docs: DataFrame, fit_rows: int = 4000, bits: int = 16) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (bucket, language)."""
    known = docs.where(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32)
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1_000_000, -(-fit_rows * 1_000_000 // sizes[lang])))])
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) < shares[F.col("lang")]).select(F.coalesce("text", F.lit("")).alias("text"), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << bits), np.int64)
        for b in batches:
            data, off = string_buffer(b.column(0))
            which = np.array([langs.index(x) for x in b.column(1).to_pylist()], np.int64)
            for i, j in doc_ranges(off, CHUNK):
                parts, docs_of, _ = _grams(data, off, i, j, bits)
                for p, d in zip(parts, docs_of, strict=True):
                    total += np.bincount((which[i:j][d] << bits) + p, minlength=total.size).reshape(total.shape)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    counts = np.zeros((1 << bits, len(langs)))
    summed = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator() if len(langs) > 64 else [summed.toArrow()]:
        if isinstance(r, pa.Table):
            counts[r["bucket"].to_numpy(), r["lang"].to_numpy()] = r["n"].to_numpy()
        else:
            counts[r["bucket"], r["lang"]] = r["n"]
    smooth = counts + 0.1
    return langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, or with ``carry`` all of docs' columns and the last two."""
    bits = int(matrix.shape[0]).bit_length() - 1
    told = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))
    rows = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = rows.columns.index("text")

    def make():
        logs = told.value

        def step(b):
            data, off = string_buffer(b.column(at))
            pred, score = [], []
            for i, j in doc_ranges(off, CHUNK):
                parts, docs_of, letters = _grams(data, off, i, j, bits)
                total = np.zeros((len(langs), j - i))
                for p, d in zip(parts, docs_of, strict=True):
                    for k in range(len(langs)):
                        total[k] += np.bincount(d, weights=logs[k][p], minlength=j - i)
                if langs:
                    top = total.argmax(axis=0)
                    sure = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                for n in range(j - i):
                    if not letters[n] or not langs:
                        pred.append("und")
                        score.append(0.0 if letters[n] else 1.0)
                    else:
                        pred.append(langs[top[n]])
                        score.append(float(sure[n]))
            cols = b.columns if carry else [b.column(0)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred), pa.array(score, pa.float64())], [*(b.schema.names if carry else ["doc_id"]), "lang_pred", "score"])

        return step

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema.fields if carry else rows.schema.fields[:1]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(rows, make, schema)


def language_report(docs: DataFrame, fit_rows: int = 4000) -> DataFrame:
    out = predict(docs, *fit(docs, fit_rows))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, fit_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """docs whose language is told with at least this score; texts without a letter go."""
    if {"lang_pred", "score"} & {c.lower() for c in docs.columns}:
        verdict = predict(docs, *fit(docs, fit_rows)).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("doc_id").distinct()
        return docs.join(verdict, "doc_id", "left_semi").select(docs.columns)
    return predict(docs, *fit(docs, fit_rows), carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(docs.columns)
