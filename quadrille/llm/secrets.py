"""Secret scans by token efficiency.

Three fixed kinds of pattern are found everywhere; beyond them, 24 or more base64-like characters that spend
many tokens on few letters and digits under a tiktoken vocabulary are reported as ``entropy``: whole runs, or
the stretches of a run that do so. Digests in upper case and UUIDs that stand alone or between separators are
left out, and what the fixed kinds take; the rest of such a run is tested. Separators have no weight, so that names
made of words and numbers are told by the ratio alone. Offsets are code points, ends exclusive.

Null and empty texts have no spans. Repeated rows are judged one by one; extra columns are ignored; an empty table
gives no rows. Texts of any length are scanned whole. Spans with one start stand in the order of the kinds.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import arrow_map, text_slices
from quadrille.llm.tokens import public_path

#: The kinds that the query contract names, in the order it gives them, with their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")

LEAST, SHORT = 24, 3
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Digests in upper-case hexadecimal by length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and UUIDs.
KNOWN = re.compile(r"[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
KNOWN_PART = re.compile(rf"(?<![A-Za-z0-9])(?:{KNOWN.pattern})(?![A-Za-z0-9])")

SPANS = "array<struct<kind:string,start:int,end:int>>"


@functools.lru_cache(2)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(piece: str, enc) -> list[tuple[int, int]]:
    """Places of the tokens that hold letters or digits; the split pattern never joins those with separators."""
    out, at = [], 0
    for t in enc.encode_ordinary(piece):
        end = at + len(enc.decode_single_token_bytes(t))
        if piece[at].isalnum():
            out.append((at, end))
        at = end
    return out


def inefficient(run: str, enc, most: float) -> bool:
    """Fewer than ``most`` letters and digits a token that holds some, and neither digest nor UUID."""
    if KNOWN.fullmatch(run):
        return False
    tokens = _tokens(run, enc)
    return sum(e - s for s, e in tokens) < most * len(tokens)


def _dense(sizes: list[int], most: float) -> list[tuple[int, int]]:
    """Ranges of tokens that no longer range beats in ``most`` times its tokens less their characters (Ruzzo and Tompa, in linear time)."""
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, last range with less before it
    total = 0.0
    for k, n in enumerate(sizes):
        before, total = total, total + most - n
        if total <= before:
            continue
        first, low = k, before
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, k + 1, low, total, j))
    return [r[:2] for r in kept]


def random_parts(piece: str, enc, most: float) -> list[tuple[int, int]]:
    """The whole piece if it is inefficient, or else its stretches of LEAST characters that are.

    A dense stretch is drawn out while it stays inefficient: to the next separators, else over short tokens glued to
    it, then over any token until it has LEAST characters.
    """
    tokens = _tokens(piece, enc)
    sizes = [e - s for s, e in tokens]
    if sum(sizes) < most * len(sizes):
        return [(0, len(piece))]
    n, before = len(sizes), [0, *itertools.accumulate(sizes)]
    left, right = list(range(n)), list(range(1, n + 1))  # each token's first and last neighbour without a separator between
    for k in range(1, n):
        if tokens[k - 1][1] == tokens[k][0]:
            left[k] = left[k - 1]
    for k in range(n - 2, -1, -1):
        if tokens[k][1] == tokens[k + 1][0]:
            right[k] = right[k + 1]
    fits = lambda i, j: before[j] - before[i] < most * (j - i)
    out: list[tuple[int, int]] = []
    for i, j in _dense(sizes, most):
        x, y = left[i], right[j - 1]
        i, j = next(w for w in ((x, y), (x, j), (i, y), (i, j)) if fits(*w))
        while i > x and sizes[i - 1] <= SHORT and fits(i - 1, j):
            i -= 1
        while j < y and sizes[j] <= SHORT and fits(i, j + 1):
            j += 1
        while tokens[j - 1][1] - tokens[i][0] < LEAST:
            beside = [(sizes[k], w) for k, w in ((i - 1, (i - 1, j)), (j, (i, j + 1))) if 0 <= k < n and fits(*w)]
            if not beside:
                break
            i, j = min(beside)[1]
        s, e = tokens[i][0], tokens[j - 1][1]
        if e - s < LEAST:
            continue
        while e < len(piece) and piece[e] == "=":
            e += 1
        while out and s < out[-1][1]:
            a, z = out.pop()
            s, e = min(a, s), max(z, e)
        out.append((s, e))
    return out


def _rest(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the taken places leave of start .. end, where that is LEAST characters at least."""
    out = []
    for s, e in [*sorted(taken), (end, end)]:
        if s - start >= LEAST:
            out.append((start, min(s, end)))
        start = max(start, e)
    return out


def spans_of(text: str, enc, most: float) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = [(s, e) for _, s, e in found]
    for m in RUN.finditer(text):
        taken = [(s, e) for s, e in base if s < m.end() and m.start() < e]
        taken += [(k.start() + m.start(), k.end() + m.start()) for k in KNOWN_PART.finditer(m[0])]
        for a, z in _rest(m.start(), m.end(), taken):
            found += [("entropy", a + s, a + e) for s, e in random_parts(text[a:z], enc, most)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = 1.9) -> DataFrame:
    """(doc_id, spans) of every document."""
    path = vocabulary or public_path("byte_bpe_50k.tiktoken")

    def make():
        enc = _ranks(path)

        def step(b: pa.RecordBatch):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, enc, chars_per_token)] for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

        return step

    return arrow_map(text_slices(docs), make, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = 1.9, mark: str = "[secret]") -> DataFrame:
    """docs with every span of each text replaced by ``mark`` (overlapping spans by one); other texts, null too, stay as they are."""
    path = vocabulary or public_path("byte_bpe_50k.tiktoken")
    at = docs.columns.index("text")

    def make():
        enc = _ranks(path)

        def clean(text: str | None) -> str | None:
            if not text or not (spans := spans_of(text, enc, chars_per_token)):
                return text
            out, pos = [], 0
            for _, s, e in spans:
                if s >= pos:
                    out += [text[pos:s], mark]
                pos = max(pos, e)
            return "".join([*out, text[pos:]])

        def step(b: pa.RecordBatch):
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

        return step

    return arrow_map(docs, make, docs.schema)


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Counts, digest and joined spans of each document."""
    found = scan_secrets(docs, **options)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(n(k) for k in BASE_KINDS),
        F.sha2(said(F.filter("spans", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        n("entropy"),
    )
