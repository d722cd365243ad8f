"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here, and its normaliser, metaspace marker, scores and byte fallback are
rebuilt: a unigram model keeps its scores; a BPE model (the public file is one) has its merges derived from them,
best score first. Texts are cut before each run of markers, which no piece of such a vocabulary crosses (checked
when the model is loaded; otherwise texts go whole), and units not met before are encoded in multithreaded
batches. Each new unit is held against the sentencepiece library; where the two differ, sentencepiece's ids stand
and the unit counts as one without parity.

Null texts count as empty and have no ids. Repeated rows are encoded alike; extra columns are ignored; an empty table
gives no rows. Texts are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.shared import arrow_map, text_slices
from quadrille.llm.tokens import public_path

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
CACHE_UNITS = 300_000


def _fields(b: bytes):
    """(number, value) of each field of a protobuf message; values are ints or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = b[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind}")
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, b[i : i + n]
        i += n


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def build(model: Model):
    """A tokenizers.Tokenizer over normalised, escaped text."""
    from tokenizers import Tokenizer, models

    if model.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback))
    if model.kind != BPE:
        raise ValueError("only unigram and BPE models have a counterpart")
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    order = sorted((i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL and len(p) > 1), key=lambda i: (-model.pieces[i][1], i))
    merges = []
    for i in order:
        p = model.pieces[i][0]
        cuts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        merges += sorted(cuts, key=lambda c: (ids[c[0]], ids[c[1]]))
    return Tokenizer(models.BPE(ids, merges, unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback))


class Codec:
    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece
        from tokenizers import normalizers

        with open(path, "rb") as f:
            data = f.read()
        self.model = m = Model(data)
        self.tok, self.check = build(m), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.chars = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.cuts = not m.suffix and m.escape and not any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER)) and not any(k == USER for _, _, k in m.pieces)
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, None] = {}
        self.raw = [self._bytes(*p) for p in m.pieces]

    @staticmethod
    def _bytes(piece: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        m = self.model
        if self.chars:
            text = self.chars.normalize_str(text)
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and m.dummy_prefix:
            text = text + " " if m.suffix else " " + text
        return text.replace(" ", MARK) if m.escape else text

    def _reference(self, unit: str) -> list[int] | None:
        """sentencepiece's ids of a unit that begins with a marker, where it can be asked for one."""
        m = self.model
        if not m.dummy_prefix or m.suffix or not unit.startswith(MARK) or unit == MARK:
            return None
        return self.check.encode(unit[1:].replace(MARK, " "))

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        made = {}
        for unit, e in zip(units, self.tok.encode_batch_fast(units, add_special_tokens=False), strict=True):
            ids = e.ids
            told = self._reference(unit)
            if told is not None and told != ids:
                self.odd[unit] = None
                ids = told
            made[unit] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def encode(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Ids as little-endian 32-bit bytes, and the number of units without parity."""
        known, split, out = self.known, [], []
        for t in texts:
            t = self.normalise(t)
            split.append(self.unit.findall(t) if self.cuts else [t] if t else [])
        new: set[str] = set()
        for units in split:
            new.update(u for u in units if u not in known)
        made = self._learn(list(new)) if new else {}
        if self.cuts and len(known) + len(made) <= CACHE_UNITS:
            known.update(made)
            made = {}
        for units in split:
            ids = b"".join([known.get(u) or made[u] for u in units]) if made else b"".join(map(known.__getitem__, units))
            out.append((ids, sum(u in self.odd for u in units) if self.odd else 0))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and not self.model.suffix and text.startswith(" ") else text


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_pieces(docs: DataFrame, model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, parity, round_trip[, ids]).

    parity: the ids are those that sentencepiece gives unit by unit. round_trip: decoding gives the text back.
    """
    path = model_path or public_path("piece_bpe_32k.model")

    def make():
        c = codec(path)

        def step(b):
            for i in range(0, b.num_rows, 200):
                texts = b.column(1).slice(i, 200).to_pylist()
                got = c.encode(texts)
                cols = [b.column(0).slice(i, 200), pa.array([len(g) // 4 for g, _ in got], pa.int64()), pa.array([zlib.crc32(g) for g, _ in got], pa.int64()), pa.array([not odd for _, odd in got]), pa.array([c.decode(g) == t for (g, _), t in zip(got, texts, strict=True)])]
                names = ["doc_id", "n_pieces", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(g, "<u4").astype(np.int32) for g, _ in got], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

        return step

    return arrow_map(text_slices(docs), make, "doc_id long, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids)


def decode_pieces(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """rows: doc_id, ids array<int>. (doc_id, text); a null array gives an empty text."""
    path = model_path or public_path("piece_bpe_32k.model")

    def make():
        c = codec(path)

        def step(b):
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return arrow_map(rows.select("doc_id", "ids"), make, "doc_id long, text string")
