"""Token-id files: fixed-width bit packing with block offsets.

Layout of a file, little-endian: magic ``QTK1``, one byte of width; packed blocks of BLOCK ids each, byte
aligned; then the footer: doc ids (int64), first id of each document and the total (int64), byte offset of
each block (int64); last three int64: number of documents, number of blocks, place of the footer. An id takes
the fewest bits that hold the vocabulary's largest id, so block b and any id in it are found without reading
what stands before.

Files follow doc_id: each range of doc_ids makes one, and a manifest names the files that count, so a retried
task leaves nothing but an unlisted file. Null texts count as empty (the end id alone); rows repeating a doc_id
keep a place each, in order of their texts; those without a doc_id come last, as NO_ID in the files; extra columns
are ignored; an empty table has no files.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.shared import NO_ID, Scratch, arrow_map, text_slices
from quadrille.llm.tokens import encoder, public_path

MAGIC, BLOCK = b"QTK1", 1 << 16


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes()
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first+n of a block."""
    if width == 16:
        return np.frombuffer(data, "<u2", n, 2 * first).astype(np.uint32)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    bit = (first + np.arange(n, dtype=np.int64)) * width
    word = np.zeros(n, np.uint64)
    for k in range(5):
        word |= raw[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 5
        self.docs, self.firsts, self.blocks = [], [0], []
        self.rest, self.n_rest = [], 0
        out.write(MAGIC + bytes([width]))

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.firsts.append(self.firsts[-1] + len(ids))
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            self.blocks.append(self.at)
            self.at += self.out.write(pack_bits(ids[a : min(a + BLOCK, end)], self.width))
        self.rest, self.n_rest = [ids[end:]], len(ids) - end

    def close(self) -> int:
        self._flush(True)
        tail = [len(self.docs), len(self.blocks), self.at]
        self.out.write(np.array([*self.docs, *self.firsts, *self.blocks, *tail], "<i8").tobytes())
        self.out.close()
        return self.firsts[-1]


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.f = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, io.SEEK_END)
        n_docs, n_blocks, self.foot = np.frombuffer(self._read(size - 24, 24), "<i8").tolist()
        head = self._read(0, 5)
        if head[:4] != MAGIC:
            raise ValueError("not a token-id file")
        self.width = head[4]
        table = np.frombuffer(self._read(self.foot, 8 * (2 * n_docs + 1 + n_blocks)), "<i8")
        self.docs, self.firsts, self.blocks = table[:n_docs], table[n_docs : 2 * n_docs + 1], table[2 * n_docs + 1 :]
        self._last: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _block(self, b: int) -> bytes:
        if self._last[0] != b:
            end = self.blocks[b + 1] if b + 1 < len(self.blocks) else self.foot
            self._last = b, self._read(int(self.blocks[b]), int(end - self.blocks[b]))
        return self._last[1]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document."""
        at, end, parts = int(self.firsts[k]), int(self.firsts[k + 1]), []
        while at < end:
            b, first = divmod(at, BLOCK)
            n = min(BLOCK - first, end - at)
            parts.append(unpack_bits(self._block(b), self.width, first, n))
            at += n
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def open_shared(url: str, write: bool = False):
    """A file in the shared folder, by any filesystem that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def write_token_files(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode and write; returns the manifest (part, url, n_docs, n_ids), already stored."""
    path, folder = vocabulary or public_path("byte_bpe_50k.json"), scratch.path("ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, url = TaskContext.get().partitionId(), None, ""
        for b in batches:
            enc = encoder(path, end_id)
            if out is None and b.num_rows:
                url = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.qtk"
                out = Writer(open_shared(url, True), width_of(enc.vocab_size))
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out.add(doc_id, np.frombuffer(enc.encode([text.as_py()])[0], "<u4"))
        if out:
            n_docs, n_ids = len(out.docs), out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([url]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "url", "n_docs", "n_ids"])

    rows = text_slices(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(rows.mapInArrow(write, "part long, url string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) read back from the files a manifest names."""
    n_files = max(1, manifest.count())
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("url", F.coalesce("base", F.lit(0)).cast("long").alias("base"))
    placed = placed.repartition(n_files, "url")  # a given number: the few bytes of a manifest are not put into one task

    def make():
        def step(b: pa.RecordBatch):
            for url, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_shared(url) as f:
                    r = Reader(f)
                    for a in range(0, len(r.docs), 2000):
                        z = min(a + 2000, len(r.docs))
                        raw = [r.ids(k).astype("<u4").tobytes() for k in range(a, z)]
                        cols = [pa.array(r.docs[a:z], mask=r.docs[a:z] == NO_ID), pa.array(r.firsts[a:z] + base), pa.array(np.diff(r.firsts[a : z + 1])), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names)

        return step

    return arrow_map(placed, make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_file_report(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, scratch, vocabulary, end_id))
