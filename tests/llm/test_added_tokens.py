"""Texts that hold the content of an added token, against the library as loaded."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quadrille.llm import packing, token_files
from quadrille.llm.tokens import Encoder, public_path

TEXTS = ["see <|endoftext|> here", "<|startoftext|><|endoftext|>", "a<|endoftext|>B <|startoftext|> c é", "<|ENDOFTEXT|> <|endof text|>", "日<|endoftext|>", "none", ""]


def library(name):
    tok = Tokenizer.from_file(public_path(name))
    return lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_a_fresh_library(name):
    want = library(name)
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(public_path(name)).encode(TEXTS)] == [want(t).tolist() for t in TEXTS]


def test_token_files_and_packing(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids, words = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    want, at = [], 0
    for k, t in enumerate(TEXTS):
        x = np.append(ids(t), 2).astype("<u4")
        want.append((k, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, token_files.token_file_report(docs).collect())) == want
    parts = {k: [] for k in range(len(TEXTS))}
    for r in packing.pack(docs, with_ids=True).orderBy("doc_id", "start").collect():
        parts[r["doc_id"]] += r["ids"]
    assert parts == {k: [*words(t).tolist(), 2] for k, t in enumerate(TEXTS)}
