"""Encoding whole texts with the tokenizers library, with a cache over the pieces that the pre-tokenizer makes.

Both public BPE files split a text with one regular expression before any merge, so a piece's ids depend
on that piece alone. Within characters up to U+017F (without control characters, NBSP and dotted I) the
expression means the same to Python's ``re``; such texts are split here and each new piece is given to the
library's BPE model once. Any other text goes to the library whole, as does one that holds an added token, such as
``<|endoftext|>``, which the library gives that token's id. Ids equal those of the library as loaded in any case.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata

import numpy as np

TOP = 0x180
UNSAFE = {0x130, 0x85, 0xA0}
CACHE_PIECES = 400_000

#: The split patterns inside byte_bpe_50k.json (byte level) and word_bpe_49k.json.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|{O}+"


def _byte_chars() -> list[str]:
    """The character that byte-level BPE shows each byte as: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def _ranges(cat: str) -> str:
    hit = [chr(c) for c in range(TOP) if unicodedata.category(chr(c))[0] == cat]
    return "".join(re.escape(c) for c in hit)


def _compile(split: str) -> re.Pattern[str]:
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(split.replace("{L}", f"[{letters}]").replace("{N}", f"[{numbers}]").replace("{O}", rf"[^\s{letters}{numbers}]"))


_SAFE = "".join(re.escape(chr(c)) for c in [9, 10, 11, 12, 13, *range(32, 127), *(c for c in range(0xA1, TOP) if c not in UNSAFE)])
ODD = re.compile(f"[^{_SAFE}]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes, with ``end`` appended where given."""

    def __init__(self, path: str, end: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.tail = b"" if end is None else int(end).to_bytes(4, "little")
        byte_level = self.tok.normalizer is None
        self.lower = not byte_level
        self.split = _compile(BYTE_SPLIT if byte_level else WORD_SPLIT)
        self.known: dict[str, bytes] = {}
        self.vocab_size = self.tok.get_vocab_size()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.tok.model.tokenize("".join(map(BYTE_CHARS.__getitem__, piece.encode())))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) < CACHE_PIECES:
            self.known[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        get, find, added, out = self.known.get, self.split.findall, self.added, []
        for text in texts:
            if ODD.search(text) or any(a in text for a in added):
                out.append(self._library([text])[0] + self.tail)
                continue
            pieces = find(text.lower() if self.lower else text)
            ids = list(map(get, pieces))
            if None in ids:
                ids = [self.known.get(p) or self._piece(p) if x is None else x for p, x in zip(pieces, ids, strict=True)]
            out.append(b"".join(ids) + self.tail)
        return out


@functools.lru_cache(4)
def encoder(path: str, end: int | None = None) -> Encoder:
    """One per Python worker, so that its cache serves all tasks the worker runs."""
    return Encoder(path, end)
