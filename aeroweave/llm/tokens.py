"""Byte-level BPE encoding of whole texts with a cache of chunks.

A byte-level BPE of this kind first cuts a text into pieces by a fixed pattern and merges inside a piece
only. The chunks used here end where such pieces end, so encoding the chunks one by one gives the ids of
the whole text; most chunks are words seen before, which a dictionary answers.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np

from .common import operator_caches

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CACHE_CHUNKS = 300_000
OPERATOR = "tokens"
LONG_CHUNK = 64

#: A run of Latin letters before an ASCII character or the end; else a run without white space; white space
#: but for a last space that belongs to the next word.
_CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[\x00-\x7f]|\Z)| ?\S+|\s+(?!\S)|\s")
#: White space to Python only, not to the tokenizer: such texts are encoded at once.
_ODD = "\x1c\x1d\x1e\x1f"

_loaded: dict[str, "ChunkEncoder"] = {}
operator_caches[OPERATOR] = _loaded.clear


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in such vocabularies: printable ones for themselves, the
    others, in order, for those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Ids by chunk; asked for a chunk that it lacks, it learns it."""

    def __init__(self, encoder: "ChunkEncoder"):
        self.encoder = encoder

    def __missing__(self, c: str) -> bytes:
        known = self.encoder.old.get(c)
        if known is None:
            known = self.encoder.chunk(c)
            if len(c) > LONG_CHUNK:
                self.encoder.long.append(c)
        self[c] = known
        return known


class ChunkEncoder:
    """Keeps two generations of known chunks: when the young one is full it becomes the old one, and what is
    met again moves back to the young one, so that frequent words stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of an added token, like those with odd white space, are encoded at once
        self.whole = [*_ODD, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype("<u2") if small else np.dtype("<u4")
        self.code = "H" if small else "I"
        self.byte_names = _byte_names()
        self.space = self.byte_names[0x20]
        self.merge = self.tokenizer.model.tokenize
        self.young = _Known(self)
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def chunk(self, c: str) -> bytes:
        """The ids of one chunk. A word of letters, with or without a space before it, is one piece: the library's
        merges apply to its bytes at once, without the steps that keep track of places in the text."""
        if c.isascii():
            spaced = c[0] == " "
            name = c[1:] if spaced else c
            if not name.isalpha():
                name = ""
            elif spaced:
                name = self.space + name
        else:
            name = c.encode().decode("latin-1").translate(self.byte_names) if c.lstrip(" ").isalpha() and max(c) < "ɐ" else ""
        if name:
            return self.pack([t.id for t in self.merge(name)])
        return self.pack(self.tokenizer.encode_batch_fast([c], add_special_tokens=False)[0].ids)

    def encode(self, texts: Iterable[str | None], end: int | None = END_ID) -> list[bytes]:
        """The ids of each text (null: empty) in little-endian bytes of ``dtype``, then the end id."""
        tail = b"" if end is None else self.pack([end])
        if len(self.young) > CACHE_CHUNKS:
            self.old, self.young = self.young, _Known(self)
        known, out = self.young.__getitem__, []
        for text in texts:
            parts = [text] if text and any(odd in text for odd in self.whole) else _CHUNK.findall(text or "")
            out.append(b"".join(map(known, parts)) + tail)
        for c in self.long:  # kept for these texts only
            del self.young[c]
        self.long.clear()
        return out


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, kept from task to task of an operator that encodes."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]
