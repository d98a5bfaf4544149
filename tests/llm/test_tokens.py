"""Token shards and packing against the tokenizer applied to whole texts."""

import io
import struct
import zlib

import helpers as H
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aeroweave.llm import packing, queries, sstable, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def table(spark, where):
    return H.documents(spark) if where == "small" else spark.read.parquet(f"{H.SF}/documents.parquet")


@pytest.mark.parametrize("where", ["small", "sf"])
def test_shards(spark, tokenizer, where):
    docs = table(spark, where)
    got = sstable.token_table(docs).collect()
    want, start = [], 0
    for doc_id, text in sorted(H.plain(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(tokenizer, text)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want


@pytest.mark.parametrize("where", ["small", "sf"])
def test_pieces(spark, tokenizer, where):
    docs = table(spark, where)
    got = packing.pieces(docs).collect()
    ids = {i: tokens.encoder(tokens.tokenizer_path()).encode([t])[0] for i, t in H.plain(docs)}
    ids = {i: np.frombuffer(v, "<u2").tolist() for i, v in ids.items()}
    assert all(ids[i] == encode(tokenizer, t) for i, t in H.plain(docs))
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for sequence, offset, length in spans:  # gapless from 0, every window full but the last
        assert sequence * 1024 + offset == at and offset + length <= 1024
        at += length
    assert at == sum(len(ids[i]) for i, _ in H.plain(docs))
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])


def test_sequences_hold_the_pieces(spark):
    docs = H.documents(spark)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2") for r in packing.sequences(docs).collect()}
    assert [len(whole[k]) for k in sorted(whole)][:-1] == [1024] * (len(whole) - 1)
    assert sum(map(len, whole.values())) == sum(r["length"] for r in packing.pieces(docs).collect())


def test_empty(spark):
    assert sstable.token_table(H.none(spark)).count() == packing.pieces(H.none(spark)).count() == 0


def test_lookup():
    out = io.BytesIO()
    writer = sstable.Writer(out, 2, block_bytes=256)
    for i in range(0, 2000, 2):
        writer.add(sstable.key_of(i), np.arange(i % 50, dtype="<u2").tobytes())
    writer.close()
    reader = sstable.Reader(pa.BufferReader(out.getvalue()))
    assert len(reader.get(500)) == 1 and reader.get(500)[0][1].tolist() == list(range(0))
    assert reader.get(542)[0][1].tolist() == list(range(42))
    assert not reader.get(501) and not reader.get(5000)


def test_registered_queries(spark):
    rows = queries.op6_concat_and_cut(spark, H.SF)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_chunks_are_learned_on_lookup(monkeypatch):
    """The ids are the library's across generations of the cache, and long chunks are kept for one call only."""
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 20)
    encoder = tokens.ChunkEncoder(tokens.tokenizer_path())
    odd = ["", " ", "\n\n", "a\x1cb", " déjà", "слово ", "x" * 100, "it's 12,5%  ", "<|endoftext|> a", "über　Straße", "ɐb"]
    texts = [*odd, " ".join(f"word{k} w" + "abcdefgh"[k % 8] * (k % 5) for k in range(60)), *odd]
    for _ in range(3):
        for text in texts:
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert encoder.encode([text], None) == [encoder.pack(want)], text
    assert "x" * 100 not in encoder.young and "x" * 100 not in encoder.old
    assert encoder.young["newword"] == encoder.pack(encoder.tokenizer.encode("newword", add_special_tokens=False).ids)
