"""Shard files against the library's ids, and their lookups against plain arrays."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardlake.llm import wavelet
from wardlake.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def opened(ids, documents=()):
    return wavelet.WaveletFile(pa.PythonFile(io.BytesIO(wavelet.build(np.array(ids, np.uint16), list(documents))), mode="r"))


def brute(rows):
    """(doc_id, start, n_tokens, crc) of distinct ids, by whole texts."""
    library, at, out = Tokenizer.from_file(PATH), 0, []
    listed = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows]
    for doc, ids in sorted(listed, key=lambda r: (r[0] is not None, r[0] or 0, np.frombuffer(ids_key(r[1]), np.uint8).tobytes())):
        out.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def ids_key(ids):
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes()


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (1, 50_000), (700, 3), (5_000, 49_408), (600_000, 300)])
def test_lookups(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n)
    shard = opened(ids, [(7, n)])
    assert shard.tokens == n and shard.documents == [(7, n)]
    assert np.array_equal(shard.ids(), ids)
    for at in rng.integers(0, n, min(n, 40)).tolist():
        token = int(ids[at])
        assert shard.access(at) == token
        places = np.flatnonzero(ids == token)
        stop = int(rng.integers(at, n + 1))
        assert shard.count(token) == len(places) and shard.count(token, at, stop) == ((places >= at) & (places < stop)).sum()
        k = int(rng.integers(0, len(places)))
        assert shard.find(token, k) == places[k] and shard.find(token, len(places)) is None
    assert shard.count(60_000) == 0 and shard.count(-1) == 0 and shard.find(60_000, 0) is None
    with pytest.raises(IndexError):
        shard.access(n)


def test_lookups_read_few_blocks():
    content = wavelet.build(np.random.default_rng(1).integers(0, 50_000, 2_000_000).astype(np.uint16), [])
    read = []

    class Counted:
        def read_at(self, size, at):
            read.append(size)
            return content[at : at + size]

    shard = wavelet.WaveletFile(Counted())
    read.clear()
    shard.access(1_234_567)
    assert sum(read) < len(content) / 5


def test_words_make_whole_texts():
    """Ids by words are the library's for texts of any characters."""
    encoder, library, rng = wavelet.WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH), random.Random(5)
    parts = ["a", "Ä", "Å", "́", "İ", "ΟΔΟΣ", "Σ", "ﬁ", "가", "ᄀ", "ᅡ", "漢字", "😀", "'s", "'LL", "don't", "12", "½", "<|endoftext|>", "<|endof", "text|>"]
    parts += [" ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", " ", "\x00", "-", "_", ".", "</w>", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3_000)]
    texts += ["".join(chr(rng.randrange(0x270)) for _ in range(rng.randrange(40))) for _ in range(2_000)]
    texts += [a + chr(c) + b for c in range(0x251) for a in ("", "a", "'") for b in ("", "s", "'S")]
    encoder.prepare()
    assert encoder.by_words
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]
    assert encoder.encode([None, ""]) == [b"", b""]


def test_full_caches(monkeypatch):
    monkeypatch.setattr(wavelet, "_CACHE_PIECES", 10)
    encoder, library, rng = wavelet.WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH), random.Random(6)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randrange(60)}, É{rng.choice(['', 'é漢'])}{rng.randrange(9)}" + "z" * rng.choice([1, 60]) for _ in range(9)) for _ in range(3)]
        assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = wavelet.WordEncoder(open(path).read()), Tokenizer.from_file(path)
    assert encoder.encode(["a  b", None]) == [np.array(library.encode("a  b").ids, "<u2").tobytes(), b""] and not encoder.by_words


ODD = [(3, None), (1, ""), (None, "no id"), (None, "also none"), (2, "b a"), (9, "<|endoftext|> x \" \n"), (5, "long word " * 40_000), (-4, "é漢😀")]


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 20])
def test_round_trip(spark, shard_tokens):
    rows = ODD + [(100 + i % 3, "same text") for i in range(30)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start int, file string").repartition(4)
    got = wavelet.round_trip(docs, PATH, shard_tokens=shard_tokens)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)


def test_empty(spark):
    assert wavelet.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_shard_starts(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "_SUM_ROWS", 4)
    rows = [(p, n, f"{p}-{n}", (p * 7 + n) % 5) for p in range(30) for n in range(p % 3)]
    got = {r.file: r.start for r in wavelet.shard_starts(spark.createDataFrame(rows, "part int, number int, file string, tokens long")).collect()}
    assert got == {f: sum(r[3] for r in rows[:i]) for i, (_, _, f, _) in enumerate(rows)}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op12_token_shards"](spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
