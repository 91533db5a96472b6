"""Token counts against the library itself."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardlake.llm import tokens
from wardlake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", "it's we'll '' ''s !'s", "  two  spaces \n\n\t tabs \r\n", "x" * 5000, " " * 3000 + "y", "ab1 " * 4000,
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext", "Ünïcödé 中文字 한국어 ́ combining",
    "𐵀 new letters ࢏ՙ", "😀😁 emoji 👩‍👩‍👧", "٣٤٥ digits ½ ²", "\x00\x01\x1f control \x85 next line",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


def test_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, "again", None)], "doc_id long, text string, N_TOKENS string")
    got = tokens.count_tokens(docs, PATH, limit=10).collect()
    assert len(got) == len(ODD) + 1
    for row in got:
        n = expected(library, row.text)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((row.text or "").encode()), n > 10)


def test_settled_characters_split_alike(library):
    counter = tokens.TokenCounter(tokens.definition_of(PATH))
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or tokens._UNSETTLED.search(c):
            continue
        text = f"a{c}1{c}!{c} {c} a"
        spans = [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)]
        assert list(map(len, counter.pre_tokens(text))) == [e - s for s, e in spans], hex(code)


def test_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE_ENTRIES", 5)
    counter = tokens.TokenCounter(tokens.definition_of(PATH), {" the": 1})
    text = "the quick brown fox jumps over the lazy dog unbelievably"
    assert [counter.count(text) for _ in range(3)] == [expected(library, text)] * 3


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op4_token_counts"](spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        n = expected(library, texts[row.doc_id])
        assert tuple(row) == (row.doc_id, len(texts[row.doc_id].encode()), n, n > 1024)
