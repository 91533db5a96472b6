"""Token counts by a two-tier lookup on the map side.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its
pre-tokens have together. Tier one is a broadcast table of the token counts of frequent
pre-tokens, found in a bounded sample. Tier two is a cache in each Python worker: what
the table lacks is encoded once by the tokenizer itself and remembered. The table and
the cache only save work; counts are the library's for every text. No pre-token of the
corpus is shuffled.

Defined results: a null or empty text has 0 bytes and 0 tokens. Special strings inside a
text count as one token each, as the library does by default. Repeated rows are each
counted. An empty table gives an empty result. Other columns pass through; a result
column replaces an input column of the same name.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How GPT-2 style byte-level tokenizers cut a text (fixed value of that format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose classes all Unicode versions of the last decade agree on. A text with
# any other character is encoded whole by the library, whose tables may differ from ours.
_UNSETTLED = re.compile(
    "[^\\x00-ͷΑ-ΡΣ-ԧא-תء-يअ-हก-ะḀ-ỿ"
    "‐-‧‰-⁞€←-⇿∀-⋿─-◿、-〃ぁ-ゖァ-ヺ"
    "一-龥가-힣！-～\U0001f400-\U0001f43e\U0001f600-\U0001f640]"
)
# Rows whose pre-tokens are counted for the broadcast table, and the table's size. Both
# bound memory and affect speed alone.
SAMPLE_ROWS = 4096
TABLE_ENTRIES = 50_000
# A pre-token longer than this is not remembered, and a full cache starts anew.
_LONGEST_KEPT = 64
_CACHE_ENTRIES = 400_000


class TokenCounter:
    """Counts tokens in one process; the tokenizer is built at first use."""

    def __init__(self, definition: str, table: dict[str, int] | None = None) -> None:
        self.definition = definition
        self.table = table or {}
        self._ready = False

    def _prepare(self) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cut = regex.compile(PRE_TOKEN).findall
        parsed = json.loads(self.definition)
        pre = parsed.get("pre_tokenizer") or {}
        plain = (
            parsed.get("normalizer") is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"])
        )
        self.by_parts = plain
        special = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known = dict(self.table)
        self._ready = True

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def pre_tokens(self, text: str) -> list[str]:
        if not self._ready:
            self._prepare()
        return self.cut(text)

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        parts = self.cut(text)
        missing = set(parts).difference(self.known)
        if not missing:
            return sum(map(self.known.__getitem__, parts))
        if len(self.known) + len(missing) > len(self.table) + _CACHE_ENTRIES:
            self.known = dict(self.table)
            missing = set(parts).difference(self.known)
        order = list(missing)
        sizes = map(len, self.tokenizer.encode_batch_fast(order, add_special_tokens=False))
        fresh = dict(zip(order, sizes))
        total = sum(fresh[p] if p in fresh else self.known[p] for p in parts)
        self.known.update((p, n) for p, n in fresh.items() if len(p) <= _LONGEST_KEPT)
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if not self._ready:
            self._prepare()
        if not self.by_parts or (not text.isascii() and _UNSETTLED.search(text)):
            return self._whole(text)
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self._plain(p) for p in pieces if p)


def definition_of(path: str) -> str:
    """The tokenizer file's text, read on the driver; executors get it by broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def frequent_lengths(docs: DataFrame, definition: str, text: str = "text") -> dict[str, int]:
    """Token counts of the pre-tokens that are frequent in a bounded sample of rows.

    Tasks count the pre-tokens of their share of the sample; what is merged and reaches
    the driver has at most TABLE_ENTRIES rows.
    """
    total = docs.count()
    if not total:
        return {}
    sample = docs.select(text).sample(min(1.0, SAMPLE_ROWS / total), seed=1)
    counter = TokenCounter(definition)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(p for p in counter.pre_tokens(value.as_py() or "") if len(p) <= _LONGEST_KEPT)
            if len(seen) > 4 * TABLE_ENTRIES:
                seen = Counter(dict(seen.most_common(TABLE_ENTRIES)))
        top = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    frequent = (
        sample.mapInArrow(counted, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
        .where("n > 1").orderBy(F.desc("n"), "part").limit(TABLE_ENTRIES).collect()
    )
    parts = [r["part"] for r in frequent]
    counter._prepare()
    return dict(zip(parts, map(len, counter.tokenizer.encode_batch_fast(parts, add_special_tokens=False))))


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than `limit` tokens) to every row."""
    definition = definition_of(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast(
        {"definition": definition, "table": frequent_lengths(docs, definition, text)}
    )
    added = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in docs.columns if c.lower() not in added or c == text]
    sent = docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("__bytes"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # A worker keeps the broadcast value between tasks, and with it the cache.
        held = shared.value
        if "counter" not in held:
            held["counter"] = TokenCounter(held["definition"], held["table"])
        count = held["counter"].count
        for batch in batches:
            column = batch.column(kept.index(text))
            sizes = pa.array([count(v.as_py()) for v in column], pa.int64())
            carried = [batch.column(i) for i in out]
            yield pa.RecordBatch.from_arrays(
                [*carried, batch.column(len(kept)), sizes], names=[*(kept[i] for i in out), "n_bytes", "n_tokens"]
            )

    out = [i for i, c in enumerate(kept) if c.lower() not in added]
    fields = {f.name: f.dataType for f in sent.schema.fields}
    schema = docs.select(*(kept[i] for i in out), F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_tokens")).schema
    for field in schema.fields:
        field.nullable = True
        field.dataType = fields.get(field.name, field.dataType)
    return sent.mapInArrow(measured, schema).withColumn("over_limit", F.col("n_tokens") > limit)
