"""Token ids of a corpus as one compressed wavelet matrix per shard.

Documents are encoded once and written, dealt to tasks by ranges of their id, and each task
writes its ids as shard files of about `SHARD_TOKENS` tokens. A file holds one bit-plane per
bit of an id, most significant first; below each plane the ids are ordered by its bit, zeros
first. Planes are cut into blocks of 2^18 bits that are compressed on their own, with the
number of ones before each, so that access to one token, counting an id in a range and
finding its k-th occurrence read a few blocks of each plane and nothing else. Reading whole
documents back merges the planes from the last to the first.

File: the magic number, the length of the header, a JSON header (tokens, planes, zeros per
plane, offsets of blocks, ones before each block, documents), compressed blocks.

Files go to the folder in spark.checkpoint.dir through a file system that pyarrow knows; a
file is written under another name and renamed, so that a task that runs again leaves the
same file. What a lost executor had written is not needed again.

Defined results: a null or empty text has no tokens but the end id. A null id sorts first;
rows with equal ids are ordered by their tokens. Each row keeps its own place. Documents are
never split, so a longer one makes a larger shard. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import durable, shared_folder
from wardlake.llm.tokens import definition_of

END_ID = 1
# Tokens per shard file: what one task holds, about 25 bytes each while it builds.
SHARD_TOKENS = 1 << 22
_MAGIC = b"WAVELET1"
_BLOCK_BITS = 1 << 18
_LEVEL = 3
# Pieces, and words, whose ids a worker remembers, and the longest of them.
_CACHE_PIECES = 600_000
_LONGEST_KEPT = 48
# Plain characters lie below; they are their own normal form, and so are their small letters.
_PLAIN_END = 0x180
# White space below that, as tokenizers' patterns have it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
# Rows of the manifest that are added up in one window.
_SUM_ROWS = 4_096


class WordEncoder:
    """Ids of a text, piece by piece.

    If the tokenizer drops white space and nothing in it looks across, the ids of a text are
    those of its pieces in a row, and ids of pieces are remembered. A text of plain Latin
    characters, which no normal form changes, is cut into lower-case pieces by the
    tokenizer's own pattern. Any other text is cut into words, at the six ASCII white-space
    characters only, which every such tokenizer treats as white space. Any other tokenizer
    encodes whole texts.
    """

    def __init__(self, definition: str) -> None:
        self.definition = definition
        self.tokenizer = None
        self.words: dict[str | bytes, bytes] = {}
        self.pieces: dict[str | bytes, bytes] = {}

    def prepare(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.definition)
        parsed = json.loads(self.definition)
        self.by_words = self._drops_space(parsed) and not parsed.get("truncation") and not parsed.get("padding")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if not self.by_words:
            return
        steps = self._steps(parsed)
        self.lowers = {"type": "Lowercase"} in steps
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parsed["added_tokens"]) or "(?!)").search
        kinds = {k: "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Only the last part begins like others, so the frequent ones may be tried first.
        *parts, last = pattern.split("|")
        pattern = "|".join([*sorted(parts, key=lambda p: p[0] == "'"), last])
        for part, text in (("\\p{L}", kinds["L"]), ("\\p{N}", kinds["N"]), ("\\s", _SPACES)):
            pattern = pattern.replace(part, text)
        self.cut = re.compile(pattern).findall
        # The longest run of plain characters; a capital whose small form is two is not plain.
        self.plain = re.compile(f"[^\u0130{chr(_PLAIN_END)}-\U0010ffff]*").fullmatch if {"type": "NFD"} not in steps else lambda word: None
        bare = parsed | {"normalizer": None, "pre_tokenizer": parsed["pre_tokenizer"]["pretokenizers"][1], "added_tokens": []}
        self.of_pieces = Tokenizer.from_str(json.dumps(bare))

    @staticmethod
    def _steps(parsed: dict) -> list[dict]:
        normal = parsed.get("normalizer") or {"type": "Sequence", "normalizers": []}
        return normal["normalizers"] if normal["type"] == "Sequence" else [normal]

    @classmethod
    def _drops_space(cls, parsed: dict) -> bool:
        folds = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        if any(s["type"] not in ("NFC", "NFD", "Lowercase") and s != folds for s in cls._steps(parsed)):
            return False
        cuts = (parsed.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if len(cuts) != 2:
            return False
        first, last = cuts
        # Only runs that the pattern matches are kept, and its class of other characters excludes white space.
        pattern = (first.get("pattern") or {}).get("Regex", "")
        dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        apart = all(
            part in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") or (part.isascii() and part[:1] == "'" and part[1:].isalpha())
            for part in pattern.split("|")
        )
        rest = last["type"] == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex", True)
        added = all(
            not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and len(t["content"].encode().split()) == 1
            for t in parsed["added_tokens"]
        )
        return bool(dropped and apart and rest and added)

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, f.ids).tobytes() for f in found]

    def _joined(self, known: dict, split: list[list], tokenizer, text_of) -> list[bytes]:
        """Ids of split texts; those of new parts are remembered."""
        missing = set().union(*split).difference(known)
        if len(known) + len(missing) > _CACHE_PIECES:
            known.clear()
            missing = set().union(*split)
        order = list(missing)
        known.update(zip(order, self._ids(tokenizer, [text_of(p) for p in order])))
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for part in order:
            if len(part) > _LONGEST_KEPT:
                del known[part]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        if self.tokenizer is None:
            self.prepare()
        texts = [t or "" for t in texts]
        if not self.by_words:
            return self._ids(self.tokenizer, texts)
        out: list[bytes] = [b""] * len(texts)
        plain = [bool(self.plain(t)) and not self.special(t) for t in texts]
        cut = [self.cut(t.lower() if self.lowers else t) for t, p in zip(texts, plain) if p]
        split = [t.encode("utf-8", "surrogatepass").split() for t, p in zip(texts, plain) if not p]
        pieces = iter(self._joined(self.pieces, cut, self.of_pieces, str))
        words = iter(self._joined(self.words, split, self.tokenizer, lambda w: w.decode("utf-8", "surrogatepass")))
        for at, p in enumerate(plain):
            out[at] = next(pieces if p else words)
        return out


def build(ids: np.ndarray, documents: list[tuple[int | None, int]]) -> bytes:
    """The file of a shard: its ids and (doc_id, tokens) of its documents in order."""
    import zstandard

    n = len(ids)
    planes = max(1, int(ids.max(initial=0)).bit_length())
    packer = zstandard.ZstdCompressor(level=_LEVEL)
    zeros, offsets, before, blocks, at = [], [], [], [], 0
    for plane in range(planes - 1, -1, -1):
        bits = (ids & ids.dtype.type(1 << plane)) != 0
        packed = np.packbits(bits)
        starts, ones, seen = [], [], 0
        for first in range(0, n, _BLOCK_BITS):
            block = packed[first >> 3 : first + _BLOCK_BITS >> 3]
            starts.append(at)
            ones.append(seen)
            seen += int(np.bitwise_count(block).sum())
            blocks.append(packer.compress(block.tobytes()))
            at += len(blocks[-1])
        offsets.append([*starts, at])
        before.append([*ones, seen])
        zeros.append(n - seen)
        ids = np.concatenate([ids[~bits], ids[bits]])
    listed = {"tokens": n, "zeros": zeros, "offsets": offsets, "ones": before, "documents": documents}
    header = packer.compress(json.dumps(listed, separators=(",", ":")).encode())
    return b"".join([_MAGIC, len(header).to_bytes(8, "little"), header, *blocks])


class WaveletFile:
    """A shard file, opened for random access; `file` has read_at(size, offset), as pyarrow's have."""

    def __init__(self, file) -> None:
        import zstandard

        self.file = file
        head = file.read_at(16, 0)
        if head[:8] != _MAGIC:
            raise ValueError("not a wavelet file")
        size = int.from_bytes(head[8:], "little")
        self._unpack = zstandard.ZstdDecompressor().decompress
        header = json.loads(self._unpack(file.read_at(size, 16)))
        self.base = 16 + size
        self.tokens: int = header["tokens"]
        self.zeros: list[int] = header["zeros"]
        self.documents = [tuple(d) for d in header["documents"]]
        self._offsets, self._ones = header["offsets"], header["ones"]
        self._block = lru_cache(64)(self._read_block)

    def _read_block(self, plane: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block, and the ones before each of its 64-byte pieces."""
        start, end = self._offsets[plane][number : number + 2]
        block = np.frombuffer(self._unpack(self.file.read_at(end - start, self.base + start)), np.uint8)
        pieces = np.add.reduceat(np.bitwise_count(block).astype(np.int64), np.arange(0, len(block), 64))
        return block, np.concatenate([[0], np.cumsum(pieces)])

    def _ones_before(self, plane: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        number, within = divmod(at, _BLOCK_BITS)
        if not within:
            return self._ones[plane][number]
        block, pieces = self._block(plane, number)
        byte, rest = divmod(within, 8)
        piece = byte >> 6
        count = int(pieces[piece]) + int(np.bitwise_count(block[piece << 6 : byte]).sum())
        if rest:
            count += (int(block[byte]) >> 8 - rest).bit_count()
        return self._ones[plane][number] + count

    def _bit(self, plane: int, at: int) -> int:
        block, _ = self._block(plane, at // _BLOCK_BITS)
        within = at % _BLOCK_BITS
        return int(block[within >> 3]) >> 7 - (within & 7) & 1

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind in a plane, by bisection over ranks."""
        low, high = 0, self.tokens
        while high - low > 1:
            middle = (low + high) // 2
            ones = self._ones_before(plane, middle)
            low, high = (middle, high) if (ones if bit else middle - ones) <= k else (low, middle)
        return low

    def _step(self, plane: int, bit: int, at: int) -> int:
        ones = self._ones_before(plane, at)
        return self.zeros[plane] + ones if bit else at - ones

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        value = 0
        for plane in range(len(self.zeros)):
            bit = self._bit(plane, at)
            value = value << 1 | bit
            at = self._step(plane, bit, at)
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        planes = len(self.zeros)
        if token < 0 or token >> planes:
            return 0, 0
        for plane in range(planes):
            bit = token >> planes - 1 - plane & 1
            start, stop = self._step(plane, bit, start), self._step(plane, bit, stop)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in a range of places."""
        first, last = self._range(token, start, self.tokens if stop is None else stop)
        return last - first

    def find(self, token: int, k: int) -> int | None:
        """Place of the k-th (from 0) occurrence of an id; None if there are fewer."""
        first, last = self._range(token, 0, self.tokens)
        if not 0 <= k < last - first:
            return None
        at, planes = first + k, len(self.zeros)
        for plane in range(planes - 1, -1, -1):
            bit = token >> planes - 1 - plane & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order."""
        n = self.tokens
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        low = np.zeros(n, kind)
        for plane in range(len(self.zeros) - 1, -1, -1):
            parts = [self._block(plane, b)[0] for b in range(-(-n // _BLOCK_BITS))]
            bits = np.unpackbits(np.concatenate(parts), count=n).astype(bool) if parts else np.zeros(0, bool)
            merged, zeros = np.empty(n, kind), self.zeros[plane]
            merged[~bits] = low[:zeros]
            merged[bits] = low[zeros:] | kind(1 << len(self.zeros) - 1 - plane)
            low = merged
        return low


def _storage(folder: str):
    """File system and path of a folder; one-slash file URIs are what Hadoop prints."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def encode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): packed ids of every text with the end id, as two or four bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast({"definition": definition_of(tokenizer_path)})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held = shared.value  # kept by the worker between tasks, and with it what it remembers
        if "encoder" not in held:
            held["encoder"] = WordEncoder(held["definition"])
            held["encoder"].prepare()
        encoder = held["encoder"]
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [i + end for i in encoder.encode(part.column(1).to_pylist())]
                sizes = pa.array([len(i) // width for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        encoded, "doc_id long, n_tokens long, ids binary"
    )


def write_shards(encoded: DataFrame, folder: str, width: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files in order of doc_id; return the written manifest (part, number, file, documents, tokens, bytes)."""
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // shard_tokens))
    kind = np.dtype(f"<u{width}")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        storage, path = _storage(folder)
        held: list[bytes] = []
        documents: list[tuple[int | None, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held, documents
            ids = np.frombuffer(b"".join(held), kind)
            name = f"shard-{part:07d}-{number:04d}.wavelet"
            content = build(ids, documents)
            fresh = f"{path}/.{name}.{uuid.uuid4().hex}"
            with storage.open_output_stream(fresh) as out:
                out.write(content)
            storage.move(fresh, f"{path}/{name}")
            row = {"part": part, "number": number, "file": name, "documents": len(documents), "tokens": len(ids), "bytes": len(content)}
            number, held, documents = number + 1, [], []
            return pa.RecordBatch.from_pylist([row], schema=out_schema)

        out_schema = pa.schema(
            [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]
        )
        size = 0
        for batch in batches:
            for doc, n, ids in zip(*(batch.column(i) for i in range(3))):
                if documents and size + n.as_py() > 2 * shard_tokens:
                    yield flush()
                    size = 0
                held.append(ids.as_py())
                documents.append((doc.as_py(), n.as_py()))
                size += documents[-1][1]
        if documents:
            yield flush()

    storage, path = _storage(folder)
    storage.create_dir(path, recursive=True)
    # The last two keys split rows with equal ids over several tasks.
    keys = ["doc_id", F.substring("ids", 1, 64), F.substring("ids", -64, 64)]
    dealt = encoded.repartitionByRange(parts, *keys).sortWithinPartitions("doc_id", "ids")
    return durable(dealt.mapInArrow(written, "part int, number int, file string, documents long, tokens long, bytes long"))


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Add start, the tokens in all shards before; sums of groups of shards are added up first."""
    group = F.floor(F.col("part") / _SUM_ROWS)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = manifest.groupBy(group.alias("group")).agg(F.sum("tokens").alias("all")).select(
        "group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("group").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("group", group).withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return placed.join(groups, "group").withColumn("start", F.col("base") + F.col("within")).drop("group", "base", "within")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files."""
    shards = durable(shard_starts(manifest).select("file", "start"))
    count = shards.count()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _storage(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with storage.open_input_file(f"{path}/{row['file']}") as file:
                    shard = WaveletFile(file)
                    ids, at, out = shard.ids().astype("<u4"), 0, []
                    for doc, n in shard.documents:
                        out.append((doc, row["start"] + at, n, zlib.crc32(ids[at : at + n])))
                        at += n
                for part in range(0, len(out), 10_000):
                    columns = zip(*out[part : part + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, count), "file").mapInArrow(opened, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, str]:
    """Encode a corpus and write its shard files; the manifest and the folder of the files."""
    encoder = WordEncoder(definition_of(tokenizer_path))
    encoder.prepare()
    folder = f"{shared_folder(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    encoded = durable(encode(docs, tokenizer_path, doc_id, text))
    return write_shards(encoded, folder, encoder.kind.itemsize, shard_tokens), folder


def round_trip(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write a corpus as shard files and read every document's place, length and checksum back."""
    return read_documents(*store(docs, tokenizer_path, doc_id, text, shard_tokens))
