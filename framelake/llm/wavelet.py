"""Token ids as wavelet matrices, a compressed file a shard.

A shard holds the ids of consecutive documents. Its ids are stored bit by bit: a plane has one bit of
every id, the most significant plane first, and behind each plane the ids are parted stably into those
with a 0 and those with a 1. So counting the ones before a place (rank) leads from plane to plane, and
finding the k-th of them (select) leads back: the file itself answers which token is at a place, how
often a token occurs before a place, and where it occurs, without an index beside it. A plane is cut into
blocks, each compressed on its own, with the ones before each block in a directory, so an answer
unpacks one block a plane.

Documents are sorted by ranges of their keys and encoded where they land; a task closes a shard
whenever its tokens fill one, so memory does not depend on the input. Spark's text writer stores a file
a shard (as bytes, behind which it writes one line end), and its binary reader reads them back.

Ids come from ``tokenizers``. Words between ASCII white space do not touch each other under a file whose
normaliser and splitter are those of ``word_bpe_49k.json``, so the ids of a word are asked once and kept in
a bounded table; texts with special tokens, and all texts under any other file, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.ordering import running
from framelake.runtime import Scratch, batches_of, join_lookup, shared_dir

SHARD_TOKENS = 1 << 21  #: tokens after which a shard is closed
BLOCK_BITS = 1 << 16  #: bits of a plane that are compressed together
WORD_MEMO, WORD_BYTES = 3 << 18, 64  #: words (and pre-tokens) kept by a worker, of words as many again that were met before these, and a kept word's bytes at most
GROUP_BYTES = 1 << 22  #: bytes of texts whose words are looked up together
MAGIC = b"FLWM0001"
#: What the file must say for words to be encoded apart (fixed values of the format).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)?")  # letters (to U+00FF), then signs: a pre-token each


class WordIds:
    """Ids of texts, as bytes of little-endian unsigned 32-bit; those of words are kept once worked out."""

    def __init__(self, path: str, memo: int = WORD_MEMO):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.apart = told.get("normalizer") == _NORMALIZER and len(steps) == 2 and steps[0] == _SPLIT and steps[1].items() >= byte_level.items() and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
        self.apart &= not told.get("truncation") and not told.get("padding") and not any(set(s) & set(" \t\n\r\v\f") or s != s.lower() for s in self.special)
        self.marks = [s.lower().encode() for s in self.special]  # as texts that hold one are told after lower-casing
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a pre-token
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # words of before the last time that they were too many; those met again are kept
        self.parts: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_parts(self, parts: list[bytes]) -> None:
        """Ids of pre-tokens, many asked for in one text: each ends with the only token that ends one."""
        asked = [b" ".join(parts[i : i + 64]).decode() for i in range(0, len(parts), 64)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)])
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(parts):
            raise ValueError("a word is not one pre-token")
        raw, at = ids.tobytes(), 0
        for part, end in zip(parts, ends.tolist(), strict=True):
            self.parts[part] = raw[at:end]
            at = end

    def learn(self, words: set[bytes]) -> None:
        plain, odd = {}, []
        for w in words:
            m = _PLAIN.fullmatch(w)
            if m:
                plain[w] = m.groups()
            else:
                odd.append(w)
        known = self.parts
        new = {p for both in plain.values() for p in both if p is not None and p not in known}
        if new:
            self.learn_parts(list(new))
        for w, (head, tail) in plain.items():
            self.words[w] = known[head] + known[tail] if tail else known[head]
        self.words.update(zip(odd, self.whole([w.decode() for w in odd]), strict=True))

    def group(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts; each of their different words is looked up once."""
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        new = set()
        for i in missing:
            x = self.older.get(words[i])
            if x is None:
                new.add(words[i])
            else:
                self.words[words[i]] = x
        if new:
            self.learn(new)
        for i in missing:
            found[i] = self.words[words[i]]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        ends = np.cumsum(counts)
        first = (np.cumsum(sizes) - sizes)[codes]  # of each word's ids, among those of the different words
        raw = ids[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = 4 * np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for w in [w for w in new if len(w) > WORD_BYTES]:
            del self.words[w]
            self.parts.pop(w, None)
        if len(self.words) > self.memo:
            self.words, self.older = {}, self.words
        if len(self.parts) > self.memo:
            self.parts.clear()
        return [raw[lo:hi] for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, for a bounded number of bytes (or one text) at a time.

        A-Z are lower-cased first where no combining mark can join a letter before that.
        """
        held, size = [], 0
        for text in texts:
            raw = text.encode()
            low = raw if b"\xcc" in raw else raw.lower()
            if not self.apart or any(s in low for s in self.marks):
                yield from self.group(held)
                yield from self.whole([text])
                held, size = [], 0
                continue
            held.append(low)
            size += len(low)
            if size >= GROUP_BYTES:
                yield from self.group(held)
                held, size = [], 0
        yield from self.group(held)


_words: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def build(ids: np.ndarray, keys: list[str | None], lengths: list[int], number: int) -> bytes:
    """The file of one shard: ``ids`` of documents of the given lengths, under the shard's number."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if n else 1
    kind = np.uint16 if planes <= 16 else np.uint32
    values, zeros, directory, body, at = ids.astype(kind), [], [], [], 0
    for p in range(planes - 1, -1, -1):
        bit = (values & kind(1 << p)) != 0
        ones = 0
        for lo in range(0, n, BLOCK_BITS):
            part = bit[lo : lo + BLOCK_BITS]
            packed = zlib.compress(np.packbits(part, bitorder="little").tobytes(), 1)
            directory.append((at, ones))
            body.append(packed)
            at += len(packed)
            ones += int(part.sum())
        directory.append((at, ones))
        zeros.append(n - ones)
        values = np.concatenate([values[~bit], values[bit]])
    head = json.dumps({"shard": number, "tokens": n, "planes": planes, "zeros": zeros, "block": BLOCK_BITS}).encode()
    docs = zlib.compress(json.dumps([keys, lengths]).encode(), 1)
    table = np.array(directory, "<u8").tobytes()
    return MAGIC + struct.pack("<QQQ", len(head), len(docs), len(table)) + head + docs + table + b"".join(body)


class Shard:
    """A shard's file: tokens, counts and occurrences straight from its planes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no wavelet shard")
        sizes = struct.unpack("<QQQ", data[8:32])
        at = [32]
        for s in sizes:
            at.append(at[-1] + s)
        head = json.loads(data[at[0] : at[1]])
        self.number, self.n, self.planes, self.zeros, self.block = head["shard"], head["tokens"], head["planes"], head["zeros"], head["block"]
        self.docs, (self.data, self.body) = data[at[1] : at[2]], (data, at[3])
        self.blocks = -(-self.n // self.block)
        self.directory = np.frombuffer(data, "<u8", 2 * self.planes * (self.blocks + 1), at[2]).reshape(self.planes, self.blocks + 1, 2)
        if self.body + int(self.directory[-1, -1, 0]) > len(data):
            raise ValueError("a wavelet shard is cut off")
        self.open: dict[tuple[int, int], np.ndarray] = {}

    def documents(self) -> tuple[list[str | None], np.ndarray]:
        """Keys and lengths of the documents, in order."""
        keys, lengths = json.loads(zlib.decompress(self.docs))
        return keys, np.array(lengths, np.int64)

    def bits(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block, as bytes 0 and 1; the last block unpacked of each plane is kept."""
        if (plane, block) not in self.open:
            lo, hi = self.directory[plane, block : block + 2, 0].tolist()
            raw = np.frombuffer(zlib.decompress(self.data[self.body + lo : self.body + hi]), np.uint8)
            self.open = {k: v for k, v in self.open.items() if k[0] != plane}
            self.open[plane, block] = np.unpackbits(raw, bitorder="little")[: min(self.block, self.n - block * self.block)]
        return self.open[plane, block]

    def ones(self, plane: int, at: int) -> int:
        """Rank: the ones before a place of a plane."""
        block, inner = divmod(at, self.block)
        before = int(self.directory[plane, block, 1])
        return before + int(self.bits(plane, block)[:inner].sum()) if inner else before

    def token(self, at: int) -> int:
        """Access: the token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for p in range(self.planes):
            bit, ones = int(self.bits(p, at // self.block)[at % self.block]), self.ones(p, at)
            value = value << 1 | bit
            at = self.zeros[p] + ones if bit else at - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences among places lo to hi are, behind the last plane."""
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self.ones(p, lo), self.ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs at places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def plane(self, p: int) -> np.ndarray:
        return np.concatenate([self.bits(p, b) for b in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)

    def places(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Select: all places from lo to hi where a token occurs, in order."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b)
        if a == b:
            return at
        for p in range(self.planes - 1, -1, -1):
            if token >> (self.planes - 1 - p) & 1:
                at = np.flatnonzero(self.plane(p))[at - self.zeros[p]]
            else:
                at = np.flatnonzero(self.plane(p) == 0)[at]
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes from the last one up, each time putting what was parted back together."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            bit = self.plane(p).astype(bool)
            back = np.empty_like(values)
            back[~bit] = values[: self.zeros[p]]
            back[bit] = values[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            values = back
        return values.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the ids of all documents, each with ``end_id`` behind it, in ascending order of ``key``; returns the folder.

    A null or empty text is ``end_id`` alone. Null keys come first; rows that share a key follow one
    another, equal texts together, and each is a document of its own. A document is never divided, so
    one longer than ``shard_tokens`` has a shard to itself. Special strings in texts are the
    tokenizer's special tokens. An empty table writes no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), filled.alias("text"), F.xxhash64(filled).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("key"), "tie", "row"]  # unique, so that many rows of one key spread over ranges

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = _encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        number, keys, ids, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for k, x in zip(batch["key"], encoder(batch["text"].tolist()), strict=True):
                keys.append(k)
                ids.append(x + end)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    yield pd.DataFrame({"file": [build(np.frombuffer(b"".join(ids), "<u4"), keys, [len(x) // 4 for x in ids], number)]})
                    number, keys, ids, held = number + 1, [], [], 0
        if keys:
            yield pd.DataFrame({"file": [build(np.frombuffer(b"".join(ids), "<u4"), keys, [len(x) // 4 for x in ids], number)]})

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("key").cast("string").alias("key"), "text")
    with batches_of(spark, 500):
        files = sorted_rows.mapInPandas(shards, "file binary")
        files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _read(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """``rows(shard)`` (a data frame) of every shard; a file is a row, as large as its shard."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield rows(Shard(data))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(parsed, schema)


def read_documents(spark: SparkSession, path: str, scratch: Scratch, key_type: str = "long") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, from the files; ``start`` counts the ids of all documents before it.

    The checksum is that of the ids as little-endian unsigned 32-bit integers. The result reads steps
    of ``scratch``; what is summed across shards is a row a shard.
    """

    def rows(shard: Shard) -> pd.DataFrame:
        keys, lengths = shard.documents()
        raw, ends = memoryview(shard.tokens().astype("<u4").tobytes()), np.cumsum(lengths)
        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return pd.DataFrame({"shard": shard.number, "key": pd.Series(keys, dtype=object), "inner": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    with batches_of(spark, 1):
        found = scratch.staged(_read(spark, path, "shard long, key string, inner long, n_tokens long, ids_crc32 long", rows))
    sizes = running(found.groupBy("shard").agg(F.sum("n_tokens").alias("tokens")), [F.col("shard")], scratch, "tokens", "before")
    placed = join_lookup(found, scratch.staged(sizes.select("shard", "before")), ["shard"])
    return placed.select(F.col("key").cast(key_type).alias("key"), (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``shard, token, n``: how often each token occurs in each shard, by rank alone."""

    def rows(shard: Shard) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard.number, "token": tokens, "n": [shard.count(t) for t in tokens]})

    return _read(spark, path, "shard long, token long, n long", rows)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``key, at``: every place where a token occurs, counted within its document; found by select."""

    def rows(shard: Shard) -> pd.DataFrame:
        keys, lengths = shard.documents()
        places, ends = shard.places(token), np.cumsum(lengths)
        doc = np.searchsorted(ends, places, side="right")
        return pd.DataFrame({"key": pd.Series([keys[d] for d in doc.tolist()], dtype=object), "at": places - (ends - lengths)[doc]})

    return _read(spark, path, "key string, at long", rows)
