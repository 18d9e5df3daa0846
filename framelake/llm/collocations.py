"""Phrase collocations by dynamic itemset counting.

The documents are dealt to a few shards, which are scanned one after another, round and round. Words
are counted from the first scan on. A longer phrase becomes active as soon as both its subphrases (the
phrase without its last word, and without its first) have been seen ``support`` times so far, even in the
middle of a round; it is then counted in the scans that follow, beside phrases of all other lengths, until it
has been counted in every shard once. So lengths are not counted pass by pass, and the scans end when no
phrase is active any more. What a subphrase reached, and in which scan, is all the state there is:
``reach``, and a phrase is active from the scan after the later of its two on, for one round.

Texts are turned into word numbers once, in chunks that are staged by shard with the hashes of their words;
a scan reads these. A task finds the phrases that may be active by a table of fixed size for each length,
in which the hash of a phrase that reached the support marks a slot with its scan. Slots may be shared, so
counts are kept by scan until a phrase has the support, and a joined look at the exact table of what was
reached then decides which of these scans count; no phrase is missed and none counted in error, whatever
the size of the table. Counts are summed in the task before they are shuffled. Words are told apart by
64-bit hashes of language and word; two words that share one are found when words are summed, and are an
error that another ``seed`` mends.

Most phrases of frequent subphrases are rare, and there are more of them than of all else. So before the scans a
pass for each length adds up how often phrases fall into each of many slots, as many as the table's words ask
for; what is shuffled is about a byte a phrase. A phrase whose slot has less than the support cannot reach it
itself and is never listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import BROADCAST_ROWS, Scratch, batches_of, discard, join_lookup

LONGEST = 4
SUPPORT = 30
SHARDS = 2
TOP = 2_000
SLOTS = 1 << 22  #: bytes of the table of what was reached, for each length
PAGE = 1 << 16  #: slots sent to the driver together
SUM_SLOTS = 1 << 29  #: slots of sums at most, for each length; a task holds a bit of each
SUM_PAGE = 1 << 18  #: slots that are added up together
SUMS_HELD = 1 << 22  #: phrases whose slots a task sorts together
CHUNK = 1 << 20  #: words numbered and counted together
_SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")  # of pieces; a tab parts words
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def slots_of(words: list[np.ndarray], size: int) -> np.ndarray:
    """The slot of each phrase, given as an array of word hashes for each of its places."""
    with np.errstate(over="ignore"):
        mixed = words[0].copy()
        for w, m in zip(words[1:], _MIX, strict=False):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * m + w
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class Numbers(dict):
    """Word numbers of one language in a chunk; new words get the next ones."""

    def __init__(self, lang: str, chunk: Chunk):
        super().__init__({b"": -2, b"\n": -1})
        self.lang, self.chunk = lang, chunk

    def __missing__(self, word: bytes) -> int:
        self.chunk.words.append((self.lang, word))
        n = self[word] = len(self.chunk.words) - 1
        return n


class Chunk:
    """Words of consecutive texts as numbers, -1 between pieces."""

    def __init__(self):
        self.numbers: dict[str, Numbers] = {}
        self.words: list[tuple[str, bytes]] = []
        self.parts: list[np.ndarray] = []
        self.held = 0

    def take(self, lang: str, text: bytes) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = Numbers(lang, self)
        found = text.lower().translate(_SEPARATORS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
        self.parts.append(ids[ids > -2])
        self.parts.append(np.full(1, -1, np.int32))  # no phrase reaches over the end of a text
        self.held += len(found)

    def rows(self, shard: int, seed: int) -> Iterator[pd.DataFrame]:
        """The chunk as a row of kind 0, and its words with their counts as rows of kind 1."""
        import xxhash

        ids = np.concatenate(self.parts)
        ids = ids[(ids >= 0) | np.append(False, ids[:-1] >= 0)]
        counts = np.bincount(ids[ids >= 0], minlength=len(self.words))
        first = xxhash.xxh64_intdigest(b"%d" % seed, 42)
        starts = {lang: xxhash.xxh64_intdigest(lang.encode(), first) for lang in self.numbers}
        hashes = np.array([xxhash.xxh64_intdigest(word, starts[lang]) for lang, word in self.words], np.uint64)  # as hash_of
        columns = dict.fromkeys(("w1", "lang", "word", "n"))
        yield pd.DataFrame({"kind": [0], "shard": [shard], **columns, "ids": [ids.tobytes()], "hashes": [hashes.tobytes()]})
        for lo in range(0, len(counts), 50_000):
            part = slice(lo, lo + 50_000)
            yield pd.DataFrame({"kind": 1, "shard": shard, "w1": hashes[part].view(np.int64), "lang": [x for x, _ in self.words[part]], "word": [w.decode() for _, w in self.words[part]], "n": counts[part], "ids": None, "hashes": None})


def hash_of(lang: Column, word: Column, seed: int) -> Column:
    """The hash that a chunk gives a word."""
    return F.xxhash64(F.lit(str(seed)), lang, word)


def chunked(rows: DataFrame, shards: int, seed: int, chunk_words: int) -> DataFrame:
    """``kind, shard, w1, lang, word, n, ids, hashes``: texts (lang, text) as chunks of word numbers, dealt to shards in turn."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, shard = Chunk(), TaskContext.get().partitionId()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                chunk.take(lang, bytes(text))
                if chunk.held >= chunk_words:
                    yield from chunk.rows(shard % shards, seed)
                    chunk, shard = Chunk(), shard + 1
        if chunk.parts:
            yield from chunk.rows(shard % shards, seed)

    return rows.select("lang", F.col("text").cast("binary").alias("text")).mapInPandas(number, "kind int, shard int, w1 long, lang string, word string, n long, ids binary, hashes binary")


def _has(bits: np.ndarray, ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the slots of the phrases that begin at these places have their bit."""
    slot = slots_of([hashes[ids[at + i]] for i in range(length)], 8 * len(bits))
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def counted(ids: np.ndarray, hashes: np.ndarray, scan: int, shards: int, tables: list[np.ndarray | None], likely: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Counts of the phrases of a chunk that may be active: ``len, w1..w4, until, n``; none is needed after scan ``until``.

    ``likely`` has for each length from 2 on a bit for each slot whose phrases may reach the support.
    """
    recent = scan - shards + 1  # mark of the first scan whose phrases are still active
    if tables[0] is None or len(ids) < 2:
        return
    state = np.append(tables[0][slots_of([hashes], len(tables[0]))], np.uint8(0))[ids]  # of the subphrase that begins at each place; the last entry is for breaks
    for length in range(2, LONGEST + 1):
        first, second = state[:-1], state[1:]
        both, latest = (first > 0) & (second > 0), np.maximum(first, second)
        at = np.flatnonzero(both & (latest >= recent))
        at = at[_has(likely[length - 2], ids, hashes, at, length)]
        if len(at):
            key = ids[at].astype(np.int64)
            for i in range(1, length):
                if i > 1:
                    _, key = np.unique(key, return_inverse=True)
                key = key << 32 | ids[at + i]
            _, where, counts = np.unique(key, return_index=True, return_counts=True)
            where = at[where]
            for lo in range(0, len(where), 100_000):
                part = where[lo : lo + 100_000]
                words = {w: hashes[ids[part + i]].view(np.int64) if i < length else np.zeros(len(part), np.int64) for i, w in enumerate(WORDS)}
                yield pd.DataFrame({"len": np.full(len(part), length, np.int32), **words, "until": latest[part].astype(np.int32) + (shards - 1), "n": counts[lo : lo + 100_000]})
        if length == LONGEST or tables[length - 1] is None:
            return
        table, reached = tables[length - 1], np.flatnonzero(both)
        state = np.zeros(len(both), np.uint8)
        state[reached] = table[slots_of([hashes[ids[reached + i]] for i in range(length)], len(table))]


def scanned(chunks: DataFrame, scan: int, shards: int, tables: list, sums: list[Broadcast]) -> DataFrame:
    """``counted`` of all chunks of a scan's shard."""
    packed = [None if t is None else zlib.compress(t.tobytes(), 1) for t in tables]
    shared = chunks.sparkSession.sparkContext.broadcast(packed)  # of a fixed size at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = [None if t is None else np.frombuffer(zlib.decompress(t), np.uint8) for t in shared.value]
        likely = [np.frombuffer(b.value, np.uint8) for b in sums]
        for batch in batches:
            for ids, hashes in zip(batch["ids"], batch["hashes"], strict=True):
                yield from counted(np.frombuffer(ids, np.int32), np.frombuffer(hashes, np.uint64), scan, shards, marks, likely)

    return chunks.select("ids", "hashes").mapInPandas(count, ", ".join(["len int", *(f"{w} long" for w in WORDS), "until int", "n long"]))


def _marks(reached: DataFrame, size: int) -> list:
    """Rows (len, page, marks): slots with the mark (scan + 1) of the latest phrase in each; at most so many bytes as all tables have."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            for length, group in b.groupby("len"):
                table = tables.setdefault(length, np.zeros(size, np.uint8))
                at = slots_of([group[w].to_numpy(np.int64).view(np.uint64) for w in WORDS[:length]], size)
                np.maximum.at(table, at, (group["reach"].to_numpy() + 1).astype(np.uint8))
        for length, table in tables.items():
            for page in range(0, size, PAGE):
                if table[page : page + PAGE].any():
                    yield pd.DataFrame({"len": [length], "page": [page], "marks": [zlib.compress(table[page : page + PAGE].tobytes(), 1)]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        best = reduce(np.maximum, (np.frombuffer(zlib.decompress(m), np.uint8) for m in group["marks"]))
        return pd.DataFrame({"len": group["len"].iloc[:1], "page": group["page"].iloc[:1], "marks": [zlib.compress(best.tobytes(), 1)]})

    schema = "len int, page long, marks binary"
    return reached.mapInPandas(pages, schema).groupBy("len", "page").applyInPandas(merged, schema).collect()


def _sums(chunks: DataFrame, often: np.ndarray, sums: list[Broadcast], size: int, support: int) -> bytes:
    """A bit for each of ``size`` slots: whether ``support`` phrases, a word longer than the last of ``sums`` tells of, fall into it.

    Both subphrases of these are likely by ``sums``, or marked words by ``often``.
    """
    target, shared = len(sums) + 2, chunks.sparkSession.sparkContext.broadcast(zlib.compress(often.tobytes(), 1))

    def paged(held: list[np.ndarray]) -> pd.DataFrame:
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        slots = np.repeat(slots, np.minimum(counts, support))
        pages, out = np.arange(0, size, SUM_PAGE), []
        ends = np.append(np.searchsorted(slots, pages), len(slots)).tolist()
        for page, lo, hi in zip(pages.tolist(), ends, ends[1:], strict=False):
            if lo < hi:
                gaps = np.diff(slots[lo:hi], prepend=np.uint32(page))
                kind = np.min_scalar_type(gaps.max())
                out.append((page, kind.itemsize, zlib.compress(gaps.astype(kind).tobytes(), 1)))
        return pd.DataFrame(out, columns=["page", "width", "gaps"])

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, likely, held = np.frombuffer(zlib.decompress(shared.value), np.uint8), [np.frombuffer(b.value, np.uint8) for b in sums], []
        for batch in batches:
            for raw, hashed in zip(batch["ids"], batch["hashes"], strict=True):
                ids, hashes = np.frombuffer(raw, np.int32), np.frombuffer(hashed, np.uint64)
                state = np.append(marks[slots_of([hashes], len(marks))] > 0, False)[ids]
                at = np.flatnonzero(state[:-1] & state[1:])
                for length, bits in enumerate(likely, 2):
                    state = np.zeros(max(len(state) - 1, 0), bool)
                    state[at[_has(bits, ids, hashes, at, length)]] = True
                    at = np.flatnonzero(state[:-1] & state[1:])
                held.append(slots_of([hashes[ids[at + i]] for i in range(target)], size).astype(np.uint32))
            if sum(map(len, held)) >= SUMS_HELD:
                yield paged(held)
                held = []
        if any(map(len, held)):
            yield paged(held)

    def added(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(SUM_PAGE, np.int64)
        for width, gaps in zip(group["width"], group["gaps"], strict=True):
            counts += np.bincount(np.cumsum(np.frombuffer(zlib.decompress(gaps), f"u{width}"), dtype=np.int64), minlength=SUM_PAGE)
        bits = np.packbits(counts >= support, bitorder="little").tobytes()
        return pd.DataFrame({"page": group["page"].iloc[:1], "bits": [zlib.compress(bits, 1)]})

    with batches_of(chunks.sparkSession, 4):  # a row is a chunk
        pages = chunks.select("ids", "hashes").mapInPandas(found, "page long, width int, gaps binary").groupBy("page").applyInPandas(added, "page long, bits binary").collect()
    out = bytearray(size // 8)
    for r in pages:
        out[r.page // 8 : (r.page + SUM_PAGE) // 8] = zlib.decompress(r.bits)
    return bytes(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _places(length: Column, first: int) -> list[Column]:
    """The words of the subphrase that leaves out the last word (``first`` 0) or the first (1) of a phrase, as ``k1..k3``."""
    zero = F.lit(0).cast("long")
    return [F.when(length - 1 > i, F.col(WORDS[i + first])).otherwise(zero).alias(f"k{i + 1}") for i in range(LONGEST - 1)]


def frequent_phrases(docs: DataFrame, scratch: Scratch, lang: str = "lang", text: str = "text", support: int = SUPPORT, shards: int = SHARDS, slots: int = SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``words``, ``phrases``, ``totals``): what occurs ``support`` times or more within pieces of one language's texts.

    ``words`` has ``lang, word, w1, n``, ``phrases`` of two words and more ``len, w1..w4, n`` with word hashes
    (0 where there is none), and ``totals`` the occurrences of all words, ``lang, total``. The language of
    a phrase is that of its words. The results read steps of ``scratch``.
    """
    if not 0 < shards <= 60:
        raise ValueError("marks of scans are bytes: 1 to 60 shards")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("length(text) > 0")
    by_scan = [f"n{i}" for i in range(shards)]  # counts of the scans of one round, each in the place of its shard
    with batches_of(spark, 500):
        dealt = scratch.staged(chunked(rows, shards, seed, CHUNK).drop("w1"), partition_by=["kind", "shard"], codec="zstd")
    step = scratch.count
    chunks, shares = dealt.where("kind = 0"), [F.sum(F.when(F.col("shard") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(by_scan)]
    words = scratch.staged(dealt.where("kind = 1").groupBy("lang", "word").agg(*shares).withColumn("w1", hash_of(F.col("lang"), F.col("word"), seed)).withColumn("n", sum(F.col(c) for c in by_scan)))
    discard(spark, f"{scratch.base}/{step}/kind=1")  # summed; the chunks beside them stay
    told = words.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    if words.select("w1").distinct().count() < told.words:
        raise ValueError("two words share a hash; take another seed")
    zero, done, reached, n_reached, latest, scan, state = F.lit(0).cast("long"), [], [], 0, -1, 0, None
    tables: list[np.ndarray | None] = [None] * (LONGEST - 1)
    sum_slots, sums = min(SUM_SLOTS, max(SUM_PAGE, 1 << ((told.n or 0) // 8).bit_length())), []
    often = np.zeros(slots, np.uint8)
    with batches_of(spark, 10_000):
        for r in _marks(words.where(F.col("n") >= support).select(F.lit(1).alias("len"), "w1", F.lit(0).alias("reach")), slots):
            marks = np.frombuffer(zlib.decompress(r.marks), np.uint8)
            often[r.page : r.page + len(marks)] = marks
    for _ in range(2, LONGEST + 1):
        sums.append(spark.sparkContext.broadcast(_sums(chunks, often, sums, sum_slots, support)))
    with batches_of(spark, 10_000):
        while scan < shards or latest >= scan - shards:
            new, here = [], f"n{scan % shards}"
            if scan < shards:
                before = sum((F.col(c) for c in by_scan[:scan]), zero)
                new.append(words.where((before + F.col(here) >= support) & (before < support)).select(F.lit(1).alias("len"), "w1", *[zero.alias(w) for w in WORDS[1:-1]]))
            if n_reached:
                made = scanned(chunks.where(F.col("shard") == scan % shards), scan, shards, tables, sums)
                parts = [made.select("len", *WORDS, "until", *[(F.col("n") if c == here else zero).alias(c) for c in by_scan])]
                if state is not None:  # what the same shard gave a round ago no longer counts
                    parts.append(state.where(F.col("until") >= scan).select("len", *WORDS, "until", *[(zero if c == here else F.col(c)).alias(c) for c in by_scan]))
                summed = _union(parts).groupBy("len", *WORDS).agg(F.max("until").alias("until"), *[F.sum(c).alias(c) for c in by_scan])
                with batches_of(spark, 1):  # a row is a chunk
                    state = scratch.staged(summed.where((F.col("until") > scan) | (sum(F.col(c) for c in by_scan) >= support)), slot="state")
                frequent = scratch.staged(_active(state, _union(reached), n_reached, scan, shards, support))
                done.append(frequent.where(F.col("since") == scan - shards + 1).select("len", *WORDS, "n"))
                new.append(frequent.where((F.col("before") < support) & (F.col("len") < LONGEST)).select("len", *WORDS[:-1]))
            fresh = scratch.staged(_union(new).withColumn("reach", F.lit(scan))) if new else None
            if fresh is not None and (n := fresh.count()):
                reached, n_reached, latest = [*reached, fresh], n_reached + n, scan
                tables = [None if t is None else t.copy() for t in tables]
                for r in _marks(fresh, slots):
                    table = tables[r.len - 1] = np.zeros(slots, np.uint8) if tables[r.len - 1] is None else tables[r.len - 1]
                    marks = np.frombuffer(zlib.decompress(r.marks), np.uint8)
                    np.maximum(table[r.page : r.page + len(marks)], marks, out=table[r.page : r.page + len(marks)])
            scan += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    empty = spark.createDataFrame([], ", ".join(["len int", *(f"{w} long" for w in WORDS), "n long"]))
    return words.where(F.col("n") >= support).select("lang", "word", "w1", "n"), scratch.staged(_union([empty, *done])), totals


def _active(state: DataFrame, reached: DataFrame, n_reached: int, scan: int, shards: int, support: int) -> DataFrame:
    """Active phrases with the support: the scan ``since`` which they are active, their counts ``n`` since then and ``before`` this scan."""
    counts = {t: F.col(f"n{t % shards}") for t in range(max(0, scan - shards + 1), scan + 1)}
    out, keys = state.where(sum(counts.values()) >= support).select("len", *WORDS, *[f"n{i}" for i in range(shards)]), [f"k{i}" for i in range(1, LONGEST)]
    for first, name in ((0, "r1"), (1, "r2")):
        side = reached.select((F.col("len") + 1).alias("len"), *[F.col(w).alias(k) for w, k in zip(WORDS, keys, strict=False)], F.col("reach").alias(name))
        out = join_lookup(out.select("*", *_places(F.col("len"), first)), side, ["len", *keys], "inner", rows=n_reached).drop(*keys)
    out = out.withColumn("since", F.greatest("r1", "r2") + 1).where((F.col("since") > scan - shards) & (F.col("since") <= scan))
    own = {t: F.when(F.col("since") <= t, c).otherwise(0) for t, c in counts.items()}
    return out.select("len", *WORDS, "since", sum(own.values()).alias("n"), (sum(own.values()) - counts[scan]).alias("before")).where(F.col("n") >= support)


def _key(places: list[str]) -> list[Column]:
    """A phrase's words moved to the front, as ``k1..k4``."""
    filled = [*places, *[None] * (LONGEST - len(places))]
    return [(F.col(p) if p else F.lit(0).cast("long")).alias(f"k{i}") for i, p in enumerate(filled, 1)]


def collocations(docs: DataFrame, scratch: Scratch, lang: str = "lang", text: str = "text", support: int = SUPPORT, cover: int = 80, scale: int = 2_000_000, top: int = TOP, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two to four words.

    Texts are split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words,
    with A-Z lower-cased; a phrase lies within a piece, and overlapping occurrences all count. Cut behind
    its k-th word a phrase scores ``floor(scale * a / (l + r))`` of its own count and those of both parts; its
    lowest-scoring cut counts, of equal ones the least k. Phrases that a longer one with
    ``100 * a >= cover`` times their count holds are left out. Ranks are by score and count, most first,
    then by the bytes of the phrase. ``n`` is the number of words of the language. A null language is
    ``und``; null and empty texts have no words; repeated rows all count; an empty table gives no rows.
    Scores are exact beyond 64 bits, and one that passes 64 bits itself is an error.
    """
    words, phrases, totals = frequent_phrases(docs, scratch, lang, text, support, **options)
    keys = [f"k{i}" for i in range(1, LONGEST + 1)]
    known = scratch.staged(words.select(*_key(["w1"]), "n").unionByName(phrases.select(*[F.col(w).alias(k) for w, k in zip(WORDS, keys, strict=True)], "n")))
    rows, cuts, inner = known.limit(BROADCAST_ROWS + 1).count(), [], []
    for length in range(2, LONGEST + 1):
        own = phrases.where(F.col("len") == length)
        for k in range(1, length):
            left = join_lookup(own.select(*WORDS, F.col("n").alias("a"), *_key(WORDS[:k])), known.withColumnRenamed("n", "l"), keys, "inner", rows=rows).drop(*keys)
            both = join_lookup(left.select("*", *_key(WORDS[k:length])), known.withColumnRenamed("n", "r"), keys, "inner", rows=rows)
            cuts.append(both.select(*WORDS, "a", F.lit(k).alias("k"), "l", "r"))
        for size in range(2, length):
            inner += [own.select(*_key(WORDS[i : i + size]), F.col("n").alias("longer")) for i in range(length - size + 1)]
    score = F.expr(f"cast({scale} as decimal(18, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = _union(cuts).withColumn("score", score.cast("long"))
    worst = scored.groupBy(*WORDS).agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select(*WORDS, "s.*")
    held = scratch.staged(_union(inner).groupBy(*keys).agg(F.max("longer").alias("longer")))
    own_key = worst.select("*", *[F.col(w).alias(k) for w, k in zip(WORDS, keys, strict=True)])
    left = join_lookup(own_key, held, keys).where(f"longer is null or cast(100 as decimal(18, 0)) * longer < cast({cover} as decimal(18, 0)) * a").drop(*keys, "longer")
    n_words = words.limit(BROADCAST_ROWS + 1).count()
    for i, w in enumerate(WORDS):
        named = words.select(F.col("w1").alias(w), F.col("word").alias(f"t{i}"), *(["lang"] if i == 0 else []))
        left = join_lookup(left, named, [w], rows=n_words)
    phrase = F.concat_ws(" ", *[F.col(f"t{i}") for i in range(LONGEST)])
    named = join_lookup(left.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"), totals.withColumnRenamed("total", "n"), ["lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # cut to the best of each task before the shuffle
    return named.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
