"""Near-duplicate detection with an LSH forest over MinHash signatures.

A document is the set of its distinct word shingles. Documents with equal sets collapse to one
representative first. A representative has a signature of minima under independent hash functions,
and stands in ``TREES`` sorted orders, each of which reads the signature from another place on. Its
neighbours in an order are those with the longest common prefix, and documents with a common prefix
of ``LEAST`` minima or more form a region of that order.

Regions are searched at a depth of their own. First each document proposes its neighbour of the
longest common prefix, and the head of the deepest stretch around it: a region of more than
``SMALL`` documents is divided by longer prefixes until a stretch is small or of full depth. The
best-supported proposals are confirmed on full sets, which joins most of every region. Then every
region goes down to the least depth: whatever shares a prefix of ``LEAST`` minima and is still apart
is compared, so a crowded region loses no link that a sparse one would find.

In small regions a one-bit MinHash sketch, compared inside the join, lets only pairs near the
threshold on to full sets. In crowded regions documents are packed into blocks, once for all orders;
a pair of blocks is one row, compared outright on full sets, and gives at most one link for any two
components, so what comes out never grows with the square of a region.

At similarity 0.8 two documents miss each other in all 24 orders with probability 7e-5, at 0.85
with 8e-7; the sketch loses a pair at the threshold with probability 4e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.components import connected_components
from framelake.runtime import Scratch, batches_of, fresh, join_lookup, staged

TREES = 24
LEAST, DEPTH = 5, 20  #: minima of the shortest common prefix of candidates, and of a key in an order
STEPS = (8, 12, 20)  #: depths at which crowded regions are divided
SMALL = 16  #: documents up to which a stretch is not divided further
CROWD = 64  #: documents beyond which a region is compared by blocks
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000  #: what a block holds at most, or else one document
SKETCH = 1024  #: one-bit minima of a sketch
SPREADS = 4.5  #: standard deviations by which a sketch may fall short of the threshold
BROADCAST_IDS = 1_000_000  #: candidates up to which their ids are broadcast to the scan of the texts
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
WORD_MEMO = 1 << 17
HASHES = TREES * LEAST
_random = np.random.default_rng(20)
_FACTORS = (_random.integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, HASHES, np.uint64)


_SKETCH_FACTORS = (_random.integers(0, 1 << 63, SKETCH, np.uint64) << np.uint64(1)) | np.uint64(1)
_SKETCH_SHIFTS = _random.integers(0, 1 << 63, SKETCH, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _NEXT
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def word(self, w: bytes) -> int:
        if len(self.memo) >= WORD_MEMO:
            self.memo.clear()
        h = self.memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get = self.memo.get
        h = np.fromiter((get(w) or self.word(w) for w in words), np.uint64, len(words))
        k = min(self.size, len(words))
        with np.errstate(over="ignore"):
            s = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                s = _mixed(s) + h[i : len(h) - k + 1 + i]
            return np.unique(_mixed(s + np.uint64(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of every hash function over the set."""
    out = np.empty(HASHES, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, HASHES, 8):
            values = (shingles[None, :] ^ _SHIFTS[at : at + 8, None]) * _FACTORS[at : at + 8, None]
            out[at : at + 8] = values.min(1)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of the least value of each of ``SKETCH`` further hash functions, as longs."""
    bits = np.empty(SKETCH, np.uint8)
    step = max(8, min(SKETCH, 200_000 // max(1, len(shingles))))
    with np.errstate(over="ignore"):
        for at in range(0, SKETCH, step):
            least = ((shingles[None, :] ^ _SKETCH_SHIFTS[at : at + step, None]) * _SKETCH_FACTORS[at : at + step, None]).min(1)
            bits[at : at + step] = _mixed(least) >> np.uint64(40) & np.uint64(1)
    return np.packbits(bits).view("<i8")


def shingle_sets(docs: DataFrame, size: int, whole: bool) -> DataFrame:
    """``(id, n, digest, marks)`` from (id, text); or ``(id, n, sketch, shingles)`` with ``whole``.

    ``marks`` are 16 bits of every minimum of the signature; ``digest`` names the set.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for batch in batches:
            made = [shingler(t) for t in batch["text"]]
            frame = {"id": batch["id"], "n": [len(s) for s in made]}
            if whole:
                frame["sketch"] = [sketch(s) for s in made]
                frame["shingles"] = [s.view("<i8") for s in made]
            else:
                frame["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in made]
                frame["marks"] = [(_mixed(signature(s)) >> np.uint64(48)).astype("<u2").tobytes() if len(s) else None for s in made]
            yield pd.DataFrame(frame)

    return docs.select("id", "text").mapInPandas(sets, "id long, n long, sketch array<long>, shingles array<long>" if whole else "id long, n long, digest binary, marks binary")


def entries(representatives: DataFrame) -> DataFrame:
    """``(id, n, prefix, key)``: a row for every order a representative stands in.

    ``key`` has the order's first ``DEPTH`` minima as bytes that sort; ``prefix`` names the region.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = (np.arange(TREES)[:, None] * LEAST + np.arange(DEPTH)) % HASHES
        for batch in batches:
            if len(batch):
                keys = np.stack([np.frombuffer(m, "<u2") for m in batch["marks"]])[:, turns]  # documents x trees x depth
                with np.errstate(over="ignore"):
                    prefix = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * _NEXT, keys.shape[:2])
                    for d in range(LEAST):
                        prefix = _mixed(prefix ^ (keys[:, :, d].astype(np.uint64) + np.uint64(1)) * _MIX)
                raw = keys.astype(">u2").tobytes()
                width = 2 * DEPTH
                yield pd.DataFrame(
                    {
                        "id": np.repeat(batch["id"].to_numpy(), TREES),
                        "n": np.repeat(batch["n"].to_numpy(), TREES),
                        "prefix": prefix.reshape(-1).view(np.int64),
                        "key": [raw[at : at + width] for at in range(0, len(raw), width)],
                    }
                )

    return representatives.select("id", "n", "marks").mapInPandas(spread, "id long, n long, prefix long, key binary")


def neighbours(prefix: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: (common prefix with the row before, its id, id of the head of the stretch around).

    A stretch is the widest run of rows with a common prefix that is small, or else the deepest run.
    """
    n = len(ids)
    equal = np.ones((n, DEPTH + 1), bool)
    equal[1:, :DEPTH] = keys[1:] == keys[:-1]
    equal[:, DEPTH] = False
    common = equal.argmin(1)
    common[1:][prefix[1:] != prefix[:-1]] = 0
    common[0] = 0
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(common < LEAST, at, 0))
    settled = np.bincount(head, minlength=n)[head] <= SMALL
    for depth in STEPS:
        deeper = np.maximum.accumulate(np.where(common < depth, at, 0))
        size = np.bincount(deeper, minlength=n)[deeper]
        move = ~settled & (size > 1)
        head = np.where(move, deeper, head)
        settled |= size <= SMALL
    return common, ids[np.maximum(at - 1, 0)], ids[head]


def proposals(shared: DataFrame) -> DataFrame:
    """``(a, b)``: for each document its best neighbour and its best head, over all orders.

    The sorted orders are cut into ranges, so a region of any size spreads; the neighbours of rows
    at the edge of a batch are not looked up, as whatever is left apart is compared later.
    """

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys = np.frombuffer(b"".join(batch["key"]), ">u2").reshape(-1, DEPTH)
            ids = batch["id"].to_numpy()
            common, before, head = neighbours(batch["prefix"].to_numpy(), keys, ids)
            near, led = common >= LEAST, head != ids
            yield pd.DataFrame(
                {
                    "a": np.concatenate([ids[near], ids[led]]),
                    "b": np.concatenate([before[near], head[led]]),
                    "led": np.concatenate([np.zeros(near.sum(), bool), np.ones(led.sum(), bool)]),
                    "common": np.concatenate([common[near], np.zeros(led.sum(), np.int64)]),
                }
            )

    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.repartitionByRange(parts, "prefix", "key", "id").sortWithinPartitions("prefix", "key", "id")
    found = ordered.select("prefix", "key", "id").mapInPandas(proposed, "a long, b long, led boolean, common long")
    counted = found.groupBy("a", "led", "b").agg(F.count("*").alias("orders"), F.max("common").alias("common"))
    best = counted.groupBy("a", "led").agg(F.max_by("b", F.struct("common", "orders", -F.col("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(x: Column, y: Column, threshold: int) -> Column:
    """Whether 100 * intersection >= threshold * union, on full sets (arrays of distinct shingles)."""
    both = F.size(F.array_intersect(x, y))
    return (100 * both >= threshold * (F.size(x) + F.size(y) - both)) & (both > 0)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``(a, b, linked)`` of pairs of ids, on full sets."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"s_{s}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", similar(F.col("s_a"), F.col("s_b"), threshold).alias("linked"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, one row per row of ``docs``; ``key`` is a unique integer.

    A-Z are lower-cased and words are runs of characters other than \\x20 and \\x09-\\x0D. A text
    with fewer words than ``shingle`` is one shingle; a null, empty or blank text has none and is
    linked with nothing. Documents whose sets have a Jaccard similarity of ``threshold`` percent or
    more are linked, and ``component_id`` is the smallest key that links reach; that document is
    ``kept``. Equal texts are linked. Rows with equal keys are one node. A row with a null key has
    no name to be linked by: its component is null and it is kept. A key that is no integer is an
    error. No rows: none. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{key} is {kind.simpleString()}, not an integer; number the rows first, as drop_near_duplicates does")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with Scratch(spark) as scratch, batches_of(spark, 500):
        sketched = scratch.staged(shingle_sets(texts, shingle, whole=False))
        classes = scratch.staged(sketched.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")))
        reps = sketched.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["id"])
        every = scratch.staged(entries(reps))
        regions = every.groupBy("prefix").agg(F.count("*").alias("m")).where("m > 1")
        shared = scratch.staged(every.join(regions, "prefix"))
        members = scratch.staged(shared.select("id").distinct())
        chosen = join_lookup(texts, members, ["id"], "left_semi", BROADCAST_IDS)
        sets = scratch.staged(shingle_sets(chosen, shingle, whole=True).dropDuplicates(["id"]))
        checked = scratch.staged(confirmed(proposals(shared), sets, threshold))
        parts = connected_components(checked.where("linked"), "a", "b")
        rest = _apart(shared, parts, scratch)
        few = _near_pairs(rest.where(f"m <= {CROWD}"), sets, threshold)
        few = confirmed(few.join(checked, ["a", "b"], "left_anti"), sets, threshold).where("linked").select("a", "b")
        links = scratch.staged(few.union(_crowd_links(rest.where(f"m > {CROWD}"), sets, threshold, scratch)))
        # components of components: only what was apart is joined now
        named = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        wider = connected_components(between, "a", "b").select(F.col("node").alias("inner"), F.col("component").alias("outer"))
        whole = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("inner"))
        whole = scratch.staged(whole.join(wider, "inner", "left").select("digest", F.coalesce("outer", "inner").alias("component_id")))
        out = sketched.select("id", "n", "digest").join(whole, "digest", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
        return staged(out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"), kept.alias("kept")))


def _apart(shared: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """``prefix, id, n, component, main, m``: entries of regions that several components share.

    ``main`` is the component most of the region's ``m`` documents belong to.
    """
    named = shared.select("prefix", "id", "n", "m").join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = scratch.staged(named)
    sizes = named.groupBy("prefix", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("prefix").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return scratch.staged(named.join(main.drop("parts"), "prefix"))


def _near_pairs(rest: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``a < b`` that share a region, are in different components and near enough by sketch.

    The main component is not paired with itself: only documents outside of it meet the others. The
    join condition compares sizes and sketches, so only pairs near the threshold are made.
    """
    words = [F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH // 64)]
    mixed = rest.join(sets.select("id", *words), "id")
    t = threshold / 100
    short = t - SPREADS * 2 * math.sqrt((1 + t) / 2 * (1 - t) / 2 / SKETCH)
    few, many = mixed.where("component <> main").alias("f"), mixed.alias("g")
    differ = sum((F.bit_count(F.col(f"f.k{i}").bitwiseXOR(F.col(f"g.k{i}"))) for i in range(1, SKETCH // 64)), F.bit_count(F.col("f.k0").bitwiseXOR(F.col("g.k0"))))
    n_a, n_b = F.col("f.n"), F.col("g.n")
    # a pair of two documents outside comes from one side only
    once = (F.col("g.component") == F.col("g.main")) | (F.col("f.id") < F.col("g.id"))
    near = (F.col("f.prefix") == F.col("g.prefix")) & (F.col("f.component") != F.col("g.component")) & once & (100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)) & (differ <= int(SKETCH * (1 - short) / 2))
    return few.join(many, near).select(F.least("f.id", "g.id").alias("a"), F.greatest("f.id", "g.id").alias("b")).distinct()


class Block:
    """Documents of one block: ids, components, sizes, and all shingles with the document each is of."""

    def __init__(self, ids: bytes, components: bytes, sizes: bytes, shingles: bytes):
        self.ids, self.components, self.sizes = (np.frombuffer(x, "<i8") for x in (ids, components, sizes))
        self.shingles = np.frombuffer(shingles, "<i8")
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)


def shared_counts(a: Block, b: Block, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of incidence matrices."""
    both = np.zeros((len(a.ids), len(b.ids)), np.float64)
    common = np.intersect1d(np.unique(a.shingles), np.unique(b.shingles), assume_unique=True)
    if not len(common):
        return both
    sides = []
    for x in (a, b):
        at = np.minimum(np.searchsorted(common, x.shingles), len(common) - 1)
        held = common[at] == x.shingles
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], x.owner[held][order], len(x.ids)))
    for low in range(0, len(common), step):
        width = min(step, len(common) - low)
        planes = []
        for at, owner, n in sides:
            i, j = np.searchsorted(at, (low, low + width))
            plane = np.zeros((n, width), np.float32)
            plane[owner[i:j], at[i:j] - low] = 1
            planes.append(plane)
        both += planes[0] @ planes[1].T  # whole numbers below 4 097, exact in single precision
    return both


def spanning_links(a: Block, b: Block, threshold: int) -> list[tuple[int, int]]:
    """Links between documents of two blocks: enough to join all components that a link joins, one for each join."""
    both = shared_counts(a, b)
    linked = (100 * both >= threshold * (a.sizes[:, None] + b.sizes[None, :] - both)) & (both > 0) & (a.components[:, None] != b.components[None, :])
    i, j = np.nonzero(linked)
    names = np.stack([np.minimum(a.components[i], b.components[j]), np.maximum(a.components[i], b.components[j])], 1)
    joined, first = np.unique(names, axis=0, return_index=True)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    out = []
    for (c, d), k in zip(joined.tolist(), first.tolist(), strict=True):
        c, d = root(c), root(d)
        if c != d:
            parent[max(c, d)] = min(c, d)
            out.append((int(a.ids[i[k]]), int(b.ids[j[k]])))
    return out


def _crowd_links(rest: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: links that join what is apart in crowded regions, compared outright by blocks.

    A document is packed once, with those of its home: the region of the least name that it is in.
    Blocks hold one component, the home's main one, or what is outside of it. Two blocks meet if a
    region holds documents of both, unless both are of the same component.
    """
    home = F.struct("prefix", "main")
    docs = rest.groupBy("id", "n", "component").agg(F.min(home).alias("home")).select("id", "n", "component", "home.prefix", (F.col("component") == F.col("home.main")).alias("inside"))
    docs = scratch.staged(docs)
    sides = docs.groupBy("prefix", "inside").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    cuts = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts"))
    placed = docs.join(sides.select("prefix", "inside", cuts.alias("cuts")), ["prefix", "inside"])
    placed = scratch.staged(placed.select("id", "n", "component", F.xxhash64("prefix", "inside", cut).alias("block"), F.when(F.col("inside"), F.col("component")).alias("only")))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        joined = [np.concatenate(group["shingles"].to_numpy()).astype("<i8")] if len(group) else []
        columns = [group[c].to_numpy("<i8").tobytes() for c in ("id", "component", "n")]
        return pd.DataFrame([[group["block"].iloc[0], *columns, joined[0].tobytes()]], columns=names)

    names = ["block", "ids", "components", "sizes", "shingles"]
    filled = placed.join(sets.select("id", "shingles"), "id").select("block", "id", "component", "n", "shingles")
    blocks = scratch.staged(filled.groupBy("block").applyInPandas(packed, "block long, ids binary, components binary, sizes binary, shingles binary"))
    held = scratch.staged(rest.select("prefix", "id").join(placed.select("id", "block", "only"), "id").select("prefix", "block", "only").distinct())
    f, g = held.alias("f"), held.alias("g")
    meet = (F.col("f.prefix") == F.col("g.prefix")) & (F.col("f.block") <= F.col("g.block")) & ~F.coalesce(F.col("f.only") == F.col("g.only"), F.lit(False))
    pairs = scratch.staged(f.join(g, meet).select(F.col("f.block").alias("block_a"), F.col("g.block").alias("block_b")).distinct())
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in names])
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(side("a"), "block_a").join(side("b"), "block_b").repartition(parts, F.xxhash64("block_a", "block_b"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.to_dict("records"):
                a, b = (Block(*(pair[f"{c}_{s}"] for c in names[1:])) for s in "ab")
                yield pd.DataFrame(spanning_links(a, b, threshold), columns=["a", "b"], dtype="int64")

    with batches_of(rest.sparkSession, 2):
        return scratch.staged(met.mapInPandas(linked, "a long, b long"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` of which ``near_duplicates`` keeps one for each component, that of the least key.

    Rows with a null key stay. Where keys repeat or are no integers, rows are told apart by a number
    staged with them: rows of one key and different texts are documents of their own, and of fully
    repeated rows one stays, without words too. Columns may have any names.
    """
    columns = docs.columns
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    integers = isinstance(docs.schema[key].dataType, T.IntegralType)
    if integers and not narrow.groupBy("key").count().where("count > 1").limit(1).count():
        found = near_duplicates(narrow, "key", "text", shingle, threshold)
        gone = staged(found.where("not kept").select(F.col("key").alias(key)))
        return join_lookup(docs, gone, [key], "left_anti", BROADCAST_IDS).select(*columns)
    (row,) = fresh(docs, "row")
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    known = docs.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(*columns).alias("hash")).where("key is not null")
    found = near_duplicates(known, "row", "text", shingle, threshold)
    # a document without words is linked with nothing, but with its repeated rows
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")).alias("c"), F.when(wordless, F.col("key")).alias("k"), F.when(wordless, F.col("hash")).alias("h")]
    kept = found.join(known.select("row", "key", "hash"), "row").groupBy(*group).agg(F.min(F.struct("key", "row")).alias("least")).select("least.row")
    gone = staged(found.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", row))
    return join_lookup(docs, gone, [row], "left_anti", BROADCAST_IDS).select(*columns)
