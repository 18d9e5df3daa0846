"""Exact top-k inner products by a bit-sliced index.

Rows are cut into blocks. In a block every attribute is stored as bitmaps over the rows, one for
each bit of its (offset) value. A query's score is a weighted sum of attributes, so it is added up
in bit slices too: the bitmaps that a binary digit of a weight selects are summed by carry-save
adders, three bitmaps of one significance giving one of the same and one of the next. Negative
digits add the complement; what that changes is the same for all rows. The best rows are then
picked from the most significant slice of the sum downward: rows that have the bit are kept while
they are at most k, or become the new field where they are more. The rows left over at the border
are equal in score, and the smallest ids among them fill the result.

The index is stored: ``build_index`` writes a row a block, with its ids, its slices and the least
and greatest value of every attribute, and ``search`` reads nothing else of the rows; scores are read
from the slices of the sum. Rows whose leading attributes lie on the same sides of their means share
blocks, so the extremes bound what a query can score in a block. Queries are packed into blocks in the same way and
first meet the block of their own region, which gives each a floor: its k-th score there. Then stripes
of row blocks meet stripes of query blocks, a group for each pair of stripes, and a query skips
the blocks that cannot reach its floor, which rises as blocks are searched. A block is shipped once a
stripe of the other side, not once a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import Scratch, batches_of, join_lookup, staged

BLOCK_ROWS = 8192  #: rows of a block, at most twice as many
BLOCK_QUERIES = 256
ROW_STRIPE, QUERY_STRIPE = 16, 8  #: blocks of a stripe at most: what a task holds
REGION_BITS = 16  #: leading attributes that may tell regions apart
NO_FLOOR = -(1 << 63)


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """Components ``floor(scale * x)`` in double precision; null for vectors that take no part.

    Those are null vectors and vectors with a null or non-finite component. A finite component whose
    product passes 62 bits is an error, as no score could hold it.
    """
    value = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.abs(x.cast("double") * scale) < 2.0**62
    whole = F.transform(vector, lambda x: F.when(fits(x), value(x)).otherwise(F.raise_error(F.lit("a component passes 62 bits"))).cast("long"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, whole)


class BitSlices:
    """The bit-sliced index of one block: attributes less ``low``, as bitmaps over the rows in order of their ids."""

    def __init__(self, ids: np.ndarray, maps: np.ndarray, low: int):
        self.ids, self.maps, self.low, self.words = ids, maps, low, maps.shape[2]
        self.all = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        """The index of ``values`` (rows x attributes)."""
        order = np.argsort(ids, kind="stable")  # so that the first set bits are the smallest ids
        n, low = len(ids), int(values.min()) if values.size else 0
        bits = max(1, (int(values.max()) - low).bit_length()) if values.size else 1
        words = -(-n // 64)
        shifted = (values[order] - low).astype(np.uint64)
        maps = np.zeros((values.shape[1], bits, words), np.uint64)
        for b in range(bits):
            plane = np.zeros((values.shape[1], words * 64), np.uint8)
            plane[:, :n] = (shifted >> np.uint64(b) & np.uint64(1)).T
            maps[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
        return cls(ids[order], maps, low)

    @classmethod
    def read(cls, row) -> BitSlices:
        ids = np.frombuffer(row.ids, "<i8")
        return cls(ids, np.frombuffer(row.slices, "<u8").reshape(row.width, row.bits, -(-len(ids) // 64)), row.low)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sum up to a constant."""
        piles: dict[int, list[np.ndarray]] = {}
        rest, level = np.abs(weights), 0
        positive = weights > 0
        while rest.any():
            digit = (rest & 1).astype(bool)
            for side, flip in ((digit & positive, False), (digit & ~positive, True)):
                chosen = np.flatnonzero(side)
                if len(chosen):
                    for b in range(self.maps.shape[1]):
                        part = self.maps[chosen, b]
                        piles.setdefault(level + b, []).append(~part if flip else part)
            rest >>= 1
            level += 1
        out = []
        s = 0
        while s <= max(piles, default=-1):
            pile = np.concatenate(piles[s]) if s in piles else np.zeros((1, self.words), np.uint64)
            while len(pile) > 1:
                third = len(pile) // 3
                if third:
                    a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                    x = a ^ b
                    carry, total, left = (a & b) | (c & x), x ^ c, pile[3 * third :]
                else:
                    a, b = pile[:1], pile[1:2]
                    carry, total, left = a & b, a ^ b, pile[:0]
                piles.setdefault(s + 1, []).append(carry)
                pile = np.concatenate([total, left]) if len(left) else total
            out.append(pile[0])
            s += 1
        return out

    def best(self, weights: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k rows of highest score, ties to smaller ids; rows with id ``skip`` are left out."""
        field, sure = self.all.copy(), np.zeros(self.words, np.uint64)
        if skip is not None:
            at = np.searchsorted(self.ids, skip)
            while at < len(self.ids) and self.ids[at] == skip:
                field[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
                at += 1
        have, slices = 0, self.sums(weights)
        for slice_ in reversed(slices):
            with_bit = field & slice_
            n = int(np.bitwise_count(with_bit).sum())
            if have + n > k:
                field = with_bit
            else:
                sure |= with_bit
                have += n
                field &= ~slice_
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        at = np.concatenate([rows(sure), rows(field)[: k - have]])
        total = np.zeros(len(at), np.uint64)
        for s, slice_ in enumerate(slices):
            total |= (slice_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) << np.uint64(s)
        # negative digits added complements, and attributes were counted from ``low``
        less = ((1 << self.maps.shape[1]) - 1) * int(-weights[weights < 0].sum()) - self.low * int(weights.sum())
        return at, total.astype(np.int64) - less


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """One block of rows as one row of the index."""
    values = np.stack(group["v"].to_numpy()).astype("<i8")
    slices = BitSlices.of(group["id"].to_numpy("<i8"), values)
    extremes = {"lows": [values.min(0).tobytes()], "highs": [values.max(0).tobytes()]}
    head = {"width": [values.shape[1]], "block": [group["block"].iloc[0]], "low": [slices.low], "high": [int(values.max()) if values.size else 0], "bits": [slices.maps.shape[1]]}
    return pd.DataFrame(head | extremes | {"ids": [slices.ids.tobytes()], "slices": [slices.maps.tobytes()]})


def _asked(group: pd.DataFrame) -> pd.DataFrame:
    """One block of queries as one row."""
    values = np.stack(group["v"].to_numpy()).astype("<i8")
    head = {"width": [values.shape[1]], "home": [group["home"].iloc[0]], "part": [group["part"].iloc[0]]}
    return pd.DataFrame(head | {"q_ids": [group["id"].to_numpy("<i8").tobytes()], "vectors": [values.tobytes()]})


INDEX = "width int, block int, low long, high long, bits int, lows binary, highs binary, ids binary, slices binary"
ASKS = "width int, home int, part int, q_ids binary, vectors binary"


class Index:
    """A stored index: ``blocks`` (a row a block), ``regions`` (which blocks a region has) and the means that tell regions apart."""

    def __init__(self, blocks: DataFrame, regions: DataFrame, means: list[float]):
        self.blocks, self.regions, self.means = blocks, regions, means

    def region(self) -> Column:
        code = F.lit(0)
        for j, mean in enumerate(self.means):
            code = code + F.when(F.get("v", F.lit(j)) > mean, 1 << (len(self.means) - 1 - j)).otherwise(0)
        return code.cast("int")

    def placed(self, df: DataFrame, name: str) -> DataFrame:
        """Add the block of the row's region that its id and vector deal it to; null for a region without rows."""
        lookup = join_lookup(df.withColumn("region", self.region()), self.regions, ["width", "region"])
        return lookup.withColumn(name, (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("cuts"))).cast("int")).drop("first", "cuts", "region")


def build_index(vectors: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS) -> Index:
    """Store the bit slices of ``vectors`` (id long, v array<long>); null ids and vectors take no part.

    Small regions of neighbouring codes share a block, large ones (copies of one vector too) have as
    many as their rows ask for, so a block has at most about twice ``block_rows`` rows.
    """
    rows = scratch.staged(vectors.where("v is not null and id is not null").select("id", "v", F.size("v").alias("width")))
    count = rows.count()
    bits = min(REGION_BITS, (count // block_rows).bit_length() + 1) if count > block_rows else 0
    means = rows.agg(F.count("*"), *[F.avg(F.get("v", F.lit(j))) for j in range(bits)]).first()[1:]
    index = Index(None, None, [m for m in means if m is not None])
    counted = rows.withColumn("region", index.region()).groupBy("width", "region").agg(F.count("*").alias("n"))
    # at most 2 ** REGION_BITS regions a width
    before = F.sum("n").over(Window.partitionBy("width").orderBy("region").rowsBetween(Window.unboundedPreceding, -1))
    first = F.floor(F.coalesce(before, F.lit(0)) / block_rows).alias("first")
    index.regions = scratch.staged(counted.select("width", "region", first, F.ceil(F.col("n") / block_rows).alias("cuts")))
    index.blocks = scratch.staged(index.placed(rows, "block").groupBy("width", "block").applyInPandas(_block, INDEX))
    return index


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k rows of highest integer inner product.

    Both inputs have (id long, v array<long>). A query meets the rows of its own length, as an inner
    product needs; tables of mixed lengths are searched length by length, side by side. A row is
    never its own query's result (same id). Ties go to the smaller id; rows that share an id and a
    score are in any order. Fewer than k rows give all there are. Null vectors and null ids take no
    part, empty vectors meet empty ones; no rows or no queries: no result. Sums that might pass 62 bits are an error.
    """
    with Scratch(vectors.sparkSession) as scratch:
        return staged(search(build_index(vectors, scratch, block_rows), queries, scratch, k, block_queries))


def _searched(slices: BitSlices, q_ids: np.ndarray, weights: np.ndarray, floors: np.ndarray, chosen: np.ndarray, k: int) -> Iterator[tuple]:
    """``(query's place, ids, scores)`` of the chosen queries in one block; a full k raises the query's floor."""
    for q in chosen.tolist():
        at, score = slices.best(weights[q], k, int(q_ids[q]))
        if len(at) == k:
            floors[q] = max(floors[q], score.min())
        yield q, slices.ids[at], score


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = 20, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """As ``top_k`` over a stored index; the result reads what is staged in ``scratch``."""
    spark = queries.sparkSession
    asked = scratch.staged(queries.where("v is not null and id is not null").select("id", "v", F.size("v").alias("width")))
    stats = index.blocks.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("width").alias("wide"), F.count("*").alias("n")).first()
    n_asked, largest = asked.agg(F.count("*"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))).first()
    if not stats["n"] or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = min(stats["low"], 0), max(stats["high"], 0)
    if max(-low, high, high - low) * largest * stats["wide"] >= 1 << 61:
        raise OverflowError("scores may pass 62 bits")
    home = index.placed(asked, "home").withColumn("home", F.coalesce("home", F.lit(-1)))
    parts = scratch.staged(home.groupBy("width", "home").agg(F.ceil(F.count("*") / block_queries).alias("parts")))
    dealt = join_lookup(home, parts, ["width", "home"]).withColumn("part", F.pmod(F.xxhash64("v", "id"), F.col("parts")).cast("int"))
    asks = scratch.staged(dealt.groupBy("width", "home", "part").applyInPandas(_asked, ASKS))

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                q_ids, none = np.frombuffer(pair.q_ids, "<i8"), np.zeros(0, np.int64)
                weights = np.frombuffer(pair.vectors, "<i8").reshape(len(q_ids), pair.width)
                floors, out = np.full(len(q_ids), NO_FLOOR, np.int64), [(none, none, none)]
                if pair.ids is not None:
                    for q, ids, score in _searched(BitSlices.read(pair), q_ids, weights, floors, np.arange(len(q_ids)), k):
                        out.append((np.full(len(ids), q_ids[q]), ids, score))
                found = [np.concatenate([o[i] for o in out]) for i in range(3)]
                yield pd.DataFrame({"width": [pair.width], "home": [pair.home], "part": [pair.part], "q_ids": [pair.q_ids], "vectors": [pair.vectors], "floors": [floors.tobytes()], "q": [found[0]], "id": [found[1]], "s": [found[2]]})

    own = index.blocks.select("width", F.col("block").alias("home"), "low", "bits", "ids", "slices")
    pairs = asks.join(own, ["width", "home"], "left").select("width", "home", "part", "q_ids", "vectors", "low", "bits", "ids", "slices")
    n_asks = asks.count()
    pairs = pairs.repartition(min(n_asks, 4096), "width", "home", "part")  # work grows with pairs, not with their bytes
    with batches_of(spark, 4):
        met = scratch.staged(pairs.withColumn("bits", F.coalesce("bits", F.lit(0))).withColumn("low", F.coalesce("low", F.lit(0).cast("long"))).mapInPandas(at_home, ASKS + ", floors binary, q array<long>, id array<long>, s array<long>"))
    first = met.select(F.explode(F.arrays_zip("q", "id", "s")).alias("f")).select(F.col("f.q").alias("query_id"), F.col("f.id").alias("vec_id"), F.col("f.s").alias("score"))

    row_stripe, query_stripe = ROW_STRIPE, QUERY_STRIPE
    stripes = lambda n, size: -(-n // size)
    while max(row_stripe, query_stripe) > 1 and stripes(stats["n"], row_stripe) * stripes(n_asks, query_stripe) < 4 * spark.sparkContext.defaultParallelism:
        row_stripe, query_stripe = max(1, row_stripe // 2), max(1, query_stripe // 2)
    down, across = stripes(stats["n"], row_stripe), stripes(n_asks, query_stripe)

    def cell(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        out = [(none, none, none)]
        if len(rows) and len(asks):
            wide = rows["width"].iloc[0]
            lows, highs = (np.stack([np.frombuffer(x, "<i8") for x in rows[c]]) for c in ("lows", "highs"))
            for ask in asks.itertuples(index=False):
                q_ids, floors = np.frombuffer(ask.q_ids, "<i8"), np.frombuffer(ask.floors, "<i8").copy()
                weights = np.frombuffer(ask.vectors, "<i8").reshape(len(q_ids), wide)
                bound = np.maximum(weights, 0) @ highs.T + np.minimum(weights, 0) @ lows.T  # queries x blocks
                for b in np.argsort(-bound.max(0), kind="stable").tolist():
                    row = rows.iloc[b]
                    chosen = np.flatnonzero(bound[:, b] >= floors)
                    if row["block"] != ask.home and len(chosen):
                        for q, ids, score in _searched(BitSlices.read(row), q_ids, weights, floors, chosen, k):
                            may = score >= floors[q]
                            out.append((np.full(int(may.sum()), q_ids[q]), ids[may], score[may]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    # a stripe has blocks of any region, so that work is spread evenly
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.blocks.withColumn("down", F.pmod("block", F.lit(down)).cast("int")).withColumn("across", each(across))
    asks = met.drop("q", "id", "s").withColumn("across", F.pmod(F.xxhash64("home", "part"), F.lit(across)).cast("int")).withColumn("down", each(down))
    keys = ["width", "down", "across"]
    cells = min(down * across, 4096)
    met_in_cells = rows.repartition(cells, *keys).groupBy(*keys).cogroup(asks.repartition(cells, *keys).groupBy(*keys))
    more = scratch.staged(met_in_cells.applyInPandas(cell, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = first.unionByName(more).withColumn("rank", rank.cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
