"""Sharding along a Hilbert curve, so that shards are compact in several metadata dimensions at once.

Each dimension is quantised in its own order to a few bits (names by ranges of the distinct ones),
the cell's place on the Hilbert curve orders the rows, and the order is cut into runs of equal row
counts. Rows of one shard then span a small box of the dimensions, and the minima and maxima of a
shard prune it for filters on any of them. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import fresh, join_lookup, shared_dir, staged

BITS = 4  #: of each dimension


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve (long) of a cell with integer coordinates below ``2**bits``.

    The coordinates are reflected and exchanged level by level, then Gray-decoded and interleaved.
    """
    n = len(axes)
    x = F.array(*[a.cast("long") for a in axes])
    at = lambda v, i: F.element_at(v, F.lit(i + 1)) if isinstance(i, int) else F.element_at(v, i + 1)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(v, s):
        p, first, own = s["q"] - 1, at(v, 0), at(v, s["i"])
        invert = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        change = F.when(invert, p).otherwise(swap)
        return F.transform(v, lambda e, j: F.when(j == 0, e.bitwiseXOR(change)).when((j == s["i"]) & ~invert, e.bitwiseXOR(swap)).otherwise(e))

    x = F.aggregate(steps, x, turn)
    gray = F.aggregate(F.slice(x, 2, n - 1), F.slice(x, 1, 1), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(e))))
    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])

    def decode(v):
        t = F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(F.element_at(v, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(v, lambda e: e.bitwiseXOR(t))

    places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    interleave = lambda v: F.aggregate(
        places, F.lit(0).cast("long"), lambda acc, b: F.aggregate(v, acc, lambda h, e: h * 2 + F.call_function("shiftright", e, b).bitwiseAND(F.lit(1).cast("long")))
    )
    # one-element arrays bind each intermediate value to a name, so that it is worked out once
    return F.element_at(F.transform(F.transform(F.array(gray), decode), interleave), 1)


def name_bounds(df: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """At most ``2**bits - 1`` names that cut the distinct names of a column, in their order, into ranges of like counts.

    Spark's range partitioning of the distinct names finds them; the driver gets one name a
    partition. Up to some hundred names a task they are exact, beyond that they rest on its sample.
    """
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    dealt = names.repartitionByRange(1 << bits, "name").groupBy(F.spark_partition_id().alias("part")).agg(F.min("name").alias("least"))
    least = sorted((r["least"] for r in dealt.collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))
    n = min(1 << bits, len(least))
    return [least[i * len(least) // n] for i in range(1, n)]


def range_quantised(value: Column, bounds: list[str]) -> Column:
    """The range (from 0) a name falls into, in the order of names, so that ranges of shards prune; nulls are in the first."""
    return sum((F.coalesce((value >= F.lit(b)).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def log_quantised(size: Column, bits: int = BITS) -> Column:
    return F.least(F.floor(F.log2(size + 1)), F.lit((1 << bits) - 1))


def shard(df: DataFrame, dimensions: list[Column], key: str, shards: int = 40, bits: int = BITS) -> DataFrame:
    """``df`` with ``curve`` (place on the curve), ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard).

    Row counts of shards differ by one at most. Rows of one cell are ordered by a hash of the key
    and then the key, so a rerun gives every row the same place; rows whose keys are equal or null
    too share their places in any order. Fewer rows than shards leave shards empty; no rows, none.
    Existing columns ``curve``, ``shard`` and ``slot`` are replaced.

    A cell of any size is cut into buckets by the key's hash, as many as its count asks for. Counts of
    cells and buckets, combined before the shuffle, give each bucket its first rank, so no task sorts
    more than a bucket, and there are at most ``2**(bits * dimensions)`` cells and that many buckets
    and four a shuffle partition, whatever the rows.
    """
    spark = df.sparkSession
    rows = staged(df.drop("curve", "shard", "slot").withColumn("curve", hilbert_index(dimensions, bits)))
    counts = staged(rows.groupBy("curve").agg(F.count("*").alias("_n")))
    total, n_cells = counts.agg(F.sum("_n"), F.count("*")).first()
    total = total or 0
    most = max(1, -(-total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cuts, cut, first, rank = fresh(rows, "cuts", "cut", "first", "rank")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.select("curve", before(Window.orderBy("curve")).alias("_cell"), F.expr(f"(_n + {most - 1}L) div {most}L").alias(cuts))
    dealt = join_lookup(rows, cells.select("curve", cuts), ["curve"], "inner", rows=n_cells)
    dealt = dealt.withColumn(cut, F.pmod(F.xxhash64(F.col(key)), F.col(cuts))).drop(cuts)
    buckets = staged(dealt.groupBy("curve", cut).agg(F.count("*").alias("_n")))
    inside = buckets.withColumn("_inside", before(Window.partitionBy("curve").orderBy(cut)))
    firsts = inside.join(cells, "curve").select("curve", cut, (F.col("_cell") + F.col("_inside")).alias(first))
    place = F.col(first) + F.row_number().over(Window.partitionBy("curve", cut).orderBy(key)) - 1
    ranked = join_lookup(dealt, firsts, ["curve", cut], "inner").withColumn(rank, place)
    number = F.expr(f"`{rank}` * {shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", number.cast("int")).withColumn("slot", (F.col(rank) - start).cast("long")).drop(cut, first, rank)


def write_shards(sharded: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Write each shard as a folder of Parquet in slot order; also return what a reader needs for pruning.

    The second result has, per shard, its rows and the least and greatest value of every atomic column.
    """
    path = path or shared_dir(sharded.sparkSession)
    shards = sharded.agg(F.max("shard")).first()[0]
    sharded.repartitionByRange(max(1, (shards or 0) + 1), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    plain = [c for c, t in sharded.dtypes if c not in ("shard", "slot") and not t.startswith(("array", "map", "struct", "binary"))]
    return path, sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in plain for n, f in (("min", F.min), ("max", F.max))])
