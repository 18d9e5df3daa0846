"""Session helpers: reading tables, cutting lineage on shared storage, size-checked lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows of one key from which it is joined apart.
HOT_ROWS = 50_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, for columns that an operator adds and takes away again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor sees.

    Where the session names none and all tasks run in the driver's own process (tests), a temporary
    folder is set once; on a cluster that is an error, as executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="framelake-"))
        base = _own[0]
    return f"{_scopes[-1] if _scopes else base.rstrip('/')}/framelake-{uuid.uuid4().hex}"


_own: list[str] = []  #: the temporary folder of tests, which set none
_scopes: list[str] = []  #: folders that take what is staged, innermost last


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes when this is left; what is to stay is written to a folder that was named before."""
    base = shared_dir(spark)
    _scopes.append(base)
    try:
        yield
    finally:
        _scopes.remove(base)
        discard(spark, base)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of staged data, by the file system it lives on."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, partition_by: list[str] | None = None, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cut lineage that survives lost executors.

    ``codec`` compresses other than the session says.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged steps of one operator, deleted when it is left; what it returns must not read them.

    ``slot`` names a step that replaces an earlier one, which is deleted once the new one is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.count, self.slots = spark, shared_dir(spark), 0, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        discard(self.spark, self.base)

    def staged(self, df: DataFrame, slot: str | None = None, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        out = staged(df, partition_by, path, codec)
        if slot:
            before = self.slots.get(slot)
            self.slots[slot] = path
            if before:
                discard(self.spark, before)
        return out


def join_lookup(big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Join a lookup with unique keys: broadcast when its counted rows are at most ``most``, else a shuffle join that AQE can split.

    ``lookup`` should be staged or cheap, as it is counted unless ``rows`` is given.
    """
    n = lookup.limit(most + 1).count() if rows is None else rows
    return big.join(F.broadcast(lookup) if n <= most else lookup, on, how)


def join_hot(big: DataFrame, lookup: DataFrame, on: list[str], least: int = HOT_ROWS) -> DataFrame:
    """Left join of a lookup with unique keys and narrow rows, where some keys may hold a large part of ``big``.

    Keys with more than ``least`` rows of ``big``, of which there can be at most half of
    ``BROADCAST_ROWS`` as ``least`` grows with the table, meet their row of the lookup without a
    shuffle; all other rows meet it by one. Null keys find nothing. ``big`` should be staged or cheap,
    as it is counted.
    """
    least = max(least, big.count() // (BROADCAST_ROWS // 2))
    (n,) = fresh(big.join(lookup, on), "n")
    keys = big.groupBy(*on).agg(F.count("*").alias(n)).where(F.col(n) > least).select(*on)
    rest = [c for c in lookup.columns if c not in on]
    hot = staged(keys.join(lookup, on, "left").select(*on, *rest))
    if not hot.limit(1).count():
        return big.join(lookup, on, "left")
    same = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in on])
    own = [c for c in big.columns if c not in on]
    met = big.alias("b").join(F.broadcast(hot).alias("h"), same).select(*[f"b.{c}" for c in on + own], *[f"h.{c}" for c in rest])
    others = big.alias("b").join(F.broadcast(hot.select(*on)).alias("h"), same, "left_anti").join(lookup, on, "left")
    return others.select(*on, *own, *rest).unionByName(met)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand at most so many rows at a time to Python from now on, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """As ``small_batches`` for what is run (not only planned) inside; the setting before holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
