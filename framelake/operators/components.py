"""Connected components as DataFrame rounds (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import Scratch, staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: tuple[str, ...] = ()) -> DataFrame:
    """Label every node of ``edges`` with the smallest node it can reach.

    ``edges`` has ``keys`` (e.g. a frame; may be empty) and two node columns of one orderable type.
    Returns ``keys + (node, component)``, one row per node that occurs in an edge; self loops make a
    node appear alone. Null nodes and repeated rows are ignored. No edges: no rows.

    Each round maps every node's neighbours to the least node around it, by two grouped minima and
    two joins; the number of rounds grows with the logarithm of the longest path, edges never
    outgrow the input, and a node with very many neighbours is only ever aggregated, not collected.
    """
    k = list(keys)
    with Scratch(edges.sparkSession) as scratch:
        pairs = edges.select(*k, F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
        pairs = scratch.staged(pairs.select(*k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        nodes = pairs.select(*k, "a").union(pairs.select(*k, "b")).distinct()
        current, seen = pairs.where("a <> b"), None
        while True:
            # large star: every neighbour above v points to the least node around v
            both = current.union(current.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy(*k, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            large = both.join(low, [*k, "a"]).where("b > a").select(*k, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # small star: v and its neighbours below it point to the least of them
            low = large.groupBy(*k, "a").agg(F.min("b").alias("m"))
            hooked = large.join(low, [*k, "a"]).select(*k, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            current = scratch.staged(hooked.union(low.select(*k, "a", F.col("m").alias("b"))).distinct(), slot="edges")
            state = current.agg(F.count("*"), F.sum(F.xxhash64(*k, "a", "b").cast("decimal(20,0)"))).first()
            if state == seen:
                break
            seen = state
        found = nodes.join(current, [*k, "a"], "left").select(*k, F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))
        return staged(found)


def numbered(df: DataFrame, keys: list[str], order: str, name: str, span: int = 1 << 16) -> DataFrame:
    """``df`` with ``name``: the place of each row among those of its keys, from 0, by the whole number ``order``.

    A task sees the rows of a span of numbers, or a count for each span of one key; rows of one number are in
    any order.
    """
    near = F.expr(f"`{order}` div {span}").alias("_near")
    sizes = df.groupBy(*keys, near).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(*keys, "_near", before.alias("_first"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_near").orderBy(order)) - 1
    return df.withColumn("_near", near).join(firsts, [*keys, "_near"]).withColumn(name, (F.col("_first") + inner).cast("long")).drop("_near", "_first")
