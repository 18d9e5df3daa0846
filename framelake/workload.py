"""The given tables seen as particles, charges, states and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.runtime import table

EDGE = 10.0
CELL = Cell.of_lengths(EDGE, EDGE, EDGE)


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as four frames of atoms in a cubic cell."""
    e = table(spark, sf_dir, "embeddings")
    position = [((F.col("embedding")[i].cast("double") + 0.5) * EDGE).alias(k) for i, k in enumerate("xyz")]
    return e.select(
        (F.col("vec_id") % 4).alias("frame"),
        F.expr("vec_id div 4").alias("atom_index"),
        F.concat(F.lit("T"), F.col("label")).alias("type"),
        (F.col("label") - 4.5).cast("double").alias("charge"),
        (F.col("label") + 1.0).cast("double").alias("mass"),
        (F.col("label") * 0.01 + 0.2).cast("double").alias("radius"),
        *position,
        CELL.column().alias("cell"),
    )


def quaternions(spark: SparkSession, sf_dir: str, slots: int = 3) -> DataFrame:
    """Unit quaternions from the first four components; ``slots`` of them make a state."""
    e = table(spark, sf_dir, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(4)]
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] + v[3] * v[3])
    return e.select(F.expr(f"vec_id div {slots}").alias("frame"), (F.col("vec_id") % slots).cast("int").alias("slot"), *[(x / size).alias(k) for k, x in zip("wxyz", v, strict=True)])


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as frames of charges, one frame per order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame"),
        F.col("l_linenumber").alias("slot"),
        (F.col("l_discount") - F.col("l_tax")).alias("charge"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_suppkey").cast("double").alias("z"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the states of one trajectory per user."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("traj"), "ts", "event_id", F.col("event_type").alias("state"), F.col("value").alias("distance"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as values on a grid."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_linenumber") - 1).cast("int").alias("ia"), (F.col("l_quantity").cast("int") - 1).alias("ib"), (F.col("l_suppkey") % 8).cast("int").alias("ic"), F.col("l_extendedprice").alias("value"))
