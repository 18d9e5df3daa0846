"""Trajectories that arrive while a simulation runs: frames as a stream.

Chunks of atoms land as Parquet files in a folder; each batch of new files updates running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Atoms from files as they appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def frame_dipoles(atoms: DataFrame) -> DataFrame:
    """Running dipole of every frame; chunks of one frame may come in any order."""
    return atoms.groupBy("frame").agg(*[F.sum(F.col("charge") * F.col(k)).alias(f"m{k}") for k in "xyz"], F.sum("charge").alias("charge"), F.count("*").alias("atoms"))


def windowed_counts(events: DataFrame, time: str, state: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Occupancy of states in windows of time; rows later than the watermark are left out."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), state).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Work through what is there and stop; the result is the in-memory table ``name``."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
