"""Pairs of points within a cutoff, under periodic boundary conditions.

The spatial join is an equal join: space is cut into bins at least as wide as the cutoff, one side
is copied to its neighbouring bins, and bins meet by their numbers; distances decide. Bins are part
of the key, so one huge frame spreads over the cluster as well as many small ones do.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import dot, fractional, nearest_image, sub, vec, widths


def _bins(cell: Column | None, cutoff: float) -> list[tuple[Column, Column]]:
    """(bin, bins along the axis; null without a cell) for each axis."""
    free = [F.floor(F.col(k) / cutoff).cast("int") for k in "xyz"]
    if cell is None:
        return [(b, F.lit(None).cast("int")) for b in free]
    out = []
    for f, w, b in zip(fractional(vec(), cell), widths(cell), free, strict=True):
        n = F.greatest(F.lit(1), F.floor(w / cutoff).cast("int"))
        own = F.least(F.floor((f - F.floor(f)) * n).cast("int"), n - 1)
        out.append((F.when(cell.isNull(), b).otherwise(own), F.when(cell.isNotNull(), n)))
    return out


def _around(b: Column, n: Column) -> Column:
    """The bin and its neighbours, each once."""
    near = F.array(b - 1, b, b + 1)
    return F.when(n.isNull(), near).otherwise(F.array_distinct(F.transform(near, lambda x: F.pmod(x, n))))


#: Candidate pairs that a task should meet, and rows of one side that meet each row of the other at once.
TASK_PAIRS = 16_000_000
BLOCK_ROWS = 2_048
MOST_TASKS = 8_192


def neighbour_pairs(left: DataFrame, right: DataFrame | None, cutoff: float, keys: tuple[str, ...] = ("frame",), ident: tuple[str, ...] = ("atom_index",), keep: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``<ident>_1``, ``<ident>_2`` (and ``keep`` columns), ``dx, dy, dz, r2`` with r2 <= cutoff squared.

    Without ``right`` each unordered pair of ``left`` comes once, smaller identity first. With it,
    every (left, right) pair but of an entity with itself. Both may have a ``cell`` column; without
    one, or where it is null, space is not periodic. Rows without a position meet nothing.

    Candidates are counted by bins first: they decide how many tasks meet them, as few rows can make many
    pairs, and into how many blocks the rows of a bin are dealt, each block of one side meeting each of the other.
    """
    periodic = "cell" in left.columns
    other = left if right is None else right
    wanted = list(dict.fromkeys([*ident, *keep]))
    bin_names = ["_b0", "_b1", "_b2"]

    def side(df: DataFrame, s: str, spread: bool) -> DataFrame:
        cell = F.col("cell") if "cell" in df.columns else None
        bins = _bins(cell, cutoff)
        cols = [*keys, *[F.col(c).alias(f"{c}_{s}") for c in wanted], *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(f"{c}_{s}") for c in "xyz"]]
        if periodic:
            parts = fractional(vec(), cell) if cell is not None else [F.lit(None).cast("double")] * 3
            cols += [F.coalesce(f, F.lit(0.0)).alias(f"_f{i}_{s}") for i, f in enumerate(parts)]
        if periodic and not spread:
            cols += [F.coalesce(cell["h"][i], F.lit(0.0)).alias(f"_h{i}") for i in range(9)]
        if not spread:
            return df.select(*cols, *[b.alias(f"_b{i}") for i, (b, _) in enumerate(bins)])
        rows = df.select(*cols, *[_around(b, n).alias(f"_n{i}") for i, (b, n) in enumerate(bins)])
        for i in range(3):
            rows = rows.withColumn(f"_b{i}", F.explode(f"_n{i}")).drop(f"_n{i}")
        return rows

    one, two = side(left, "1", False), side(other, "2", True)
    met = [*keys, *bin_names]
    sizes = one.groupBy(*met).agg(F.count("*").alias("_p")).join(two.groupBy(*met).agg(F.count("*").alias("_q")), met)
    work, here, there = sizes.agg(F.sum(F.col("_p") * F.col("_q").cast("double")), F.max("_p"), F.max("_q")).first()
    many = bool(work) and work > TASK_PAIRS
    if many:
        apart = (math.ceil(here * min(there, BLOCK_ROWS) / TASK_PAIRS), math.ceil(there / BLOCK_ROWS))
        for s, n in zip("12", apart, strict=True):
            if n > 1:
                own = F.pmod(F.xxhash64(*[f"{c}_{s}" for c in ident]), F.lit(n)).cast("int").alias(f"_s{s}")
                every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(f"_s{s}")
                one, two = (one.select("*", own), two.select("*", every)) if s == "1" else (one.select("*", every), two.select("*", own))
                met.append(f"_s{s}")
        tasks = min(MOST_TASKS, math.ceil(work / TASK_PAIRS) + 7)
        one, two = one.repartition(tasks, *met), two.repartition(tasks, *met)
    both = one.join(two.hint("merge") if many else two, met)
    ends = [(F.col(f"{c}_1"), F.col(f"{c}_2")) for c in ident]
    if right is None:  # in the order of the identities' columns, without a struct for each candidate
        differ = reduce(lambda rest, p: (p[0] < p[1]) | ((p[0] == p[1]) & rest), reversed(ends), F.lit(False))
    else:
        differ = reduce(lambda rest, p: rest | (p[0] != p[1]), ends[1:], ends[0][0] != ends[0][1])
    d = sub(vec(suffix="_1"), vec(suffix="_2"))
    if periodic:
        cells = [F.floor(F.col(f"_f{i}_1") - F.col(f"_f{i}_2") + 0.5) for i in range(3)]
        d = tuple(v - (cells[0] * F.col(f"_h{k}") + cells[1] * F.col(f"_h{3 + k}") + cells[2] * F.col(f"_h{6 + k}")) for k, v in enumerate(d))
    # A generator keeps the optimizer from writing the whole difference into every later use of it, and the code from outgrowing what is compiled.
    once = F.inline(F.array(F.struct(*[v.alias(f"d{k}") for k, v in zip("xyz", d, strict=True)])))
    names = [f"{c}_{s}" for s in "12" for c in wanted]
    r2 = dot(vec("d"), vec("d"))
    return both.where(differ).select(*keys, *names, once).where(r2 <= cutoff * cutoff).select(*keys, *names, "dx", "dy", "dz", r2.alias("r2"))


def all_pairs(left: DataFrame, cutoff: float, keys: tuple[str, ...] = ("frame",), ident: str = "atom_index") -> DataFrame:
    """The same pairs by joining every two points of a frame: for small frames and for tests."""
    side = lambda s: left.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in (ident, "x", "y", "z")], *(["cell"] if s == "1" and "cell" in left.columns else []))
    both = side("1").join(side("2"), list(keys)).where(F.col(f"{ident}_1") < F.col(f"{ident}_2"))
    d = nearest_image(sub(vec(suffix="_1"), vec(suffix="_2")), F.col("cell") if "cell" in left.columns else None)
    out = both.withColumns({f"d{k}": v for k, v in zip("xyz", d, strict=True)}).withColumn("r2", dot(vec("d"), vec("d")))
    return out.where(F.col("r2") <= cutoff * cutoff).select(*keys, f"{ident}_1", f"{ident}_2", "dx", "dy", "dz", "r2")


def clashes(probes: DataFrame, points: DataFrame, cutoff: float, keys: tuple[str, ...] = ("frame",), ident: str = "atom_index") -> DataFrame:
    """Probes with any point within the cutoff (other than themselves)."""
    near = neighbour_pairs(probes, points, cutoff, keys, (ident,)).select(*keys, F.col(f"{ident}_1").alias(ident)).distinct()
    return probes.join(near, [*keys, ident], "left_semi")


def union_entities(*selections: DataFrame) -> DataFrame:
    """Several entity lists as one without repeats, each with the lists it is in (``in_lists``)."""
    tagged = [s.withColumn("_l", F.lit(i)) for i, s in enumerate(selections)]
    keys = ["frame", "kind", "id"]
    both = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in both.columns if c not in (*keys, "_l")]
    return both.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_set("_l")).alias("in_lists"))
