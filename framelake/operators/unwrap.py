"""Molecules made whole across the boundary of a cell.

A bond says by how many cells its second atom must be moved to lie beside the first. These whole numbers
are composed along a spanning forest, without walking it bond by bond: every group of atoms (at first
each atom) hangs itself on its neighbour of least number, chains of such links are halved by pointer jumping
until all point to their top, with the moves along them added up, and what is left of the bonds then connects
fewer than half as many groups. So the number of rounds grows with the logarithm of a molecule's length,
and no task sees a molecule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import cartesian, fractional, sub, vec
from framelake.runtime import Scratch, staged

_MOVE = ("da", "db", "dc")


def _sum(*terms: tuple[int, str]) -> list[Column]:
    """The moves of several links together, each with its sign and the suffix of its columns."""
    return [sum((sign * F.coalesce(F.col(f"{m}{s}"), F.lit(0)) for sign, s in terms[1:]), terms[0][0] * F.coalesce(F.col(f"{m}{terms[0][1]}"), F.lit(0))).cast("int").alias(m) for m in _MOVE]


def bond_moves(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """``frame, i, j, da, db, dc``: cells by which atom j is moved to its image beside atom i; none without a cell."""
    points = atoms.select("frame", "atom_index", "x", "y", "z", "cell")
    one = points.select("frame", F.col("atom_index").alias("i"), *[F.col(k).alias(f"{k}_1") for k in "xyz"], "cell")
    two = points.select("frame", F.col("atom_index").alias("j"), *[F.col(k).alias(f"{k}_2") for k in "xyz"])
    both = bonds.select("frame", "i", "j").where("i <> j").join(one, ["frame", "i"]).join(two, ["frame", "j"])
    f = fractional(sub(vec(suffix="_2"), vec(suffix="_1")), F.col("cell"))
    return both.select("frame", "i", "j", *[F.coalesce(-F.floor(x + 0.5), F.lit(0)).cast("int").alias(m) for m, x in zip(_MOVE, f, strict=True)])


def image_moves(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """``frame, atom_index, component, da, db, dc, infinite`` of all bonded atoms: cells by which each is moved.

    ``component`` is the least atom of the molecule, which stays. A molecule that is bonded to an image of
    itself is ``infinite`` and has no whole form: none of its atoms is moved. Repeated bonds change nothing.
    """
    with Scratch(atoms.sparkSession) as scratch:
        links = scratch.staged(bond_moves(bonds, atoms))
        back = links.select("frame", F.col("j").alias("a"), F.col("i").alias("b"), *[(-F.col(m)).alias(m) for m in _MOVE])
        edges = scratch.staged(links.select("frame", F.col("i").alias("a"), F.col("j").alias("b"), *_MOVE).union(back).distinct())
        places = scratch.staged(edges.select("frame", F.col("a").alias("atom_index"), F.col("a").alias("component")).distinct().select("*", *[F.lit(0).alias(m) for m in _MOVE]))
        while edges.limit(1).count():
            # of every group with a smaller neighbour the least of these, and the group's move beside it
            least = edges.where("b < a").groupBy("frame", "a").agg(F.min(F.struct("b", *_MOVE)).alias("t"))
            up = scratch.staged(least.select("frame", "a", F.col("t.b").alias("top"), *[(-F.col(f"t.{m}")).alias(m) for m in _MOVE]), slot="up")
            while True:
                above = up.select("frame", F.col("a").alias("top"), F.col("top").alias("next"), *[F.col(m).alias(f"{m}_up") for m in _MOVE])
                jumped = up.join(above, ["frame", "top"], "left")
                after = scratch.staged(jumped.select("frame", "a", F.coalesce("next", "top").alias("top"), *_sum((1, ""), (1, "_up")), F.col("next").isNotNull().alias("moved")), slot="up")
                up = after.drop("moved")
                if not after.where("moved").limit(1).count():
                    break
            hung = up.select("frame", F.col("a").alias("component"), "top", *[F.col(m).alias(f"{m}_up") for m in _MOVE])
            placed = places.join(hung, ["frame", "component"], "left")
            places = scratch.staged(placed.select("frame", "atom_index", F.coalesce("top", "component").alias("component"), *_sum((1, ""), (1, "_up"))), slot="places")
            first = up.select("frame", "a", F.col("top").alias("ta"), *[F.col(m).alias(f"{m}_1") for m in _MOVE])
            second = up.select("frame", F.col("a").alias("b"), F.col("top").alias("tb"), *[F.col(m).alias(f"{m}_2") for m in _MOVE])
            drawn = edges.join(first, ["frame", "a"], "left").join(second, ["frame", "b"], "left").select("frame", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), *_sum((1, "_1"), (1, ""), (-1, "_2")))
            edges = scratch.staged(drawn.where("a <> b").groupBy("frame", "a", "b").agg(F.min(F.struct(*_MOVE)).alias("t")).select("frame", "a", "b", "t.*"), slot="edges")
        one = places.select("frame", F.col("atom_index").alias("i"), "component", *[F.col(m).alias(f"{m}_1") for m in _MOVE])
        two = places.select("frame", F.col("atom_index").alias("j"), *[F.col(m).alias(f"{m}_2") for m in _MOVE])
        off = links.join(one, ["frame", "i"]).join(two, ["frame", "j"]).select("frame", "component", *_sum((1, "_1"), (1, ""), (-1, "_2")))
        endless = off.where("da <> 0 or db <> 0 or dc <> 0").select("frame", "component").distinct().withColumn("infinite", F.lit(True))
        found = places.join(endless, ["frame", "component"], "left").withColumn("infinite", F.coalesce("infinite", F.lit(False)))
        return staged(found.select("frame", "atom_index", "component", *[F.when(F.col("infinite"), 0).otherwise(F.col(m)).alias(m) for m in _MOVE], "infinite"))


def whole_molecules(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``atoms`` with the positions of whole molecules, and ``infinite``; the least atom of each molecule stays.

    Molecules may be longer than the cell. Atoms without bonds stay; so do those of a molecule bonded to an
    image of itself, which is marked. Existing columns ``infinite`` are replaced.
    """
    names = [f"_{m}" for m in _MOVE]
    moves = image_moves(bonds, atoms).select("frame", "atom_index", *[F.col(m).alias(n) for m, n in zip(_MOVE, names, strict=True)], "infinite")
    both = atoms.drop("infinite").join(moves, ["frame", "atom_index"], "left").withColumn("infinite", F.coalesce("infinite", F.lit(False)))
    step = cartesian(tuple(F.coalesce(n, F.lit(0)).cast("double") for n in names), F.col("cell"))
    return both.withColumns({k: F.col(k) + F.coalesce(s, F.lit(0.0)) for k, s in zip("xyz", step, strict=True)}).drop(*names)
