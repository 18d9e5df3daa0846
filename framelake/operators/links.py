"""Molecules, and atoms of few neighbours, without a list of all bonds.

Atoms that stand together in a small enough box are all bonded to each other, whatever their radii: a clique.
Cliques of a few grids, shifted against each other, are found by grouping, so what they say grows with the
atoms, where bonds of a crowded frame grow with their square. Only pairs that cliques leave open are compared.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import CELL_TYPE, cartesian, dot, fractional, norm, sub, vec, widths
from framelake.operators.components import connected_components
from framelake.operators.pairs import _bins, neighbour_pairs
from framelake.operators.selection import select
from framelake.operators.topology import TopologySettings, detect_bonds
from framelake.operators.unwrap import image_moves
from framelake.runtime import Scratch, staged

#: Atoms of a clique, as an atom sees them on average, from which cliques save more than they cost.
CROWDED = 3.0
_GRIDS = [(a, b, c) for a in (0.0, 0.5) for b in (0.0, 0.5) for c in (0.0, 0.5)]
_BOX = ["_c0", "_c1", "_c2"]
_BINS = ["_b0", "_b1", "_b2"]
_IMAGE = ["_a0", "_a1", "_a2"]


def _boxes(cell: Column, size: float) -> list[Column]:
    """How many boxes a cell has along each axis so that none is wider than ``size`` from corner to corner."""
    rows = [tuple(cell["h"][3 * i + k] for k in range(3)) for i in range(3)]
    units = [tuple(v / norm(r) for v in r) for r in rows]
    signs = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    widest = F.greatest(*[norm(tuple(units[0][k] + p * units[1][k] + q * units[2][k] for k in range(3))) for p, q in signs])
    return [F.ceil(norm(r) * widest / size).cast("long") for r in rows]


def _bonding(atoms: DataFrame, settings: TopologySettings) -> tuple[DataFrame, float, float] | None:
    """Atoms that may bond, the distance within which any two do and that beyond which none do.

    None where no such distance holds for all, or a cell is too small for one image of a pair to matter.
    """
    df = atoms
    if settings.no_bond:
        df = df.join(select(atoms, settings.no_bond).select("frame", "atom_index"), ["frame", "atom_index"], "left_anti")
    if "cell" not in df.columns:
        df = df.withColumn("cell", F.lit(None).cast(CELL_TYPE))
    df = df.where(F.col("radius").isNotNull() & reduce(lambda a, b: a & b, (F.coalesce(F.abs(k) < math.inf, F.lit(False)) for k in "xyz")))
    least, most = df.agg(F.min("radius"), F.max("radius")).first()
    if settings.criteria or least is None or not 2 * least + settings.tolerance > 0 or not most < math.inf:
        return None
    sure, cutoff = (2 * least + settings.tolerance) * (1 - 1e-6), 2 * most + settings.tolerance
    cell = F.col("cell")
    narrow = df.where(cell.isNotNull() & ((F.least(*_boxes(cell, sure)) < 8) | (F.least(*widths(cell)) < 3.1 * cutoff)))
    return None if narrow.limit(1).count() else (df.select("frame", "atom_index", "x", "y", "z", "radius", "cell"), sure, cutoff)


def _cliques(df: DataFrame, sure: float, grids: list[tuple[float, float, float]]) -> DataFrame:
    """``df`` with ``_g, _c0, _c1, _c2``: the box of each atom in each grid."""
    cell, free = F.col("cell"), sure / math.sqrt(3)
    parts = [F.when(cell.isNull(), F.col(k) / free).otherwise((f - F.floor(f)) * n).alias(f"_p{i}") for i, (k, f, n) in enumerate(zip("xyz", fractional(vec(), cell), _boxes(cell, sure), strict=True))]
    shifts = F.inline(F.array(*[F.struct(F.lit(g).alias("_g"), *[F.lit(s).alias(f"_s{i}") for i, s in enumerate(shift)]) for g, shift in enumerate(grids)]))  # a generator keeps the places from being written out for each grid
    each = df.select("*", *parts, *[n.alias(f"_m{i}") for i, n in enumerate(_boxes(cell, sure))]).select("*", shifts)
    place = [F.floor(F.col(f"_p{i}") + F.col(f"_s{i}")) for i in range(3)]
    return each.select(*df.columns, "_g", *[F.when(F.col(f"_m{i}").isNull(), p).otherwise(F.pmod(p, F.col(f"_m{i}"))).cast("long").alias(c) for i, (p, c) in enumerate(zip(place, _BOX, strict=True))])


def linking_bonds(atoms: DataFrame, settings: TopologySettings = TopologySettings(), images: bool = False) -> DataFrame:
    """``frame, i, j``: some of the bonds of ``detect_bonds``, from which the same molecules follow.

    With ``images`` the same moves to whole molecules (``unwrap``) follow too, and whether they are infinite. Bonds within
    cliques come first, from one atom to each other one. Then atoms are compared only with those around them
    that these bonds leave in another molecule, or in another image of the same. Where cliques are small, bonds have criteria, or cells are not
    several times as wide as a bond, all bonds are given.
    """
    known = _bonding(atoms, settings)
    if known is None:
        return detect_bonds(atoms, settings).select("frame", "i", "j")
    df, sure, cutoff = known
    with Scratch(atoms.sparkSession) as scratch:
        # all of a box of the first grid to its least atom, then of each box of the others one atom for each of these
        first = _cliques(df.select("frame", "atom_index", "x", "y", "z", "cell"), sure, _GRIDS[:1])
        roots = first.groupBy("frame", *_BOX).agg(F.min("atom_index").alias("_root"), F.count("*").alias("_n"))
        mean = roots.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0]
        if mean is None or mean < CROWDED:
            return detect_bonds(atoms, settings).select("frame", "i", "j")
        placed = scratch.staged(first.join(roots.drop("_n"), ["frame", *_BOX]).drop("_g", *_BOX))
        star = placed.where("atom_index <> _root").select("frame", F.col("_root").alias("i"), F.col("atom_index").alias("j"))
        parts = scratch.staged(_cliques(placed, sure, _GRIDS[1:]).groupBy("frame", "_g", *_BOX, "_root").agg(F.min("atom_index").alias("j")))
        heads = parts.groupBy("frame", "_g", *_BOX).agg(F.min("j").alias("i"))
        across = parts.join(heads, ["frame", "_g", *_BOX]).where("i <> j").select("frame", "i", "j")
        thin = scratch.staged(star.union(across).distinct())
        if images:
            found = image_moves(thin, df)
        else:
            found = connected_components(thin, "i", "j", ("frame",)).select("frame", F.col("node").alias("atom_index"), "component", *[F.lit(0).alias(m) for m in ("da", "db", "dc")], F.lit(True).alias("infinite"))
        known = df.join(found, ["frame", "atom_index"], "left").withColumns({"component": F.coalesce("component", "atom_index"), "infinite": F.coalesce("infinite", F.lit(False)), **{m: F.coalesce(m, F.lit(0)) for m in ("da", "db", "dc")}})
        moved = cartesian(tuple(F.col(m).cast("double") for m in ("da", "db", "dc")), F.col("cell"))
        known = known.withColumns({f"u{k}": F.col(k) + F.coalesce(v, F.lit(0.0)) for k, v in zip("xyz", moved, strict=True)})
        known = known.withColumns({a: F.when(F.col("cell").isNull() | F.col("infinite"), 0).otherwise(F.floor(f) + F.col(m)).cast("long") for a, f, m in zip(_IMAGE, fractional(vec(), F.col("cell")), ("da", "db", "dc"), strict=True)})
        bins = _bins(F.col("cell"), cutoff)
        known = scratch.staged(known.select("*", *[b.alias(c) for c, (b, _) in zip(_BINS, bins, strict=True)], *[n.alias(f"_n{i}") for i, (_, n) in enumerate(bins)]))
        sizes = known.groupBy("frame", "component").agg(F.count("*").alias("_size"))
        # of every bin the greatest molecule (or image of one) in and around it; atoms of smaller ones are compared with what is there
        label = known.select("frame", *_BINS, "_n0", "_n1", "_n2", "component", "infinite", *_IMAGE).distinct()
        for i in range(3):
            b, n, a = F.col(f"_b{i}"), F.col(f"_n{i}"), F.col(f"_a{i}")
            step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
            turn = F.when(n.isNull() | F.col("infinite"), 0).otherwise(F.floor((b + F.col("_s")) / n))
            label = label.select("*", step.alias("_s")).withColumns({f"_a{i}": (a + turn).cast("long"), f"_b{i}": F.when(n.isNull(), b + F.col("_s")).otherwise(F.pmod(b + F.col("_s"), n)).cast("int")}).drop("_s")
        rank = F.struct("_size", "component", *_IMAGE)
        top = label.join(sizes, ["frame", "component"]).groupBy("frame", *_BINS).agg(F.max(rank).alias("_top"))
        both = known.join(sizes, ["frame", "component"]).join(top, ["frame", *_BINS])
        kept = ("radius", "component", "infinite", "ux", "uy", "uz")
        left = scratch.staged(both.where(rank < F.col("_top")).select("frame", "atom_index", "x", "y", "z", "cell", *kept))
        pairs = neighbour_pairs(left, known.select("frame", "atom_index", "x", "y", "z", "cell", *kept), cutoff, keep=kept)
        apart = sub(vec("u", "_1"), vec("u", "_2"))
        other = (F.col("component_1") != F.col("component_2")) | (~F.col("infinite_1") & (dot(apart, apart) > (1.01 * cutoff) ** 2))
        bonded = F.sqrt("r2") <= F.col("radius_1") + F.col("radius_2") + settings.tolerance
        more = pairs.where(other & bonded).select("frame", F.least("atom_index_1", "atom_index_2").alias("i"), F.greatest("atom_index_1", "atom_index_2").alias("j"))
        return staged(thin.union(more).distinct())  # the steps it reads go with the scratch


def few_neighbours(atoms: DataFrame, settings: TopologySettings, most: int) -> DataFrame:
    """``frame, centre, end``: all bonds of every atom that has at most ``most`` of them, and of some others.

    Atoms with more than that in a clique are left out before any pair is made.
    """
    known = _bonding(atoms, settings)
    if known is None:
        bonds = detect_bonds(atoms, settings)
        return bonds.select("frame", F.col("i").alias("centre"), F.col("j").alias("end")).union(bonds.select("frame", "j", "i"))
    df, sure, cutoff = known
    placed = _cliques(df.select("frame", "atom_index", "x", "y", "z", "cell"), sure, _GRIDS).drop("x", "y", "z", "cell")
    crowded = placed.groupBy("frame", "_g", *_BOX).agg(F.count("*").alias("_n")).where(F.col("_n") > most + 1)
    many = placed.join(crowded, ["frame", "_g", *_BOX], "left_semi").select("frame", "atom_index").distinct()
    left = staged(df.join(many, ["frame", "atom_index"], "left_anti"))
    pairs = neighbour_pairs(left, df, cutoff, keep=("radius",))
    return pairs.where(F.sqrt("r2") <= F.col("radius_1") + F.col("radius_2") + settings.tolerance).select("frame", F.col("atom_index_1").alias("centre"), F.col("atom_index_2").alias("end"))
