"""Fourier transforms of meshes that no task holds, and the whole Ewald sum.

A mesh is transformed axis by axis (pencils). Its dense form is rows of ``LINE`` neighbouring values along c:
the rows of all points of one axis meet in a group, a slab as long as that axis and ``LINE`` wide, which is
transformed along the axis and cut into rows for the next one. So a group's size grows with an edge of the
mesh, not with the mesh, and between two axes there is one shuffle (the transpose).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import dot, fractional, vec
from framelake.operators.pairs import neighbour_pairs

LINE = 64  #: values along c that stay together
_ROW = "key string, ia int, ib int, block int, line binary"


def _rows(key, ia, ib, block, values: np.ndarray) -> pd.DataFrame:
    """Rows of a stack of lines."""
    lines = np.ascontiguousarray(values, np.complex128)
    return pd.DataFrame({"key": key, "ia": np.asarray(ia, np.int32), "ib": np.asarray(ib, np.int32), "block": np.int32(block), "line": [x.tobytes() for x in lines]})


def _lines(group: pd.DataFrame) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.complex128) for x in group["line"]])


def _slab(group: pd.DataFrame, place: str, n: int) -> np.ndarray:
    """The lines of a group at their places along an axis; missing ones are zero."""
    found = _lines(group)
    out = np.zeros((n, found.shape[1]), np.complex128)
    out[group[place].to_numpy()] = found
    return out


def convolve(mesh: DataFrame, shape: tuple[int, int, int], multiplier: Callable[[str, np.ndarray, int, np.ndarray], np.ndarray], line: int = LINE) -> DataFrame:
    """``key, ia, ib, ic, value``: the inverse transform of the mesh's transform times ``multiplier``, real part.

    ``mesh`` has ``key`` (text), ``ia, ib, ic`` and ``value``, each point at most once; missing points are
    zero. ``multiplier(key, ka, kb, kc)`` gives the factors of the wave numbers ka (all of them, as rows)
    and kc (a stretch, as columns) for one kb. Both transforms are three one-axis transforms, the first and
    the last within a line's own pencil.
    """
    na, nb, nc = shape
    blocks = [(b, np.arange(b * line, min(nc, (b + 1) * line))) for b in range(-(-nc // line))]

    def along_c(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            pencils = np.zeros((len(batch), nc), np.complex128)
            for i, (at, values) in enumerate(zip(batch["at"], batch["value"], strict=True)):
                pencils[i, np.asarray(at)] = values
            waves = np.fft.fft(pencils, axis=1)
            for b, kc in blocks:
                yield _rows(batch["key"].to_numpy(), batch["ia"], batch["ib"], b, waves[:, kc])

    def along_b(inverse: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            slab = (np.fft.ifft if inverse else np.fft.fft)(_slab(group, "ib", nb), axis=0)
            first = group.iloc[0]
            return _rows(first["key"], np.full(nb, first["ia"]), np.arange(nb), int(first["block"]), slab)

        return run

    def along_a(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        key, kb, block = first["key"], int(first["ib"]), int(first["block"])
        waves = np.fft.fft(_slab(group, "ia", na), axis=0) * multiplier(key, np.arange(na), kb, blocks[block][1])
        return _rows(key, np.arange(na), np.full(na, kb), block, np.fft.ifft(waves, axis=0))

    def back_along_c(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["ib", "block"])
        rows = g["ib"].unique()
        stretches = [np.frombuffer(x, np.complex128) for x in g["line"]]
        pencils = np.concatenate(stretches).reshape(len(rows), nc)
        value = np.fft.ifft(pencils, axis=1).real
        first = g.iloc[0]
        return pd.DataFrame({"key": first["key"], "ia": np.int32(first["ia"]), "ib": np.repeat(rows.astype(np.int32), nc), "ic": np.tile(np.arange(nc, dtype=np.int32), len(rows)), "value": value.ravel()})

    pencils = mesh.groupBy("key", "ia", "ib").agg(F.collect_list(F.struct("ic", "value")).alias("points"))
    rows = pencils.select("key", "ia", "ib", F.col("points.ic").alias("at"), F.col("points.value").alias("value")).mapInPandas(along_c, _ROW)
    rows = rows.groupBy("key", "ia", "block").applyInPandas(along_b(False), _ROW)
    rows = rows.groupBy("key", "ib", "block").applyInPandas(along_a, _ROW)
    rows = rows.groupBy("key", "ia", "block").applyInPandas(along_b(True), _ROW)
    return rows.groupBy("key", "ia", F.expr(f"ib div {line}").alias("some")).applyInPandas(back_along_c, "key string, ia int, ib int, ic int, value double")


# --- Ewald sum ------------------------------------------------------------------------------------

# Published rational approximations of the error function on three intervals (W. J. Cody, 1969): fixed values.
_ERF_TOP = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_BOTTOM = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_MID_TOP = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_MID_BOTTOM = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_FAR_TOP = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_FAR_BOTTOM = (1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def erfc(x: Column) -> Column:
    """Complementary error function of a column of numbers from 0 on, to double precision."""
    near = 1.0 - x * _polynomial(x * x, _ERF_TOP) / _polynomial(x * x, _ERF_BOTTOM)
    middle = F.exp(-x * x) * _polynomial(x, _MID_TOP) / _polynomial(x, _MID_BOTTOM)
    y = 1.0 / (x * x)
    far = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - y * _polynomial(y, _FAR_TOP) / _polynomial(y, _FAR_BOTTOM))
    return F.when(x < 0.46875, near).when(x <= 4.0, middle).otherwise(far)


def structure_factors(atoms: DataFrame, largest: float) -> DataFrame:
    """``frame, h, k, l, k2, volume, re, im``: sums of charges times phases, for wave vectors up to a length.

    Of two opposite wave vectors one is taken. Indices along a lattice vector reach no farther than the
    length allows, so cells of any shape have all of theirs; sums are combined before the shuffle.
    """
    f, g = fractional(vec(), F.col("cell")), F.col("cell.g")
    rows = atoms.where("charge <> 0").select("frame", "charge", "cell", *[x.alias(f"_f{i}") for i, x in enumerate(f)])
    for name, edge in zip("hkl", "abc", strict=True):
        most = F.floor(F.lit(largest / (2 * math.pi)) * F.col(f"cell.{edge}") + 1e-9).cast("int")
        rows = rows.withColumn(name, F.explode(F.sequence(-most if name != "h" else F.lit(0), most)))
    half = (F.col("h") > 0) | ((F.col("h") == 0) & (F.col("k") > 0)) | ((F.col("h") == 0) & (F.col("k") == 0) & (F.col("l") > 0))
    wave = tuple(2 * math.pi * (F.col("h") * g[i] + F.col("k") * g[3 + i] + F.col("l") * g[6 + i]) for i in range(3))
    rows = rows.where(half).withColumn("k2", dot(wave, wave)).where(F.col("k2") <= largest * largest)
    phase = 2 * math.pi * (F.col("h") * F.col("_f0") + F.col("k") * F.col("_f1") + F.col("l") * F.col("_f2"))
    return rows.groupBy("frame", "h", "k", "l").agg(F.first("k2").alias("k2"), F.first("cell.volume").alias("volume"), F.sum(F.col("charge") * F.cos(phase)).alias("re"), F.sum(F.col("charge") * F.sin(phase)).alias("im"))



def ewald_sum(atoms: DataFrame, beta: float, cutoff: float, tolerance: float = 1e-8) -> DataFrame:
    """``frame, real, reciprocal, self, background, energy``: electrostatic energy of each frame in e**2 per angstrom.

    The real part is over nearest images within the cutoff, the reciprocal part over all wave vectors whose
    factor exp(-k**2 / 4 beta**2) is at least ``tolerance``; a cell that is not neutral has a uniform
    background. The energy then does not depend on beta, as long as erfc(beta * cutoff) is as small.
    Each term is a sum that is combined before its shuffle. Atoms at one place have an infinite energy.
    A cutoff beyond half of a cell's least width is an error, as is a frame without a cell, and a beta
    or a cutoff that is not positive; frames without charges have zeros.
    """
    if beta <= 0 or cutoff <= 0 or not 0 < tolerance < 1:
        raise ValueError("beta and cutoff are positive, the tolerance is between 0 and 1")
    g = F.col("cell.g")
    widest = F.greatest(*[F.sqrt(g[3 * i] * g[3 * i] + g[3 * i + 1] * g[3 * i + 1] + g[3 * i + 2] * g[3 * i + 2]) for i in range(3)])
    cells = atoms.groupBy("frame").agg(F.max(F.coalesce(widest, F.lit(float("inf")))).alias("widest")).agg(F.max("widest")).first()[0]
    if cells is not None and 2 * cutoff * cells > 1 + 1e-9:
        raise ValueError("every frame needs a cell at least twice as wide as the cutoff")
    charged = atoms.where("charge <> 0").select("frame", "atom_index", "charge", "x", "y", "z", "cell")
    pairs = neighbour_pairs(charged, None, cutoff, keep=("charge",))
    r = F.sqrt("r2")
    bond = F.when(F.col("r2") > 0, F.col("charge_1") * F.col("charge_2") * erfc(beta * r) / r).otherwise(F.lit(float("inf")))
    real = pairs.groupBy("frame").agg(F.sum(bond).alias("real"))
    largest = 2 * beta * math.sqrt(-math.log(tolerance))
    waves = structure_factors(charged, largest)
    term = 4 * math.pi / F.col("volume") * F.exp(-F.col("k2") / (4 * beta * beta)) / F.col("k2") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    reciprocal = waves.groupBy("frame").agg(F.sum(term).alias("reciprocal"))
    own = (-beta / math.sqrt(math.pi) * F.sum(F.col("charge") * F.col("charge"))).alias("self")
    total = F.sum("charge")
    background = (-math.pi / (2 * beta * beta) * total * total / F.first("cell.volume")).alias("background")
    base = atoms.groupBy("frame").agg(own, background)
    out = base.join(real, "frame", "left").join(reciprocal, "frame", "left").fillna(0.0, ["real", "reciprocal", "self", "background"])
    return out.select("frame", "real", "reciprocal", "self", "background", (F.col("real") + F.col("reciprocal") + F.col("self") + F.col("background")).alias("energy"))
