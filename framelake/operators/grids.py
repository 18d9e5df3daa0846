"""Charges and dipoles on grids, electrostatic potentials, and averages of grids along axes.

Grids are long: ``ia, ib, ic`` and a value. Spreading and averaging are DataFrame expressions; only
the Fourier transform works on a cell's dense mesh or on slabs of it (``spectral``), inside a grouped
function whose input is already summed to grid points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import cartesian, dot, fractional, nearest_image, sub, vec
from framelake.operators import spectral

KE = 14.3996  #: volt angstrom per elementary charge


def b_spline(order: int, u: Column) -> Column:
    """Cardinal B-spline of an order at ``u``; zero outside (0, order).

    The truncated power form is a plain sum, so it compiles as well as a product would.
    """
    terms = [(-1) ** k * math.comb(order, k) * F.pow(F.greatest(u - k, F.lit(0.0)), F.lit(float(order - 1))) for k in range(order + 1)] if order > 1 else []
    if order == 1:
        return F.when((u >= 0) & (u < 1), 1.0).otherwise(0.0)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when((u > 0) & (u < order), total / math.factorial(order - 1)).otherwise(0.0)


def b_spline_np(order: int, u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, float)
    if order == 1:
        return ((u >= 0) & (u < 1)).astype(float)
    return (u * b_spline_np(order - 1, u) + (order - u) * b_spline_np(order - 1, u - 1)) / (order - 1)


def smooth_size(length: float, spacing: float) -> int:
    """The least number with no prime factor above 5 that resolves ``length`` at ``spacing``."""
    n = max(1, math.ceil(length / spacing))
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def spread(points: DataFrame, values: dict[str, Column], shape: tuple[int, int, int], order: int, keys: tuple[str, ...] = ("frame",), centred: bool = False) -> DataFrame:
    """``keys, ia, ib, ic`` and the sums of ``values`` spread to ``order`` grid points per axis by B-splines.

    Points have ``cell``; ``centred`` shifts the mesh by half of its size, as for potentials. Rows of
    a point are summed where they are made, before the shuffle.
    """
    if order < 1:
        raise ValueError("the order is 1 or more")
    f = fractional(vec(), F.col("cell"))
    df = points.where("cell is not null").select(*keys, *[v.alias(n) for n, v in values.items()], *[((x - F.floor(x)) * n + ((n - 1) / 2 if centred else 0.0)).alias(f"_w{i}") for i, (x, n) in enumerate(zip(f, shape, strict=True))])
    for i, (name, n) in enumerate(zip(("ia", "ib", "ic"), shape, strict=True)):
        w = F.col(f"_w{i}")
        options = F.array(*[F.struct(F.pmod(F.floor(w) - k, F.lit(n)).cast("int").alias("at"), b_spline(order, w - F.floor(w) + k).alias("m")) for k in range(order)])
        df = df.withColumn(f"_o{i}", F.explode(options)).withColumns({name: F.col(f"_o{i}.at"), f"_m{i}": F.col(f"_o{i}.m")})
    weight = F.col("_m0") * F.col("_m1") * F.col("_m2")
    return df.where(weight != 0).groupBy(*keys, "ia", "ib", "ic").agg(*[F.sum(F.col(n) * weight).alias(n) for n in values])


def molecular_dipoles(atoms: DataFrame) -> DataFrame:
    """``frame, mol_index, mol_type, x, y, z, mx, my, mz (, cell)``: sums of charge times distance from the centre of mass."""
    centre = {k: F.sum(F.col("mass") * F.col(k)) / F.sum("mass") for k in "xyz"}
    sums = [(F.sum(F.col("charge") * F.col(k)) - F.sum("charge") * centre[k]).alias(f"m{k}") for k in "xyz"]
    return atoms.groupBy("frame", "mol_index", "mol_type").agg(*[c.alias(k) for k, c in centre.items()], *sums, F.first("cell").alias("cell"))


def polarisation_grid(molecules: DataFrame, shape: tuple[int, int, int], order: int = 4, frames: int | None = None) -> DataFrame:
    """``ia, ib, ic, mx, my, mz, magnitude``: time mean of spread dipoles; magnitude of the mean."""
    n = frames or molecules.select("frame").distinct().count()
    if not n:
        raise ValueError("there are no frames")
    total = spread(molecules, {f"m{k}": F.col(f"m{k}") for k in "xyz"}, shape, order, keys=())
    means = total.withColumns({f"m{k}": F.col(f"m{k}") / n for k in "xyz"})
    return means.withColumn("magnitude", F.sqrt(dot(vec("m"), vec("m"))))


def _spline_factor(order: int, n: int) -> np.ndarray:
    """Of each wave number of an axis, what takes the spreading by splines back; zero where splines cannot see it."""
    j = np.arange(order - 1)
    s = (b_spline_np(order, j + 1)[None] * np.exp(2j * np.pi * np.arange(n)[:, None] * j[None] / n)).sum(1)
    size = np.abs(s) ** 2
    return np.where(size < 1e-20, 0.0, 1 / np.where(size < 1e-20, 1.0, size))


def _greens_function(h: np.ndarray, shape: tuple[int, int, int], beta: float, order: int, places: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Factors of the wave numbers at ``places`` along the axes (all of them where none are given)."""
    volume = abs(np.linalg.det(h))
    g = np.linalg.inv(h).T  # rows: reciprocal vectors without 2 pi, for lattice vectors in the rows of h
    places = places or tuple(np.arange(n) for n in shape)
    m = [np.fft.fftfreq(n, 1 / n)[p] for n, p in zip(shape, places, strict=True)]
    k = 2 * np.pi * (m[0][:, None, None, None] * g[0] + m[1][None, :, None, None] * g[1] + m[2][None, None, :, None] * g[2])
    k2 = (k**2).sum(-1)
    none = k2 == 0
    out = 4 * np.pi * KE / volume * np.exp(-k2 / (4 * beta**2)) / np.where(none, 1.0, k2)
    for axis, n in enumerate(shape):
        out *= _spline_factor(order, n)[places[axis]].reshape([-1 if a == axis else 1 for a in range(3)])
    return np.where(none, 0.0, out)


DENSE = 1 << 21  #: points of a mesh up to which a task transforms it whole (about 100 MB)


def pme_potential(atoms: DataFrame, shape: tuple[int, int, int], beta: float = 0.25, order: int = 4, dense: int = DENSE) -> DataFrame:
    """``ia, ib, ic, value``: mean smooth electrostatic potential in volts over the frames.

    Charges are spread by DataFrame expressions and summed over all frames of one cell, as the
    transform of a sum is the sum of the transforms; so there is a mesh for each distinct cell. A mesh of
    up to ``dense`` points is transformed in a task; a larger one by pencils, in which a task holds slabs.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    n_frames = atoms.select("frame").distinct().count()
    if atoms.where("cell is null").limit(1).count() or not n_frames:
        raise ValueError("every frame needs a cell")
    key = F.array_join(F.transform("cell.h", lambda v: v.cast("string")), ",")
    charges = spread(atoms.where("charge <> 0").withColumn("key", key), {"value": F.col("charge")}, shape, order, keys=("key",), centred=True)
    size = shape[0] * shape[1] * shape[2]

    def cell_of(name: str) -> np.ndarray:
        return np.array([float(v) for v in name.split(",")]).reshape(3, 3)

    def transform(group: pd.DataFrame) -> pd.DataFrame:
        green = _greens_function(cell_of(group["key"].iloc[0]), shape, beta, order)
        mesh = np.zeros(shape)
        mesh[group["ia"], group["ib"], group["ic"]] = group["value"]
        value = np.fft.ifftn(np.fft.fftn(mesh) * green).real
        ia, ib, ic = (x.ravel() for x in np.indices(shape))
        return pd.DataFrame({"ia": ia, "ib": ib, "ic": ic, "value": value.ravel()})

    def factors(name: str, ka: np.ndarray, kb: int, kc: np.ndarray) -> np.ndarray:
        return _greens_function(cell_of(name), shape, beta, order, (ka, np.array([kb]), kc))[:, 0]

    if size <= dense:
        each = charges.groupBy("key").applyInPandas(transform, "ia int, ib int, ic int, value double")
    else:
        each = spectral.convolve(charges, shape, factors)
    return each.groupBy("ia", "ib", "ic").agg((F.sum("value") * (size / n_frames)).alias("value"))


def grid_points(spark, shape: tuple[int, int, int]) -> DataFrame:
    n = shape[0] * shape[1] * shape[2]
    return spark.range(n).select(*[F.expr(e).cast("int").alias(c) for c, e in (("ia", f"id div {shape[1] * shape[2]}"), ("ib", f"id div {shape[2]} % {shape[1]}"), ("ic", f"id % {shape[2]}"))])


def realspace_potential(atoms: DataFrame, shape: tuple[int, int, int], cutoff: float = 10.0) -> DataFrame:
    """``ia, ib, ic, value``: mean over frames of ``ke q / r`` summed over charges within the cutoff.

    Each charge makes rows for the grid points of its own box only: fractional offsets up to the
    cutoff over the cell's widths, each grid point once.
    """
    n_frames = atoms.select("frame").distinct().count()
    cell = F.col("cell")
    f = fractional(vec(), cell)
    df = atoms.where("charge <> 0 and cell is not null").withColumns({f"_f{i}": x - F.floor(x) for i, x in enumerate(f)})
    g = F.col("cell.g")
    for i, (name, n) in enumerate(zip(("ia", "ib", "ic"), shape, strict=True)):
        reach = F.ceil(cutoff * F.sqrt(sum((g[3 * i + k] * g[3 * i + k] for k in range(1, 3)), g[3 * i] * g[3 * i])) * n).cast("int") + 1
        near = F.round(F.col(f"_f{i}") * n).cast("int")
        every = F.sequence(F.lit(0), F.lit(n - 1))
        df = df.withColumn(name, F.explode(F.when(2 * reach + 1 >= n, every).otherwise(F.transform(F.sequence(near - reach, near + reach), lambda x: F.pmod(x, F.lit(n))))))
    point = cartesian(tuple(F.col(c) / n for c, n in zip(("ia", "ib", "ic"), shape, strict=True)), cell)
    d = nearest_image(sub(point, vec()), cell)
    r2 = dot(d, d)
    hit = df.withColumn("_r2", r2).where((F.col("_r2") <= cutoff * cutoff) & (F.col("_r2") >= 1e-10))
    summed = hit.groupBy("ia", "ib", "ic").agg((F.sum(KE * F.col("charge") / F.sqrt("_r2")) / n_frames).alias("value"))
    return grid_points(atoms.sparkSession, shape).join(summed, ["ia", "ib", "ic"], "left").fillna(0.0, ["value"])


def gridspread_potential(atoms: DataFrame, shape: tuple[int, int, int], order: int = 4, radius: int = 2) -> DataFrame:
    """``ia, ib, ic, value``: spread charges, then each point's sum of ``ke Q / distance`` over its stencil.

    The stencil reaches ``radius`` points along every axis without the centre. Charges are summed over
    the frames of each distinct cell, and distances are those of that cell; frames without one count
    as empty.
    """
    n_frames = atoms.select("frame").distinct().count()
    h = F.transform("cell.h", lambda v: F.round(v, 12))
    periodic = atoms.where("charge <> 0 and cell is not null").withColumn("_h", F.array_join(h, " "))
    total = spread(periodic, {"q": F.col("charge")}, shape, order, keys=("_h",))
    cells = periodic.groupBy("_h").agg(F.min("cell").alias("cell"))
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("da", "db", "dc"), (i, j, k), strict=True)]) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) for k in range(-radius, radius + 1) if (i, j, k) != (0, 0, 0)])
    rows = total.join(cells, "_h").withColumn("_o", F.explode(offsets))
    step = tuple(F.col(f"_o.{c}") / n for c, n in zip(("da", "db", "dc"), shape, strict=True))
    d = cartesian(step, F.col("cell"))
    to = [F.pmod(F.col(c) + F.col(f"_o.d{c[1]}"), F.lit(n)).cast("int").alias(c) for c, n in zip(("ia", "ib", "ic"), shape, strict=True)]
    moved = rows.select(*to, (KE * F.col("q") / F.sqrt(dot(d, d)) / n_frames).alias("value"))
    return moved.groupBy("ia", "ib", "ic").agg(F.sum("value").alias("value"))


def average(grid: DataFrame, axes: str, value: str = "value") -> DataFrame:
    """Mean over one or two of the axes a, b, c; the others stay."""
    over = set(axes)
    if not over or not over < set("abc"):
        raise ValueError(f"{axes!r} is no choice of one or two of a, b, c")
    return grid.groupBy(*[f"i{a}" for a in "abc" if a not in over]).agg(F.avg(value).alias(value))


@dataclass(frozen=True)
class GridHeader:
    """Counts, origin and step vectors of a grid."""

    counts: tuple[int, int, int]
    origin: tuple[float, float, float]
    steps: tuple[tuple[float, float, float], ...]

    @property
    def orthogonal(self) -> bool:
        return all(abs(self.steps[i][k]) < 1e-9 for i in range(3) for k in range(3) if i != k)


def average_cartesian(grid: DataFrame, header: GridHeader, axes: str, value: str = "value") -> DataFrame:
    """Mean over one or two of x, y, z; bins of the finest step of each remaining axis, empty ones 0.

    Result columns are ``<axis>_bin, <axis>`` for every axis that stays, and the value.
    """
    over = set(axes)
    if not over or not over < set("xyz"):
        raise ValueError(f"{axes!r} is no choice of one or two of x, y, z")
    names = ("ia", "ib", "ic")
    keep = [k for k in "xyz" if k not in over]
    df, spans = grid, {}
    for k in keep:
        i = "xyz".index(k)
        at = F.lit(header.origin[i])
        low = high = header.origin[i]
        for name, step, n in zip(names, header.steps, header.counts, strict=True):
            at = at + F.col(name) * step[i]
            low, high = low + min(0.0, step[i] * (n - 1)), high + max(0.0, step[i] * (n - 1))
        width = min(abs(s[i]) for s in header.steps if abs(s[i]) > 1e-12)
        spans[k] = low, width, int(math.floor((high - low) / width + 0.5)) + 1
        df = df.withColumn(f"{k}_bin", F.floor((at - low) / width + 0.5).cast("int"))
    bins = [f"{k}_bin" for k in keep]
    means = df.groupBy(*bins).agg(F.avg(value).alias(value))
    total = math.prod(s[2] for s in spans.values())
    every = grid.sparkSession.range(total)
    rest = total
    for k in keep:
        rest //= spans[k][2]
        every = every.withColumn(f"{k}_bin", F.expr(f"id div {rest} % {spans[k][2]}").cast("int"))
    out = every.drop("id").join(means, bins, "left").fillna(0.0, [value])
    return out.withColumns({k: F.lit(spans[k][0]) + F.col(f"{k}_bin") * spans[k][1] for k in keep})


def reduce_axes(grid: DataFrame, header: GridHeader, axes: str, value: str = "value") -> DataFrame:
    """``average`` for axes of a, b, c, ``average_cartesian`` for x, y, z; of an orthogonal grid both are the former."""
    if set(axes) <= set("abc"):
        return average(grid, axes, value)
    if header.orthogonal:
        return average(grid, axes.translate(str.maketrans("xyz", "abc")), value)
    return average_cartesian(grid, header, axes, value)


def ewald_reciprocal(atoms: DataFrame, beta: float, most: int) -> DataFrame:
    """``frame, energy``: reciprocal-space energy (e**2 per angstrom) over wave vectors with indices up to ``most``.

    Every atom meets a fixed list of wave vectors; structure factors are summed before the shuffle.
    """
    ms = [(i, j, k) for i in range(-most, most + 1) for j in range(-most, most + 1) for k in range(-most, most + 1) if (i, j, k) != (0, 0, 0)]
    waves = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("hkl", m, strict=True)]) for m in ms])
    f = fractional(vec(), F.col("cell"))
    rows = atoms.where("charge <> 0").select("frame", "charge", "cell", *[x.alias(f"_f{i}") for i, x in enumerate(f)], F.explode(waves).alias("m"))
    phase = 2 * math.pi * (F.col("m.h") * F.col("_f0") + F.col("m.k") * F.col("_f1") + F.col("m.l") * F.col("_f2"))
    sums = rows.groupBy("frame", "m").agg(F.sum(F.col("charge") * F.cos(phase)).alias("re"), F.sum(F.col("charge") * F.sin(phase)).alias("im"), F.first("cell").alias("cell"))
    g = F.col("cell.g")
    k = tuple(2 * math.pi * (F.col("m.h") * g[i] + F.col("m.k") * g[3 + i] + F.col("m.l") * g[6 + i]) for i in range(3))
    k2 = dot(k, k)
    term = 2 * math.pi / F.col("cell.volume") * F.exp(-k2 / (4 * beta * beta)) / k2 * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return sums.groupBy("frame").agg(F.sum(term).alias("energy"))
