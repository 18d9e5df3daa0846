"""Structures made from others: boxes filled with molecules, and crystal slabs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.elements import element_of, mass_of, radius_of
from framelake.functions.geometry import Cell, cartesian, fractional, nearest_image, sub, vec
from framelake.operators.aggregates import DENSITY
from framelake.runtime import shared_dir, staged, swept
from framelake.sources import trajectories

DOMAIN_COPIES = 256  #: copies that a domain of a box is asked for, about


def box_of(values: Sequence[float]) -> np.ndarray:
    """Edge vectors as rows, from one edge, three edges, or three edges and three angles in degrees."""
    v = [float(x) for x in values]
    if len(v) == 1:
        return np.diag(v * 3)
    if len(v) == 3:
        return np.diag(v)
    if len(v) == 6:
        return np.array(Cell.of_lengths(*v).vectors)
    raise ValueError("a box is one, three or six numbers")


def random_rotations(rng: np.random.Generator, n: int) -> np.ndarray:
    q = rng.normal(size=(n, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], -1), np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], -1), np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], -1)], 1)


class PlacedPoints:
    """Points in a grid of bins at least as wide as the cutoff, for clash tests in a periodic box."""

    def __init__(self, low: np.ndarray, box: np.ndarray, cutoff: float):
        self.low, self.box, self.inverse, self.cutoff = low, box, np.linalg.inv(box), cutoff
        heights = 1 / np.linalg.norm(self.inverse, axis=0)  # between opposite faces
        self.n = np.maximum(1, np.floor(heights / max(cutoff, 1e-9))).astype(int)
        self.bins: dict[tuple, list[np.ndarray]] = {}

    def _bin(self, p: np.ndarray) -> tuple:
        f = (p - self.low) @ self.inverse
        return tuple(np.minimum(((f - np.floor(f)) * self.n).astype(int), self.n - 1))

    def clash(self, points: np.ndarray) -> bool:
        for p in points:
            b = self._bin(p)
            for key in {tuple((b[i] + d[i]) % self.n[i] for i in range(3)) for d in np.ndindex(3, 3, 3) for d in [np.array(d) - 1]}:
                for q in self.bins.get(key, ()):
                    f = (p - q) @ self.inverse
                    d = (f - np.floor(f + 0.5)) @ self.box
                    if d @ d < self.cutoff * self.cutoff:
                        return True
        return False

    def add(self, points: np.ndarray) -> None:
        for p in points:
            self.bins.setdefault(self._bin(p), []).append(p)


def target_count(density: float, volume: float, molar_mass: float) -> int:
    """Molecules in a volume (cubic angstrom) at a density (g/cm3)."""
    return round(density * volume / (molar_mass * DENSITY))


class Domains:
    """A box cut into domains that copies of a template fill side by side.

    A domain is at least ``reach`` wide between its faces. Along an axis there are either one or
    an even number, so domains of one colour (the parities of their places) have a whole domain
    between them, and copies whose centres lie in them cannot clash.
    """

    def __init__(self, low: np.ndarray, box: np.ndarray, reach: float, wanted: int):
        self.low, self.inverse = low, np.linalg.inv(box)
        self.heights = 1 / np.linalg.norm(self.inverse, axis=0)
        edge = (abs(float(np.linalg.det(box))) / max(wanted, 1)) ** (1 / 3)
        n = np.floor(self.heights / max(reach, edge, 1e-9) + 1e-9).astype(int)
        self.n = [int(m - m % 2) if m >= 2 else 1 for m in n]
        self.count = math.prod(self.n)

    def place(self, domain: int) -> tuple[int, ...]:
        return tuple(int(i) for i in np.unravel_index(domain, self.n))

    def colour(self, domain: Column) -> Column:
        _, b, c = self.n
        return (F.floor(domain / (b * c)) % 2 * 4 + F.floor(domain / c) % b % 2 * 2 + domain % c % 2).cast("int")

    def near(self, points: DataFrame, within: float) -> DataFrame:
        """A row ``frame, domain, x, y, z`` for each domain that a point lies in or nearer to than ``within``, at most ``reach``."""
        out = points.select("frame", *"xyz", F.lit(0).cast("long").alias("domain"))
        for i, n in enumerate(self.n):
            if n == 1:
                continue
            f = sum(((F.col(k) - float(self.low[j])) * float(self.inverse[j, i]) for j, k in enumerate("xyz")), F.lit(0.0))
            out = out.withColumn("g", (f - F.floor(f)) * n).withColumn("at", F.least(F.floor("g"), F.lit(n - 1)))
            pad = within / float(self.heights[i]) * n + 1e-9
            before = F.when(F.col("g") - F.col("at") <= pad, F.array(F.pmod(F.col("at") - 1, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
            behind = F.when(F.col("at") + 1 - F.col("g") <= pad, F.array(F.pmod(F.col("at") + 1, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
            out = out.withColumn("axis", F.explode(F.array_distinct(F.concat(F.array("at"), before, behind))))
            out = out.withColumn("domain", F.col("domain") + F.col("axis") * math.prod(self.n[i + 1 :])).drop("g", "at", "axis")
        return out.select("frame", "domain", *"xyz")


def solvate(
    frames: DataFrame,
    template: Sequence[tuple[str, float, float, float]],
    box: Sequence[float],
    number: int | None = None,
    density: float | None = None,
    molar_mass: float | None = None,
    min_distance: float = 2.5,
    max_attempts: int = 200,
    seed: int = 42,
    around_existing: bool = False,
    origin: Sequence[float] = (0.0, 0.0, 0.0),
    domain_copies: int = DOMAIN_COPIES,
) -> DataFrame:
    """``frame, copy, site, element, x, y, z``: copies of a template put at random into each frame's box (with a corner at ``origin``).

    Exactly one of ``number`` and ``density`` (with ``molar_mass``) says how many. Atoms of different copies are at
    least ``min_distance`` apart, across the box's faces too; with ``around_existing`` they keep
    away from the frame's own atoms as well, of which ``frames`` then has ``x, y, z`` (rows without a place are in nobody's way).

    The box is cut into domains of about ``domain_copies`` copies, each asked for its share. Domains of one colour are
    filled side by side, each by a task that sees its own atoms and those within reach; the next colour
    sees what was placed. Domains that met their share are then asked for what others had no room for, until no copy is missing or
    none has room. A domain makes ``max_attempts`` attempts a copy, pooled over the copies asked of it. Random numbers
    depend on seed, domain and sweep only, so results do not depend on partitions and reruns agree. A
    frame without room has no rows. Repeated frames without own atoms count once; no frames give no rows.
    """
    if (number is None) == (density is None):
        raise ValueError("give either a number or a density")
    low, edges = np.array(origin, float), box_of(box)
    if number is None:
        if not molar_mass:
            raise ValueError("a density needs the molar mass")
        number = target_count(density, abs(float(np.linalg.det(edges))), molar_mass)
    spark = frames.sparkSession
    path = shared_dir(spark)
    with swept(spark):
        return staged(_filled(frames, template, low, edges, number, min_distance, max_attempts, seed, around_existing, domain_copies), path=path)


def _filled(frames: DataFrame, template: Sequence[tuple], low: np.ndarray, edges: np.ndarray, number: int, min_distance: float, max_attempts: int, seed: int, around_existing: bool, domain_copies: int) -> DataFrame:
    spark = frames.sparkSession
    shape = np.array([t[1:] for t in template], float)
    shape -= shape.mean(0)
    names = [t[0] for t in template]
    radius = float(np.linalg.norm(shape, axis=1).max())
    own = staged(frames.select("frame", *"xyz")) if around_existing else None
    crowd = own.groupBy("frame").count().agg(F.max("count")).first()[0] or 0 if around_existing else 0
    wanted = max(number, crowd // len(template)) // domain_copies
    domains = Domains(low, edges, 2 * radius + min_distance, wanted)
    n = np.array(domains.n)

    def fill(key: tuple, asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            domain, sweep, quota = int(key[1]), int(asked["sweep"].iloc[0]), int(asked["quota"].iloc[0])
            rng, placed, made = np.random.default_rng([seed, sweep, domain]), PlacedPoints(low, edges, min_distance), 0
            placed.add(points[["x", "y", "z"]].to_numpy(float))
            corner = np.array(domains.place(domain))
            for _ in range(quota * max_attempts):
                if made == quota:
                    break
                at = shape @ random_rotations(rng, 1)[0].T + low + (corner + rng.random(3)) / n @ edges
                if not placed.clash(at):
                    placed.add(at)
                    out += [(int(key[0]), domain, sweep, made, s, names[s], *map(float, x)) for s, x in enumerate(at)]
                    made += 1
        return pd.DataFrame(out, columns=["frame", "domain", "sweep", "k", "site", "element", "x", "y", "z"])

    schema = "frame long, domain long, sweep int, k long, site int, element string, x double, y double, z double"
    share = lambda i: F.floor(i * number / domains.count)
    every = frames.select("frame").distinct().withColumn("domain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(domains.count - 1).cast("long"))))
    asked = staged(every.select("frame", "domain", F.lit(0).alias("sweep"), (share(F.col("domain") + 1) - share(F.col("domain"))).alias("quota"), F.lit(number).cast("long").alias("missing")))
    standing = [own] if around_existing else []
    made, tallies = [], []
    by_domain = Window.partitionBy("frame").orderBy(F.xxhash64("domain"), "domain").rowsBetween(Window.unboundedPreceding, -1)  # a row a domain
    while True:
        here = []
        colours = asked.where("quota > 0").select(domains.colour(F.col("domain"))).distinct().collect()  # at most eight
        for colour in sorted(c[0] for c in colours):
            turn = domains.colour(F.col("domain")) == colour
            points = reduce(DataFrame.union, [x.select("frame", *"xyz") for x in standing + here], spark.createDataFrame([], "frame long, x double, y double, z double"))
            seen = domains.near(points.dropna(), radius + min_distance).where(turn)
            tasks = asked.where(turn & (F.col("quota") > 0)).groupBy("frame", "domain")
            here.append(staged(tasks.cogroup(seen.groupBy("frame", "domain")).applyInPandas(fill, schema)))
        now = reduce(DataFrame.union, here, spark.createDataFrame([], schema))
        got = now.where("site = 0").groupBy("frame", "domain").agg(F.count("*").alias("got"))
        tally = asked.join(got, ["frame", "domain"], "left").fillna(0, ["got"])
        # the last sweep may find more than is missing: domains in the order of a hash keep theirs
        left = F.col("missing") - F.coalesce(F.sum("got").over(by_domain), F.lit(0))
        tally = staged(tally.withColumn("take", F.greatest(F.lit(0), F.least("got", left))))
        tallies.append(tally.select("frame", "domain", "sweep", "take"))
        standing += here
        made += here
        whole = Window.partitionBy("frame")
        rest = tally.withColumn("missing", F.col("missing") - F.sum("take").over(whole)).where("missing > 0 and got = quota")
        quota = F.ceil(F.col("missing") / F.count("*").over(whole))
        asked = staged(rest.select("frame", "domain", (F.col("sweep") + 1).alias("sweep"), quota.alias("quota"), "missing"))
        if not asked.limit(1).count():
            break
    first = F.coalesce(F.sum("take").over(Window.partitionBy("frame").orderBy("sweep", "domain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = reduce(DataFrame.union, tallies).withColumn("first", first)
    kept = reduce(DataFrame.union, made, spark.createDataFrame([], schema)).join(numbered, ["frame", "domain", "sweep"]).where("k < take")
    return kept.select("frame", (F.col("first") + F.col("k")).cast("int").alias("copy"), "site", "element", *"xyz")


def surface_basis(cell: Cell, hkl: tuple[int, int, int]) -> tuple[np.ndarray, float]:
    """(three lattice vectors, the last one out of the plane; spacing of the planes).

    The first two span the plane (h k l) with the least area found among short lattice vectors.
    """
    if not any(hkl):
        raise ValueError("a plane needs one index other than 0")
    d = math.gcd(*map(abs, hkl))
    h, k, l = (v // d for v in hkl)  # noqa: E741
    lattice = np.array(cell.vectors)
    normal = np.array(cell.g).reshape(3, 3).T @ np.array([h, k, l], float)
    ints = [(i, j, m) for i in range(-6, 7) for j in range(-6, 7) for m in range(-6, 7) if (i, j, m) != (0, 0, 0)]
    flat = sorted((v for v in ints if v[0] * h + v[1] * k + v[2] * l == 0), key=lambda v: (round(float(np.linalg.norm(np.array(v) @ lattice)), 9), tuple(-x for x in v)))
    u = np.array(flat[0])
    w = next(np.array(v) for v in flat if np.linalg.norm(np.cross(u, v)) > 0 and math.gcd(*map(int, np.abs(np.cross(u, v)))) == 1)
    out = min((v for v in ints if v[0] * h + v[1] * k + v[2] * l == 1), key=lambda v: (round(float(np.linalg.norm(np.array(v) @ lattice)), 9), tuple(-x for x in v)))
    return np.array([u, w, out]) @ lattice, 1 / float(np.linalg.norm(normal))


def slab(atoms: DataFrame, cell: Cell, hkl: tuple[int, int, int], depth: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Atoms of the first frame as a slab parallel to (h k l), in its own basis.

    Columns of ``atoms`` with new positions, and ``fa, fb`` (within the plane's unit mesh, 0 to 1)
    and ``depth`` (in plane spacings, from 0 below ``depth``). ``shift`` moves the cut along the
    normal. The lattice is copied by a bounded range of translations and cut by fractional filters.
    """
    basis, _ = surface_basis(cell, hkl)
    made = Cell(tuple(basis.ravel()))
    corners = np.array(list(np.ndindex(2, 2, 2))) @ (basis * np.array([[1], [1], [depth + abs(shift) + 1]]))
    reach = np.abs(np.floor(corners @ np.linalg.inv(np.array(cell.vectors)))).max(0).astype(int) + 1
    first = atoms.where(F.col("frame") == F.lit(atoms.agg(F.min("frame")).first()[0])).drop("cell")
    df = first
    for i, r in enumerate(reach.tolist()):
        df = df.withColumn(f"_t{i}", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    old, new = cell.column(), made.column()
    inside = [x - F.floor(x + 1e-9) for x in fractional(vec(), old)]
    moved = cartesian(tuple(x + F.col(f"_t{i}") for i, x in enumerate(inside)), old)
    df = df.withColumns(dict(zip("xyz", moved, strict=True)))
    f = fractional(vec(), new)
    df = df.withColumns({"fa": f[0], "fb": f[1], "depth": f[2] - shift}).where(f"fa >= -1e-9 and fa < 1 - 1e-9 and fb >= -1e-9 and fb < 1 - 1e-9 and depth >= -1e-9 and depth < {depth} - 1e-9")
    return df.drop("_t0", "_t1", "_t2")


def slab_of_molecules(atoms: DataFrame, cell: Cell, hkl: tuple[int, int, int], depth: float = 1.0, shift: float = 0.0, whole: bool = False) -> DataFrame:
    """As ``slab``, of whole molecules: what lies inside is decided by the centroid of the atoms.

    ``whole``: the molecules of the first frame are whole already (``unwrap``); else each atom is taken at its
    image nearest to the first of its molecule, which is right for molecules up to half of the cell.
    """
    points = _whole_molecules(atoms, cell, whole)
    centres = slab(points.groupBy("frame", "mol_index").agg(*[F.avg(k).alias(k) for k in "xyz"]), cell, hkl, depth, shift)
    centres = centres.select("frame", "mol_index", *[F.col(k).alias(f"{k}_to") for k in "xyz"])
    each = points.join(points.groupBy("frame", "mol_index").agg(*[F.avg(k).alias(f"{k}_from") for k in "xyz"]), ["frame", "mol_index"])
    out = each.join(centres, ["frame", "mol_index"])
    out = out.withColumns({k: F.col(k) - F.col(f"{k}_from") + F.col(f"{k}_to") for k in "xyz"}).drop(*[f"{k}_{e}" for k in "xyz" for e in ("from", "to")])
    return out.withColumns(slab_coordinates(cell, hkl, shift))


def _whole_molecules(atoms: DataFrame, cell: Cell, whole: bool = False) -> DataFrame:
    """Atoms of the first frame, each at its image nearest to the first atom of its molecule unless they are ``whole``."""
    first = atoms.where(F.col("frame") == F.lit(atoms.agg(F.min("frame")).first()[0])).drop("cell")
    if whole:
        return first
    heads = first.groupBy("frame", "mol_index").agg(F.min_by(F.struct("x", "y", "z"), "atom_index").alias("_head"))
    both = first.join(heads, ["frame", "mol_index"])
    head = tuple(F.col(f"_head.{k}") for k in "xyz")
    near = nearest_image(sub(vec(), head), cell.column())
    return both.withColumns({k: h + d for k, h, d in zip("xyz", head, near, strict=True)}).drop("_head")


def slab_coordinates(cell: Cell, hkl: tuple[int, int, int], shift: float = 0.0) -> dict[str, Column]:
    """``fa, fb, depth`` of a position in the basis of a slab."""
    f = fractional(vec(), Cell(tuple(surface_basis(cell, hkl)[0].ravel())).column())
    return {"fa": f[0], "fb": f[1], "depth": f[2] - shift}


def stood_up(slab_atoms: DataFrame, cell: Cell, hkl: tuple[int, int, int], depth: float = 1.0, direction: Sequence[float] | None = None) -> DataFrame:
    """A slab turned so that its first edge is x (or ``direction``, in lattice vectors, as far as it lies in the plane) and its plane x, y; with its cell."""
    basis, _ = surface_basis(cell, hkl)
    a, b, c = (float(np.linalg.norm(v)) for v in basis)
    angle = lambda u, v: math.degrees(math.acos(float(u @ v) / float(np.linalg.norm(u) * np.linalg.norm(v))))
    made = Cell.of_lengths(a, b, c, angle(basis[1], basis[2]), angle(basis[0], basis[2]), angle(basis[0], basis[1]))
    moved = cartesian((F.col("fa"), F.col("fb"), F.col("depth")), made.column())
    out = slab_atoms.withColumns(dict(zip("xyz", moved, strict=True)))
    vectors = np.array(made.vectors)
    if direction is not None:
        along = np.array(direction, float) @ np.array(cell.vectors) @ np.linalg.inv(basis) @ vectors
        if np.hypot(along[0], along[1]) < 1e-9:
            raise ValueError("the direction is the normal of the plane")
        out = align_x(out, vectors, along)
    whole = Cell(tuple((vectors * np.array([[1], [1], [depth]])).ravel()))
    return out.withColumn("cell", whole.column())


def read_template(spark: SparkSession, path: str, most: int = 100_000) -> list[tuple[str, float, float, float]]:
    """(type, x, y, z) of the first frame of a file of one molecule; more than ``most`` atoms are an error."""
    atoms = trajectories.load(spark, [path])
    rows = atoms.where(F.col("frame") == 0).orderBy("atom_index").select("type", "x", "y", "z").limit(most + 1).collect()
    if not 0 < len(rows) <= most:
        raise ValueError(f"{path!r} has no template of 1 to {most} atoms")
    return [tuple(r) for r in rows]


def with_copies(atoms: DataFrame, template: Sequence[tuple[str, float, float, float]], box: Sequence[float], **options) -> DataFrame:
    """``atoms`` and, behind the last of each frame, the atoms of the copies that ``solvate`` puts there."""
    new = solvate(atoms.select("frame"), template, box, **options)
    ends = atoms.groupBy("frame").agg((F.max("atom_index") + 1).alias("_end"), *([F.first("cell").alias("cell")] if "cell" in atoms.columns else []))
    place = (F.col("_end") + F.col("copy") * len(template) + F.col("site")).cast("long")
    element = element_of(F.col("type"))
    made = new.withColumnRenamed("element", "type").join(ends, "frame").withColumns({"atom_index": place, "name": F.col("type"), "element": element, "mass": mass_of(element), "radius": radius_of(element)})
    return atoms.unionByName(made.select(*[c for c in made.columns if c in atoms.columns]), allowMissingColumns=True)


def possible_cuts(atoms: DataFrame, cell: Cell, hkl: tuple[int, int, int], gap: float = 0.1, molecules: bool = False, whole: bool = False) -> list[float]:
    """Shifts (in plane spacings) in the middle of every gap between atomic layers of one spacing.

    Layers are gathered as the least and greatest depth of bins no wider than half a gap, so a gap
    lies between bins and at most ``2 * spacing / gap + 1`` of them come to the driver, exactly.
    """
    if gap <= 0:
        raise ValueError("a gap is wider than 0")
    _, spacing = surface_basis(cell, hkl)
    bins = math.ceil(2 * spacing / gap)
    if molecules:  # a cut between molecules: their centroids are the layers
        atoms = _whole_molecules(atoms, cell, whole).groupBy("frame", "mol_index").agg(*[F.avg(k).alias(k) for k in "xyz"])
    rows = slab(atoms, cell, hkl).select(F.round(F.pmod("depth", F.lit(1.0)), 6).alias("d"))
    layers = sorted((r[1], r[2]) for r in rows.groupBy(F.floor(F.col("d") * bins)).agg(F.min("d"), F.max("d")).collect())
    ends = [low for low, _ in layers[1:]] + [layers[0][0] + 1.0] if layers else []
    return [(a + b) / 2 % 1.0 for (_, a), b in zip(layers, ends, strict=True) if (b - a) * spacing >= gap]


def align_x(atoms: DataFrame, basis: np.ndarray, direction: np.ndarray) -> DataFrame:
    """Rotate about the normal of the first two basis vectors until ``direction`` points along the first."""
    normal = np.cross(basis[0], basis[1])
    n = normal / np.linalg.norm(normal)
    d = direction - (direction @ n) * n
    angle = math.atan2(float(np.cross(d, basis[0]) @ n), float(d @ basis[0]))
    k = np.array([[0, -n[2], n[1]], [n[2], 0, -n[0]], [-n[1], n[0], 0]])
    m = np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k
    return atoms.withColumns({c: sum((F.col(p) * float(m[i, j]) for j, p in enumerate("xyz") if j), F.col("x") * float(m[i, 0])) for i, c in enumerate("xyz")})
