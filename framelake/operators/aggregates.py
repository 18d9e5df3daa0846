"""Histograms, averages and reports over frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geometry import dot, norm, vec
from framelake.operators.pairs import neighbour_pairs

DEBYE = 4.80320  #: of one elementary charge times one angstrom
DENSITY = 1.6605388  #: g/cm3 of one dalton per cubic angstrom
MOLAR = 1660.5388  #: mol/l of one per cubic angstrom


def rdf(first: DataFrame, second: DataFrame, cutoff: float = 6.0, bins: int = 100, volume: Column | None = None) -> DataFrame:
    """``bin, r, gofr, nofr``: radial distribution of ``second`` around ``first``, mean over frames.

    Both have ``frame, kind, id, x, y, z`` (and ``cell``). Pairs nearer than the cutoff fall into
    bins of equal width; a bin is divided by its shell volume and by the number of pairs per volume
    of its frame (volume 1 without a cell). Empty bins are 0. No frames: an error.
    """
    spark = first.sparkSession
    width = cutoff / bins
    cell_volume = (F.col("cell.volume") if "cell" in first.columns else F.lit(1.0)) if volume is None else volume
    frames = first.groupBy("frame").agg(F.count("*").alias("n1"), F.coalesce(F.first(cell_volume), F.lit(1.0)).alias("volume"))
    frames = frames.join(second.groupBy("frame").agg(F.count("*").alias("n2")), "frame")
    n_frames = frames.count()
    if not n_frames:
        raise ValueError("there are no frames")
    pairs = neighbour_pairs(first, second, cutoff, ident=("kind", "id")).where(F.col("r2") < cutoff * cutoff)
    counts = pairs.groupBy("frame", F.floor(F.sqrt("r2") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    r = (F.col("bin") + 0.5) * width
    shell = 4 * math.pi / 3 * (F.pow(r + width / 2, F.lit(3.0)) - F.pow(r - width / 2, F.lit(3.0)))
    each = F.col("n") / shell / (F.col("n1") * F.col("n2") / F.col("volume"))
    means = counts.join(frames, "frame").groupBy("bin").agg((F.sum(each) / n_frames).alias("gofr"), (F.sum("n") / n_frames).alias("nofr"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(means, "bin", "left").select("bin", r.alias("r"), F.coalesce("gofr", F.lit(0.0)).alias("gofr"), F.coalesce("nofr", F.lit(0.0)).alias("nofr"))


def cell_means(frames: DataFrame) -> DataFrame:
    """Mean cell parameters over the frames that have a cell."""
    return frames.where("cell is not null").agg(*[F.avg(f"cell.{k}").alias(k) for k in ("a", "b", "c", "alpha", "beta", "gamma", "volume")], F.count("*").alias("frames"))


def cell_geometry(cells: DataFrame) -> DataFrame:
    """Surface area, lattice and reciprocal vectors and kind of each frame's cell."""
    c = lambda k: F.col(f"cell.{k}")
    sine = lambda k: F.sin(F.radians(c(k)))
    area = 2 * (c("b") * c("c") * sine("alpha") + c("a") * c("c") * sine("beta") + c("a") * c("b") * sine("gamma"))
    right = lambda k: F.abs(c(k) - 90) < 1e-6
    same = lambda p, q: F.abs(c(p) - c(q)) < 1e-6
    square = right("alpha") & right("beta") & right("gamma")
    kind = (
        F.when(square & same("a", "b") & same("b", "c"), "cubic")
        .when(square & same("a", "b"), "tetragonal")
        .when(square, "orthorhombic")
        .when(right("alpha") & right("beta") & (F.abs(c("gamma") - 120) < 1e-6) & same("a", "b"), "hexagonal")
        .when(same("a", "b") & same("b", "c") & same("alpha", "beta") & same("beta", "gamma"), "rhombohedral")
        .when(right("alpha") & right("gamma"), "monoclinic")
        .otherwise("triclinic")
    )
    return cells.select("frame", area.alias("surface_area"), c("h").alias("direct"), c("g").alias("reciprocal"), kind.alias("cell_type"))


def composition(atoms: DataFrame) -> DataFrame:
    """``type, n, element, mass`` on the first frame; an element per type is that of its last atom."""
    first = atoms.where(F.col("frame") == F.lit(atoms.agg(F.min("frame")).first()[0]))
    element = [F.max_by("element", "atom_index").alias("element")] if "element" in atoms.columns else []
    return first.groupBy("type").agg(F.count("*").alias("n"), *element, F.sum("mass").alias("mass"))


def densities(atoms: DataFrame) -> DataFrame:
    """``frame, n, mass, mass_density, number_density``; no cell, no densities."""
    each = atoms.groupBy("frame").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.first("cell.volume").alias("volume"))
    return each.select("frame", "n", "mass", (F.col("mass") / F.col("volume") * DENSITY).alias("mass_density"), (F.col("n") / F.col("volume")).alias("number_density"))


def molecule_report(kinds: DataFrame, members: DataFrame, atoms: DataFrame) -> DataFrame:
    """Per frame and molecule type: count, atoms per molecule, molar mass, concentration, mass share, representative."""
    masses = members.join(atoms.select("frame", "atom_index", "mass", *(["cell"] if "cell" in atoms.columns else [])), ["frame", "atom_index"])
    volume = F.first("cell.volume") if "cell" in atoms.columns else F.lit(None).cast("double")
    each = masses.groupBy("frame", "mol_index").agg(F.sum("mass").alias("mass"), volume.alias("volume"))
    rows = kinds.join(each, ["frame", "mol_index"]).groupBy("frame", "mol_type", "fingerprint").agg(
        F.count("*").alias("n"), F.max("n_atoms").alias("atoms_per_molecule"), F.max_by("mass", "mol_index").alias("molar_mass"), F.max("mol_index").alias("representative"), F.sum("mass").alias("mass"), F.first("volume").alias("volume")
    )
    whole = rows.groupBy("frame").agg(F.sum("mass").alias("total"))
    return rows.join(whole, "frame").select("frame", "mol_type", "fingerprint", "n", "atoms_per_molecule", "molar_mass", "representative", (F.col("n") / F.col("volume") * MOLAR).alias("concentration"), (100 * F.col("mass") / F.col("total")).alias("mass_percent"))


def free_energies(mass: Column, inertia: tuple[Column, Column, Column], temperature: float = 300.0, pressure: float = 101325.0) -> tuple[Column, Column]:
    """Translational (ideal gas) and rotational (rigid rotor, symmetry number 1) free energies in kJ/mol.

    ``mass`` in dalton, principal moments of inertia in dalton times square angstrom.
    """
    k, h, n, u = 1.380649e-23, 6.62607015e-34, 6.02214076e23, 1.66053907e-27
    q_t = F.pow(2 * math.pi * mass * u * k * temperature / h**2, F.lit(1.5)) * (k * temperature / pressure)
    turn = 8 * math.pi**2 * k * temperature / h**2 * u * 1e-20
    q_r = math.sqrt(math.pi) * F.sqrt(inertia[0] * inertia[1] * inertia[2]) * turn**1.5
    scale = -k * temperature * n / 1000
    return F.log(q_t) * scale, F.log(q_r) * scale


def principal_moments(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric matrix, least first, in closed form (the angle of its scaled deviator)."""
    third = (xx + yy + zz) / 3
    a, b, c = xx - third, yy - third, zz - third
    size = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(size > 0, det / (2 * size * size * size)).otherwise(0.0)))) / 3
    most, least = third + 2 * size * F.cos(turn), third + 2 * size * F.cos(turn + 2 * math.pi / 3)
    return least, 3 * third - most - least, most


def molecule_moments(atoms: DataFrame) -> DataFrame:
    """``frame, mol_index, n_atoms, mass, i_1, i_2, i_3``: principal moments of inertia about the centre of mass, least first.

    In dalton times square angstrom, of molecules that are whole (``unwrap``). A single atom has zeros, a
    linear molecule a least moment of zero up to rounding, which is set to zero.
    """
    centres = atoms.groupBy("frame", "mol_index").agg(F.sum("mass").alias("mass"), F.count("*").alias("n_atoms"), *[(F.sum(F.col("mass") * F.col(k)) / F.sum("mass")).alias(f"{k}_c") for k in "xyz"])
    d = {k: F.col(k) - F.col(f"{k}_c") for k in "xyz"}
    each = atoms.select("frame", "mol_index", F.col("mass").alias("m"), "x", "y", "z").join(centres, ["frame", "mol_index"])
    products = {p + q: F.sum(F.col("m") * d[p] * d[q]).alias(p + q) for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")}
    sums = each.groupBy("frame", "mol_index").agg(F.first("n_atoms").alias("n_atoms"), F.first("mass").alias("mass"), *products.values())
    s = {n: F.col(n) for n in products}
    moments = principal_moments(s["yy"] + s["zz"], s["xx"] + s["zz"], s["xx"] + s["yy"], -s["xy"], -s["xz"], -s["yz"])
    out = sums.select("frame", "mol_index", "n_atoms", "mass", *[m.alias(f"i_{n}") for n, m in enumerate(moments, 1)])
    flat = (F.col("n_atoms") < 3) | (F.col("i_1") < 1e-6 * F.col("i_3"))
    return out.withColumns({"i_1": F.when(flat, 0.0).otherwise(F.col("i_1")), "i_2": F.when(F.col("n_atoms") < 2, 0.0).otherwise(F.col("i_2")), "i_3": F.when(F.col("n_atoms") < 2, 0.0).otherwise(F.col("i_3"))})


def molecule_energies(kinds: DataFrame, moments: DataFrame, temperature: float = 300.0, pressure: float = 101325.0) -> DataFrame:
    """``frame, mol_type, representative, mass, i_1, i_2, i_3, translational, rotational``: free energies in kJ/mol by molecule type.

    They are those of the type's last molecule in the frame. A linear molecule turns about two axes, a
    single atom about none (0).
    """
    rows = kinds.join(moments.drop("n_atoms"), ["frame", "mol_index"])
    last = rows.groupBy("frame", "mol_type").agg(F.max(F.struct("mol_index", "n_atoms", "mass", "i_1", "i_2", "i_3")).alias("r")).select("frame", "mol_type", F.col("r.mol_index").alias("representative"), "r.n_atoms", "r.mass", "r.i_1", "r.i_2", "r.i_3")
    translation, rotation = free_energies(F.col("mass"), tuple(F.col(f"i_{n}") for n in (1, 2, 3)), temperature, pressure)
    k, h, n, u = 1.380649e-23, 6.62607015e-34, 6.02214076e23, 1.66053907e-27
    linear = F.log(8 * math.pi**2 * k * temperature / h**2 * u * 1e-20 * F.col("i_3")) * (-k * temperature * n / 1000)
    turning = F.when(F.col("n_atoms") == 1, 0.0).when(F.col("i_1") == 0, linear).otherwise(rotation)
    return last.select("frame", "mol_type", "representative", "mass", "i_1", "i_2", "i_3", translation.alias("translational"), turning.alias("rotational"))


def dipoles(atoms: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """``keys, mx, my, mz, charge`` and, with a cell, the projections on its unit vectors."""
    sums = [F.sum(F.col("charge") * F.col(k)).alias(f"m{k}") for k in "xyz"]
    out = atoms.groupBy(*keys).agg(*sums, F.sum("charge").alias("charge"), *([F.first("cell").alias("cell")] if "cell" in atoms.columns else []))
    if "cell" in atoms.columns:
        m, h = vec("m"), F.col("cell.h")
        along = {n: tuple(h[3 * i + k] for k in range(3)) for i, n in enumerate("abc")}
        out = out.withColumns({f"m_{n}": dot(m, v) / norm(v) for n, v in along.items()}).drop("cell")
    return out


def mean_dipole(frames: DataFrame) -> DataFrame:
    """Mean vector over frames, its magnitude in e angstrom and in Debye."""
    means = frames.agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in "xyz"], F.avg("charge").alias("charge"), F.count("*").alias("frames"))
    size = norm(vec("m"))
    return means.withColumns({"magnitude": size, "debye": size * DEBYE})


def occupancy(states: DataFrame, state: str = "state") -> DataFrame:
    """``state, n, percent``."""
    n = states.groupBy(state).agg(F.count("*").alias("n"))
    whole = states.agg(F.count("*").alias("_all"))  # one row
    return n.crossJoin(F.broadcast(whole)).select(state, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def quality(states: DataFrame, keys: tuple[str, ...] = (), distance: str = "distance", frame: str = "frame") -> DataFrame:
    """Mean, least and greatest distance with the first frame of each extreme."""
    least = F.min(F.struct(distance, frame)).alias("lo")
    most = F.max(F.struct(F.col(distance), (-F.col(frame)).alias("f"))).alias("hi")
    df = states.groupBy(*keys).agg(F.avg(distance).alias("mean"), least, most, F.count("*").alias("n"))
    return df.select(*keys, "n", "mean", F.col(f"lo.{distance}").alias("least"), F.col(f"lo.{frame}").alias("least_frame"), F.col(f"hi.{distance}").alias("most"), (-F.col("hi.f")).alias("most_frame"))


def transitions(states: DataFrame, state: str = "state", keys: tuple[str, ...] = ("traj",), order: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Frames whose state differs from the frame before: ``keys, order, from_state, to_state``."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return states.withColumn("from_state", before).where(F.col("from_state") != F.col(state)).select(*keys, *order, "from_state", F.col(state).alias("to_state"))


def bounding_box(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("frame").agg(*[f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])
