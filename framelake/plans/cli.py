"""Command line: sub-commands in a chain, as ``load a.pdb modify --translate 1 0 0 rdf --s1 aO --s2 aH``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framelake.functions.elements import element_of, mass_of
from framelake.operators import aggregates, generate, orientation
from framelake.operators.grids import reduce_axes, smooth_size
from framelake.operators.selection import compile_selection
from framelake.operators.topology import BondCriterion
from framelake.plans.session import Session
from framelake.runtime import staged
from framelake.sources import grid_files, trajectories

LEVELS = [logging.CRITICAL, logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG]
NEEDS_LOAD = {"modify", "pmepot", "wrap", "write", "rdf", "dipole", "info", "top", "qc", "solvate", "surface"}


def parsers() -> dict[str, argparse.ArgumentParser]:
    p = {n: argparse.ArgumentParser(prog=n) for n in ("load", "modify", "wrap", "top", "rdf", "dipole", "pmepot", "dxreduce", "info", "write", "qc", "solvate", "surface")}
    p["load"].add_argument("files", nargs="+")
    p["load"].add_argument("--into-mem", action="store_true")
    p["load"].add_argument("--slice")
    m = p["modify"]
    m.add_argument("--translate", nargs=3, type=float)
    m.add_argument("--rotate", nargs=2)
    m.add_argument("--rotate-origin", nargs=3, type=float, default=(0, 0, 0))
    m.add_argument("--wrap", action="store_true")
    for name, kind in (("charge", float), ("type", str), ("mol-type", str)):
        m.add_argument(f"--set-{name}", type=kind, action="append", default=[])
    m.add_argument("--sel", action="append", default=[])
    p["wrap"].add_argument("--atomic", action="store_true")
    t = p["top"]
    t.add_argument("-a", "--auto", action="store_true")
    t.add_argument("--no-bond")
    t.add_argument("--bond-criteria", action="append", default=[])
    t.add_argument("--bond-tolerance", type=float, default=0.4)
    t.add_argument("--update-frequency", type=int, default=0)
    t.add_argument("--from-file", action="store_true")
    r = p["rdf"]
    r.add_argument("--s1", required=True)
    r.add_argument("--s2", required=True)
    r.add_argument("--rcut", type=float, default=6.0)
    r.add_argument("--nbins", type=int, default=100)
    r.add_argument("--mol-origin", choices=("com", "centroid"), default="com")
    r.add_argument("--out", default="gofr.out")
    d = p["dipole"]
    d.add_argument("-o", "--out")
    d.add_argument("--sel")
    d.add_argument("--grid-out")
    d.add_argument("--grid", nargs=3, type=int)
    d.add_argument("--spacing", type=float, default=1.0)
    d.add_argument("--order", type=int, default=4)
    q = p["qc"]
    q.add_argument("--carbonates", required=True)
    q.add_argument("--train", action="store_true")
    q.add_argument("--c3-symmetry", action=argparse.BooleanOptionalAction, default=True)
    q.add_argument("-k", "--clusters", type=int, default=3)
    q.add_argument("--ref-config", default="surface_configs.json")
    q.add_argument("-o", "--output")
    q.add_argument("--distance-threshold", type=float, default=0.3)
    v = p["solvate"]
    v.add_argument("-m", "--molecule", required=True)
    v.add_argument("--origin", nargs=3, type=float, default=(0.0, 0.0, 0.0))
    v.add_argument("--box", nargs="+", type=float, required=True)
    many = v.add_mutually_exclusive_group(required=True)
    many.add_argument("-n", "--n-molecules", type=int)
    many.add_argument("--density", type=float)
    v.add_argument("--min-dist", type=float, default=2.5)
    v.add_argument("--max-attempts", type=int, default=200)
    v.add_argument("--seed", type=int, default=42)
    c = p["surface"]
    c.add_argument("hkl", nargs=3, type=int)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--shift", type=float)
    c.add_argument("--depth", type=float, default=1.0)
    c.add_argument("--atomic", action="store_true")
    c.add_argument("--x-direction", nargs=3, type=float)
    e = p["pmepot"]
    e.add_argument("out")
    e.add_argument("--spacing", type=float, default=1.0)
    e.add_argument("--grid", nargs=3, type=int)
    e.add_argument("--beta", type=float, default=0.25)
    e.add_argument("--order", type=int, default=4)
    e.add_argument("--real-space", action="store_true")
    e.add_argument("--cutoff", type=float, default=10.0)
    e.add_argument("--grid-spread", action="store_true")
    e.add_argument("--cell-radius", type=int, default=2)
    x = p["dxreduce"]
    x.add_argument("file")
    x.add_argument("-o", "--out", required=True)
    x.add_argument("--average", required=True)
    p["write"].add_argument("path")
    p["write"].add_argument("--original-ids", action="store_true")
    return p


def split(argv: list[str]) -> list[tuple[str, list[str]]]:
    """The chain as (sub-command, its arguments)."""
    names, out = set(parsers()), []
    for word in argv:
        if word in names:
            out.append((word, []))
        elif out:
            out[-1][1].append(word)
        else:
            raise ValueError(f"unknown sub-command {word!r}")
    if not out:
        raise ValueError("a sub-command is needed")
    loaded = False
    for name, _ in out:
        if name in NEEDS_LOAD and not loaded:
            raise ValueError(f"{name} needs load before it")
        loaded |= name == "load"
    return out


def run(spark: SparkSession, argv: list[str]) -> Session:
    """Carry out a chain; analyses write where their options say."""
    chain = [(n, parsers()[n].parse_args(a)) for n, a in split(argv)]
    s = Session(spark)
    for name, o in chain:
        if name == "load":
            s.load(o.files, o.into_mem, o.slice)
        elif name == "modify":
            s.modify(move=tuple(o.translate) if o.translate else None, turn=(float(o.rotate[0]), o.rotate[1]) if o.rotate else None, origin=tuple(o.rotate_origin), wrap=o.wrap, charges=o.set_charge, types=o.set_type, mol_types=o.set_mol_type, selections=o.sel)
        elif name == "wrap":
            s.wrap(o.atomic)
        elif name == "top":
            s.topology(tolerance=o.bond_tolerance, no_bond=o.no_bond, criteria=[BondCriterion.parse(c) for c in o.bond_criteria], update_frequency=o.update_frequency, from_input=o.from_file, compute=not o.from_file)
        elif name == "rdf":
            grid_files.write_rdf(s.rdf(o.s1, o.s2, o.rcut, o.nbins, o.mol_origin), o.out)
        elif name == "dipole":
            s.dipole().show(truncate=False)
            if o.out:
                grid_files.write_dipoles(s.dipoles(), o.out)
            if o.grid_out:
                if not o.sel:
                    raise ValueError("--grid-out needs --sel")
                shape, vectors = _mesh(s, o)
                field = staged(s.polarisation(o.sel, shape, o.order))
                for suffix, value in (("Px", "mx"), ("Py", "my"), ("Pz", "mz"), ("Pmag", "magnitude")):
                    grid_files.write_dx(field, grid_files.centred_header(shape, vectors), f"{o.grid_out}_{suffix}.dx", value)
        elif name == "pmepot":
            shape, vectors = _mesh(s, o)
            values = s.potential(shape, o.beta, o.order, o.real_space, o.cutoff, o.grid_spread, o.cell_radius)
            grid_files.write_dx(values, grid_files.centred_header(shape, vectors), o.out)
        elif name == "qc":
            _configurations(s, o)
        elif name == "solvate":
            template = generate.read_template(spark, o.molecule)
            mass = None if o.density is None else spark.createDataFrame(template, "type string, x double, y double, z double").agg(F.sum(mass_of(element_of(F.col("type"))))).first()[0]
            s.solvate(template, o.box, number=o.n_molecules, density=o.density, molar_mass=mass, min_distance=o.min_dist, max_attempts=o.max_attempts, seed=o.seed, origin=o.origin)
        elif name == "surface":
            trajectories.write(s.surface(tuple(o.hkl), o.shift, o.depth, o.atomic, o.x_direction), o.output)
        elif name == "dxreduce":
            header, grid = grid_files.read_dx(spark, o.file)
            reduced = reduce_axes(grid, header, o.average)
            columns = [k for k in reduced.columns if k != "value" and not k.endswith("_bin")]
            grid_files.write_profile(reduced, [*columns, "value"], o.out)
        elif name == "info":
            for title, df in s.info().items():
                logging.getLogger(__name__).info("%s", title)
                df.show(truncate=False)
        elif name == "write":
            s.write(o.path, original_ids=o.original_ids)
    return s


def _mesh(s: Session, o: argparse.Namespace) -> tuple[tuple[int, int, int], list]:
    """Numbers of grid points, as asked for or by spacing, and the cell's vectors."""
    c = s.cell()
    return tuple(o.grid) if o.grid else tuple(smooth_size(c[k], o.spacing) for k in "abc"), [c["h"][i : i + 3] for i in (0, 3, 6)]


def _configurations(s: Session, o: argparse.Namespace) -> None:
    """Learn the configurations of the selected carbonates, or name the one that each frame is in."""
    if compile_selection(o.carbonates, "jm").kind != "molecule":
        raise ValueError("carbonates are molecules: select them by j or m")
    states = staged(s.states(o.carbonates, o.c3_symmetry))
    if o.train:
        centroids, _ = orientation.k_means(states, o.clusters)
        orientation.describe(centroids).orderBy("ref", "slot").show(truncate=False)
        grid_files.write_states(centroids, o.ref_config)
        return
    references = grid_files.read_states(s.spark, o.ref_config)
    orientation.check_slots(states, references)
    found = staged(orientation.nearest_state(states, references, o.distance_threshold, permute=True))
    moves = aggregates.transitions(found.withColumn("traj", F.lit(0)))
    for report in (aggregates.occupancy(found).orderBy("state"), aggregates.quality(found), moves.agg(F.count("*").alias("transitions"))):
        report.show(truncate=False)
    if o.output:
        grid_files.write_assignments(found, o.output)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] in (["--help"], ["-h"]):
        print(__doc__)
        return 0
    if argv[:1] == ["--verbosity"]:
        logging.basicConfig(level=LEVELS[min(4, max(0, int(argv[1])))])
        argv = argv[2:]
    try:
        split(argv)
        run(SparkSession.builder.getOrCreate(), argv)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
