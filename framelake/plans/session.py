"""A chain of steps over a trajectory: load, transform, analyse.

``Session`` collects transforms lazily; every analysis applies all of them to the scanned frames.
Topology is always that of the scanned coordinates. ``info`` and ``surface`` look at the scan itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.elements import element_of, mass_of, radius_of
from framelake.functions.geometry import Cell
from framelake.operators import aggregates, generate, grids, orientation, topology, transforms, unwrap
from framelake.operators.selection import compile_selection, select, select_entities
from framelake.runtime import staged
from framelake.sources import trajectories


class Session:
    """One trajectory and what is to be done with it."""

    def __init__(self, spark: SparkSession, atoms: DataFrame | None = None):
        self.spark, self.scan, self.steps = spark, atoms, []
        self.settings = topology.TopologySettings()
        self.input_bonds: DataFrame | None = None

    def load(self, paths: Sequence[str], cache: bool = False, frames: str | None = None) -> Session:
        """Read files in order; ``frames`` is ``b:e:s``."""
        cut = transforms.parse_slice(frames) if frames else None
        self.scan = self._complete(trajectories.load(self.spark, paths, cache, cut))
        pdb = [p for p in paths if trajectories.extension(p) == "pdb"]
        if pdb:
            self.input_bonds = staged(trajectories.read_bonds(self.spark, pdb[0]))
        return self

    @staticmethod
    def _complete(atoms: DataFrame) -> DataFrame:
        e = F.coalesce("element", element_of(F.col("type")))
        return atoms.withColumns({"element": e, "mass": mass_of(e), "radius": radius_of(e)})

    def _scan(self) -> DataFrame:
        if self.scan is None:
            raise ValueError("load a trajectory first")
        return self.scan

    def topology(self, **settings) -> Session:
        """Set how bonds are found: tolerance, no_bond, criteria, update_frequency, from_input, compute."""
        self.settings = topology.TopologySettings(**settings)
        return self

    def modify(self, **changes) -> Session:
        self.steps += transforms.modify(**changes)
        return self

    def wrap(self, atomic: bool = False) -> Session:
        self.steps.append(transforms.wrap_atoms() if atomic else transforms.wrap_molecules())
        return self

    def _topology(self) -> tuple[DataFrame, DataFrame]:
        """(``frame, anchor``; ``frame, i, j(, length)`` of the bonds of the anchors): which topology each frame uses."""
        scan = self._scan()
        frames = scan.select("frame").distinct()
        if self.input_bonds is not None and self.settings.from_input and not self.settings.compute:
            return frames.withColumn("anchor", F.lit(0).cast("long")), self.input_bonds.where("frame = 0").select("frame", "i", "j")  # every frame has the input's bonds
        if not self.settings.compute:
            return frames.withColumn("anchor", F.col("frame")), frames.select("frame", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")).where("1 = 0")
        anchors = staged(topology.anchor_frames(frames, self.settings.update_frequency))
        at = scan.join(anchors.select(F.col("anchor").alias("frame")).distinct(), "frame", "left_semi")
        return anchors, staged(topology.detect_bonds(at, self.settings))

    def bonds(self) -> DataFrame:
        """Bonds of every frame: each frame uses the topology of its anchor frame."""
        anchors, found = self._topology()
        return anchors.join(found.withColumnRenamed("frame", "anchor"), "anchor").drop("anchor")

    def molecules(self) -> tuple[DataFrame, DataFrame]:
        """(``frame, atom_index, mol_index``; molecule types); components are found on anchor frames only."""
        anchors, found = self._topology()
        members = staged(topology.molecules(found.select("frame", "i", "j"), self._scan(), anchors))
        return members, staged(topology.molecule_types(members, self._scan()))

    def atoms(self, with_molecules: bool = False) -> DataFrame:
        """Atoms after all transforms. Molecule columns are joined where a step or the caller needs them."""
        df = self._scan()
        if with_molecules:
            members, kinds = self.molecules()
            df = df.drop("mol_index", "mol_type").join(members, ["frame", "atom_index"]).join(kinds.select("frame", "mol_index", "mol_type"), ["frame", "mol_index"])
        return transforms.pipeline(df, self.steps)

    def _for(self, *texts: str) -> DataFrame:
        return self.atoms(any(compile_selection(t).kind == "molecule" for t in texts))

    def select(self, text: str, **options) -> DataFrame:
        return select(self._for(text), text, **options)

    def rdf(self, first: str, second: str, cutoff: float = 6.0, bins: int = 100, origin: str = "com") -> DataFrame:
        a = self._for(first, second)
        return aggregates.rdf(select_entities(a, first, origin), select_entities(a, second, origin), cutoff, bins)

    def dipoles(self) -> DataFrame:
        """Dipole of every frame."""
        return aggregates.dipoles(self.atoms())

    def dipole(self) -> DataFrame:
        return aggregates.mean_dipole(self.dipoles())

    def cell(self) -> dict:
        """The first cell of the scan, as its fields."""
        held = self._scan().where("cell is not null").select("cell").first()
        if held is None:
            raise ValueError("there is no cell")
        return held[0].asDict()

    def polarisation(self, text: str, shape: tuple[int, int, int], order: int = 4) -> DataFrame:
        if compile_selection(text).kind != "molecule":
            raise ValueError("a polarisation grid is of molecules")
        return grids.polarisation_grid(staged(grids.molecular_dipoles(select(self.atoms(True), text))), shape, order)

    def potential(self, shape: tuple[int, int, int], beta: float = 0.25, order: int = 4, real_space: bool = False, cutoff: float = 10.0, spread: bool = False, radius: int = 2) -> DataFrame:
        a = staged(self.atoms())
        if not real_space:
            return grids.pme_potential(a, shape, beta, order)
        return grids.gridspread_potential(a, shape, order, radius) if spread else grids.realspace_potential(a, shape, cutoff)

    def states(self, text: str, c3: bool = True) -> DataFrame:
        """Orientations of the selected carbonates: ``frame, slot, w, x, y, z``."""
        q = orientation.carbonate_orientations(select(self.atoms(True), text))
        q = q.withColumnRenamed("mol_index", "slot")
        return orientation.canonical_c3(q) if c3 else q

    def info(self) -> dict[str, DataFrame]:
        """Reports on the scan itself: composition, densities, cell, topology, molecule types and their free energies."""
        scan, bonds = self._scan(), staged(self.bonds().select("frame", "i", "j"))
        members, kinds = self.molecules()
        cells = scan.groupBy("frame").agg(F.first("cell").alias("cell"))
        whole = unwrap.whole_molecules(scan, bonds)
        return {
            "composition": aggregates.composition(scan),
            "density": aggregates.densities(scan),
            "cell": aggregates.cell_means(cells),
            "cell_geometry": aggregates.cell_geometry(cells.where("cell is not null")),
            "topology": topology.counts(scan, bonds),
            "molecules": aggregates.molecule_report(kinds, members, scan),
            "energies": aggregates.molecule_energies(kinds, aggregates.molecule_moments(whole.drop("mol_index").join(members, ["frame", "atom_index"]))),
        }

    def solvate(self, template: Sequence[tuple[str, float, float, float]], box: Sequence[float], **options) -> Session:
        """Add copies of a template to every frame, as a step of the chain; bonds are those of the scan."""
        self.steps.append(lambda df: generate.with_copies(df, template, box, **options))
        return self

    def surface(self, hkl: tuple[int, int, int], shift: float | None = None, depth: float = 1.0, atomic: bool = False, direction: Sequence[float] | None = None) -> DataFrame:
        """Slabs of the scan's first frame, a frame for each cut between layers (or the one at ``shift``)."""
        scan = self._scan()
        first = scan.where(F.col("frame") == F.lit(scan.agg(F.min("frame")).first()[0]))
        held = first.where("cell is not null").select("cell.h").first()
        if held is None:
            raise ValueError("surface needs a cell")
        cell = Cell(tuple(held[0]))
        if not atomic:
            bonds = self.bonds().join(first.select("frame").distinct(), "frame", "left_semi")
            named = first.drop("mol_index").join(self.molecules()[0], ["frame", "atom_index"])
            first = staged(unwrap.whole_molecules(named, bonds).drop("infinite"))
        shifts = generate.possible_cuts(first, cell, hkl, molecules=not atomic, whole=True) if shift is None else [shift]
        if not shifts:
            raise ValueError("no gap between layers to cut at")
        cut = generate.slab if atomic else partial(generate.slab_of_molecules, whole=True)
        slabs = [generate.stood_up(cut(first, cell, hkl, depth, s), cell, hkl, depth, direction).withColumn("frame", F.lit(n).cast("long")) for n, s in enumerate(shifts)]
        out = reduce(DataFrame.unionByName, slabs)
        part = Window.partitionBy("frame").orderBy("atom_index", "depth", "fa", "fb")  # one slab: a crystal's cell in a few layers
        return out.withColumn("atom_index", (F.row_number().over(part) - 1).cast("long")).drop("fa", "fb", "depth")

    def write(self, path: str, parts: int = 1, original_ids: bool = False) -> None:
        trajectories.write(self.atoms(), path, self.input_bonds, parts, original_ids)
