"""Molecules and impropers from cliques, against those of all bonds."""

import random

from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import links, topology


def groups(bonds):
    """The least atom of each bonded atom's molecule."""
    least = {}
    for f, *ends in bonds:
        for a in ends:
            least.setdefault((f, a), a)
    while True:
        before = dict(least)
        for f, i, j in bonds:
            least[f, i] = least[f, j] = min(least[f, i], least[f, j])
        if least == before:
            return least


def test_links_give_what_all_bonds_give(spark, monkeypatch):
    """A frame of clouds over the boundary, and one with a rod that is bonded to its own image."""
    monkeypatch.setattr(links, "CROWDED", 0.0)
    rng = random.Random(3)
    rows = [(0, c * 40 + n, *[rng.gauss(m, 0.45) for m in (c * 2.0, 0.1, 6.4)]) for c in range(3) for n in range(40)]
    rows += [(5, n, n * 0.1, 3.0 + rng.random() * 0.1, 1.0) for n in range(60)] + [(5, 60 + n, rng.random() * 6, rng.random() * 7, rng.random() * 6 - 3) for n in range(40)]
    atoms = spark.createDataFrame(rows, "frame long, atom_index long, x double, y double, z double").withColumn("radius", 0.2 + F.col("atom_index") % 10 * 0.01)
    atoms = atoms.withColumn("cell", Cell.of_lengths(6.0, 7.0, 6.5).column())
    settings = topology.TopologySettings(tolerance=0.05)
    every, some = topology.detect_bonds(atoms, settings).cache(), links.linking_bonds(atoms, settings).cache()
    assert not some.join(every, ["frame", "i", "j"], "left_anti").count()
    assert some.where("frame = 5").count() < every.where("frame = 5").count()
    rows = lambda df, *c: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    assert groups(rows(some, "frame", "i", "j")) == groups(rows(every, "frame", "i", "j"))
    found = rows(topology.impropers_of(links.few_neighbours(atoms, settings, 3)), *"ijkl")
    assert found == rows(topology.improper_dihedrals(every), *"ijkl") and found


def test_whole_molecules_follow_from_links(spark, monkeypatch):
    """Links move each atom as all bonds do, and the queries of whole molecules ask for no more bonds than these."""
    from framelake import catalogue, workload
    from framelake.operators import unwrap

    monkeypatch.setattr(links, "CROWDED", 0.0)
    rng = random.Random(4)
    rows = [(0, n, *[rng.gauss(m, 0.3) for m in (0.0, 0.1, 9.9)]) for n in range(40)] + [(1, n, n * 0.1, 3.0 + rng.random() * 0.1, 1.0) for n in range(100)]
    atoms = spark.createDataFrame(rows, "frame long, atom_index long, x double, y double, z double").withColumn("radius", 0.2 + F.col("atom_index") % 10 * 0.01).withColumn("cell", Cell.of_lengths(10.0, 10.0, 10.0).column()).cache()
    used = []
    monkeypatch.setattr(workload, "atoms", lambda *_: atoms)
    monkeypatch.setattr(unwrap, "whole_molecules", lambda a, b: used.append(b) or a.limit(0).withColumn("infinite", F.lit(False)))
    catalogue.whole_molecules(spark, "")
    every = topology.detect_bonds(atoms, topology.TopologySettings(tolerance=0.05)).cache()
    assert used[0].count() < every.count() and not used[0].join(every, ["frame", "i", "j"], "left_anti").count()
    moves = [{tuple(r) for r in unwrap.image_moves(b, atoms).collect()} for b in (used[0], every)]
    assert moves[0] == moves[1] and {r[-1] for r in moves[0]} == {False, True}
