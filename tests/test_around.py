"""What is made from the atoms around a bin, without bonds as rows, against the same from a table of bonds."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import crowds, pairs, topology
from framelake.runtime import staged

PLAIN = topology.TopologySettings(tolerance=0.05)
RULED = topology.TopologySettings(tolerance=0.05, no_bond="x > 3", criteria=[topology.BondCriterion.parse(t) for t in ("aT1,T2&aT3<0.3", "aT4&aT4>0.2")])
KINDS = {"skew": (Cell.of_lengths(4, 4.5, 5, 80, 85, 75), PLAIN), "thin": (Cell.of_lengths(1.1, 3, 3), RULED), "open": (None, PLAIN)}


@pytest.fixture(params=KINDS)
def crowd(request, spark, monkeypatch):
    """(atoms, settings, their bonds by rows); then candidates count as many, and bonds may not be listed as rows any more."""
    rng = random.Random(7)
    rows = [(f, n, f"T{n % 5}" if n % 7 else None, 0.2 + n % 5 * 0.02 if n else None, *[rng.gauss(1.0, 0.5) if n != 5 else None for _ in "xyz"]) for f in range(2) for n in range(90)]
    rows += [(1, 200, "T1", 0.2, 3.0, 3.0, 3.0)] + [(1, 201 + n, "T1", 0.2, 2.8 + n * 0.4, 1.9, 2.0) for n in range(3)]
    cell, settings = KINDS[request.param]
    atoms = spark.createDataFrame(rows, "frame long, atom_index long, type string, radius double, x double, y double, z double").repartition(3)
    atoms = staged(atoms.withColumn("cell", cell.column()) if cell else atoms)
    bonds = staged(topology.detect_bonds(atoms, settings))
    for module, name, value in ((pairs, "TASK_PAIRS", 1_000), (crowds, "GROUPS", 12), (crowds, "BLOCK", 32), (crowds, "BATCH_ENDS", 2_000), (crowds, "LINKED_ENDS", 600)):
        monkeypatch.setattr(module, name, value)

    def rowwise(*_, **__):
        raise AssertionError("bonds as rows")

    monkeypatch.setattr(topology, "detect_bonds", rowwise)
    return atoms, settings, bonds


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def spread(df):
    """``rows`` of what many tasks made."""
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 3
    return Counter(tuple(r)[:-1] for r in got)


def test_angles(crowd):
    atoms, settings, bonds = crowd
    assert spread(topology.detected_angles(atoms, settings)) == rows(topology.angles(bonds))
    got, want = spread(topology.detected_angle_values(atoms, settings)), rows(topology.bonded_angle_values(bonds, atoms))
    assert len(want) > 1000 and {r[:-1]: r[-1] for r in got} == pytest.approx({r[:-1]: r[-1] for r in want}, abs=1e-7) and got.total() == want.total()


def test_issues(crowd):
    atoms, settings, bonds = crowd
    assert spread(topology.detected_issues(atoms, settings)) == rows(topology.bond_issues(bonds))


def test_dihedrals(crowd):
    atoms, settings, bonds = crowd
    assert spread(topology.detected_dihedrals(atoms, settings)) == rows(topology.proper_dihedrals(bonds))
    got = {tuple(r)[:-1]: r.phi for r in topology.detected_dihedral_values(atoms, settings).collect()}
    want = {tuple(r)[:-1]: r.phi for r in topology.bonded_dihedral_values(bonds, atoms).collect()}
    assert got.keys() == want.keys() and all(math.cos(got[q] - want[q]) > 1 - 1e-9 for q in want)


def test_second_neighbours(crowd, monkeypatch):
    atoms, settings, bonds = crowd
    monkeypatch.setattr(crowds, "STRIPE_BYTES", 3)
    assert spread(topology.detected_second_neighbours(atoms, settings)) == rows(topology.neighbours_at(bonds, atoms, 2).select("frame", "start", "atom"))


def test_ring_sizes(crowd, monkeypatch):
    atoms, settings, bonds = crowd
    monkeypatch.setattr(topology, "TRIED", 2)
    assert spread(topology.detected_ring_sizes(atoms, settings)) == rows(topology.ring_sizes(bonds))


def test_force_field_types(crowd):
    atoms, settings, bonds = crowd
    atoms = atoms.withColumn("element", F.element_at(F.array(*map(F.lit, ("C", "N", "O", "B", "Si", "S"))), (F.col("atom_index") % 6 + 1).cast("int")))
    got = rows(topology.detected_uff_types(atoms, settings))
    assert got == rows(topology.uff_types(atoms, bonds)) and len({r[2] for r in got}) > 4
