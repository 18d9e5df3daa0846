"""Bonds of crowded frames, whose bins meet as arrays, against a row for each candidate."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import crowds, pairs, topology

SETTINGS = {
    "plain": topology.TopologySettings(tolerance=0.05),
    "no_bond": topology.TopologySettings(tolerance=0.05, no_bond="aT3 or x > 2.0"),
    "criteria": topology.TopologySettings(tolerance=0.05, criteria=[topology.BondCriterion.parse(t) for t in ("aT1,T2&aT3<0.3", "aT4&aT4>0.2")]),
}


@pytest.mark.parametrize(("kind", "cell"), [("plain", Cell.of_lengths(4, 4.5, 5, 80, 85, 75)), ("criteria", Cell.of_lengths(1.1, 3, 3)), ("no_bond", None)])
def test_same_bonds_as_by_rows(spark, monkeypatch, kind, cell):
    rng = random.Random(5)
    rows = [(f, n, f"T{n % 5}" if n % 7 else None, 0.2 + n % 5 * 0.02 if n else None, *[rng.gauss(1.0, 0.7) if n != 5 else None for _ in "xyz"]) for f in range(2) for n in range(150)]
    atoms = spark.createDataFrame(rows, "frame long, atom_index long, type string, radius double, x double, y double, z double").repartition(3).cache()
    if cell:
        atoms = atoms.withColumn("cell", cell.column())
    want = {tuple(r) for r in topology.detect_bonds(atoms, SETTINGS[kind]).collect()}
    for module, name, value in ((pairs, "TASK_PAIRS", 1_000), (crowds, "PART_ROWS", 8), (crowds, "GROUP_PAIRS", 100), (crowds, "BLOCK", 32)):
        monkeypatch.setattr(module, name, value)

    def rowwise(*_, **__):
        raise AssertionError("a row for each candidate")

    monkeypatch.setattr(topology, "neighbour_pairs", rowwise)
    got = topology.detect_bonds(atoms, SETTINGS[kind]).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) > 100 and {tuple(r)[:4] for r in got} == want
    assert len({r.task for r in got}) > 3
    near = {}
    for f, i, j, _ in want:
        near.setdefault((f, i), []).append(j)
        near.setdefault((f, j), []).append(i)
    lists = {(r.frame, r.atom_index): (r.degree, r.partners) for r in topology.detected_connectivity(atoms, SETTINGS[kind]).collect()}
    assert lists == {(f, n): (len(near.get((f, n), [])), sorted(near.get((f, n), []))) for f in range(2) for n in range(150)}
