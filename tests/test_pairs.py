import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import pairs
from framelake.operators.pairs import neighbour_pairs


def atoms_of(spark, xyz, cell):
    rows = [(0, i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "frame long, atom_index long, x double, y double, z double")
    return df.withColumn("cell", cell.column()) if cell else df


def brute(xyz, cell, cutoff):
    d = xyz[:, None] - xyz[None]
    if cell:
        h = np.array(cell.h).reshape(3, 3)
        f = d @ np.linalg.inv(h)
        d = d - np.floor(f + 0.5) @ h
    r2 = (d**2).sum(-1)
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(r2 <= cutoff * cutoff, 1)), strict=True)}


@pytest.mark.parametrize("cell", [None, Cell.of_lengths(20, 20, 20), Cell.of_lengths(15, 16, 17, 80, 85, 75), Cell.of_lengths(6, 20, 9, 110, 95, 70)])
def test_same_as_brute_force(spark, cell):
    xyz = np.random.default_rng(42).uniform(-5, 15, (300, 3))
    got = {(r.atom_index_1, r.atom_index_2) for r in neighbour_pairs(atoms_of(spark, xyz, cell), None, 2.5).collect()}
    assert got == brute(xyz, cell, 2.5)


def test_lattice_counts_every_pair_twice_across_equal_lists(spark):
    xyz = np.array(list(np.ndindex(10, 10, 10))) * 2.5 + 1.25
    a = atoms_of(spark, xyz, Cell.of_lengths(25, 25, 25))
    assert neighbour_pairs(a, a, 6.0).count() == 56_000


def test_one_frame_in_many_bins_has_no_repeats(spark):
    xyz = np.random.default_rng(1).uniform(0, 4, (40, 3))
    p = neighbour_pairs(atoms_of(spark, xyz, Cell.of_lengths(4, 4, 4)), None, 1.9)
    assert p.count() == p.select("atom_index_1", "atom_index_2").distinct().count()
    assert p.agg(F.max("r2")).first()[0] <= 1.9**2


@pytest.mark.parametrize("edge", [None, 3.0])
def test_few_rows_with_many_pairs_are_dealt_to_many_tasks(spark, monkeypatch, edge):
    """All points in one bin: its rows meet block by block in several tasks, and every pair comes once."""
    monkeypatch.setattr(pairs, "TASK_PAIRS", 500)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    rows = [(0, i, 0.01 * i, 0.005 * i, 0.0) for i in range(80)]
    points = spark.createDataFrame(rows, "frame long, atom_index long, x double, y double, z double")
    if edge:
        points = points.withColumn("cell", Cell.of_lengths(edge, edge, edge).column())
    near = pairs.neighbour_pairs(points, None, 1.0).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.atom_index_1, r.atom_index_2) for r in near}) == len(near) == pairs.all_pairs(points, 1.0).count()
    assert len({r.task for r in near}) > 3
    both = pairs.neighbour_pairs(points, points.where("atom_index < 40"), 1.0).select("atom_index_1", "atom_index_2").collect()
    assert len(set(both)) == len(both) == sum(1 for i in range(80) for j in range(40) if i != j and (i - j) ** 2 * 1.25e-4 <= 1.0)
