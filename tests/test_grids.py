import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import grids
from framelake.sources import grid_files

CELL = Cell.of_lengths(8, 9, 10)


def atoms_of(spark, n=12):
    rng = np.random.default_rng(3)
    q = rng.normal(size=n)
    q -= q.mean()
    rows = [(0, i, float(q[i]), *map(float, rng.uniform(0, 8, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "frame long, atom_index long, charge double, x double, y double, z double").withColumn("cell", CELL.column())


@pytest.mark.parametrize("order", [1, 2, 3, 4, 6])
def test_spline_forms_agree(spark, order):
    u = [k / 7 for k in range(-3, 7 * order + 4)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(grids.b_spline(order, F.col("u"))).collect()]
    assert got == pytest.approx(grids.b_spline_np(order, np.array(u)).tolist(), abs=1e-9)


def test_spread_keeps_the_charge(spark):
    a = atoms_of(spark)
    total = grids.spread(a, {"q": F.col("charge") + 1}, (6, 6, 6), 4).agg(F.sum("q")).first()[0]
    assert total == pytest.approx(12, abs=1e-9)


def test_potential_is_that_of_the_wave_sum(spark):
    shape, beta = (32, 32, 32), 0.4
    a = atoms_of(spark)
    got = np.zeros(shape)
    for r in grids.pme_potential(a, shape, beta, 6).collect():
        got[r.ia, r.ib, r.ic] = r.value
    rows = a.collect()
    q, xyz = np.array([r.charge for r in rows]), np.array([[r.x, r.y, r.z] for r in rows])
    frac = xyz / np.array([8, 9, 10])
    m = np.array([v for v in np.ndindex(15, 15, 15)]) - 7
    m = m[(m != 0).any(1)]
    k = 2 * np.pi * m / np.array([8, 9, 10])
    k2 = (k**2).sum(1)
    s = (q[None] * np.exp(-2j * np.pi * m @ frac.T)).sum(1)
    green = 4 * np.pi * grids.KE / CELL.volume * np.exp(-k2 / (4 * beta**2)) / k2
    assert abs(got.mean()) < 1e-9
    for f in ((0.11, 0.37, 0.92), (0.5, 0.03, 0.74)):  # the spline takes mesh values to any place
        want = (green * (s * np.exp(2j * np.pi * m @ np.array(f))).real).sum()
        value, w = 0.0, [x * n + (n - 1) / 2 for x, n in zip(f, shape, strict=True)]
        for k in np.ndindex(6, 6, 6):
            weight = np.prod([grids.b_spline_np(6, np.array(v - np.floor(v) + i)) for v, i in zip(w, k, strict=True)])
            value += weight * got[tuple((int(np.floor(v)) - i) % n for v, i, n in zip(w, k, shape, strict=True))]
        assert value == pytest.approx(want, abs=2e-3)


def test_dx_round_trip(spark, tmp_path):
    g = grids.grid_points(spark, (3, 4, 5)).withColumn("value", (F.col("ia") * 100 + F.col("ib") * 10 + F.col("ic")).cast("double"))
    header = grid_files.centred_header((3, 4, 5), CELL.vectors)
    grid_files.write_dx(g, header, f"file://{tmp_path}/g.dx")
    back, grid = grid_files.read_dx(spark, f"file://{tmp_path}/g.dx")
    assert back.counts == (3, 4, 5) and back.steps[0][0] == pytest.approx(8 / 3, rel=1e-5)
    assert grid.where("value <> ia * 100 + ib * 10 + ic").count() == 0 and grid.count() == 60


def test_dx_by_many_tasks(spark, tmp_path):
    """A file of many splits, with comments and uneven lines, gives its values in order."""
    values = [i * 0.25 for i in range(6 * 7 * 8)]
    lines, at = ["# a grid"], 0
    lines += grid_files.header_lines(grids.GridHeader((6, 7, 8), (0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))))
    while at < len(values):
        n = 1 + at % 4
        lines.append("  ".join(map(str, values[at : at + n])))
        at += n
    (tmp_path / "g.dx").write_text("\n".join([*lines, 'attribute "dep" string "positions"', ""]))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    try:
        _, grid = grid_files.read_dx(spark, f"file://{tmp_path}/g.dx")
        assert spark.read.text(f"file://{tmp_path}/g.dx").rdd.getNumPartitions() >= 4
        assert [r.value for r in grid.orderBy("ia", "ib", "ic").collect()] == values
    finally:
        spark.conf.set(name, before)
    (tmp_path / "few.dx").write_text("\n".join(lines[:-3]))
    with pytest.raises(ValueError, match="fewer"):
        grid_files.read_dx(spark, f"file://{tmp_path}/few.dx")


def test_averages(spark):
    g = grids.grid_points(spark, (2, 3, 4)).withColumn("value", F.col("ic").cast("double"))
    assert {r.ic: r.value for r in grids.average(g, "ab").collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError):
        grids.average(g, "abc")


def test_sizes():
    assert [grids.smooth_size(x, 1.0) for x in (6.2, 7, 11, 13.1, 31)] == [8, 8, 12, 15, 32]
