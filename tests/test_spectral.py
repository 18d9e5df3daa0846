"""Pencil transforms against whole ones, and the Ewald sum against known energies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import grids, spectral

CELLS = [Cell.of_lengths(8, 9, 10, 80, 95, 100), Cell.of_lengths(9, 9, 9)]


def charges(spark, cells=CELLS, n=14):
    rng = np.random.default_rng(3)
    rows = [(f, i, float(rng.normal()), *map(float, rng.uniform(0, 8, 3))) for f in range(4) for i in range(n)]
    df = spark.createDataFrame(rows, "frame long, atom_index long, charge double, x double, y double, z double")
    return df.withColumn("cell", F.when(F.col("frame") % 2 == 0, cells[0].column()).otherwise(cells[-1].column()))


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.ia, r.ib, r.ic] = r.value
    return out


@pytest.mark.parametrize("line", [4, 64])
def test_pencils_give_the_whole_transform(spark, line):
    shape, rng = (5, 6, 9), np.random.default_rng(1)
    mesh = rng.normal(size=(2, *shape)) * (rng.random((2, *shape)) < 0.2)
    rows = [(f"m{k}", *map(int, p), float(mesh[k][p])) for k in range(2) for p in np.ndindex(*shape) if mesh[k][p]]
    df = spark.createDataFrame(rows, "key string, ia int, ib int, ic int, value double")
    factor = rng.normal(size=shape)
    got = spectral.convolve(df, shape, lambda key, a, b, c: (2.0 if key == "m1" else 1.0) * factor[np.ix_(a, [b], c)][:, 0], line)
    assert got.count() == 2 * 5 * 6 * 9
    for k in range(2):
        want = np.fft.ifftn(np.fft.fftn(mesh[k]) * factor).real * (k + 1)
        assert np.abs(dense(got.where(F.col("key") == f"m{k}"), shape) - want).max() < 1e-9


def test_potential_by_pencils(spark):
    """Frames of two cells on a mesh that no edge of the cells suits; both ways agree."""
    a, shape = charges(spark), (6, 10, 15)
    whole, pencils = (dense(grids.pme_potential(a, shape, 0.5, 4, dense=d), shape) for d in (1 << 20, 0))
    assert np.abs(whole - pencils).max() < 1e-9 < np.abs(whole).max()
    apart = [dense(grids.pme_potential(a.where(F.col("frame") == f), shape, 0.5, 4), shape) for f in range(4)]
    assert np.abs(whole - np.mean(apart, axis=0)).max() < 1e-9


def test_error_function(spark):
    x = np.concatenate([np.linspace(0, 7, 400), [0.46875, 4.0, 12.0, 25.0]])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(spectral.erfc(F.col("x"))).collect()]
    for v, g in zip(x, got):
        assert g == pytest.approx(math.erfc(v), rel=2e-14, abs=1e-300)


@pytest.mark.parametrize("cells", [CELLS, CELLS[:1]])
def test_energy_does_not_depend_on_beta(spark, cells):
    """Charged, tilted cells of two kinds."""
    a = charges(spark, cells)
    energies = [{r.frame: r.energy for r in spectral.ewald_sum(a, beta, 3.7, 1e-11).collect()} for beta in (1.2, 1.4)]
    assert len(energies[0]) == 4
    for f in range(4):
        assert energies[0][f] == pytest.approx(energies[1][f], abs=1e-6)


def test_rock_salt(spark):
    """Eight ions of a cell of edge 2: the Madelung constant, for each ion half of 1.7475645946."""
    rows = [(0, i, 1.0 if sum(p) % 2 == 0 else -1.0, *map(float, p)) for i, p in enumerate(np.ndindex(2, 2, 2))]
    a = spark.createDataFrame(rows, "frame long, atom_index long, charge double, x double, y double, z double").withColumn("cell", Cell.of_lengths(2, 2, 2).column())
    with pytest.raises(ValueError, match="twice as wide"):
        spectral.ewald_sum(a, 3.0, 1.2)
    big = a.crossJoin(spark.range(64)).select(F.lit(0).alias("frame"), (F.col("atom_index") * 64 + F.col("id")).alias("atom_index"), "charge", *[(F.col(k) + 2 * (F.floor(F.col("id") / 4**i) % 4)).alias(k) for i, k in enumerate("xyz")]).withColumn("cell", Cell.of_lengths(8, 8, 8).column())
    r = spectral.ewald_sum(big, 1.5, 3.9, 1e-10).first()
    assert r.energy == pytest.approx(-512 * 1.7475645946 / 2, abs=1e-5) and abs(r.background) < 1e-12


def test_frames_without_charges(spark):
    a = charges(spark).withColumn("charge", F.when(F.col("frame") == 1, F.col("charge")).otherwise(0.0))
    assert {r.frame: r.energy != 0 for r in spectral.ewald_sum(a, 1.2, 3.7).collect()} == {0: False, 1: True, 2: False, 3: False}
    assert spectral.ewald_sum(a.limit(0), 1.2, 3.7).count() == 0
    for beta, cutoff, tolerance in ((0, 1, 0.1), (1, 0, 0.1), (1, 1, 1)):
        with pytest.raises(ValueError):
            spectral.ewald_sum(a, beta, cutoff, tolerance)
    with pytest.raises(ValueError):
        spectral.ewald_sum(a.withColumn("cell", F.lit(None).cast(a.schema["cell"].dataType)), 1, 1)
