import math

import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.plans import cli
from framelake.plans.session import Session
from framelake.sources import grid_files, trajectories
from framelake.streaming import frames as streaming


def xyz(path, n=4):
    with open(path, "w") as f:
        for k in range(n):
            f.write(f'3\nLattice="20 0 0 0 20 0 0 0 20"\nO {k} 0 0\nH {0.96 + k} 0 0\nH {-0.24 + k} 0.927 0\n')


def test_load_modify_write(spark, tmp_path):
    xyz(tmp_path / "a.xyz")
    out = f"{tmp_path}/b.xyz"
    cli.run(spark, ["load", f"{tmp_path}/a.xyz", "--slice", "1::2", "modify", "--translate", "1.5", "-0.5", "2", "write", out])
    back = trajectories.load(spark, [out])
    assert sorted(r.x for r in back.where("atom_index = 0").collect()) == [2.5, 4.5]
    assert back.select("cell.a").first()[0] == pytest.approx(20)


def test_chain_errors():
    for argv in ([], ["write", "x.xyz"], ["modify", "--wrap"], ["nonsense"]):
        assert cli.main(argv) == 1
    assert cli.main(["--help"]) == 0
    with pytest.raises(ValueError):
        trajectories.check_inputs(["a.xtc"])
    with pytest.raises(ValueError):
        trajectories.extension("a.foo")


def test_info_and_rdf(spark, tmp_path):
    xyz(tmp_path / "a.xyz", 2)
    s = Session(spark).load([f"{tmp_path}/a.xyz"]).topology(compute=True)
    info = s.info()
    assert {(r.bonds, r.angles) for r in info["topology"].collect()} == {(2, 1)}
    assert {(r.mol_type, r.n, r.fingerprint) for r in info["molecules"].collect()} == {("M1", 1, "H,H,O")}
    g = s.rdf("aO", "aH", 2.0, 10)
    assert g.where("gofr > 0").count() == 1
    assert s.select("mM1 and x > 0.5").select("frame").distinct().count() == 1


def test_topology_file_names_the_frames(spark, tmp_path):
    xyz(tmp_path / "top.xyz", 1)
    a = trajectories.load(spark, [f"{tmp_path}/top.xyz"]).drop("frame")
    moved = a.crossJoin(spark.range(3).withColumnRenamed("id", "frame")).withColumn("x", F.col("x") + F.col("frame")).withColumn("cell", Cell.of_lengths(25, 25, 25).column())
    for ext in ("xtc", "dcd"):
        trajectories.write(moved, f"file://{tmp_path}/t.{ext}", parts=2)
        both = trajectories.load(spark, [f"{tmp_path}/top.xyz", f"file://{tmp_path}/t.{ext}"])
        rows = {r.frame: (round(r.x, 2), r.element) for r in both.where("atom_index = 0").collect()}
        assert rows == {0: (0.0, "O"), 1: (0.0, "O"), 2: (1.0, "O"), 3: (2.0, "O")}


def test_stream_of_frames(spark, tmp_path):
    a = spark.createDataFrame([(0, 0, 1.0, 1.0, 2.0, 3.0), (0, 1, -1.0, 0.0, 0.0, 0.0), (1, 0, 2.0, 1.0, 1.0, 1.0)], "frame long, atom_index long, charge double, x double, y double, z double")
    a.repartition(3).write.parquet(f"{tmp_path}/chunks")
    stream = streaming.read_stream(spark, f"{tmp_path}/chunks", "frame long, atom_index long, charge double, x double, y double, z double", 1)
    streaming.run_once(streaming.frame_dipoles(stream), "dipoles", f"{tmp_path}/state")
    assert {r.frame: (r.mx, r.my, r.mz, r.atoms) for r in spark.table("dipoles").collect()} == {0: (1.0, 2.0, 3.0, 2), 1: (2.0, 2.0, 2.0, 1)}


def carbonates(path):
    """Two frames of two flat groups, the second turned by half a right angle in the second frame."""
    with open(path, "w") as f:
        for turn in (0.0, math.pi / 4):
            f.write('8\nLattice="20 0 0 0 20 0 0 0 20"\n')
            for n, (x, t) in enumerate(((4.0, 0.0), (12.0, turn))):
                f.write(f"C {x} 5 5\n" + "".join(f"O {x + 1.28 * math.cos(t + a)} {5 + 1.28 * math.sin(t + a)} 5\n" for a in (0.1, 0.1 + 2 * math.pi / 3, 0.1 + 4 * math.pi / 3)))


def test_configurations_of_carbonates(spark, tmp_path):
    carbonates(tmp_path / "c.xyz")
    chain = ["load", f"{tmp_path}/c.xyz", "top", "--auto", "qc", "--carbonates", "mM1", "--ref-config", f"{tmp_path}/r.json"]
    cli.run(spark, [*chain, "--train", "-k", "2"])
    cli.run(spark, [*chain, "-o", f"{tmp_path}/q.txt"])
    lines = [r.value.split() for r in spark.read.text(f"{tmp_path}/q.txt").collect()]
    assert lines[0] == ["#", "Frame", "Configuration", "Distance"]
    assert [x[:2] for x in lines[1:]] == [["0", "1"], ["1", "2"]]
    assert all(float(x[2]) < 1e-6 for x in lines[1:])
    with pytest.raises(ValueError):
        cli.run(spark, [*chain[:-3], "aC", *chain[-2:]])


def test_dipole_files(spark, tmp_path):
    xyz(tmp_path / "a.xyz", 2)
    chain = ["load", f"{tmp_path}/a.xyz", "modify", "--set-charge", "-0.8", "--sel", "aO", "--set-charge", "0.4", "--sel", "aH"]
    cli.run(spark, [*chain, "top", "--auto", "dipole", "-o", f"{tmp_path}/d.txt", "--grid-out", f"{tmp_path}/p", "--sel", "mM1", "--grid", "8", "8", "8"])
    lines = [r.value.split() for r in spark.read.text(f"{tmp_path}/d.txt").collect()]
    assert [float(v) for v in lines[1]] == pytest.approx([0, 0.288, 0.3708, 0, 0.288, 0.3708, 0], abs=1e-5)
    header, grid = grid_files.read_dx(spark, f"{tmp_path}/p_Px.dx")
    assert header.counts == (8, 8, 8)
    assert grid.agg(F.sum("value")).first()[0] != 0


def test_solvated_chain(spark, tmp_path):
    xyz(tmp_path / "a.xyz", 2)
    xyz(tmp_path / "water.xyz", 1)
    cli.run(spark, ["load", f"{tmp_path}/a.xyz", "solvate", "-m", f"{tmp_path}/water.xyz", "--box", "12", "14", "16", "80", "95", "100", "--origin", "30", "0", "0", "-n", "5", "write", f"{tmp_path}/s.xyz"])
    back = trajectories.load(spark, [f"{tmp_path}/s.xyz"])
    assert {(r.frame, r.n, r.top) for r in back.groupBy("frame").agg(F.count("*").alias("n"), F.max("atom_index").alias("top")).collect()} == {(0, 18, 17), (1, 18, 17)}
    assert back.where("atom_index >= 3").agg(F.min("x")).first()[0] > 20
    assert {r.type: r.n for r in back.where("frame = 0").groupBy("type").agg(F.count("*").alias("n")).collect()} == {"O": 6, "H": 12}


@pytest.mark.parametrize("extra, atoms", [([], 6), (["--atomic"], 6), (["--x-direction", "0", "1", "0"], 6)])
def test_surface_chain(spark, tmp_path, extra, atoms):
    with open(tmp_path / "w.xyz", "w") as f:
        f.write('3\nLattice="5 0 0 0 6 0 0 0 7"\nO 1 1 6.8\nH 1.96 1 6.8\nH 0.76 1.2 7.7\n')
    cli.run(spark, ["load", f"{tmp_path}/w.xyz", "top", "--auto", "surface", "0", "0", "1", "-o", f"{tmp_path}/s.pdb", "--depth", "2", *extra])
    back = trajectories.load(spark, [f"{tmp_path}/s.pdb"])
    assert {r["count"] for r in back.groupBy("frame").count().collect()} == {atoms}
    assert back.select("cell.volume").first()[0] == pytest.approx(420, rel=1e-3)
    if not extra:  # whole molecules
        o, h = (back.where(f"frame = 0 and type = '{t}'").select("x", "y", "z").collect() for t in "OH")
        assert all(sorted(math.dist(a, b) for b in h)[1] < 1.1 for a in o)
