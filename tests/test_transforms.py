import pytest
from pyspark.sql import functions as F

from framelake import runtime
from framelake.functions.geometry import Cell
from framelake.operators import transforms as t


@pytest.fixture()
def one(spark):
    df = spark.createDataFrame([(0, 0, "A", 12.0, -1.0, 3.0)], "frame long, atom_index long, type string, x double, y double, z double")
    return df.withColumn("cell", Cell.of_lengths(10, 10, 10).column())


def at(df):
    r = df.first()
    return pytest.approx((r.x, r.y, r.z))


def test_wrap(one):
    assert at(one.transform(t.wrap_atoms())) == (2, 9, 3)


def test_wrap_without_cell(one):
    bare = one.withColumn("cell", F.lit(None).cast(one.schema["cell"].dataType))
    assert at(bare.transform(t.wrap_atoms())) == (12, -1, 3)


def test_order(one):
    assert at(t.pipeline(one, t.modify(move=(1, 2, 3), turn=(90, "z"), wrap=True))) == (9, 3, 6)


def test_rotation_about_a_point(one):
    assert at(one.transform(t.rotate(180, "x", (0, 1, 1)))) == (12, 3, -1)


def test_bad_arguments():
    with pytest.raises(ValueError):
        t.rotate(1, "w")
    with pytest.raises(ValueError):
        t.set_column("charge", [1.0, 2.0], ["aA"])
    for text in ("-1:2:1", "0:5:0", "a:b", "1:2:3:4"):
        with pytest.raises(ValueError):
            t.parse_slice(text)


def test_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "frame")
    assert [r.frame for r in t.slice_frames(df, *t.parse_slice("2:9:3")).orderBy("frame").collect()] == [2, 5, 8]
    assert t.parse_slice("3:") == (3, -1, 1) and t.parse_slice("::2") == (0, -1, 2)


def test_no_shift_is_no_step(one):
    assert one.transform(t.translate(0, 0, 0)) is one


def test_hot_keys_are_joined_apart(spark):
    big = spark.createDataFrame([(i % 3 if i < 90 else 7, None if i % 11 == 0 else "a", i) for i in range(100)], "k int, t string, v int")
    lookup = spark.createDataFrame([(0, "a", "zero"), (7, "a", "seven"), (2, "a", None), (9, None, "nine")], "k int, t string, name string")
    plain = sorted(big.join(lookup, ["k", "t"], "left").select("k", "t", "v", "name").collect(), key=lambda r: r.v)
    for least in (2, 9, 20, 1000):
        out = runtime.join_hot(big, lookup, ["k", "t"], least)
        assert out.columns == ["k", "t", "v", "name"] and sorted(out.collect(), key=lambda r: r.v) == plain
    assert runtime.join_hot(big.limit(0), lookup, ["k", "t"]).count() == 0
