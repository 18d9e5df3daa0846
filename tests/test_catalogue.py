import math

import duckdb
import pytest

from framelake import catalogue

DATA = "/root/testdata/sf0.001"
FEW = ["slice_frames", "ring_sizes", "ewald_total", "assignment_distance", "sel_bool_position", "sel_static_membership", "rotate_origin", "pairs_cross", "rdf", "bonds_criteria", "moltypes", "topo_epoch", "transitions", "quality", "polarisation_grid", "grid_rebin_x", "perm_distance", "io_dx"]


def rows_of(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", FEW)
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_open_slice_reaches_the_end(spark):
    """Of 100 000 events the slice without an end gives every seventh from 10 on, and the rows of its SQL."""
    con, big = duckdb.connect(), DATA.replace("sf0.001", "sf0.1")
    con.sql(f"create view events as select * from '{big}/events.parquet'")
    got, want = catalogue.queries()["slice_frames_open"](spark, big).toPandas(), con.sql(catalogue.oracle_sql()["slice_frames_open"]).df()
    assert rows_of(got) == rows_of(want) and got["frame"].max() > 99_990
