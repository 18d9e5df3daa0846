"""Registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import workload
from framelake.operators import aggregates, generate, grids, links, orientation, pairs, selection, spectral, topology, transforms, unwrap
from framelake.operators.selection import select, select_entities
from framelake.runtime import staged
from framelake.sources import frame_index, grid_files, trajectories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- pieces of SQL -------------------------------------------------------------------------------

ATOMS = """atoms AS MATERIALIZED (SELECT CAST(vec_id % 4 AS BIGINT) AS frame, CAST(vec_id // 4 AS BIGINT) AS atom_index,
  'T' || CAST(label AS VARCHAR) AS type, CAST(label AS DOUBLE) - 4.5 AS charge, CAST(label AS DOUBLE) + 1.0 AS mass,
  CAST(label AS DOUBLE) * 0.01 + 0.2 AS radius, label,
  (CAST(embedding[1] AS DOUBLE) + 0.5) * 10.0 AS x, (CAST(embedding[2] AS DOUBLE) + 0.5) * 10.0 AS y,
  (CAST(embedding[3] AS DOUBLE) + 0.5) * 10.0 AS z FROM embeddings)"""
IMAGE = "({0} - 10.0 * floor({0} / 10.0 + 0.5))"


def _pairs_sql(left: str = "atoms", right: str = "atoms", where: str = "a.atom_index < b.atom_index", cutoff: float = 0.5, extra: str = "") -> str:
    d = [IMAGE.format(f"(a.{k} - b.{k})") for k in "xyz"]
    r2 = " + ".join(f"{v} * {v}" for v in d)
    return f"SELECT a.frame AS frame, a.atom_index AS i, b.atom_index AS j, {r2} AS r2{extra} FROM {left} a JOIN {right} b ON a.frame = b.frame AND {where} WHERE {r2} <= {cutoff * cutoff}"


BONDS = f"""{ATOMS}, cand AS MATERIALIZED ({_pairs_sql(cutoff=0.65, extra=', a.radius + b.radius + 0.05 AS reach, a.type AS ti, b.type AS tj')}),
bonds AS MATERIALIZED (SELECT frame, i, j, sqrt(r2) AS length FROM cand WHERE sqrt(r2) <= reach),
adj AS (SELECT frame, i AS c, j AS e FROM bonds UNION ALL SELECT frame, j, i FROM bonds)"""
COMPONENTS = f"""{BONDS}, reach(frame, atom, other) AS (SELECT frame, atom_index, atom_index FROM atoms UNION
  SELECT r.frame, r.atom, a.e FROM reach r JOIN adj a ON a.frame = r.frame AND a.c = r.other),
comp AS (SELECT frame, atom AS atom_index, min(other) AS component FROM reach GROUP BY ALL),
members AS (SELECT frame, atom_index, component, CAST(dense_rank() OVER (PARTITION BY frame ORDER BY component) - 1 AS BIGINT) AS mol_index FROM comp),
prints AS (SELECT m.frame, m.mol_index, string_agg(a.type, ',' ORDER BY a.type) AS fingerprint, count(*) AS n_atoms, min(m.atom_index) AS first_atom
  FROM members m JOIN atoms a USING (frame, atom_index) GROUP BY ALL),
firsts AS (SELECT frame, fingerprint, min(mol_index) AS f FROM prints GROUP BY ALL),
ranks AS (SELECT frame, fingerprint, 'M' || CAST(dense_rank() OVER (PARTITION BY frame ORDER BY f) AS VARCHAR) AS mol_type FROM firsts),
kinds AS (SELECT p.frame, p.mol_index, r.mol_type, CAST(row_number() OVER (PARTITION BY p.frame, p.fingerprint ORDER BY p.mol_index) AS INT) AS subindex,
  p.fingerprint, CAST(p.n_atoms AS BIGINT) AS n_atoms, p.first_atom FROM prints p JOIN ranks r USING (frame, fingerprint))"""
STATES = "st AS (SELECT user_id AS traj, ts, event_id, event_type AS state, value AS distance FROM events)"
QUAT = """qs AS (SELECT CAST(vec_id // 3 AS BIGINT) AS frame, CAST(vec_id % 3 AS INT) AS slot, CAST(embedding[1] AS DOUBLE) / s AS w, CAST(embedding[2] AS DOUBLE) / s AS x,
  CAST(embedding[3] AS DOUBLE) / s AS y, CAST(embedding[4] AS DOUBLE) / s AS z FROM (SELECT *, sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2
  + CAST(embedding[3] AS DOUBLE) ** 2 + CAST(embedding[4] AS DOUBLE) ** 2) AS s FROM embeddings)),
refs AS (SELECT CAST(frame AS INT) AS ref, slot, w AS w_r, x AS x_r, y AS y_r, z AS z_r FROM qs WHERE frame < 3)"""
POSITIONS = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z"


def register(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


SETTINGS = topology.TopologySettings(tolerance=0.05)


def _bonds(spark, d, **settings) -> DataFrame:
    return topology.detect_bonds(workload.atoms(spark, d), topology.TopologySettings(tolerance=0.05, **settings))


def _staged_bonds(spark, d) -> DataFrame:
    return staged(_bonds(spark, d))


def _links(spark, d, images: bool = False) -> DataFrame:
    """Bonds from which the molecules of all bonds follow, and with ``images`` their moves to whole molecules."""
    return staged(links.linking_bonds(workload.atoms(spark, d), topology.TopologySettings(tolerance=0.05), images))


def _impropers(spark, d) -> DataFrame:
    return topology.impropers_of(links.few_neighbours(workload.atoms(spark, d), topology.TopologySettings(tolerance=0.05), 3))


def _molecular(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms with molecule columns, molecule types, members), the molecules being those of the detected bonds."""
    a = workload.atoms(spark, d)
    members = staged(topology.molecules(_links(spark, d), a))
    kinds = staged(topology.molecule_types(members, a))
    named = a.join(members, ["frame", "atom_index"]).join(kinds.select("frame", "mol_index", "mol_type"), ["frame", "mol_index"])
    return named, kinds, members


# --- scans, selections, transforms ---------------------------------------------------------------


@register("SELECT event_id AS frame, user_id, event_type FROM events WHERE event_id >= 10 AND event_id < 9000 AND (event_id - 10) % 7 = 0")
def slice_frames(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("frame"), "user_id", "event_type")
    return transforms.slice_frames(ev, *transforms.parse_slice("10:9000:7"))


@register("SELECT event_id AS frame, user_id, event_type FROM events WHERE event_id >= 10 AND (event_id - 10) % 7 = 0")
def slice_frames_open(spark, d):
    """The slice without an end, so that it grows with the table."""
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("frame"), "user_id", "event_type")
    return transforms.slice_frames(ev, *transforms.parse_slice("10::7"))


@register(f"WITH {ATOMS} SELECT frame, atom_index, type FROM atoms WHERE type IN ('T0', 'T3') OR atom_index BETWEEN 5 AND 20 OR atom_index = 2")
def sel_type_union(spark, d):
    return select(workload.atoms(spark, d), "aT0,T3,i2,5-20", strict=True).select("frame", "atom_index", "type")


@register(f"WITH {ATOMS} SELECT frame, atom_index FROM atoms WHERE (type IN ('T1', 'T2') AND z > 4.5) OR (type = 'T5' AND x <= 4.0 AND NOT y < 5.0)")
def sel_bool_position(spark, d):
    return select(workload.atoms(spark, d), "(aT1,T2 and z > 4.5) or aT5 and x <= 4.0 and not y < 5").select("frame", "atom_index")


@register(f"WITH {ATOMS} SELECT frame, atom_index FROM atoms WHERE NOT (type = 'T7' OR x > 5.0)")
def sel_not(spark, d):
    return select(workload.atoms(spark, d), "NOT (aT7 OR x > 5.0)").select("frame", "atom_index")


@register(f"WITH {ATOMS}, m AS (SELECT DISTINCT atom_index FROM atoms WHERE frame = 0 AND type IN ('T0', 'T1')) SELECT frame, atom_index, type FROM atoms SEMI JOIN m USING (atom_index)")
def sel_static_membership(spark, d):
    return selection.select_static(workload.atoms(spark, d), "aT0,T1").select("frame", "atom_index", "type")


@register(
    f"WITH RECURSIVE {COMPONENTS}, com AS (SELECT m.frame, m.mol_index, sum(a.mass * a.x) / sum(a.mass) AS x, sum(a.mass * a.z) / sum(a.mass) AS z, count(*) AS n FROM members m JOIN atoms a USING (frame, atom_index) GROUP BY ALL) "
    "SELECT frame, mol_index, kinds.mol_type, round(x, 6) AS x, round(z, 6) AS z FROM com JOIN kinds USING (frame, mol_index) WHERE (kinds.mol_type IN ('M1', 'M2') OR mol_index BETWEEN 3 AND 40) AND z > 4.4"
)
def sel_molecule_com(spark, d):
    named, _, _ = _molecular(spark, d)
    s = selection.compile_selection("mM1,M2,j3-40 and z > 4.4")
    return _rounded(selection.molecules_of(named).where(s.column).select("frame", "mol_index", "mol_type", "x", "z"))


@register(f"WITH {ATOMS} SELECT frame, atom_index, round(CASE WHEN type = 'T4' THEN x + 1.5 ELSE x END, 6) AS x, round(CASE WHEN type = 'T4' THEN y - 0.5 ELSE y END, 6) AS y, round(CASE WHEN type = 'T4' THEN z + 2.0 ELSE z END, 6) AS z FROM atoms")
def translate_sel(spark, d):
    return _rounded(workload.atoms(spark, d).transform(transforms.translate(1.5, -0.5, 2.0, "aT4")).select("frame", "atom_index", "x", "y", "z"))


@register(f"WITH {ATOMS} SELECT frame, atom_index, round((x - 5) * cos(radians(30.0)) - (y - 4) * sin(radians(30.0)) + 5, 6) AS x, round((x - 5) * sin(radians(30.0)) + (y - 4) * cos(radians(30.0)) + 4, 6) AS y, round(z, 6) AS z FROM atoms")
def rotate_origin(spark, d):
    return _rounded(workload.atoms(spark, d).transform(transforms.rotate(30, "z", (5, 4, 0))).select("frame", "atom_index", "x", "y", "z"))


@register(f"WITH {ATOMS} SELECT frame, atom_index, CASE WHEN x < 5.0 THEN -1.0 WHEN type = 'T1' THEN 0.5 ELSE charge END AS charge FROM atoms")
def set_charge_pairs(spark, d):
    return workload.atoms(spark, d).transform(transforms.set_column("charge", [0.5, -1.0], ["aT1", "x < 5.0"])).select("frame", "atom_index", "charge")


@register(f"WITH {ATOMS} SELECT frame, atom_index, CASE WHEN type = 'T1' THEN 'A' WHEN type = 'T2' THEN 'B' ELSE type END AS type, CASE WHEN type = 'T1' THEN 'LIG' ELSE 'UNK' END AS mol_type, round(x + CASE WHEN type = 'T1' THEN 0.25 ELSE 0 END, 6) AS x FROM atoms")
def set_types(spark, d):
    a = workload.atoms(spark, d).withColumn("mol_type", F.lit("UNK"))
    steps = [*transforms.modify(move=(0.25, 0, 0), selections=["aT1"]), transforms.set_column("mol_type", ["LIG"], ["aT1"]), transforms.set_column("type", ["A", "B"], ["aT1", "aT2"])]
    return _rounded(transforms.pipeline(a, steps).select("frame", "atom_index", "type", "mol_type", "x"))


@register(f"WITH {ATOMS} SELECT frame, atom_index, " + ", ".join(f"round(({k} + 7.0) - 10.0 * floor(({k} + 7.0) / 10.0), 6) AS {k}" for k in "xyz") + " FROM atoms")
def wrap_atomic(spark, d):
    return _rounded(transforms.pipeline(workload.atoms(spark, d), [transforms.translate(7, 7, 7), transforms.wrap_atoms()]).select("frame", "atom_index", "x", "y", "z"))


@register(
    f"WITH RECURSIVE {COMPONENTS}, com AS (SELECT m.frame, m.mol_index, " + ", ".join(f"sum(a.mass * (a.{k} + 7.0)) / sum(a.mass) AS c{k}" for k in "xyz") + " FROM members m JOIN atoms a USING (frame, atom_index) GROUP BY ALL) "
    "SELECT m.frame, m.atom_index, " + ", ".join(f"round(a.{k} + 7.0 - 10.0 * floor(c{k} / 10.0), 6) AS {k}" for k in "xyz") + " FROM members m JOIN atoms a USING (frame, atom_index) JOIN com USING (frame, mol_index)"
)
def wrap_molecular(spark, d):
    named, _, _ = _molecular(spark, d)
    return _rounded(transforms.pipeline(named, [transforms.translate(7, 7, 7), transforms.wrap_molecules()]).select("frame", "atom_index", "x", "y", "z"))


# Images of all atoms of a molecule that bonds lead to from its least atom, up to two cells away; a second image of one atom makes it endless.
_IMAGES = f"""{COMPONENTS}, mv AS (SELECT b.frame, b.i, b.j, {", ".join(f"CAST(-floor((q.{k} - p.{k}) / 10.0 + 0.5) AS INT) AS d{k}" for k in "xyz")} FROM bonds b JOIN atoms p ON p.frame = b.frame AND p.atom_index = b.i JOIN atoms q ON q.frame = b.frame AND q.atom_index = b.j),
bm AS (SELECT * FROM mv UNION ALL SELECT frame, j, i, -dx, -dy, -dz FROM mv), im(frame, root, atom, sx, sy, sz) AS (SELECT DISTINCT frame, component, component, 0, 0, 0 FROM comp UNION
  SELECT im.frame, im.root, bm.j, im.sx + bm.dx, im.sy + bm.dy, im.sz + bm.dz FROM im JOIN bm ON bm.frame = im.frame AND bm.i = im.atom WHERE greatest(abs(im.sx + bm.dx), abs(im.sy + bm.dy), abs(im.sz + bm.dz)) <= 2),
endless AS (SELECT frame, root, count(*) <> count(DISTINCT atom) AS infinite FROM im GROUP BY ALL),
whole AS (SELECT a.frame, a.atom_index, a.mass, a.type, e.infinite, {", ".join(f"a.{k} + CASE WHEN e.infinite THEN 0 ELSE 10.0 * im.s{k} END AS {k}" for k in "xyz")} FROM atoms a JOIN im ON im.frame = a.frame AND im.atom = a.atom_index JOIN endless e ON e.frame = im.frame AND e.root = im.root WHERE NOT e.infinite OR (im.sx, im.sy, im.sz) = (0, 0, 0))"""


_MOMENTS = f"""{_IMAGES}, wm AS (SELECT w.frame, m.mol_index, w.mass AS m, w.x, w.y, w.z FROM (SELECT DISTINCT frame, atom_index, mass, x, y, z FROM whole) w JOIN members m USING (frame, atom_index)),
cm AS (SELECT frame, mol_index, count(*) AS n_atoms, sum(m) AS mass, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM wm GROUP BY ALL),
mm AS (SELECT frame, mol_index, n_atoms, mass, {", ".join(f"sum(m * ({p} - c{p}) * ({q} - c{q})) AS {p + q}" for p, q in ("xx", "yy", "zz", "xy", "xz", "yz"))} FROM wm JOIN cm USING (frame, mol_index) GROUP BY ALL)"""


@register(
    f"WITH RECURSIVE {_MOMENTS}, s AS (SELECT *, xx + yy + zz AS tr, (yy + zz) * (xx + zz) + (yy + zz) * (xx + yy) + (xx + zz) * (xx + yy) - xy * xy - xz * xz - yz * yz AS minors, "
    "(yy + zz) * ((xx + zz) * (xx + yy) - yz * yz) - xy * (xy * (xx + yy) + yz * xz) - xz * (xy * yz + (xx + zz) * xz) AS det FROM mm) "
    "SELECT frame, mol_index, n_atoms, mass, round(2 * tr, 4) AS trace, round(minors, 3) AS minors, round(det, 2) AS det FROM s"
)
def inertia_invariants(spark, d):
    """Principal moments by the three invariants that they have in common with the tensor: sum, sum of products, product."""
    a, b = workload.atoms(spark, d), _links(spark, d, images=True)
    named = unwrap.whole_molecules(a, b).join(staged(topology.molecules(b, a)), ["frame", "atom_index"])
    m = aggregates.molecule_moments(named)
    i, j, k = (F.col(f"i_{n}") for n in (1, 2, 3))
    return m.select("frame", "mol_index", "n_atoms", "mass", F.round(i + j + k, 4).alias("trace"), F.round(i * j + i * k + j * k, 3).alias("minors"), F.round(i * j * k, 2).alias("det"))


@register(f"WITH RECURSIVE {_IMAGES} SELECT DISTINCT frame, atom_index, {POSITIONS}, infinite FROM whole")
def whole_molecules(spark, d):
    made = unwrap.whole_molecules(workload.atoms(spark, d), _links(spark, d, images=True))
    return _rounded(made.select("frame", "atom_index", "x", "y", "z", "infinite"))


# --- pairs and radial distributions --------------------------------------------------------------


@register(f"WITH {ATOMS}, p AS ({_pairs_sql(cutoff=1.0)}) SELECT frame, i, j, round(r2, 6) AS r2 FROM p")
def pairs_self(spark, d):
    p = pairs.neighbour_pairs(workload.atoms(spark, d), None, 1.0)
    return _rounded(p.select("frame", F.col("atom_index_1").alias("i"), F.col("atom_index_2").alias("j"), "r2"))


@register(f"WITH {ATOMS}, p AS ({_pairs_sql('(SELECT * FROM atoms WHERE label <= 4)', '(SELECT * FROM atoms WHERE label >= 3)', 'a.atom_index <> b.atom_index', 1.2)}) SELECT frame, i, j, round(r2, 6) AS r2 FROM p")
def pairs_cross(spark, d):
    a = workload.atoms(spark, d)
    p = pairs.neighbour_pairs(select(a, "aT0,T1,T2,T3,T4"), select(a, "aT3,T4,T5,T6,T7,T8,T9"), 1.2)
    return _rounded(p.select("frame", F.col("atom_index_1").alias("i"), F.col("atom_index_2").alias("j"), "r2"))


@register(f"WITH {ATOMS}, p AS ({_pairs_sql('(SELECT * FROM atoms WHERE label = 0)', '(SELECT * FROM atoms WHERE label > 0)', 'true', 0.9)}) SELECT DISTINCT frame, i AS atom_index FROM p")
def clash_probe(spark, d):
    a = workload.atoms(spark, d)
    return pairs.clashes(select(a, "aT0"), select(a, "not aT0"), 0.9).select("frame", "atom_index")


@register(f"WITH {ATOMS} SELECT frame, 'atom' AS kind, atom_index AS id, CAST(type IN ('T0', 'T1') AS INT) + CAST(x < 5.0 AS INT) AS lists FROM atoms WHERE type IN ('T0', 'T1') OR x < 5.0")
def entity_union(spark, d):
    a = workload.atoms(spark, d)
    both = pairs.union_entities(select_entities(a, "aT0,T1"), select_entities(a, "x < 5.0"))
    return both.select("frame", "kind", "id", F.size("in_lists").cast("int").alias("lists"))


def _rdf_sql(sets: str, cutoff: float, bins: int) -> str:
    d = [IMAGE.format(f"(a.{k} - b.{k})") for k in "xyz"]
    r2 = " + ".join(f"{v} * {v}" for v in d)
    w = cutoff / bins
    return f"""{sets}, n1 AS (SELECT frame, count(*) AS n1 FROM s1 GROUP BY ALL), n2 AS (SELECT frame, count(*) AS n2 FROM s2 GROUP BY ALL),
fr AS (SELECT * FROM n1 JOIN n2 USING (frame)), nf AS (SELECT count(*) AS nf FROM fr),
h AS (SELECT frame, CAST(floor(sqrt(r2) / {w!r}) AS INT) AS bin, count(*) AS n FROM (SELECT a.frame, {r2} AS r2 FROM s1 a JOIN s2 b ON a.frame = b.frame AND a.id <> b.id) WHERE r2 < {cutoff * cutoff!r} GROUP BY ALL),
g AS (SELECT bin, sum(n / (4 * pi() / 3 * (pow((bin + 0.5) * {w!r} + {w / 2!r}, 3) - pow((bin + 0.5) * {w!r} - {w / 2!r}, 3))) / (n1 * n2 / 1000.0)) / max(nf) AS gofr, sum(n) / max(nf) AS nofr FROM h JOIN fr USING (frame), nf GROUP BY ALL)
SELECT CAST(b.bin AS INT) AS bin, round((b.bin + 0.5) * {w!r}, 6) AS r, round(coalesce(gofr, 0.0), 6) AS gofr, round(coalesce(nofr, 0.0), 6) AS nofr FROM range({bins}) b(bin) LEFT JOIN g ON g.bin = b.bin"""


@register("WITH " + _rdf_sql(f"{ATOMS}, s1 AS (SELECT *, atom_index AS id FROM atoms WHERE label < 2), s2 AS (SELECT *, atom_index AS id FROM atoms WHERE label >= 1)", 4.0, 100))
def rdf(spark, d):
    a = workload.atoms(spark, d)
    return _rounded(aggregates.rdf(select_entities(a, "aT0,T1"), select_entities(a, "not aT0"), 4.0, 100))


@register(
    "WITH RECURSIVE "
    + _rdf_sql(f"{COMPONENTS}, s1 AS (SELECT m.frame, m.mol_index AS id, " + ", ".join(f"sum(a.mass * a.{k}) / sum(a.mass) AS {k}" for k in "xyz") + " FROM members m JOIN atoms a USING (frame, atom_index) GROUP BY ALL), s2 AS (SELECT * FROM s1 WHERE z > 5.0)", 3.0, 30)
)
def rdf_molecules(spark, d):
    named, _, _ = _molecular(spark, d)
    named = staged(named)
    return _rounded(aggregates.rdf(select_entities(named, "j0-1000000000"), select_entities(named, "j0-1000000000 and z > 5.0"), 3.0, 30))


# --- topology ------------------------------------------------------------------------------------


@register(f"WITH {BONDS} SELECT frame, i, j, round(length, 6) AS length FROM bonds")
def bonds(spark, d):
    return _rounded(_bonds(spark, d))


@register(f"WITH {BONDS}, no AS (SELECT frame, atom_index FROM atoms WHERE type = 'T3' OR x > 6.0) SELECT b.frame, b.i, b.j FROM bonds b WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.frame = b.frame AND no.atom_index IN (b.i, b.j))")
def bonds_no_bond(spark, d):
    return _bonds(spark, d, no_bond="aT3 or x > 6.0").select("frame", "i", "j")


@register(
    f"WITH {BONDS} SELECT frame, i, j FROM cand WHERE sqrt(r2) <= reach AND NOT (((ti IN ('T1', 'T2') AND tj = 'T3') OR (tj IN ('T1', 'T2') AND ti = 'T3')) AND sqrt(r2) >= 0.4) AND NOT (ti = 'T5' AND tj = 'T5' AND sqrt(r2) <= 0.3)"
)
def bonds_criteria(spark, d):
    rules = [topology.BondCriterion.parse(t) for t in ("aT1,T2&aT3<0.4", "aT5&aT5>0.3")]
    return _bonds(spark, d, criteria=rules).select("frame", "i", "j")


@register(f"WITH {BONDS} SELECT p.frame, p.e AS i, p.c AS centre, q.e AS k FROM adj p JOIN adj q ON p.frame = q.frame AND p.c = q.c AND p.e < q.e")
def angles(spark, d):
    return topology.detected_angles(workload.atoms(spark, d), SETTINGS)


PROPERS = "SELECT DISTINCT b.frame, p.e AS i, b.i AS j, b.j AS k, q.e AS l FROM bonds b JOIN adj p ON p.frame = b.frame AND p.c = b.i AND p.e <> b.j JOIN adj q ON q.frame = b.frame AND q.c = b.j AND q.e <> b.i"
IMPROPERS = "SELECT frame, c AS i, list_sort(list(e))[1] AS j, list_sort(list(e))[2] AS k, list_sort(list(e))[3] AS l FROM adj GROUP BY frame, c HAVING count(*) = 3"


@register(f"WITH {BONDS} {PROPERS}")
def propers(spark, d):
    return topology.detected_dihedrals(workload.atoms(spark, d), SETTINGS)


@register(f"WITH {BONDS} {IMPROPERS}")
def impropers(spark, d):
    out = _impropers(spark, d)
    return out.select("frame", *[F.col(c).cast("long").alias(c) for c in "ijkl"])


@register(f"WITH {BONDS} SELECT DISTINCT p.frame, p.c AS start, q.e AS atom FROM adj p JOIN adj q ON p.frame = q.frame AND p.e = q.c WHERE q.e <> p.c AND NOT EXISTS (SELECT 1 FROM adj x WHERE x.frame = p.frame AND x.c = p.c AND x.e = q.e)")
def khop2(spark, d):
    return topology.detected_second_neighbours(workload.atoms(spark, d), SETTINGS)


@register(f"WITH RECURSIVE {COMPONENTS} SELECT frame, atom_index, mol_index FROM members")
def components(spark, d):
    return _molecular(spark, d)[2].select("frame", "atom_index", "mol_index")


@register(f"WITH RECURSIVE {COMPONENTS} SELECT frame, mol_index, mol_type, subindex, fingerprint, n_atoms, first_atom FROM kinds")
def moltypes(spark, d):
    return _molecular(spark, d)[1]


@register(f"WITH {BONDS}, pr AS ({PROPERS}) SELECT frame, 'dihedral ' || i || '-' || j || '-' || k || '-' || l || ' repeats an atom' AS issue FROM pr WHERE i = l")
def topo_issues(spark, d):
    return topology.detected_issues(workload.atoms(spark, d), SETTINGS)


@register(f"WITH {BONDS} SELECT a.frame, a.atom_index, CAST(count(e) AS BIGINT) AS degree, coalesce(string_agg(CAST(e AS VARCHAR), ',' ORDER BY e), '') AS partners FROM atoms a LEFT JOIN adj ON adj.frame = a.frame AND adj.c = a.atom_index GROUP BY ALL")
def topo_connectivity(spark, d):
    c = topology.detected_connectivity(workload.atoms(spark, d), topology.TopologySettings(tolerance=0.05))
    return c.select("frame", "atom_index", F.col("degree").cast("long").alias("degree"), F.array_join(F.col("partners").cast("array<string>"), ",").alias("partners"))


@register(
    f"WITH {BONDS}, an AS (SELECT p.frame, count(*) AS n FROM adj p JOIN adj q ON p.frame = q.frame AND p.c = q.c AND p.e < q.e GROUP BY ALL), pr AS (SELECT frame, count(*) AS n FROM ({PROPERS}) GROUP BY ALL), im AS (SELECT frame, count(*) AS n FROM ({IMPROPERS}) GROUP BY ALL), "
    "na AS (SELECT frame, count(*) AS n FROM atoms GROUP BY ALL), nb AS (SELECT frame, count(*) AS n FROM bonds GROUP BY ALL) SELECT na.frame, na.n AS atoms, coalesce(nb.n, 0) AS bonds, coalesce(an.n, 0) AS angles, coalesce(pr.n, 0) AS propers, coalesce(im.n, 0) AS impropers FROM na LEFT JOIN nb USING (frame) LEFT JOIN an USING (frame) LEFT JOIN pr USING (frame) LEFT JOIN im USING (frame)"
)
def topo_counts(spark, d):
    return topology.counts(workload.atoms(spark, d), _staged_bonds(spark, d))


def _diff(a: str, b: str) -> str:
    return ", ".join(IMAGE.format(f"({a}.{k} - {b}.{k})") + f" AS {k}" for k in "xyz")


@register(
    f"WITH {BONDS}, an AS (SELECT p.frame, p.e AS i, p.c AS centre, q.e AS k FROM adj p JOIN adj q ON p.frame = q.frame AND p.c = q.c AND p.e < q.e), "
    + "v AS (SELECT an.*, " + ", ".join(IMAGE.format(f"(c.{k} - a.{k})") + f" AS u{k}, " + IMAGE.format(f"(c.{k} - b.{k})") + f" AS v{k}" for k in "xyz")
    + " FROM an JOIN atoms a ON a.frame + 10 * a.atom_index = an.frame + 10 * an.i JOIN atoms c ON c.frame + 10 * c.atom_index = an.frame + 10 * an.centre JOIN atoms b ON b.frame + 10 * b.atom_index = an.frame + 10 * an.k) "
    "SELECT frame, i, centre, k, round(acos(greatest(-1.0, least(1.0, (ux * vx + uy * vy + uz * vz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz))))), 4) AS theta FROM v"
)
def angle_values(spark, d):
    return _rounded(topology.detected_angle_values(workload.atoms(spark, d), SETTINGS), 4)


_JOIN4 = " ".join(f"JOIN atoms {n} ON {n}.frame + 10 * {n}.atom_index = q.frame + 10 * q.{c}" for n, c in (("ai", "i"), ("aj", "j"), ("ak", "k"), ("al", "l")))
_B = ", ".join(f"{IMAGE.format(f'({a}.{k} - {b}.{k})')} AS {n}{k}" for n, a, b in (("p", "ai", "aj"), ("r", "aj", "ak"), ("s", "ak", "al")) for k in "xyz")
_CROSS = lambda n, u, v: f"{u}y * {v}z - {u}z * {v}y AS {n}x, {u}z * {v}x - {u}x * {v}z AS {n}y, {u}x * {v}y - {u}y * {v}x AS {n}z"


@register(
    f"WITH {BONDS}, q AS MATERIALIZED ({PROPERS}), v AS MATERIALIZED (SELECT q.*, {_B} FROM q {_JOIN4} WHERE q.i <> q.l), n AS MATERIALIZED (SELECT *, {_CROSS('m', 'p', 'r')}, {_CROSS('n', 'r', 's')} FROM v), c AS MATERIALIZED (SELECT *, {_CROSS('c', 'm', 'n')} FROM n) "
    "SELECT frame, i, j, k, l, round(atan2((rx * cx + ry * cy + rz * cz) / sqrt(rx * rx + ry * ry + rz * rz), mx * nx + my * ny + mz * nz), 4) AS phi FROM c"
)
def dihedral_values(spark, d):
    return _rounded(topology.detected_dihedral_values(workload.atoms(spark, d), SETTINGS), 4)


_BI = ", ".join(f"{IMAGE.format(f'({a}.{k} - {b}.{k})')} AS {n}{k}" for n, a, b in (("p", "ai", "aj"), ("r", "ai", "ak"), ("s", "ai", "al")) for k in "xyz")


@register(
    f"WITH {BONDS}, q AS MATERIALIZED ({IMPROPERS}), v0 AS MATERIALIZED (SELECT q.*, {_BI} FROM q {_JOIN4}), v AS MATERIALIZED (SELECT *, rx - px AS ux, ry - py AS uy, rz - pz AS uz, sx - px AS wx, sy - py AS wy, sz - pz AS wz FROM v0), n AS MATERIALIZED (SELECT *, {_CROSS('n', 'u', 'w')} FROM v) "
    "SELECT frame, i, j, k, l, round(abs(px * nx + py * ny + pz * nz) / sqrt(nx * nx + ny * ny + nz * nz), 4) AS distance FROM n"
)
def improper_values(spark, d):
    return _rounded(topology.improper_values(_impropers(spark, d), workload.atoms(spark, d)).select("frame", *[F.col(c).cast("long").alias(c) for c in "ijkl"], "distance"), 4)


@register(
    "WITH s AS (SELECT user_id AS traj, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame FROM events), k AS (SELECT * FROM s WHERE frame >= 3 AND frame % 2 = 1) "
    "SELECT traj, frame, CAST(floor((frame + 1) / 4) AS BIGINT) AS epoch, coalesce(last_value(CASE WHEN (frame + 1) % 4 = 0 THEN frame END IGNORE NULLS) OVER w, first_value(frame) OVER w) AS anchor FROM k WINDOW w AS (PARTITION BY traj ORDER BY frame ROWS UNBOUNDED PRECEDING)"
)
def topo_epoch(spark, d):
    from pyspark.sql import Window

    st = workload.states(spark, d).select("traj", (F.row_number().over(Window.partitionBy("traj").orderBy("ts", "event_id")) - 1).cast("long").alias("frame"))
    kept = transforms.slice_frames(st, 3, -1, 2)
    return topology.anchor_frames(kept, 4, keys=("traj",)).select("traj", "frame", topology.epoch(F.col("frame"), 4).alias("epoch"), "anchor")


@register(
    f"WITH RECURSIVE {BONDS}, path(frame, start, tip, ring) AS (SELECT frame, c, e, [c, e] FROM adj WHERE e > c UNION ALL SELECT p.frame, p.start, a.e, list_append(p.ring, a.e) FROM path p JOIN adj a ON a.frame = p.frame AND a.c = p.tip WHERE a.e > p.start AND NOT list_contains(p.ring, a.e) AND len(p.ring) < 6) "
    "SELECT p.frame, array_to_string(p.ring, '-') AS ring FROM path p JOIN adj a ON a.frame = p.frame AND a.c = p.tip AND a.e = p.start WHERE len(p.ring) > 2 AND p.ring[2] < p.tip"
)
def rings(spark, d):
    return topology.cycles(_staged_bonds(spark, d), 6, text=True)


# Walks of up to seven bonds from one end of a bond to the other without that bond; the shortest has no detour.
_RING_SIZES = f"""{BONDS}, walk(frame, i, j, node, d) AS (SELECT frame, i, j, i, 0 FROM bonds UNION
  SELECT w.frame, w.i, w.j, a.e, w.d + 1 FROM walk w JOIN adj a ON a.frame = w.frame AND a.c = w.node WHERE w.d < 7 AND w.node <> w.j AND NOT (a.c = w.i AND a.e = w.j)),
sizes AS (SELECT frame, i, j, CAST(min(d) + 1 AS INT) AS size FROM walk WHERE node = j GROUP BY ALL)"""


@register(f"WITH RECURSIVE {_RING_SIZES} SELECT frame, i, j, size FROM sizes")
def ring_sizes(spark, d):
    return topology.detected_ring_sizes(workload.atoms(spark, d), SETTINGS)


@register(
    f"""WITH RECURSIVE {_RING_SIZES}, el AS (SELECT frame, atom_index, list_extract(['C', 'C', 'C', 'N', 'O', 'H', 'S', 'P', 'Si', 'Fe'], label + 1) AS e FROM atoms),
r AS (SELECT frame, i AS a FROM sizes UNION SELECT frame, j FROM sizes), nb AS (SELECT adj.frame, adj.c, count(*) AS n, count(*) FILTER (el.e = 'O') AS no, count(*) FILTER (el.e = 'Si') AS nsi FROM adj JOIN el ON el.frame = adj.frame AND el.atom_index = adj.e GROUP BY ALL),
v AS (SELECT el.frame, el.atom_index, e, coalesce(n, 0) AS n, coalesce(no, 0) AS no, coalesce(nsi, 0) AS nsi, r.a IS NOT NULL AS ring FROM el LEFT JOIN nb ON nb.frame = el.frame AND nb.c = el.atom_index LEFT JOIN r ON r.frame = el.frame AND r.a = el.atom_index),
p AS (SELECT *, CASE WHEN n > 4 THEN n WHEN abs(5 - n) > 2 THEN n - 1 ELSE n + ceil((5 - n) / 2) END AS p, CASE WHEN no = 3 THEN 2 WHEN n > 4 THEN n WHEN abs(6 - n) > 2 THEN n - 1 ELSE n + ceil((6 - n) / 2) END AS s FROM v)
SELECT frame, atom_index, coalesce(CASE e WHEN 'H' THEN 'H_' WHEN 'C' THEN CASE n WHEN 2 THEN 'C_1' WHEN 3 THEN CASE WHEN ring THEN 'C_R' ELSE 'C_2' END WHEN 4 THEN 'C_3' END
  WHEN 'N' THEN CASE WHEN n = 1 THEN 'N_1' WHEN n IN (2, 3, 4) AND ring THEN 'N_R' WHEN n = 2 THEN 'N_2' WHEN n IN (3, 4) THEN 'N_3' END
  WHEN 'O' THEN CASE WHEN n = 1 THEN 'O_2' WHEN n = 2 AND ring THEN 'O_R' WHEN n = 2 AND nsi > 0 THEN 'O_3_z' WHEN n = 2 THEN 'O_3' END
  WHEN 'P' THEN CASE p WHEN 5 THEN 'P_3+5' WHEN 4 THEN 'P_3+q' ELSE 'P_3+3' END
  WHEN 'S' THEN CASE WHEN s = 1 THEN 'S_2' WHEN s = 2 AND ring THEN 'S_R' WHEN s = 4 THEN 'S_3+4' WHEN s = 6 THEN 'S_3+6' ELSE 'S_3+2' END
  WHEN 'Si' THEN 'Si3' WHEN 'Fe' THEN CASE n WHEN 6 THEN 'Fe6+2' ELSE 'Fe3+2' END END, 'UNKNOWN') AS uff FROM p"""
)
def uff_types(spark, d):
    a = workload.atoms(spark, d).withColumn("element", F.element_at(F.array(*[F.lit(e) for e in ("C", "C", "C", "N", "O", "H", "S", "P", "Si", "Fe")]), F.substring("type", 2, 2).cast("int") + 1))
    return topology.detected_uff_types(a, SETTINGS)


# --- aggregates ----------------------------------------------------------------------------------


@register(f"WITH {ATOMS} SELECT type, count(*) AS n, sum(mass) AS mass FROM atoms WHERE frame = 0 GROUP BY ALL")
def composition(spark, d):
    return aggregates.composition(workload.atoms(spark, d))


@register(f"WITH {ATOMS} SELECT frame, count(*) AS n, sum(mass) AS mass, round(sum(mass) / 1000.0 * 1.6605388, 6) AS mass_density, round(count(*) / 1000.0, 6) AS number_density FROM atoms GROUP BY ALL")
def density(spark, d):
    return _rounded(aggregates.densities(workload.atoms(spark, d)))


@register(
    f"WITH RECURSIVE {COMPONENTS}, each AS (SELECT m.frame, m.mol_index, sum(a.mass) AS mass FROM members m JOIN atoms a USING (frame, atom_index) GROUP BY ALL), "
    "r AS (SELECT frame, mol_type, fingerprint, count(*) AS n, max(n_atoms) AS atoms_per_molecule, arg_max(mass, mol_index) AS molar_mass, max(mol_index) AS representative, sum(mass) AS mass FROM kinds JOIN each USING (frame, mol_index) GROUP BY ALL) "
    "SELECT frame, mol_type, fingerprint, n, atoms_per_molecule, molar_mass, representative, round(n / 1000.0 * 1660.5388, 4) AS concentration, round(100 * mass / sum(mass) OVER (PARTITION BY frame), 4) AS mass_percent FROM r"
)
def moltype_report(spark, d):
    a, kinds, members = _molecular(spark, d)
    out = aggregates.molecule_report(kinds, members, workload.atoms(spark, d))
    return _rounded(out, 4, "concentration", "mass_percent")


@register(
    "WITH c AS (SELECT l_orderkey AS frame, max(l_quantity) AS a, max(l_extendedprice) / 1000 AS b, 1.0 + max(l_linenumber) AS c FROM lineitem GROUP BY ALL) SELECT round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(c), 6) AS c, 90.0 AS alpha, 90.0 AS beta, 90.0 AS gamma, round(avg(a * b * c), 4) AS volume, count(*) AS frames FROM c"
)
def cell_mean(spark, d):
    from framelake.functions.geometry import cell_from_parameters

    right = F.lit(90.0)
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("frame")).agg(F.max("l_quantity").alias("a"), (F.max("l_extendedprice") / 1000).alias("b"), (1.0 + F.max("l_linenumber")).alias("c"))
    frames = li.select("frame", cell_from_parameters(F.col("a"), F.col("b"), F.col("c"), right, right, right).alias("cell"))
    out = aggregates.cell_means(frames)
    return out.withColumns({**{k: F.round(k, 6) for k in ("a", "b", "c", "alpha", "beta", "gamma")}, "volume": F.round("volume", 4)})


@register(f"WITH {ATOMS} SELECT frame, " + ", ".join(f"round({f}({k}), 6) AS {f}_{k}" for k in "xyz" for f in ("min", "max")) + " FROM atoms GROUP BY ALL")
def bounding_box(spark, d):
    return _rounded(aggregates.bounding_box(workload.atoms(spark, d)))


_DIPOLE = ", ".join(f"sum(q * {k}) AS m{k}" for k in "xyz")
_CHARGES = "ch AS (SELECT l_orderkey AS frame, l_discount - l_tax AS q, l_quantity AS x, l_extendedprice / 1000 AS y, CAST(l_suppkey AS DOUBLE) AS z FROM lineitem)"


@register(f"WITH {_CHARGES}, f AS (SELECT frame, {_DIPOLE}, sum(q) AS charge FROM ch GROUP BY ALL) SELECT frame, round(mx, 4) AS mx, round(my, 4) AS my, round(mz, 4) AS mz, round(charge, 6) AS charge FROM f")
def dipole_frames(spark, d):
    out = aggregates.dipoles(workload.charges(spark, d))
    return _rounded(_rounded(out, 4, "mx", "my", "mz"), 6, "charge")


@register(
    f"WITH {_CHARGES}, f AS (SELECT frame, {_DIPOLE}, sum(q) AS charge FROM ch GROUP BY ALL), m AS (SELECT avg(mx) AS mx, avg(my) AS my, avg(mz) AS mz, avg(charge) AS charge, count(*) AS frames FROM f) "
    "SELECT round(mx, 4) AS mx, round(my, 4) AS my, round(mz, 4) AS mz, round(charge, 6) AS charge, frames, round(sqrt(mx * mx + my * my + mz * mz), 4) AS magnitude, round(sqrt(mx * mx + my * my + mz * mz) * 4.8032, 3) AS debye FROM m"
)
def dipole_mean(spark, d):
    out = aggregates.mean_dipole(aggregates.dipoles(workload.charges(spark, d)))
    return _rounded(_rounded(_rounded(out, 4, "mx", "my", "mz", "magnitude"), 6, "charge"), 3, "debye")


@register(f"WITH {STATES}, n AS (SELECT state, count(*) AS n FROM st GROUP BY ALL) SELECT state, n, round(100.0 * n / (SELECT count(*) FROM st), 6) AS percent FROM n")
def occupancy(spark, d):
    return _rounded(aggregates.occupancy(workload.states(spark, d)))


@register(f"WITH {STATES}, o AS (SELECT *, lag(state) OVER (PARTITION BY traj ORDER BY ts, event_id) AS p FROM st) SELECT traj, event_id, p AS from_state, state AS to_state FROM o WHERE p <> state")
def transitions(spark, d):
    return aggregates.transitions(workload.states(spark, d), order=("ts", "event_id")).select("traj", "event_id", "from_state", "to_state")


@register(
    f"WITH {STATES} SELECT state, count(*) AS n, round(avg(distance), 6) AS mean, min(distance) AS least, (arg_min(struct_pack(e := event_id), struct_pack(d := distance, e := event_id))).e AS least_frame, max(distance) AS most, (arg_min(struct_pack(e := event_id), struct_pack(d := -distance, e := event_id))).e AS most_frame FROM st GROUP BY ALL"
)
def quality(spark, d):
    return _rounded(aggregates.quality(workload.states(spark, d), ("state",), frame="event_id"), 6, "mean")


# --- grids ---------------------------------------------------------------------------------------


def _spread_sql(n: int, values: str, centred: bool, keys: str = "frame") -> str:
    """Order-two spreading: weight 1 - f to the point below... the spline of order two peaks at one."""
    add = (n - 1) / 2 if centred else 0.0
    w = ", ".join(f"({k} / 10.0 - floor({k} / 10.0)) * {n} + {add!r} AS w{k}" for k in "xyz")
    pts = "sp AS (SELECT *, " + w + " FROM pt), ko AS (SELECT * FROM (VALUES (0), (1)) t(k)), ex AS (SELECT sp.*, "
    pts += ", ".join(f"CAST((floor(w{c}) - {t}.k + {n}) % {n} AS INT) AS i{a}, CASE WHEN {t}.k = 0 THEN w{c} - floor(w{c}) ELSE 1 - (w{c} - floor(w{c})) END AS m{t}" for c, a, t in (("x", "a", "ka"), ("y", "b", "kb"), ("z", "c", "kc")))
    return pts + f" FROM sp, ko ka, ko kb, ko kc), gr AS (SELECT {keys}{', ' if keys else ''}ia, ib, ic, {values} FROM ex WHERE mka * mkb * mkc <> 0 GROUP BY ALL)"


@register(f"WITH {ATOMS}, pt AS (SELECT * FROM atoms), {_spread_sql(8, 'sum(charge * mka * mkb * mkc) AS q', True)} SELECT frame, ia, ib, ic, round(q, 5) AS q FROM gr")
def charge_spread(spark, d):
    return _rounded(grids.spread(workload.atoms(spark, d), {"q": F.col("charge")}, (8, 8, 8), 2, centred=True), 5)


@register(
    f"WITH RECURSIVE {COMPONENTS}, pt AS (SELECT m.frame, m.mol_index, " + ", ".join(f"sum(a.mass * a.{k}) / sum(a.mass) AS {k}, sum(a.charge * a.{k}) - sum(a.charge) * sum(a.mass * a.{k}) / sum(a.mass) AS d{k}" for k in "xyz") + " FROM members m JOIN atoms a USING (frame, atom_index) GROUP BY ALL), "
    + _spread_sql(6, ", ".join(f"sum(d{k} * mka * mkb * mkc) / 4 AS m{k}" for k in "xyz"), False, "") + " SELECT ia, ib, ic, round(mx, 4) AS mx, round(my, 4) AS my, round(mz, 4) AS mz, round(sqrt(mx * mx + my * my + mz * mz), 4) AS magnitude FROM gr"
)
def polarisation_grid(spark, d):
    named, _, _ = _molecular(spark, d)
    out = grids.polarisation_grid(staged(grids.molecular_dipoles(named)), (6, 6, 6), 2)
    return out.select("ia", "ib", "ic", *[F.round(c, 4).alias(c) for c in ("mx", "my", "mz", "magnitude")])


def _pme_sql(n: int = 12, beta: float = 0.6) -> str:
    """The potential of charges spread by cubic splines, by direct sums over wave numbers, an axis a step."""
    spline = "CASE WHEN u < 1 THEN u * u * u / 6 WHEN u < 2 THEN (-3 * u * u * u + 12 * u * u - 12 * u + 4) / 6 WHEN u < 3 THEN (3 * u * u * u - 24 * u * u + 60 * u - 44) / 6 ELSE (4 - u) * (4 - u) * (4 - u) / 6 END"
    axes = "".join(f", w{a} AS (SELECT frame, atom_index, ({k} / 10.0 - floor({k} / 10.0)) * {n} + {(n - 1) / 2!r} AS w FROM atoms), m{a} AS (SELECT frame, atom_index, CAST((floor(w) - j + {n}) % {n} AS INT) AS i{a}, {spline} AS m{a} FROM (SELECT *, w - floor(w) + j AS u FROM w{a}, j))" for a, k in zip("abc", "xyz"))
    steps, at, cols = [], "mesh", ["ia", "ib", "ic"]
    for sign, names in ((-1, ("kc", "kb", "ka")), (1, ("ic", "ib", "ia"))):
        for new in names:
            old = ("i" if new[0] == "k" else "k") + new[1]
            rest = [c for c in cols if c != old]
            turn = f"(2 * pi() * ({old} * t.v % {n}) / {n})"
            kept = ", ".join([*rest, f"t.v AS {new}"])
            steps.append(f"{new}s AS (SELECT {kept}, sum(re * cos{turn} - {sign} * im * sin{turn}) AS re, sum(im * cos{turn} + {sign} * re * sin{turn}) AS im FROM {at}, t GROUP BY ALL)")
            at, cols = f"{new}s", [*rest, new]
            if new == "ka":
                factor = " * ".join(f"pow((4 + 2 * cos(2 * pi() * k{a} / {n})) / 6, -2)" for a in "abc")
                steps.append(f"k2s AS (SELECT *, ({' + '.join(f'pow(k{a} - CASE WHEN 2 * k{a} >= {n} THEN {n} ELSE 0 END, 2)' for a in 'abc')}) * pow(2 * pi() / 10, 2) AS k2 FROM kas)")
                green = f"CASE WHEN k2 = 0 THEN 0 ELSE 4 * pi() * {grids.KE} / 1000 * exp(-k2 / {4 * beta * beta!r}) / k2 * {factor} END"
                steps.append(f"gs AS (SELECT ka, kb, kc, re * {green} AS re, im * {green} AS im FROM k2s)")
                at = "gs"
    return f"""WITH {ATOMS}, t AS (SELECT CAST(i AS INT) AS v FROM range({n}) r(i)), j AS (SELECT CAST(i AS INT) AS j FROM range(4) r(i)){axes},
mesh AS (SELECT ia, ib, ic, sum(charge * ma * mb * mc) AS re, 0.0 AS im FROM atoms JOIN ma USING (frame, atom_index) JOIN mb USING (frame, atom_index) JOIN mc USING (frame, atom_index) GROUP BY ALL), {", ".join(steps)}
SELECT ia, ib, ic, round(re / 4, 4) AS value FROM ias"""


@register(_pme_sql())
def pme_potential(spark, d):
    return _rounded(grids.pme_potential(workload.atoms(spark, d), (12, 12, 12), 0.6, 4), 4)


@register(_pme_sql())
def pme_pencils(spark, d):
    """The same potential with no task that holds the mesh."""
    return _rounded(grids.pme_potential(workload.atoms(spark, d), (12, 12, 12), 0.6, 4, dense=0), 4)


@register(
    f"WITH {ATOMS}, g AS (SELECT CAST(i // 36 AS INT) AS ia, CAST(i // 6 % 6 AS INT) AS ib, CAST(i % 6 AS INT) AS ic FROM range(216) t(i)), p AS (SELECT ia, ib, ic, charge, " + ", ".join(IMAGE.format(f"(i{c} * 10.0 / 6 - {k})") + f" AS d{k}" for c, k in zip("abc", "xyz")) + " FROM g, atoms), "
    "s AS (SELECT ia, ib, ic, sum(14.3996 * charge / sqrt(dx * dx + dy * dy + dz * dz)) / 4 AS v FROM p WHERE dx * dx + dy * dy + dz * dz <= 6.25 AND dx * dx + dy * dy + dz * dz >= 1e-10 GROUP BY ALL) SELECT g.ia, g.ib, g.ic, round(coalesce(v, 0.0), 4) AS value FROM g LEFT JOIN s USING (ia, ib, ic)"
)
def realspace_potential(spark, d):
    return _rounded(grids.realspace_potential(workload.atoms(spark, d), (6, 6, 6), 2.5), 4)


@register(
    f"WITH {ATOMS}, pt AS (SELECT * FROM atoms), {_spread_sql(10, 'sum(charge * mka * mkb * mkc) AS q', False, '')}, r AS (SELECT CAST(i AS INT) - 2 AS v FROM range(5) t(i)), o AS (SELECT a.v AS da, b.v AS db, c.v AS dc FROM r a, r b, r c WHERE (a.v, b.v, c.v) <> (0, 0, 0)) "
    "SELECT CAST((ia + da + 10) % 10 AS INT) AS ia, CAST((ib + db + 10) % 10 AS INT) AS ib, CAST((ic + dc + 10) % 10 AS INT) AS ic, round(sum(14.3996 * q / sqrt(da * da + db * db + dc * dc) / 4), 4) AS value FROM gr, o GROUP BY ALL"
)
def gridspread_potential(spark, d):
    return _rounded(grids.gridspread_potential(workload.atoms(spark, d), (10, 10, 10), 2, 2), 4)


@register(
    f"WITH {ATOMS}, r AS (SELECT CAST(i AS INT) - 2 AS v FROM range(5) t(i)), w AS (SELECT a.v AS h, b.v AS k, c.v AS l FROM r a, r b, r c WHERE (a.v, b.v, c.v) <> (0, 0, 0)), "
    "s AS (SELECT frame, h, k, l, sum(charge * cos(2 * pi() * (h * x + k * y + l * z) / 10.0)) AS re, sum(charge * sin(2 * pi() * (h * x + k * y + l * z) / 10.0)) AS im FROM atoms, w GROUP BY ALL), "
    "t AS (SELECT *, (h * h + k * k + l * l) * pow(2 * pi() / 10.0, 2) AS k2 FROM s) SELECT frame, round(sum(2 * pi() / 1000.0 * exp(-k2 / (4 * 0.16)) / k2 * (re * re + im * im)), 4) AS energy FROM t GROUP BY ALL"
)
def ewald_energy(spark, d):
    return _rounded(grids.ewald_reciprocal(workload.atoms(spark, d), 0.4, 2), 4)


_EWALD = (0.8, 5.0, 1e-7)  # beta, cutoff, tolerance


def _ewald_sql(beta: float, cutoff: float, tolerance: float) -> str:
    """Real part by the power series of the error function, reciprocal part over all wave vectors."""
    largest = 2 * beta * math.sqrt(-math.log(tolerance))
    most = int(largest * 10 / (2 * math.pi) + 1e-9)
    series = "list_sum(list_transform(range(90), lambda n: pow(-1, n) * exp((2 * n + 1) * ln(b) - lgamma(n + 1)) / (2 * n + 1)))"
    pairs = _pairs_sql(cutoff=cutoff, extra=", a.charge * b.charge AS qq")
    return f"""WITH {ATOMS}, pr AS ({pairs}), br AS (SELECT frame, qq, sqrt(r2) AS r, {beta} * sqrt(r2) AS b FROM pr),
re AS (SELECT frame, sum(qq * (1 - 2 / sqrt(pi()) * {series}) / r) AS real FROM br GROUP BY frame),
v AS (SELECT CAST(i AS INT) - {most} AS v FROM range({2 * most + 1}) t(i)), w AS (SELECT a.v AS h, b.v AS k, c.v AS l, (a.v * a.v + b.v * b.v + c.v * c.v) * pow(2 * pi() / 10.0, 2) AS k2 FROM v a, v b, v c WHERE (a.v, b.v, c.v) <> (0, 0, 0)),
s AS (SELECT frame, h, k, l, k2, sum(charge * cos(2 * pi() * (h * x + k * y + l * z) / 10.0)) AS re, sum(charge * sin(2 * pi() * (h * x + k * y + l * z) / 10.0)) AS im FROM atoms, w WHERE k2 <= {largest * largest!r}e0 GROUP BY ALL),
rc AS (SELECT frame, sum(2 * pi() / 1000.0 * exp(-k2 / {4 * beta * beta!r}e0) / k2 * (re * re + im * im)) AS reciprocal FROM s GROUP BY frame),
o AS (SELECT frame, -{beta} / sqrt(pi()) * sum(charge * charge) AS self, -pi() / ({2 * beta * beta!r}e0 * 1000.0) * pow(sum(charge), 2) AS background FROM atoms GROUP BY frame)
SELECT frame, round(coalesce(real, 0.0), 3) AS real, round(reciprocal, 3) AS reciprocal, round(self, 3) AS self, round(background, 3) AS background, round(coalesce(real, 0.0) + reciprocal + self + background, 3) AS energy FROM o LEFT JOIN re USING (frame) LEFT JOIN rc USING (frame)"""


@register(_ewald_sql(*_EWALD))
def ewald_total(spark, d):
    return _rounded(spectral.ewald_sum(workload.atoms(spark, d), *_EWALD), 3)


_GRID = "gv AS (SELECT CAST(l_linenumber - 1 AS INT) AS ia, CAST(l_quantity AS INT) - 1 AS ib, CAST(l_suppkey % 8 AS INT) AS ic, l_extendedprice AS value FROM lineitem)"


@register(f"WITH {_GRID} SELECT ia, ib, round(avg(value), 3) AS value FROM gv GROUP BY ALL")
def grid_avg_c(spark, d):
    return _rounded(grids.average(workload.grid(spark, d), "c"), 3)


@register(f"WITH {_GRID} SELECT ic, round(avg(value), 3) AS value FROM gv GROUP BY ALL")
def grid_avg_ab(spark, d):
    return _rounded(grids.average(workload.grid(spark, d), "ab"), 3)


@register(f"WITH {_GRID}, b AS (SELECT CAST(floor((ia * 1.0 + ib * 0.5) / 0.5 + 0.5) AS INT) AS x_bin, avg(value) AS value FROM gv GROUP BY ALL) SELECT CAST(n AS INT) AS x_bin, n * 0.5 AS x, round(coalesce(value, 0.0), 3) AS value FROM range(63) t(n) LEFT JOIN b ON b.x_bin = n")
def grid_rebin_x(spark, d):
    header = grids.GridHeader((7, 51, 8), (0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.5, 1.0, 0.0), (0.0, 0.0, 1.0)))
    return _rounded(grids.reduce_axes(workload.grid(spark, d), header, "yz"), 3, "value")


# --- orientations --------------------------------------------------------------------------------


def _turn(n: int) -> str:
    c, s = orientation._THIRD[n][0], orientation._THIRD[n][3]
    return f"w * {c!r} - z * {s!r} AS w{n}, x * {c!r} + y * {s!r} AS x{n}, y * {c!r} - x * {s!r} AS y{n}, z * {c!r} + w * {s!r} AS z{n}"


@register(
    f"WITH {QUAT}, t AS (SELECT frame, slot, w AS w0, x AS x0, y AS y0, z AS z0, {_turn(1)}, {_turn(2)} FROM qs) SELECT frame, slot, "
    + ", ".join(f"round(CASE WHEN abs(w2) > abs(w0) AND abs(w2) > abs(w1) THEN {k}2 WHEN abs(w1) > abs(w0) THEN {k}1 ELSE {k}0 END, 6) AS {k}" for k in "wxyz") + " FROM t"
)
def quat_c3(spark, d):
    return _rounded(orientation.canonical_c3(workload.quaternions(spark, d)))


_ANGLE = "2 * acos(least(1.0, abs(w * w_r + x * x_r + y * y_r + z * z_r)))"


def _references(spark, d):
    return workload.quaternions(spark, d).where("frame < 3").select(F.col("frame").cast("int").alias("ref"), "slot", "w", "x", "y", "z")


@register(
    f"WITH {QUAT}, dd AS (SELECT frame, ref, sqrt(avg(({_ANGLE}) ** 2)) AS distance FROM qs JOIN refs USING (slot) GROUP BY ALL), b AS (SELECT frame, (min(struct_pack(d := distance, r := ref))) AS b FROM dd GROUP BY ALL) SELECT frame, CASE WHEN b.d > 1.8 THEN 0 ELSE b.r + 1 END AS state, round(b.d, 5) AS distance FROM b"
)
def quat_assign(spark, d):
    return _rounded(orientation.nearest_state(workload.quaternions(spark, d), _references(spark, d), 1.8), 5)


def _c3_angle(a: str, b: str) -> str:
    out = []
    for n in range(3):
        c, s = orientation._THIRD[n][0], orientation._THIRD[n][3]
        turned = {"w": f"({b}.w_r * {c!r} - {b}.z_r * {s!r})", "x": f"({b}.x_r * {c!r} + {b}.y_r * {s!r})", "y": f"({b}.y_r * {c!r} - {b}.x_r * {s!r})", "z": f"({b}.z_r * {c!r} + {b}.w_r * {s!r})"}
        out.append("2 * acos(least(1.0, abs(" + " + ".join(f"{a}.{k} * {turned[k]}" for k in "wxyz") + ")))")
    return f"least({', '.join(out)})"


@register(
    f"WITH {QUAT}, full_frames AS (SELECT frame FROM qs GROUP BY frame HAVING count(*) = 3), m AS (SELECT q.frame, r.ref, q.slot, r.slot AS rs, ({_c3_angle('q', 'r')}) ** 2 AS v FROM qs q SEMI JOIN full_frames USING (frame), refs r), "
    "p AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) t(a, b, c)), "
    "s AS (SELECT m0.frame, m0.ref, min(m0.v + m1.v + m2.v) AS v FROM p JOIN m m0 ON m0.slot = 0 AND m0.rs = p.a JOIN m m1 ON m1.frame = m0.frame AND m1.ref = m0.ref AND m1.slot = 1 AND m1.rs = p.b JOIN m m2 ON m2.frame = m0.frame AND m2.ref = m0.ref AND m2.slot = 2 AND m2.rs = p.c GROUP BY ALL) "
    "SELECT frame, ref, round(sqrt(v / 3), 5) AS distance FROM s"
)
def perm_distance(spark, d):
    q = workload.quaternions(spark, d)
    whole = q.join(q.groupBy("frame").count().where("count = 3").select("frame"), "frame", "left_semi")
    return _rounded(orientation.permuted_distances(whole, _references(spark, d)), 5)


_SIX = QUAT.replace("// 3", "// 6").replace("% 3", "% 6")
_STEPS = ["f0 AS (SELECT frame, ref, 1 << rs AS mask, v FROM m WHERE slot = 0)"] + [f"f{k} AS (SELECT frame, ref, mask | (1 << rs) AS mask, min(f.v + m.v) AS v FROM f{k - 1} f JOIN m USING (frame, ref) WHERE m.slot = {k} AND (mask >> rs) & 1 = 0 GROUP BY ALL)" for k in range(1, 6)]


@register(
    f"WITH {_SIX}, whole_frames AS (SELECT frame FROM qs GROUP BY frame HAVING count(*) = 6), m AS MATERIALIZED (SELECT q.frame, r.ref, q.slot, r.slot AS rs, ({_c3_angle('q', 'r')}) ** 2 AS v FROM qs q SEMI JOIN whole_frames USING (frame), refs r), "
    + ", ".join(_STEPS) + " SELECT frame, ref, round(sqrt(v / 6), 5) AS distance FROM f5"
)
def assignment_distance(spark, d):
    """States of six slots: the least distance over all orders, by assignment."""
    q = workload.quaternions(spark, d, 6)
    whole = q.join(q.groupBy("frame").count().where("count = 6").select("frame"), "frame", "left_semi")
    refs = q.where("frame < 3").select(F.col("frame").cast("int").alias("ref"), "slot", "w", "x", "y", "z")
    return _rounded(orientation.permuted_distances(whole, refs), 5)


@register(
    f"WITH {QUAT}, ff AS (SELECT frame FROM qs GROUP BY frame HAVING count(*) = 3), q AS (SELECT * FROM qs SEMI JOIN ff USING (frame)), dd AS (SELECT frame, ref, sqrt(avg(({_ANGLE}) ** 2)) AS distance FROM q JOIN refs USING (slot) GROUP BY ALL), "
    "b AS (SELECT frame, min(struct_pack(d := distance, r := ref)) AS b FROM dd GROUP BY ALL), "
    "m AS (SELECT refs.ref, refs.slot, q.*, CASE WHEN w * w_r + x * x_r + y * y_r + z * z_r < 0 THEN -1.0 ELSE 1.0 END AS side FROM q JOIN b USING (frame) JOIN refs ON refs.ref = b.b.r AND refs.slot = q.slot), "
    "t AS (SELECT ref, slot, sum(side * w) AS w, sum(side * x) AS x, sum(side * y) AS y, sum(side * z) AS z FROM (SELECT ref, slot, side, w, x, y, z FROM m) GROUP BY ALL) "
    "SELECT ref, slot, " + ", ".join(f"round({k} / sqrt(w * w + x * x + y * y + z * z), 5) AS {k}" for k in "wxyz") + " FROM t"
)
def quat_kmeans_step(spark, d):
    q = workload.quaternions(spark, d)
    whole = q.join(q.groupBy("frame").count().where("count = 3").select("frame"), "frame", "left_semi")
    refs = _references(spark, d)
    return _rounded(orientation.update_centroids(whole, orientation.nearest_state(whole, refs), refs), 5)


@register(
    "SELECT l_orderkey AS frame, round(2 * (max(l_quantity) * max(l_extendedprice) / 1000 + max(l_quantity) * (1.0 + max(l_linenumber)) + max(l_extendedprice) / 1000 * (1.0 + max(l_linenumber))), 5) AS surface_area, "
    "CASE WHEN abs(max(l_quantity) - max(l_extendedprice) / 1000) < 1e-6 AND abs(max(l_extendedprice) / 1000 - 1.0 - max(l_linenumber)) < 1e-6 THEN 'cubic' WHEN abs(max(l_quantity) - max(l_extendedprice) / 1000) < 1e-6 THEN 'tetragonal' ELSE 'orthorhombic' END AS cell_type FROM lineitem GROUP BY ALL"
)
def cell_geometry(spark, d):
    from framelake.functions.geometry import cell_from_parameters

    right = F.lit(90.0)
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("frame")).agg(F.max("l_quantity").alias("a"), (F.max("l_extendedprice") / 1000).alias("b"), (1.0 + F.max("l_linenumber")).alias("c"))
    cells = li.select("frame", cell_from_parameters(F.col("a"), F.col("b"), F.col("c"), right, right, right).alias("cell"))
    return _rounded(aggregates.cell_geometry(cells).select("frame", "surface_area", "cell_type"), 5)


@register()
def quat_kmeans(spark, d):
    q = workload.quaternions(spark, d)
    whole = staged(q.join(q.groupBy("frame").count().where("count = 3").select("frame"), "frame", "left_semi"))
    return _rounded(orientation.k_means(whole, 3)[1], 5)


# --- files and structures ------------------------------------------------------------------------


def _file_atoms(spark, d) -> DataFrame:
    return workload.atoms(spark, d)


def _through(spark, d, ext: str) -> DataFrame:
    """Write the atoms in a format as one file to the shared folder, and read it back in at least eight byte ranges."""
    from framelake.runtime import shared_dir

    a = staged(_file_atoms(spark, d))
    path = f"{shared_dir(spark)}.{ext}"
    trajectories.write(a, path, by_size=True)  # frames of one table may have an atom more or less
    size = sum(n for _, n in frame_index.files_of(spark, path))
    ranges = min(frame_index.RANGE_BYTES, max(1, size // 8))
    if ext in ("xyz", "pdb"):
        return trajectories.load(spark, [path], range_bytes=ranges)
    names = f"{shared_dir(spark)}.xyz"
    trajectories.write(a.where("frame = 0"), names)
    return trajectories.load(spark, [names, path], range_bytes=ranges).where("frame > 0").withColumn("frame", F.col("frame") - 1)


# Positions as each format holds them: decimals as printed, single precision, thousandths of a nanometre.


@register(f"WITH {ATOMS} SELECT frame, atom_index, type, " + ", ".join(f"CAST(printf('%.6f', {k}) AS DOUBLE) AS {k}" for k in "xyz") + " FROM atoms")
def io_xyz(spark, d):
    return _through(spark, d, "xyz").select("frame", "atom_index", "type", "x", "y", "z")


@register(f"WITH {ATOMS} SELECT frame, atom_index, type, 10.0 AS a, " + ", ".join(f"CAST(printf('%.3f', {k}) AS DOUBLE) AS {k}" for k in "xyz") + " FROM atoms")
def io_pdb(spark, d):
    return _through(spark, d, "pdb").select("frame", "atom_index", "type", F.col("cell.a").alias("a"), "x", "y", "z")


@register(f"WITH {ATOMS} SELECT frame, atom_index, " + ", ".join(f"CAST(CAST({k} AS FLOAT) AS DOUBLE) AS {k}" for k in "xyz") + " FROM atoms")
def io_dcd(spark, d):
    return _through(spark, d, "dcd").select("frame", "atom_index", "x", "y", "z")


@register(f"WITH {ATOMS} SELECT frame, atom_index, " + ", ".join(f"floor({k} / 10 * 1000.0 + 0.5) / 1000.0 * 10 AS {k}" for k in "xyz") + " FROM atoms")
def io_xtc(spark, d):
    return _through(spark, d, "xtc").select("frame", "atom_index", "x", "y", "z")


@register(f"WITH {_GRID}, g AS (SELECT ia, ib, ic, avg(value) AS value FROM gv GROUP BY ALL), f AS (SELECT CAST(i // 400 AS INT) AS ia, CAST(i // 8 % 50 AS INT) AS ib, CAST(i % 8 AS INT) AS ic FROM range(2800) t(i)) SELECT f.ia, f.ib, f.ic, CAST(round(coalesce(value, 0.0), -2) AS BIGINT) AS value FROM f LEFT JOIN g ON g.ia = f.ia AND g.ib = f.ib AND g.ic = f.ic")
def io_dx(spark, d):
    from framelake.runtime import shared_dir

    g = workload.grid(spark, d).groupBy("ia", "ib", "ic").agg(F.round(F.avg("value"), -2).alias("value"))
    header = grids.GridHeader((7, 50, 8), (0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)))
    path = f"{shared_dir(spark)}.dx"
    grid_files.write_dx(g, header, path)
    back = grid_files.read_dx(spark, path)[1]
    return back.select("ia", "ib", "ic", F.round("value").cast("long").alias("value"))


@register(f"WITH {ATOMS} SELECT frame, CAST(40 AS BIGINT) AS copies, CAST(120 AS BIGINT) AS atoms, CAST(0 AS BIGINT) AS clashes FROM atoms GROUP BY frame")
def solvate_invariants(spark, d):
    """Frames filled with water around their atoms, in domains of five copies: copies, and pairs nearer than allowed (none)."""
    water = [("O", 0.0, 0.0, 0.0), ("H", 0.96, 0.0, 0.0), ("H", -0.24, 0.927, 0.0)]
    a = workload.atoms(spark, d)
    placed = generate.solvate(a, water, [workload.EDGE], number=40, min_distance=0.5, around_existing=True, domain_copies=5)
    points = placed.select("frame", "copy", "x", "y", "z", (F.col("copy") * 10 + F.col("site")).cast("long").alias("id"), workload.CELL.column().alias("cell"))
    points = points.union(a.select("frame", (-F.col("atom_index") - 1).cast("int"), "x", "y", "z", -F.col("atom_index") - 1, "cell"))
    near = pairs.neighbour_pairs(points, None, 0.5, ident=("id",), keep=("copy",)).where("copy_1 <> copy_2 and id_2 >= 0 and r2 < 0.25 - 1e-9")
    counts = placed.groupBy("frame").agg(F.countDistinct("copy").alias("copies"), F.count("*").alias("atoms"))
    clashes = near.groupBy("frame").agg(F.count("*").alias("clashes"))
    return a.select("frame").distinct().join(counts, "frame", "left").join(clashes, "frame", "left").fillna(0)


@register(
    f"WITH {ATOMS}, s AS (SELECT atom_index, " + ", ".join(f"{k} / 10 - floor({k} / 10 + 1e-9) AS f{k}" for k in "xyz") + " FROM atoms WHERE frame = 0) "
    "SELECT atom_index, CAST(t AS BIGINT) AS layer, round(fx + fy - floor(fx + fy + 1e-9) + t, 6) AS depth, " + ", ".join(f"round(f{k}, 6) AS f{k}" for k in "xyz") + " FROM s, range(2) r(t)"
)
def surface_slab(spark, d):
    """Every atom of the unit cell comes once per spacing of the planes (1 1 0), a lattice translation from its place."""
    out = generate.slab(workload.atoms(spark, d), workload.CELL, (1, 1, 0), depth=2.0)
    from pyspark.sql import Window

    layer = (F.row_number().over(Window.partitionBy("atom_index").orderBy("depth")) - 1).cast("long")
    places = [(F.col(k) / workload.EDGE - F.floor(F.col(k) / workload.EDGE + 1e-9)).alias(f"f{k}") for k in "xyz"]
    return _rounded(out.select("atom_index", layer.alias("layer"), "depth", *places), 6)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
