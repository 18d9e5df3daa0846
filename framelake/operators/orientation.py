"""Orientations as quaternions: distances, nearest states, clusters.

A state is a list of quaternions, one per slot: rows ``frame, slot, w, x, y, z``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from framelake.functions.geometry import cross, dot, nearest_image, sub, unit, vec
from framelake.runtime import staged

Quat = tuple[Column, Column, Column, Column]


def quat(suffix: str = "") -> Quat:
    return tuple(F.col(f"{k}{suffix}") for k in "wxyz")


def product(p: Quat, q: tuple) -> Quat:
    a, b, c, d = p
    e, f, g, h = q
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


_THIRD = tuple((math.cos(math.radians(60 * n)), 0.0, 0.0, math.sin(math.radians(60 * n))) for n in range(3))


def canonical_c3(df: DataFrame) -> DataFrame:
    """Of a quaternion and its turns by 120 and 240 degrees about z, the one of greatest abs(w); ties keep the earlier."""
    turned = [quat(), *(product(quat(), tuple(F.lit(v) for v in r)) for r in _THIRD[1:])]
    size = [F.abs(t[0]) for t in turned]
    second = (size[1] > size[0]) & (size[1] >= size[2])
    third = (size[2] > size[0]) & (size[2] > size[1])
    return df.withColumns({f"_{k}": F.when(third, turned[2][i]).when(second, turned[1][i]).otherwise(turned[0][i]) for i, k in enumerate("wxyz")}).select(*[F.col(f"_{c}").alias(c) if c in "wxyz" else F.col(c) for c in df.columns])


def angle(p: Quat, q: Quat) -> Column:
    """Rotation angle between two orientations; a quaternion and its negative are the same."""
    overlap = F.abs(sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0]))
    return 2 * F.acos(F.least(F.lit(1.0), overlap))


def angle_c3(p: Quat, q: Quat) -> Column:
    """The least angle over turns of the second by thirds about its z."""
    return F.least(*[angle(p, product(q, tuple(F.lit(v) for v in r))) for r in _THIRD])


def state_distances(states: DataFrame, references: DataFrame) -> DataFrame:
    """``frame, ref, distance``: root mean square angle, slot by slot. References: ``ref, slot, w, x, y, z``, a short list."""
    b = references.select("ref", "slot", *[F.col(k).alias(f"{k}_r") for k in "wxyz"])
    both = states.join(F.broadcast(b), "slot").withColumn("a", angle(quat(), quat("_r")))
    out = both.groupBy("frame", "ref").agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("distance"))
    return out


def check_slots(states: DataFrame, references: DataFrame) -> None:
    """Raise where states and references have different numbers of slots."""
    sizes = [sorted(r[0] for r in df.groupBy(k).agg(F.count("*").alias("n")).select("n").distinct().collect()) for df, k in ((states, "frame"), (references, "ref"))]
    if len(set(map(tuple, sizes))) != 1 or len(sizes[0]) != 1:
        raise ValueError(f"states have {sizes[0]} slots, references {sizes[1]}")


def nearest_state(states: DataFrame, references: DataFrame, threshold: float | None = None, permute: bool = False) -> DataFrame:
    """``frame, state, distance``: the nearest reference, 1-based by ``ref`` + 1 with a threshold beyond which it is 0.

    Without a threshold ``state`` is ``ref``. Ties go to the smaller reference.
    """
    d = permuted_distances(states, references) if permute else state_distances(states, references)
    best = d.groupBy("frame").agg(F.min(F.struct("distance", "ref")).alias("b")).select("frame", F.col("b.ref").alias("ref"), F.col("b.distance").alias("distance"))
    if threshold is None:
        return best.withColumnRenamed("ref", "state")
    return best.select("frame", F.when(F.col("distance") > threshold, 0).otherwise(F.col("ref") + 1).cast("int").alias("state"), "distance")


def permuted_distances(states: DataFrame, references: DataFrame) -> DataFrame:
    """``frame, ref, distance``: least root mean square of C3 angles over all orders of the slots.

    The matrix of squared angles is an array per (frame, reference). For up to four slots every
    order is one sum of its entries; beyond, the assignment is solved on each matrix.
    """
    n = references.groupBy("ref").count().agg(F.max("count")).first()[0] or 0
    b = references.select("ref", F.col("slot").alias("slot_r"), *[F.col(k).alias(f"{k}_r") for k in "wxyz"])
    both = states.crossJoin(F.broadcast(b)).withColumn("a", angle_c3(quat(), quat("_r")))  # references: a short list
    rank = F.struct("slot", "slot_r", (F.col("a") * F.col("a")).alias("v"))
    m = both.groupBy("frame", "ref").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda r: r["v"]).alias("m"))
    if n <= 4:
        sums = [sum((F.col("m")[i * n + j] for i, j in enumerate(p) if i), F.col("m")[p[0]]) for p in itertools.permutations(range(n))]
        return m.select("frame", "ref", F.sqrt((F.least(*sums) if len(sums) > 1 else sums[0]) / n).alias("distance"))

    @F.pandas_udf("double")
    def assigned(matrices: pd.Series) -> pd.Series:
        out = np.empty(len(matrices))
        for lo in range(0, len(out), 1000):
            costs = np.stack([np.asarray(x, float).reshape(n, n) for x in matrices.iloc[lo : lo + 1000]])
            out[lo : lo + 1000] = np.sqrt(least_assignments(costs)[0] / n)
        return pd.Series(out)

    return m.select("frame", "ref", assigned("m").alias("distance"))


def least_assignments(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least sums of one entry per row and column, the column of each row) of many square matrices at once.

    Rows are taken in turn; the shortest augmenting path to a free column is found under reduced costs, which
    stay non-negative. So a matrix takes n**3 steps, and each step runs over all matrices side by side.
    """
    if not np.isfinite(costs).all():
        raise ValueError("a matrix of costs has entries that are no finite numbers")
    many, n, _ = costs.shape
    every = np.arange(many)
    row_price, column_price = np.zeros((many, n + 1)), np.zeros((many, n + 1))
    row_of = np.full((many, n + 1), n)  # of each column; n: free. The last column stands for the row to place
    for row in range(n):
        row_of[:, n] = row
        at, nearest = np.full(many, n), np.full((many, n), np.inf)
        before, taken = np.full((many, n), n), np.zeros((many, n + 1), bool)
        busy = np.ones(many, bool)
        while busy.any():
            b = every[busy]
            taken[b, at[b]] = True
            own = row_of[b, at[b]]
            reduced = costs[b, own] - row_price[b, own][:, None] - column_price[b, :n]
            shorter = (reduced < nearest[b]) & ~taken[b, :n]
            nearest[b] = np.where(shorter, reduced, nearest[b])
            before[b] = np.where(shorter, at[b][:, None], before[b])
            open_ = np.where(taken[b, :n], np.inf, nearest[b])
            to = open_.argmin(1)
            step = open_[np.arange(len(b)), to]
            raised = np.zeros((len(b), n + 1))
            np.put_along_axis(raised, row_of[b], np.where(taken[b], step[:, None], 0.0), 1)
            raised[:, n] = 0.0
            row_price[b] += raised
            column_price[b] -= np.where(taken[b], step[:, None], 0.0)
            nearest[b] -= np.where(taken[b, :n], 0.0, step[:, None])
            at[b] = to
            busy[b] = row_of[b, to] < n
        back = np.ones(many, bool)
        while back.any():
            b = every[back]
            come = before[b, at[b]]
            row_of[b, at[b]] = row_of[b, come]
            at[b] = come
            back[b] = come < n
    column = np.empty((many, n), np.int64)
    np.put_along_axis(column, row_of[:, :n], np.broadcast_to(np.arange(n), (many, n)), 1)
    return np.take_along_axis(costs, column[:, :, None], 2)[:, :, 0].sum(1), column


def initial_centroids(states: DataFrame, k: int) -> DataFrame:
    """State number ``(i * n) / k`` of the n frames in order, for i below k."""
    frames = staged(states.select("frame").distinct())
    n = frames.count()
    wanted = frames.sparkSession.createDataFrame([(i, i * n // k) for i in range(k)], "ref int, at long")
    numbered = _numbered(frames)
    chosen = numbered.join(F.broadcast(wanted), "at").select("frame", "ref")
    return states.join(F.broadcast(chosen), "frame").select("ref", "slot", "w", "x", "y", "z")


def _numbered(frames: DataFrame) -> DataFrame:
    """Frames with their place in order (``at``, from 0), by counts of ranges of frame numbers."""
    part = F.floor(F.col("frame") / 4096).alias("_p")
    sizes = frames.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_p", before.alias("_first"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy("frame")) - 1
    return frames.withColumn("_p", part).join(firsts, "_p").select("frame", (F.col("_first") + inner).alias("at"))


def update_centroids(states: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """New centroids: sums of members turned to the side of their old centroid, normalised; empty ones stay.

    Turning every member to its centroid rather than to the running sum makes the result independent
    of the order of frames, so partial sums combine; for clusters narrower than a right angle the
    two agree.
    """
    old = F.broadcast(centroids.select(F.col("ref").alias("state"), "slot", *[F.col(k).alias(f"{k}_r") for k in "wxyz"]))
    rows = states.join(assigned.select("frame", "state"), "frame").join(old, ["state", "slot"])
    overlap = sum((F.col(k) * F.col(f"{k}_r") for k in "xyz"), F.col("w") * F.col("w_r"))
    side = F.when(overlap < 0, -1.0).otherwise(1.0)
    sums = rows.groupBy("state", "slot").agg(*[F.sum(side * F.col(k)).alias(k) for k in "wxyz"])
    size = F.sqrt(sum((F.col(k) * F.col(k) for k in "xyz"), F.col("w") * F.col("w")))
    new = sums.where(size > 0).select(F.col("state").alias("ref"), "slot", *[(F.col(k) / size).alias(f"{k}_n") for k in "wxyz"])
    return centroids.join(new, ["ref", "slot"], "left").select("ref", "slot", *[F.coalesce(f"{k}_n", k).alias(k) for k in "wxyz"])


def k_means(states: DataFrame, k: int = 3, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids ``ref, slot, w, x, y, z``; assignment ``frame, state, distance``) when one more step moves no centroid.

    Equal assignments alone are not enough, as members may still turn to the other side of a centroid
    and move it. The number of steps grows with the states, so it has no bound unless ``steps`` sets
    one; what still changes after those, or comes back to earlier centroids without settling, is an
    error. Centroids, ``k`` rows a slot, pass through the driver; states do not.

    Steps are first taken over packed states, without a shuffle (``_settled``); those that decide come after.
    """
    spark = states.sparkSession
    centroids = initial_centroids(states, k)
    schema = centroids.schema
    rows, taken = _settled(states, centroids.collect(), steps)
    seen = set()
    for _ in itertools.count() if steps is None else range(steps + 1 - taken):
        centroids = spark.createDataFrame(rows, schema)
        new = update_centroids(states, nearest_state(states, centroids), centroids).collect()
        old = {(r.ref, r.slot): r[2:] for r in rows}
        if all(abs(u - v) <= 1e-9 for r in new for u, v in zip(r[2:], old[r.ref, r.slot], strict=True)):  # sums in another order differ by less
            return staged(centroids), staged(nearest_state(states, centroids))
        mark = tuple(sorted((r.ref, r.slot, *(round(v, 12) for v in r[2:])) for r in new))
        if mark in seen:
            raise RuntimeError("k-means comes back to earlier centroids without settling")
        seen.add(mark)
        rows = new
    raise RuntimeError(f"k-means still changes after {steps} steps")


#: Rows of states in a block.
PACKED_ROWS = 65_536


def _packed(states: DataFrame, slots: list) -> DataFrame:
    """States in blocks of some ``PACKED_ROWS`` rows, a frame in one block: numbers of frames and slots, and quaternions, as bytes."""
    blocks = math.ceil(states.count() / PACKED_ROWS)
    dealt = states.select(F.pmod(F.xxhash64("frame"), F.lit(max(1, blocks))).alias("_block"), "frame", "slot", *"wxyz")

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        who = np.unique(df["frame"], return_inverse=True)[1]
        return pd.DataFrame({"who": [who.astype(np.int32).tobytes()], "slot": [np.searchsorted(slots, df["slot"]).astype(np.int32).tobytes()], "q": [df[list("wxyz")].to_numpy(np.float64).tobytes()]})

    return dealt.where(F.col("slot").isin(slots)).groupBy("_block").applyInPandas(pack, "who binary, slot binary, q binary")


def _block_sums(who: np.ndarray, slot: np.ndarray, q: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Sums by centroid and slot of quaternions turned to the side of their frame's nearest centroid (``refs``: centroid, slot, component)."""
    overlap = np.einsum("nc,rnc->rn", q, refs[:, slot])
    angles = 2 * np.arccos(np.minimum(1.0, np.abs(overlap)))
    away = np.stack([np.bincount(who, a * a) for a in angles]) / np.bincount(who)
    state = np.sqrt(away).argmin(0)[who]
    turned = q * np.where(overlap[state, np.arange(len(q))] < 0, -1.0, 1.0)[:, None]
    cell = state * refs.shape[1] + slot
    return np.stack([np.bincount(cell, t, refs.shape[0] * refs.shape[1]) for t in turned.T], axis=1)


def _settled(states: DataFrame, rows: list, steps: int | None) -> tuple[list, int]:
    """Centroids after at most ``steps`` steps, or where a step moves none (or leads back), and the number of steps.

    A step is a pass over packed states, which sums in its tasks; a row a centroid and slot of each block meets in the driver.
    Centroids that have not the same slots, or numbers that are none, are left to ``update_centroids``.
    """
    refs, slots = sorted({r.ref for r in rows}), sorted({r.slot for r in rows})
    at = {(r.ref, r.slot): [r.w, r.x, r.y, r.z] for r in rows}
    if not rows or len(at) < len(refs) * len(slots) or len(at) < len(rows) or any(v is None for q in at.values() for v in q):
        return rows, 0
    bad = " or ".join(f"{c} is null or isnan({c})" for c in "wxyz")
    if states.where(f"frame is null or slot is null or {bad}").limit(1).count():
        return rows, 0
    held = staged(_packed(states, slots))
    centroids, seen, taken = np.array([[at[r, s] for s in slots] for r in refs]), set(), 0
    while steps is None or taken < steps:

        def sums(blocks: Iterator[pd.DataFrame], refs: np.ndarray = centroids) -> Iterator[pd.DataFrame]:
            for df in blocks:
                for b in df.itertuples():
                    found = _block_sums(np.frombuffer(b.who, np.int32), np.frombuffer(b.slot, np.int32), np.frombuffer(b.q).reshape(-1, 4), refs)
                    yield pd.DataFrame({"at": np.arange(len(found)), **{k: found[:, i] for i, k in enumerate("wxyz")}})

        made = held.mapInPandas(sums, "at int, w double, x double, y double, z double")
        total = np.zeros((centroids.shape[0] * centroids.shape[1], 4))
        for r in sorted(made.collect()):
            total[r.at] += r[1:]
        total, size = total.reshape(centroids.shape), np.linalg.norm(total, axis=1).reshape(centroids.shape[:2])[..., None]
        new = np.where(size > 0, total / np.where(size > 0, size, 1.0), centroids)
        still, mark = (np.abs(new - centroids) <= 1e-9).all(), np.round(new, 12).tobytes()
        if still or mark in seen:
            break
        seen.add(mark)
        centroids, taken = new, taken + 1
    ends = {(r, s): centroids[i, j].tolist() for i, r in enumerate(refs) for j, s in enumerate(slots)}
    return [Row(ref=r.ref, slot=r.slot, **dict(zip("wxyz", ends[r.ref, r.slot], strict=True))) for r in rows], taken


def carbonate_orientations(atoms: DataFrame) -> DataFrame:
    """``frame, mol_index, w, x, y, z``: orientation of each group of one C and three O.

    The O are taken in order of their angle about C in the plane of x and y; z is the group's normal
    (turned up), x points from C to the first O. Degenerate groups have the identity. A molecule of
    other atoms is an error. One row of three vectors is gathered per molecule.
    """
    c = atoms.where("element = 'C'").select("frame", "mol_index", *[F.col(k).alias(f"{k}_c") for k in "xyz"], *(["cell"] if "cell" in atoms.columns else []))
    o = atoms.where("element = 'O'").select("frame", "mol_index", "x", "y", "z")
    shape = atoms.groupBy("frame", "mol_index").agg(F.sum((F.col("element") == "C").cast("int")).alias("c"), F.sum((F.col("element") == "O").cast("int")).alias("o"), F.count("*").alias("n"))
    if shape.where("c <> 1 or o <> 3 or n <> 4").limit(1).count():
        raise ValueError("a carbonate is one C and three O")
    both = o.join(c, ["frame", "mol_index"])
    d = nearest_image(sub(vec(), vec(suffix="_c")), F.col("cell") if "cell" in atoms.columns else None)
    rows = both.select("frame", "mol_index", F.struct(F.atan2(d[1], d[0]).alias("turn"), *[v.alias(k) for k, v in zip("xyz", d, strict=True)]).alias("o"))
    g = rows.groupBy("frame", "mol_index").agg(F.array_sort(F.collect_list("o")).alias("o"))
    v = [tuple(F.col("o")[i][k] for k in "xyz") for i in range(3)]
    g = g.withColumns({f"n{k}": e for k, e in zip("xyz", cross(sub(v[1], v[0]), sub(v[2], v[0])), strict=True)} | {f"p{k}": e for k, e in zip("xyz", v[0], strict=True)}).drop("o")
    size = F.sqrt(dot(vec("n"), vec("n")))
    up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0) / size
    g = g.withColumn("bad", size < 1e-6).withColumns({f"z{k}": F.col(f"n{k}") * up for k in "xyz"})
    along = dot(vec("p"), vec("z"))
    g = g.withColumns({f"x{k}": F.col(f"p{k}") - along * F.col(f"z{k}") for k in "xyz"})
    g = g.withColumn("bad", F.col("bad") | (F.sqrt(dot(vec("x"), vec("x"))) < 1e-6))
    g = g.withColumns({f"u{k}": e for k, e in zip("xyz", unit(vec("x")), strict=True)})
    g = g.withColumns({f"v{k}": e for k, e in zip("xyz", cross(vec("z"), vec("u")), strict=True)})
    q = from_axes(vec("u"), vec("v"), vec("z"))
    return g.select("frame", "mol_index", *[F.when(F.coalesce("bad", F.lit(True)), i).otherwise(e).alias(k) for k, e, i in zip("wxyz", q, (1.0, 0.0, 0.0, 0.0), strict=True)])


def from_axes(x, y, z) -> Quat:
    """Quaternion of the rotation whose matrix has the three unit vectors as columns."""
    m = [[x[i], y[i], z[i]] for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]
    s = [F.sqrt(F.greatest(F.lit(0.0), 1 + t)) for t in (trace, m[0][0] - m[1][1] - m[2][2], m[1][1] - m[0][0] - m[2][2], m[2][2] - m[0][0] - m[1][1])]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    forms = [(s[0] / 2, a / (2 * s[0]), b / (2 * s[0]), c / (2 * s[0])), (a / (2 * s[1]), s[1] / 2, d / (2 * s[1]), e / (2 * s[1])), (b / (2 * s[2]), d / (2 * s[2]), s[2] / 2, f / (2 * s[2])), (c / (2 * s[3]), e / (2 * s[3]), f / (2 * s[3]), s[3] / 2)]
    top = F.greatest(*s)
    return tuple(F.when(s[0] == top, forms[0][i]).when(s[1] == top, forms[1][i]).when(s[2] == top, forms[2][i]).otherwise(forms[3][i]) for i in range(4))


def describe(centroids: DataFrame) -> DataFrame:
    """``ref, slot, rotation, tilt`` in degrees: turn about z (120 added where negative) and lean of the axis."""
    turn = F.degrees(2 * F.atan2(F.col("z"), F.col("w")))
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 2 * (F.col("x") ** 2 + F.col("y") ** 2)))))
    return centroids.select("ref", "slot", F.when(turn < 0, turn + 120).otherwise(turn).alias("rotation"), tilt.alias("tilt"))
