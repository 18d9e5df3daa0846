"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, as near to one as the relative entropy allows, such that the words of
each source add up to its target. The solution of this convex program is an exponential tilt: the
rate of a document of x words in source s is ``exp(lambda_s * x / scale_s)``, held at the limit of
copies. The dual is solved by Newton iterations over the histogram of (source, size), as the rate
depends on nothing else; its sums are distributed, and brackets guard each step. Rates are then
rounded to whole copies: floors first, and the fractions, ordered by size, by systematic sampling,
which keeps a source's words within about one document of its target. A last pass trades single
documents of fitting size for what is still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import fresh, join_lookup, staged

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
STEPS = 100  #: Newton steps beyond which a source is taken not to converge, which is an error
SPREAD = 4  #: candidates for the last pass from each size octave of a source


def n_words(text: Column) -> Column:
    """Words (runs of characters other than \\x20 and \\x09-\\x0D) of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from rows (source, source_size), one per source.

    Sources in order of their names (null last) weigh ``weights``, repeating, and share the sum of
    all sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above. Sources are ordered by the level at which they stop; the level of
    the rest follows from sums over that order.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(behind), F.lit(0.0))
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(behind), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - full) / left  # if all sources before this one stop
    rows = rows.withColumn("level", level)
    level = F.max("level").over(everything)  # it rises up to the first source that does not stop, then falls
    return rows.withColumn("target", F.least(F.col("cap"), level * F.col("w"))).select("source", "source_size", "target")


def _rate(size: Column, most: int) -> Column:
    """Rate of a document: the exponential tilt, at most ``most``."""
    tilt = F.exp(F.least(F.col("tilt") * size / F.col("scale"), F.lit(50.0)))
    return F.when(F.col("target") >= F.col("cap"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilt))


def solve(histogram: DataFrame, wanted: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """``(source, target, cap, scale, tilt)``: the dual solution for each source.

    ``histogram`` has (source, size, n). Sums are of integers (millionths of words), so they do not
    depend on the order of tasks and reruns agree. A source that does not come within a ten
    thousandth of its target is an error.
    """
    scale = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = wanted.join(scale, wanted.source.eqNullSafe(scale.source)).select(
        wanted.source, "target", (F.col("source_size") * float(most)).alias("cap"), F.greatest("scale", F.lit(1.0)).alias("scale")
    )
    state = staged(state.withColumns({"tilt": F.lit(0.0), "low": F.lit(-1e4), "high": F.lit(1e4), "off": F.lit(1e18)}))
    for _ in range(STEPS):
        rows = histogram.alias("h").join(F.broadcast(state.alias("s")) if state.count() <= 100_000 else state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        rate = _rate(F.col("size"), most)
        sums = rows.groupBy(F.col("s.source").alias("source")).agg(
            F.sum((rate * F.col("size") * F.col("n") * 1e6).cast("decimal(38,0)")).cast("double").alias("have"),
            F.sum(F.when(rate < most, rate * F.col("size") * F.col("size") / F.col("scale") * F.col("n") * 1e6).cast("decimal(38,0)")).cast("double").alias("slope"),
        )
        gap = F.col("have") / 1e6 - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / (F.col("slope") / 1e6)
        # near the limits the sum is far from linear: a step out of the bracket halves it instead
        inside = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(F.when(F.abs(low) > 9e3, high - 2 * F.greatest(F.abs(high), F.lit(0.5))).when(F.abs(high) > 9e3, low + 2 * F.greatest(F.abs(low), F.lit(0.5))).otherwise((low + high) / 2))
        done = (F.abs(gap) <= 1e-4 * F.col("target") + 1e-3) | (F.col("target") >= F.col("cap"))
        joined = state.alias("s").join(sums.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "have", "slope")
        state = staged(joined.select("source", "target", "cap", "scale", F.when(done, F.col("tilt")).otherwise(inside).alias("tilt"), low.alias("low"), high.alias("high"), F.when(done, 0.0).otherwise(F.abs(gap)).alias("off")))
        if not state.where("off > 0").limit(1).count():
            return state.select("source", "target", "cap", "scale", "tilt")
    raise ArithmeticError(f"the mix does not meet its targets after {STEPS} steps")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, row: str | None = None) -> DataFrame:
    """``(key, source, size, source_size, target, rate, copies, taken)``, one row per row of ``docs``.

    With ``row``, a column of ``docs`` that differs in every row, that column comes first.

    ``copies`` (0 to ``most``) is how often the mix takes the document and ``taken`` its words then.
    A null or empty text has size 0 and takes no words; it keeps one copy. Null sources are one
    source, last in order. Rows with equal keys are documents of their own, told apart by a hash of
    their text; fully repeated rows may swap their copies. One source: its target is its size. No
    rows: none. The source of a third of all rows spreads over many buckets in every step.
    """
    own = [row] if row else []
    rows = staged(docs.select(*own, F.col(key), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.lit(7), F.col(text)).alias("h")))
    histogram = staged(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = staged(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")))
    wanted = staged(targets(per_source, weights, most))
    solution = solve(histogram.where("size > 0"), wanted, most)
    spread = wanted.alias("w").join(solution.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source")), "left").select("w.source", "w.source_size", "w.target", "cap", "scale", "tilt")
    named = lambda df: df.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    spread = staged(named(spread).drop("source"))
    n_sources = spread.count()
    # systematic rounding of the fractions: ranks in order of (size, hash), bucket by bucket
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("size"), most))
    cuts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rated = join_lookup(named(rows), spread, ["_s"], rows=n_sources).withColumn("rate", F.round(rate, 9))
    rated = rated.withColumns({"part": F.round((F.col("rate") - F.floor("rate")) * 1e9).cast("long"), "_cut": F.pmod("h", F.lit(cuts))})
    rated = staged(rated.drop("cap", "scale", "tilt"))
    order = ["size", "_cut"]
    buckets = staged(rated.groupBy("_s", *order).agg(F.sum("part").alias("_sum")))
    # sums before each bucket: sizes of a source fall into groups of octaves and tenths, then sizes, then cuts
    level = F.floor(F.log2(F.col("size") + 1) * 16).cast("long")
    buckets = buckets.withColumn("_level", level)
    levels = buckets.groupBy("_s", "_level").agg(F.sum("_sum").alias("_t"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select("_s", "_level", before("_t", Window.partitionBy("_s").orderBy("_level")).alias("_low"))
    sizes = buckets.groupBy("_s", "_level", "size").agg(F.sum("_sum").alias("_t"))
    sizes = sizes.withColumn("_mid", before("_t", Window.partitionBy("_s", "_level").orderBy("size"))).drop("_t")
    inner = buckets.withColumn("_in", before("_sum", Window.partitionBy("_s", "size").orderBy("_cut")))
    firsts = inner.join(sizes, ["_s", "_level", "size"]).join(levels, ["_s", "_level"]).select("_s", *order, (F.col("_low") + F.col("_mid") + F.col("_in")).alias("_first"))
    run = F.col("_first") + before("part", Window.partitionBy("_s", *order).orderBy("h", key, *own))
    placed = rated.join(firsts, ["_s", *order]).withColumn("_run", run)
    one = 1_000_000_000
    up = F.floor((F.col("_run") + F.col("part") + one // 2) / one) - F.floor((F.col("_run") + one // 2) / one)
    rounded = staged(placed.withColumn("copies", (F.floor("rate") + up).cast("int")).drop("_run", "_first", "part"))
    changes = staged(_repair(rounded, spread, most))
    fixed = join_lookup(rounded, changes, ["_s", "size", "h"]).withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return fixed.select(*own, key, "source", F.col("size").cast("long").alias("size"), "source_size", "target", "rate", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _repair(rounded: DataFrame, spread: DataFrame, most: int) -> DataFrame:
    """``(_s, size, h, change)``: single documents of each source given one copy more or less.

    From every octave of sizes a few documents stand by (least hashes under a few salts); going
    down in size, each is taken that still fits into what its source lacks or has too much. Documents
    that share size and hash with another (repeated rows) do not stand by.
    """
    have = rounded.groupBy("_s").agg(F.sum(F.col("copies") * F.col("size")).alias("have"))
    gaps = have.join(spread.select("_s", "target"), "_s").withColumn("gap", F.round(F.col("target") - F.col("have")).cast("long"))
    octave, salt = F.floor(F.log2(F.col("size"))), F.pmod(F.shiftright("h", 8), F.lit(SPREAD))
    able = lambda up: F.col("copies") < most if up else F.col("copies") > 0
    stand = rounded.where("size > 0").groupBy("_s", octave.alias("_o"), salt.alias("_k")).agg(
        F.min(F.when(able(True), F.struct("h", "size"))).alias("more"), F.min(F.when(able(False), F.struct("h", "size"))).alias("less")
    )
    order = lambda c: F.sort_array(F.filter(F.collect_list(F.struct(F.col(f"{c}.size").alias("size"), F.col(f"{c}.h").alias("h"))), lambda x: x["size"].isNotNull()), asc=False)
    lists = stand.groupBy("_s").agg(order("more").alias("more"), order("less").alias("less")).join(gaps.select("_s", "gap"), "_s")
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<struct<size:bigint,h:bigint>>").alias("took"))

    def choose(acc, x):
        fits = x["size"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["took"], F.array(x))).otherwise(acc["took"]).alias("took"))

    picked = F.aggregate(F.when(F.col("gap") > 0, F.col("more")).otherwise(F.col("less")), start, choose)["took"]
    rows = lists.select("_s", F.when(F.col("gap") > 0, 1).otherwise(-1).alias("change"), F.explode(picked).alias("x")).select("_s", "x.size", "x.h", "change")
    same = rounded.join(F.broadcast(rows.select("_s", "size", "h")) if rows.limit(10_001).count() <= 10_000 else rows.select("_s", "size", "h"), ["_s", "size", "h"], "left_semi")
    single = same.groupBy("_s", "size", "h").count().where("count = 1").drop("count")
    return rows.join(single, ["_s", "size", "h"], "left_semi")


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them.

    Rows get a number, staged with them, by which their copies come back; so null and repeated keys
    and fully repeated rows are documents of their own. Columns may have any names.
    """
    row, copies = fresh(docs, "row", "copies")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    columns = [F.col(c) for c in (row, key, text, source)]
    narrow = numbered.select(*[c.alias(n) for c, n in zip(columns, ("row", "key", "text", "name"), strict=True)])
    often = mix(narrow, "key", "text", "name", weights, most, row="row").where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    return numbered.join(often, row).withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
