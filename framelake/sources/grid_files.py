"""Grids as DX text, profiles as columns, and reference states as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators.grids import GridHeader


def read_dx(spark: SparkSession, path: str) -> tuple[GridHeader, DataFrame]:
    """(header, ``ia, ib, ic, value``) of a DX file.

    The few header lines come to the driver; values stay distributed, and a large file is read by many
    tasks. A value's place follows from the byte its split begins at, its line's place in the split, and its
    place in the line; fewer values than announced are an error.
    """
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("byte")).alias("b"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    words = lines.withColumns({"word": F.split(F.trim("line"), r"\s+"), "at": F.struct("b", "row")})
    header = words.where(F.col("line").rlike(r"^\s*(object|origin|delta)")).orderBy("at").select("at", "word").limit(10).collect()
    counts, origin, steps, items, start = None, None, [], 0, None
    for at, w in header:
        if w[0] == "object" and "gridpositions" in w:
            counts = tuple(int(x) for x in w[-3:])
        elif w[0] == "origin":
            origin = tuple(float(x) for x in w[1:4])
        elif w[0] == "delta":
            steps.append(tuple(float(x) for x in w[1:4]))
        elif w[0] == "object" and "items" in w:
            items, start = int(w[w.index("items") + 1]), at
    if not counts or not origin or len(steps) != 3 or start is None:
        raise ValueError(f"{path!r} has no grid header")
    behind = F.struct(F.struct(F.lit(start["b"]["file"]).alias("file"), F.lit(start["b"]["byte"]).alias("byte")).alias("b"), F.lit(start["row"]).alias("row"))
    numbers = words.where((F.col("at") > behind) & F.col("line").rlike(r"^\s*[-+.0-9]"))
    # a line's first value: values are summed by split, and then within it, so that no task sees all lines
    sizes = numbers.select("b", "row", F.size("word").alias("n"), "word")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("b").agg(F.sum("n").alias("t")).select("b", before("t", Window.orderBy("b")).alias("first"))
    placed = sizes.withColumn("inner", before("n", Window.partitionBy("b").orderBy("row"))).join(F.broadcast(blocks), "b")  # a row a split
    values = placed.select((F.col("first") + F.col("inner")).alias("base"), F.posexplode("word").alias("k", "v"))
    na, nb, nc = counts
    grid = values.where(F.col("base") + F.col("k") < items).select((F.col("base") + F.col("k")).alias("i"), F.col("v").cast("double").alias("value"))
    grid = grid.select(F.expr(f"i div {nb * nc}").cast("int").alias("ia"), F.expr(f"i div {nc} % {nb}").cast("int").alias("ib"), F.expr(f"i % {nc}").cast("int").alias("ic"), "value")
    if items != na * nb * nc or grid.count() < items:
        raise ValueError(f"{path!r} has fewer values than its header says")
    return GridHeader(counts, origin, tuple(steps)), grid


def header_lines(h: GridHeader) -> list[str]:
    number = lambda v: " ".join(f"{x:.6g}" for x in v)
    n = " ".join(map(str, h.counts))
    items = h.counts[0] * h.counts[1] * h.counts[2]
    return [f"object 1 class gridpositions counts {n}", f"origin {number(h.origin)}", *[f"delta {number(s)}" for s in h.steps], f"object 2 class gridconnections counts {n}", f"object 3 class array type double rank 0 items {items} data follows"]


def write_dx(grid: DataFrame, header: GridHeader, path: str, value: str = "value") -> None:
    """Write a folder with one DX file: three values of six significant digits a line, c fastest.

    Missing grid points are 0. Triples are built by their place in the order; rows stream to the
    file in order without being gathered.
    """
    na, nb, nc = header.counts
    spark = grid.sparkSession
    place = (F.col("ia").cast("long") * nb + F.col("ib")) * nc + F.col("ic")
    full = spark.range(na * nb * nc).withColumnRenamed("id", "i").join(grid.select(place.alias("i"), F.col(value).alias("v")), "i", "left").fillna(0.0, ["v"])
    lines = full.groupBy(F.expr("i div 3").alias("row")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("g"))
    text = lines.select("row", F.array_join(F.transform("g", lambda x: F.format_string("%.6g", x["v"])), " ").alias("value"))
    ends = ['attribute "dep" string "positions"', 'object "regular positions regular connections" class field', 'component "positions" value 1', 'component "connections" value 2', 'component "data" value 3']
    extra = [(i - 100, s) for i, s in enumerate(header_lines(header))] + [(2**60 + i, s) for i, s in enumerate(ends)]
    spark.createDataFrame(extra, "row long, value string").union(text).repartitionByRange(1, "row").sortWithinPartitions("row").select("value").write.text(path)


def centred_header(counts: tuple[int, int, int], cell_vectors) -> GridHeader:
    """Header of a potential: the grid's middle is the origin."""
    steps = tuple(tuple(x / n for x in v) for v, n in zip(cell_vectors, counts, strict=True))
    origin = tuple(-sum((n - 1) / 2 * s[k] for n, s in zip(counts, steps, strict=True)) for k in range(3))
    return GridHeader(tuple(counts), origin, steps)


def write_profile(profile: DataFrame, columns: list[str], path: str) -> None:
    """Columns of numbers in order; with two coordinates a blank line stands behind each outer row."""
    numbers = [F.format_string("%.8f", F.col(c).cast("double")) for c in columns]
    rows = profile.select(*columns[:-1], F.lit(0).alias("_k"), F.concat_ws(" ", *numbers).alias("value"))
    if len(columns) == 3:
        ends = profile.groupBy(columns[0]).agg(F.max(columns[1]).alias(columns[1])).select(*columns[:2], F.lit(1).alias("_k"), F.lit("").alias("value"))
        rows = rows.union(ends)
    rows.repartitionByRange(1, columns[0]).sortWithinPartitions(*columns[:-1], "_k").select("value").write.text(path)


def write_rdf(rdf: DataFrame, path: str) -> None:
    """``r gofr`` in columns of 16 with eight decimals."""
    head = rdf.sparkSession.createDataFrame([(-1, f"{'r':>16}{'gofr':>16}")], "bin int, value string")
    rows = rdf.select("bin", F.format_string("%16.8f%16.8f", "r", "gofr").alias("value"))
    head.union(rows).repartitionByRange(1, "bin").sortWithinPartitions("bin").select("value").write.text(path)


def _write_ordered(rows: DataFrame, head: str, path: str) -> None:
    """``frame, value`` as text in order of frames, behind a line of column names."""
    first = rows.sparkSession.createDataFrame([(-1, head)], "frame long, value string")
    first.union(rows).repartitionByRange(1, "frame").sortWithinPartitions("frame").select("value").write.text(path)


def write_dipoles(dipoles: DataFrame, path: str) -> None:
    """Frame, dipole along x, y, z and along the cell's vectors (without a cell: x, y, z again), in e angstrom."""
    along = [f"m_{k}" if f"m_{k}" in dipoles.columns else m for k, m in zip("abc", ("mx", "my", "mz"), strict=True)]
    value = F.format_string("%6d" + "  %12.6f" * 6, "frame", "mx", "my", "mz", *[F.coalesce(c, m) for c, m in zip(along, ("mx", "my", "mz"), strict=True)])
    _write_ordered(dipoles.select("frame", value.alias("value")), "# frame  dx(e.A)  dy(e.A)  dz(e.A)  da(e.A)  db(e.A)  dc(e.A)", path)


def write_assignments(states: DataFrame, path: str) -> None:
    """Frame, configuration and distance."""
    _write_ordered(states.select("frame", F.concat_ws(" ", "frame", "state", "distance").alias("value")), "# Frame Configuration Distance", path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """``ref, slot, w, x, y, z`` of a JSON file of reference configurations."""
    raw = spark.read.json(path, multiLine=True)
    each = raw.select(F.posexplode("configurations").alias("ref", "c")).select("ref", F.posexplode("c.quaternions").alias("slot", "q"))
    return each.select("ref", "slot", *[F.col(f"q.{k}").cast("double").alias(k) for k in "wxyz"])


def write_states(states: DataFrame, path: str) -> None:
    """Reference configurations as one JSON document."""
    q = F.struct("slot", F.struct("w", "x", "y", "z").alias("q"))
    each = states.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(q)), lambda s: s["q"]).alias("quaternions"))
    rows = F.struct("ref", F.struct(F.col("ref").alias("frame_number"), "quaternions").alias("c"))
    whole = each.agg(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["c"]).alias("configurations"))  # a short list
    whole.select(F.to_json(F.struct("configurations")).alias("value")).coalesce(1).write.text(path)
