"""Merkle manifest of a dataset as a postorder append log.

Rows of a group (such as a source) are the leaves of a tree in which every ``ARITY`` consecutive nodes
of a level become one of the next, and the roots of the groups are the leaves of a tree of their own.
The nodes of a tree are logged in the order in which they are completed: a node stands right behind its
last child, so a log only ever grows at its end, and an aligned range of leaves with its whole subtree
is one stretch of it. Aligned builders hash ``BLOCK`` leaves each and write such a stretch as one row;
the nodes above are built in the same way from the tops of the stretches, generation by generation.

Where a node stands follows from its level, its number and the size of its tree alone, as the sizes
of the subtrees before it are known. So a proof is extracted without searching: a block of leaves
finds the siblings within it in its own stretch, and those of its top and of the nodes above at
positions that are computed and then joined with the log.

No group meets in one task: leaves are numbered by ranges, and a task sees blocks. Digests are
lower-case hexadecimal SHA-256 of concatenated text (children: of their hexadecimal digests).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.ordering import running
from framelake.runtime import Scratch, batches_of, join_lookup

ARITY = 16
BLOCK = ARITY**2  #: leaves of an aligned builder
PATHS_AT_ONCE = 2_000  #: groups whose paths to the root are broadcast; beyond it they are joined by shuffle


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(level: int, n: int) -> int:
    """Nodes of a level in a tree of ``n`` leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    h = 0
    while width(h, n) > 1:
        h += 1
    return h


def position(level: int, index: int, n: int) -> int:
    """Place in the log of a node: all that is complete before it, counted level by level.

    Its own level and those below have ended with its last leaf; of those above, the nodes that end
    before its first leaf are there.
    """
    last = min((index + 1) * ARITY**level, n)
    return sum(width(j, last) for j in range(level + 1)) - 1 + sum(index // ARITY ** (j - level) for j in range(level + 1, height(n)))


def siblings(level: int, index: int, n: int) -> range:
    """Numbers of the nodes in the run of a node, itself included."""
    first = index // ARITY * ARITY
    return range(first, min(first + ARITY, width(level, n)))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row: its fields one after another."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


@dataclass
class Log:
    """The log of many trees: ``stretches`` (tree, block, n, position, digests) of aligned builders, from
    leaves to the top of each block, ``upper`` (tree, position, digest) of the nodes above them, and
    ``roots`` (tree, n, digest). Digests are hexadecimal, 64 characters each."""

    stretches: DataFrame
    upper: DataFrame
    roots: DataFrame

    def entries(self) -> DataFrame:
        """``tree, position, digest``: the whole log, a node a row."""
        inner = self.stretches.select("tree", F.col("position").alias("first"), F.posexplode(F.expr(r"regexp_extract_all(digests, '.{64}', 0)")).alias("at", "digest"))
        return inner.select("tree", (F.col("first") + F.col("at")).alias("position"), "digest").unionByName(self.upper)


def _completed(digests: list[str], first: int, level: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes over consecutive nodes of one level, in the order of completion.

    An aligned range of at most ``BLOCK`` nodes is closed up to two levels above, or the root.
    """
    top = min(level + 2, height(n))

    def close(lo: int, hi: int, up: int) -> Iterator[tuple[int, int, str]]:
        if up == level:
            yield level, first + lo, digests[lo]
            return
        span, last = ARITY ** (up - 1 - level), []
        for at in range(lo, hi, span):
            for node in close(at, min(at + span, hi), up - 1):
                yield node
            last.append(node[2])
        yield up, (first + lo) // ARITY ** (up - level), digest("".join(last))

    yield from close(0, len(digests), top)


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (tree, n, index, digest, ...) of one level gathered to aligned blocks, in order."""
    inner = F.struct("index", "digest", *[F.col(c).cast("string").alias(c) for c in carried])  # long integers beside nulls would pass through pandas as floats
    return nodes.groupBy("tree", "n", F.expr(f"index div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(inner)).alias("nodes"))


def append_log(blocks: DataFrame, scratch: Scratch) -> Log:
    """The log of trees whose leaves come as ``blocks`` (tree, n, block, nodes). The result reads steps of ``scratch``."""
    spark = blocks.sparkSession

    def stretched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tree, n, block, nodes in zip(b["tree"], b["n"], b["block"], b["nodes"], strict=True):
                made = list(_completed([x["digest"] for x in nodes], block * BLOCK, 0, n))
                out.append((tree, block, n, position(0, block * BLOCK, n), "".join(d for _, _, d in made)))
            yield pd.DataFrame(out, columns=["tree", "block", "n", "position", "digests"])

    def above(level: int):
        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for tree, n, block, nodes in zip(b["tree"], b["n"], b["block"], b["nodes"], strict=True):
                    for lev, index, d in _completed([x["digest"] for x in nodes], block * BLOCK, level, n):
                        if lev > level:
                            out.append((tree, n, lev, index, position(lev, index, n), d))
                yield pd.DataFrame(out, columns=["tree", "n", "level", "index", "position", "digest"])

        return build

    with batches_of(spark, 64):
        stretches = scratch.staged(blocks.mapInPandas(stretched, "tree long, block long, n long, position long, digests string"))
        tops = stretches.select("tree", "n", F.col("block").alias("index"), F.substring("digests", -64, 64).alias("digest"))
        upper, level = None, 2
        roots = tops.where(F.col("n") <= BLOCK)
        largest = stretches.agg(F.max("n")).first()[0] or 0
        while height(largest) > level:
            nodes = _blocks(tops.where(F.col("n") > ARITY**level))
            made = scratch.staged(nodes.mapInPandas(above(level), "tree long, n long, level int, index long, position long, digest string"))
            upper = made if upper is None else upper.unionByName(made)
            level += 2
            tops = made.where(F.col("level") == level).select("tree", "n", "index", "digest")
        if upper is not None:
            roots = roots.unionByName(upper.where("index = 0").groupBy("tree", "n").agg(F.max(F.struct("level", "index", "digest")).alias("top")).select("tree", "n", F.col("top.index").alias("index"), "top.digest"))
            upper = upper.select("tree", "position", "digest")
        else:
            upper = spark.createDataFrame([], "tree long, position long, digest string")
    return Log(stretches, upper, roots.select("tree", "n", "digest"))


def _paths(log: Log) -> DataFrame:
    """``tree, block, left, right``: the siblings of every block's top and of the nodes above it, from the log by position."""

    def addresses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tree, n, block in zip(b["tree"].tolist(), b["n"].tolist(), b["block"].tolist(), strict=True):
                for level in range(2, height(n)):
                    index = block // ARITY ** (level - 2)
                    out += [(tree, block, level, q, q < index, position(level, q, n)) for q in siblings(level, index, n) if q != index]
            yield pd.DataFrame(out, columns=["tree", "block", "level", "q", "before", "position"])

    asked = log.stretches.where(F.col("n") > BLOCK).select("tree", "n", "block").mapInPandas(addresses, "tree long, block long, level int, q long, before boolean, position long")
    last = F.octet_length("digests") / 64 - 1
    tops = log.stretches.where(F.col("n") > BLOCK).select("tree", (F.col("position") + last).cast("long").alias("position"), F.substring("digests", -64, 64).alias("digest"))
    found = asked.join(tops.unionByName(log.upper), ["tree", "position"])
    side = lambda own: F.array_join(F.transform(F.filter("s", lambda x: x["before"] == own), lambda x: x["digest"]), "")
    by_level = found.groupBy("tree", "block", "level").agg(F.array_sort(F.collect_list(F.struct("q", "before", "digest"))).alias("s"))
    step = by_level.select("tree", "block", F.struct("level", side(F.lit(True)).alias("left"), side(F.lit(False)).alias("right")).alias("step"))
    steps = step.groupBy("tree", "block").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return steps.select("tree", "block", F.col("steps.left").alias("left"), F.col("steps.right").alias("right"))


def proofs(blocks: DataFrame, log: Log, carried: dict[str, str], scratch: Scratch, beyond: DataFrame | None = None) -> DataFrame:
    """``tree, index, digest, <carried>, left, right``: for every leaf in ``blocks`` the siblings on its way to the root.

    ``left`` and ``right`` have an entry for each level from the leaf upwards: the joined digests of
    the siblings before and behind. ``beyond`` (tree, left, right) goes on from the root of the tree.
    """
    names = ["tree", "index", "digest", *carried, "left", "right"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                n, first, out = row.n, row.block * BLOCK, []
                at = lambda level, q: row.digests[64 * (position(level, q, n) - row.position) :][:64]  # noqa: B023, E731
                ups = []  # of each run of leaves, its own siblings one level up
                for run in range(first // ARITY, -(-min(first + BLOCK, n) // ARITY)):
                    if height(n) > 1:
                        digests = [at(1, q) for q in siblings(1, run, n)]
                        place = run % ARITY
                        ups.append(("".join(digests[:place]), "".join(digests[place + 1 :])))
                leaves = [at(0, q) for q in range(first, min(first + BLOCK, n))]
                outer_left = [*(row.left if row.left is not None else ()), *(row.far_left if row.far_left is not None else ())]
                outer_right = [*(row.right if row.right is not None else ()), *(row.far_right if row.far_right is not None else ())]
                for node in row.nodes:
                    i = node["index"] - first
                    lo = i // ARITY * ARITY
                    left, right = [], []
                    if height(n) > 0:
                        left.append("".join(leaves[lo:i]))
                        right.append("".join(leaves[i + 1 : lo + ARITY]))
                    if height(n) > 1:
                        left.append(ups[i // ARITY][0])
                        right.append(ups[i // ARITY][1])
                    out.append((row.tree, node["index"], leaves[i], *[node[c] for c in carried], left + outer_left, right + outer_right))
                yield pd.DataFrame(out, columns=names)

    schema = ", ".join(["tree long", "index long", "digest string", *(f"{c} string" for c in carried), "left array<string>", "right array<string>"])
    paths = _paths(log)
    spark = blocks.sparkSession
    if beyond is None:
        beyond = spark.createDataFrame([], "tree long, left array<string>, right array<string>")
    far = beyond.select("tree", F.col("left").alias("far_left"), F.col("right").alias("far_right"))
    joined = blocks.join(log.stretches.drop("n"), ["tree", "block"]).join(paths, ["tree", "block"], "left")
    joined = scratch.staged(join_lookup(joined, far, ["tree"], most=PATHS_AT_ONCE))
    with batches_of(spark, 16):
        return scratch.staged(joined.mapInPandas(extract, schema).withColumns({c: F.col(c).cast(t) for c, t in carried.items()}))


def proof_text(left: str = "left", right: str = "right") -> Column:
    """All siblings of a proof, level by level, from left to right."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")


def fold(start: Column, left: str = "left", right: str = "right") -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), start, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def manifest(rows: DataFrame, group: str, order: list[str], digest_column: str, carried: dict[str, str], scratch: Scratch) -> DataFrame:
    """Every row of ``rows`` with the roots it is under and its proof.

    Columns: ``digest``, ``carried`` (names and types of further columns), ``subroot`` of its group,
    ``root`` of all, ``left`` and ``right``. Leaves of a group are in the order of ``order`` and then of
    their digests, nulls first; groups are in bytewise order, the null group first. A group of one row has
    its leaf as root, a single group's root is the root of all; then these levels add nothing to a
    proof. Rows that are equal in all of that are leaves of their own, beside each other. An empty
    table has no root and gives no rows. The result reads steps of ``scratch``.
    """
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    narrow = scratch.staged(rows.select(key.alias("key"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(digest_column).alias("digest"), *carried).withColumn("row", F.monotonically_increasing_id()))
    placed = scratch.staged(running(narrow, [F.col(c) for c in ("key", *(f"_o{i}" for i in range(len(order))), "digest", "row")], scratch))
    groups = placed.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = scratch.staged(running(groups, [F.col("first")], scratch, name="tree"))
    leaves = join_lookup(placed, trees, ["key"]).select("tree", "n", (F.col("at") - F.col("first")).alias("index"), "digest", *carried)
    blocks = scratch.staged(_blocks(leaves, *carried))
    log = append_log(blocks, scratch)
    top = log.roots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("n"), F.col("tree").alias("index"), "digest")
    top_blocks = scratch.staged(_blocks(top))
    top_log = append_log(top_blocks, scratch)
    way = proofs(top_blocks, top_log, {}, scratch).select(F.col("index").alias("tree"), "left", "right", F.col("digest").alias("subroot"))
    root = top_log.roots.first()
    found = proofs(blocks, log, carried, scratch, way.drop("subroot"))
    return join_lookup(found, way.select("tree", "subroot"), ["tree"]).withColumn("root", F.lit(root["digest"] if root else None)).drop("tree", "index")


def documents_manifest(docs: DataFrame, scratch: Scratch, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> DataFrame:
    """``manifest`` of documents by source: leaves are digests of ``columns``, of which ``text`` may have been tampered with.

    Where ``tampered`` (a condition) holds, ``other`` is the leaf of the document with the A-Z of its text
    lower-cased, and elsewhere null. Null fields are part of the digest; a null text stays null.
    """
    changed = [F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in columns]
    other = F.when(tampered, leaf(*changed)) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.col("source").alias("group"), leaf(*[F.col(c) for c in columns]).alias("leaf"), other.alias("other"))
    return manifest(rows, "group", ["doc_id"], "leaf", {"doc_id": rows.schema["doc_id"].dataType.simpleString(), "other": "string"}, scratch)


def verified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document, one in five tampered with.

    Tampered with are those whose id's CRC-32 is divisible by five; a null id is not. The folded root is
    worked out from the leaf as it is now and the proof alone.
    """
    made = documents_manifest(docs, scratch, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    folded = made.withColumn("folded_root", fold(F.coalesce("other", "digest")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
