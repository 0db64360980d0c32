"""A Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf; the leaves of a source, in order of their id, form a tree in which 16 consecutive nodes
have one parent, and the sources' roots form a tree above them. Builders work on aligned blocks of 4096
nodes: they read a block in order and write a node as soon as it is complete, so children precede their
parent and a node's place in the log is the number of nodes completed before it. That number has a closed
form in the sizes of the subtrees to its left, so any sibling is found in the log without a search: a proof
is a join of computed positions with the log.

Positions in a tree come from a range partitioning and the counts of its parts, so no task sees a whole
source. Three levels need one round of builders, each further three levels another on the nodes below.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.llm.common import cut, discard

# Nodes of a run, and levels that one builder completes.
FAN, BITS, HEIGHT = 16, 4, 3
BLOCK_BITS = BITS * HEIGHT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOG = "tree string, size long, level int, at long, pos long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves; a lone leaf is its own root."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def position(size: int, level: int, at: int) -> int:
    """Place in the log, from zero, of the node number ``at`` of a level: the nodes completed before it.

    Up to its own level that is every node over the leaves until the node's end; above it, the nodes that end
    before the node begins.
    """
    end = min((at + 1) << BITS * level, size)
    done = sum((end + (1 << BITS * g) - 1) >> BITS * g for g in range(level + 1))
    while at := at >> BITS:
        done += at
    return done - 1


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours can't be confused."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(doc_id, tree, leaf, other)``: each row's digest, and the digest with A-Z of its text in lower case where ``tampered``.

    ``tree`` names the source such that a null one comes first and the rest follow bytewise.
    """
    text = F.col("text").cast("string")
    hashed = lambda t: F.sha2(F.concat(*(framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), framed(t)), 256)
    other = F.when(tampered, hashed(F.translate(text, UPPER, LOWER))) if tampered is not None else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        hashed(text).alias("leaf"),
        other.alias("other"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``at``, its place in its tree by ``order``, from zero, and the ``size`` of the tree.

    Rows are sorted over range partitions and written; a place is the rows of the tree in earlier parts plus
    the rows before it in its own. Rows that are equal in every column may be dealt over parts.
    """
    rows = cut(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    by = ["tree", *order, "tie"]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    placed = cut(sorted_rows.withColumn("row", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("part", F.shiftright("row", 33))
    # One row for each tree and part that holds some of it.
    parts = Window.partitionBy("tree")
    before = parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    spans = cut(
        spans.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(parts).alias("size")),
        "spans",
    )
    discard(rows)
    return placed.join(spans, ["tree", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def completed(digests: list[str], first: int, base: int, size: int):
    """Nodes ``(level, at, digest)`` of an aligned block of level ``base`` that begins at ``first``, as they are completed."""
    top = min(base + HEIGHT, levels(size))
    last = [(size - 1) >> BITS * g for g in range(top + 1)]
    runs: list[list[str]] = [[] for _ in range(top)]
    for at, node in enumerate(digests, first):
        level = base
        if not base:
            yield 0, at, node
        while level < top:
            runs[level].append(node)
            if len(runs[level]) < FAN and at != last[level]:
                break
            node = digest("".join(runs[level]))
            runs[level].clear()
            level, at = level + 1, at >> BITS
            yield level, at, node


def build(nodes: DataFrame, base: int) -> DataFrame:
    """The log entries that the builders of one round write, from ``nodes(tree, size, at, digest)`` of level ``base``."""

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        tree, size = group.column("tree")[0].as_py(), group.column("size")[0].as_py()
        found = list(completed(group.column("digest").to_pylist(), group.column("at")[0].as_py(), base, size))
        level, at, node = zip(*found, strict=True)
        return pa.table(
            {
                "tree": pa.array([tree] * len(found), pa.string()),
                "size": pa.array([size] * len(found), pa.int64()),
                "level": pa.array(level, pa.int32()),
                "at": pa.array(at, pa.int64()),
                "pos": pa.array([position(size, g, k) for g, k, _ in found], pa.int64()),
                "digest": pa.array(node, pa.string()),
            }
        )

    blocks = nodes.select("tree", "size", "at", "digest", F.shiftright("at", BLOCK_BITS).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(block, LOG)


def append_log(placed: DataFrame) -> DataFrame:
    """The log of all trees of ``placed(tree, size, at, digest)``: every round of builders appends to it."""
    log = cut(build(placed, 0), "log")
    tallest = levels(log.agg(F.max("size")).first()[0] or 0)
    below = log
    for base in range(HEIGHT, tallest, HEIGHT):
        below = cut(build(below.where((F.col("level") == base) & (F.col("size") > 1 << BITS * base)), base), "log")
        log = log.unionByName(below)
    return log


def height(size: Column) -> Column:
    """:func:`levels` as an expression, for trees of up to 2^60 leaves."""
    return F.coalesce(*(F.when(size <= 1 << BITS * g, g) for g in range(16))).cast("int")


def position_of(size: Column, level: Column, at: Column) -> Column:
    """:func:`position` as an expression."""
    right = lambda n, g: F.call_function("shiftright", n, (BITS * g).cast("int"))
    wide = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), (BITS * g).cast("int"))
    none = F.lit(0).cast("long")
    end = F.least((at + 1) * wide(level), size)
    own = F.aggregate(F.sequence(F.lit(0), level), none, lambda n, g: n + right(end + wide(g) - 1, g))
    above = F.aggregate(F.sequence(F.lit(1), F.lit(15)), none, lambda n, g: n + right(at, g))
    return own + above - 1


def paths(nodes: DataFrame, log: DataFrame, base: int) -> DataFrame:
    """``(tree, at, path)`` of ``nodes(tree, size, at)`` of level ``base``.

    ``path`` lists, level by level up to the root, the node's own place in its run and the digests of the run's others.
    Their places in the log are computed, not searched. A node that is the root has no row.
    """
    top = height(F.col("size"))
    steps = nodes.where(top > base).select("tree", "size", "at", F.explode(F.sequence(F.lit(base), top - 1)).alias("level"))
    steps = steps.withColumn("own", F.expr(f"shiftright(at, {BITS} * (level - {base}))"))
    first = F.col("own") - F.col("own") % FAN
    last = F.least(first + FAN - 1, F.expr(f"shiftright(size - 1, {BITS} * level)"))
    steps = steps.withColumn("sibling", F.explode(F.sequence(first, last)))
    asked = steps.select(
        "tree", "at", "level", "own", "sibling", position_of(F.col("size"), F.col("level"), F.col("sibling")).alias("pos")
    )
    found = asked.join(log.select("tree", "pos", "digest"), ["tree", "pos"])
    others = F.array_sort(F.collect_list(F.when(F.col("sibling") != F.col("own"), F.struct("sibling", "digest"))))
    runs = found.groupBy("tree", "at", "level").agg(F.max(F.col("own") % FAN).cast("int").alias("slot"), F.transform(others, lambda s: s["digest"]).alias("others"))
    return runs.groupBy("tree", "at").agg(F.array_sort(F.collect_list(F.struct("level", "slot", "others"))).alias("path"))


class Manifest(NamedTuple):
    """Written tables: the placed leaves, the log of the sources' trees, and the log of the tree above them."""

    placed: DataFrame  # tree, doc_id, leaf, other, size, at
    log: DataFrame
    top: DataFrame


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """Build the trees of ``docs(doc_id, source, lang, n_chars, text)``.

    Rows are ordered by id, a null id first, and rows with the same id by their digest. Null values have a
    mark of their own, columns beyond the five are not covered. An empty table has an empty log.
    """
    placed = cut(ranked(leaves(docs, tampered), ["doc_id", "leaf"]), "placed")
    log = append_log(placed.withColumnRenamed("leaf", "digest"))
    roots = log.where(F.col("level") == height(F.col("size"))).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    return Manifest(placed, log, append_log(ranked(roots, ["source"])))


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that ``node`` and the others of its runs give."""
    for slot, others in path:
        node = digest("".join([*others[:slot], node, *others[slot:]]))
    return node


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of ``docs`` (see :func:`manifest`).

    The proof of a row is the others of its runs, level by level through its source's root to the root; the
    folded root is recomputed from it and the row's leaf, that of the changed text where ``tampered``. An
    unchanged row verifies, as does one whose change leaves the text as it was. An empty table has no proofs.
    """
    made = manifest(docs, tampered)
    size, level = F.col("size"), F.col("level")
    root = made.top.where(level == height(size)).select("tree", F.col("digest").alias("root"))
    # The tree above: its leaves are the sources' roots, told apart by their digest's place.
    roots = made.log.where(level == height(size)).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("digest").alias("subroot"))
    roots = cut(ranked(roots, ["source"]), "subroots")
    over = roots.join(paths(roots, made.top, 0), ["tree", "at"], "left").join(root, "tree")
    over = cut(over.select(F.col("source").alias("tree"), "subroot", "root", F.col("path").alias("over")), "sources")
    # Of every block its root node, and the path from there.
    own = made.log.where(level == F.least(height(size), F.lit(HEIGHT))).select("tree", "size", "at")
    blocks = own.join(paths(own, made.log, HEIGHT), ["tree", "at"], "left").join(over, "tree")
    blocks = cut(blocks.select("tree", F.col("at").alias("block"), "path", "subroot", "root", "over"), "blocks")
    inside = made.log.where(level < HEIGHT).withColumn("block", F.expr(f"shiftright(at, {BLOCK_BITS} - {BITS} * level)"))
    rows = made.placed.withColumn("block", F.shiftright("at", BLOCK_BITS))
    head = blocks.select("tree", "block", F.struct("path", "subroot", "root", "over").alias("head"))
    # The nodes of a block lie together in the log, the way up from it is sent along once.
    nodes = inside.select("tree", "block", "size", "pos", "digest", F.lit(None).cast(head.schema["head"].dataType).alias("head")).unionByName(
        head.select("tree", "block", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), "head")
    )

    def prove(docs_of: pa.Table, log_of: pa.Table) -> pa.Table:
        if not docs_of.num_rows:
            return RESULT.empty_table()
        way = next(h for h in log_of.column("head").to_pylist() if h is not None)
        slots = [(s["slot"], s["others"]) for s in (way["path"] or []) + (way["over"] or [])]
        tail = "".join("".join(others) for _, others in slots)
        by_pos = {p: d for p, d in zip(log_of.column("pos").to_pylist(), log_of.column("digest").to_pylist(), strict=True) if d is not None}
        total = docs_of.column("size")[0].as_py()
        near = min(levels(total), HEIGHT)
        runs: dict[tuple[int, int], list[str]] = {}

        def run(level: int, parent: int) -> list[str]:
            if (level, parent) not in runs:
                last = (total - 1) >> BITS * level
                runs[level, parent] = [by_pos[position(total, level, k)] for k in range(parent << BITS, min((parent + 1) << BITS, last + 1))]
            return runs[level, parent]

        out = []
        for at, doc_id, leaf, other in zip(*(docs_of.column(c).to_pylist() for c in ("at", "doc_id", "leaf", "other")), strict=True):
            path = []
            for level in range(near):
                own_at, all_of = at >> BITS * level, run(level, at >> BITS * (level + 1))
                slot = own_at % FAN
                path.append((slot, all_of[:slot] + all_of[slot + 1 :]))
            proof = digest("".join("".join(others) for _, others in path) + tail)
            folded = fold(leaf if other is None else other, path + slots)
            out.append((doc_id, leaf, way["subroot"], way["root"], proof, folded, folded == way["root"]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RESULT.types, strict=True)], schema=RESULT)

    names = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInArrow(prove, names)


RESULT = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
)
