"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is scaled to length one, rotated at random (two rounds of random signs and a Hadamard transform)
and coded by the signs of its coordinates; the inner product of the vector with its own code is stored as
correction factor. For another vector, the inner product with the code divided by that factor estimates the
inner product of the two without bias, and its error has a known bound; only pairs whose upper bound reaches
the threshold are computed exactly, in double precision.

Which pairs are looked at at all comes from the codes too: further rotations give tables of keys of ``bits``
code bits, and vectors with a common key in a table meet. The number of tables follows from ``bits`` and the
chance ``miss`` that a pair just at the threshold meets nowhere; closer pairs are safer still.

Equal vectors are one point with a weight. A key that many points share is dealt to blocks of points, every
two blocks of it a task of bounded size; a task returns counts by point and a star for each component it
sees, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import components, cut, discard

THRESHOLD = 0.98
MISS = 1e-6
BLOCK = 512
# Standard deviations of the estimate's error that are allowed for.
SURE = 6.0
SEED = 20


class Plan(NamedTuple):
    bits: int
    tables: int
    threshold: float


def plan(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> Plan:
    """Key length by the number of vectors, so that the chance meetings per vector do not grow with it."""
    bits = max(8, min(60, math.ceil(math.log2(max(vectors, 2))) + 4))
    equal = (1 - math.acos(threshold) / math.pi) ** bits
    return Plan(bits, math.ceil(math.log(miss) / math.log1p(-equal)), threshold)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Rotation ``number`` of the rows of ``x``, padded with zeros to a power of two of at least 64 columns."""
    size = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, number]).choice([-1.0, 1.0], (2, size))
    for flip in signs:
        out *= flip
        width = 1
        while width < size:
            pairs = out.reshape(len(x), -1, 2, width)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
            width *= 2
        out /= math.sqrt(size)
    return out


def keys_of(x: np.ndarray, p: Plan) -> np.ndarray:
    """Shape (rows, tables): the key of each unit vector in each table."""
    size = max(64, 1 << (x.shape[1] - 1).bit_length())
    turns = -(-p.bits * p.tables // size)
    signs = np.concatenate([rotate(x, 1 + k) > 0 for k in range(turns)], axis=1)[:, : p.bits * p.tables]
    return signs.reshape(len(x), p.tables, p.bits) @ (1 << np.arange(p.bits, dtype=np.int64))


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes of +1 and -1, and the correction factors."""
    turned = rotate(x, 0)
    code = np.where(turned > 0, 1.0, -1.0)
    return turned, code, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of pairs of rows whose exact cosine reaches the threshold; rows are scaled by powers of two only."""
    lengths = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (a, b)]
    turned, _, _ = codes_of(b / lengths[1][:, None])
    _, code, factor = codes_of(a / lengths[0][:, None])
    size = turned.shape[1]
    estimate = code @ turned.T / math.sqrt(size) / factor[:, None]
    error = SURE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(size - 1)
    i, j = np.nonzero(estimate + error[:, None] >= threshold)
    out = np.zeros(estimate.shape, bool)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q]) / (lengths[0][p] * lengths[1][q]) >= threshold
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def linkable() -> Column:
    vector = F.col("embedding").cast("array<double>")
    # A NaN counts as larger than any number.
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    filled = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & filled, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, digest, vector)`` of the rows that can be linked at all."""
    rows = vectors.where(linkable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )

    def digests(batches):
        for batch in batches:
            marks, scaled = [], []
            for row in batch.column(2):
                x = np.asarray(row.as_py(), np.float64) + 0.0
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
                marks.append(hashlib.md5(x.tobytes()).digest())
                scaled.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in scaled], pa.int32()),
                    pa.array(marks, pa.binary()),
                    pa.array(scaled, pa.list_(pa.float64())),
                ],
                ["vec_id", "label", "dim", "digest", "vector"],
            )

    return rows.mapInArrow(digests, "vec_id long, label string, dim int, digest binary, vector array<double>")


def with_keys(points: DataFrame, p: Plan) -> DataFrame:
    """``points`` with the array ``keys``, one for each table."""
    schema = "id long, label string, dim int, weight long, vector array<double>, keys array<long>"

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for k in range(0, part.num_rows, 2000):
                    some = part.slice(k, 2000)
                    x = matrix(some.column(4), dim)
                    keys = keys_of(x / np.linalg.norm(x, axis=1)[:, None], p)
                    listed = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * p.tables, pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([*some.columns, listed], [f.split()[0] for f in schema.split(", ")])

    return points.select("id", "label", "dim", "weight", "vector").mapInArrow(run, schema)


def compare(group: pa.Table, p: Plan) -> pa.Table:
    """One pair of blocks of one key: ``(a, b, n)``, links of ``a`` met first in this table, and stars (n = 0)."""
    rows = group.combine_chunks()
    get = lambda name: rows.column(name).to_numpy()
    ids, weight, block = get("id"), get("weight"), get("block")
    first, second, table = (int(rows.column(c)[0].as_py()) for c in ("first", "second", "at"))
    dim = int(rows.column("dim")[0].as_py())
    x = matrix(rows.column("vector").combine_chunks(), dim)
    keys = matrix(rows.column("keys").combine_chunks(), p.tables)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    found = near(x[left], x[right], p.threshold) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
    i, j = np.nonzero(found)
    i, j = left[i], right[j]
    go = i < j if first == second else np.ones(len(i), bool)
    i, j = i[go], j[go]
    new = np.ones(len(i), bool)
    for k in range(0, len(i) if table else 0, 1 << 16):
        part = slice(k, k + (1 << 16))
        new[part] = ~(keys[i[part], :table] == keys[j[part], :table]).any(axis=1)
    links = np.bincount(i[new], weight[j[new]], len(ids)) + np.bincount(j[new], weight[i[new]], len(ids))
    # The smallest id reachable in this task, by spreading labels over its links.
    label = ids.copy()
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (label == before).all():
            break
    star, counted = np.flatnonzero(label != ids), np.flatnonzero(links)
    return pa.table(
        {
            "a": np.concatenate([ids[counted], ids[star]]),
            "b": np.concatenate([ids[counted], label[star]]),
            "n": np.concatenate([links[counted].astype(np.int64), np.zeros(len(star), np.int64)]),
        }
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, label, embedding)``.

    Vectors are compared if label and length are equal. Null labels and vectors that are null, zero, or hold
    null or non-finite components link with nothing: they are their own component. So are rows without an
    id, whose component is null and which are kept. Rows with equal vectors link with each other, whatever their ids.
    """
    rows = cut(usable(vectors), "vectors")
    same = ["label", "dim", "digest"]
    points = cut(
        rows.groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "points"
    )
    p = plan(points.count(), threshold, miss)
    keyed = cut(with_keys(points, p), "keyed")
    met = keyed.select("id", "label", "dim", F.posexplode("keys").alias("at", "key"))
    place = ["label", "dim", "at", "key"]
    crowds = cut(met.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = met.join(crowds, place).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "at", "key", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = cut(dealt, "dealt")
    full = dealt.join(keyed, "id")
    found = cut(full.groupBy(*place, "first", "second").applyInArrow(lambda group: compare(group, p), "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    classes = components(found.where("n = 0").select("a", "b").distinct())
    judged = points.join(counts, "id", "left").join(classes, F.col("id") == F.col("node"), "left")
    judged = cut(
        judged.select(
            *same,
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        ),
        "judged",
    )
    discard(keyed, crowds, dealt, found)
    linked = rows.select("vec_id", *same).join(judged, same).select("vec_id", "n_links", "component_id")
    valid = linked.unionByName(alone(vectors))
    return valid.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def alone(vectors: DataFrame) -> DataFrame:
    """Rows that link with nothing, as their own components."""
    rest = vectors.where(~linkable())
    vec_id = F.col("vec_id").cast("long")
    return rest.select(vec_id.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), vec_id.alias("component_id"))
