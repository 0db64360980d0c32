"""Quality scores by a hashed word n-gram logistic regression.

A text becomes a sparse vector: counts of its words, marks and pairs of neighbours (a word repeated at once
is the same pair for every word), hashed into a fixed
number of slots, with the square root of each count, scaled to length one. The regression is fitted by
follow-the-regularised-leader updates (per-coordinate rates, L1 and L2 terms) on shards of a bounded
sample whose weights are averaged. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import bytes_of, cut, discard, kept_rows, map_arrow, slices
from aislewise.llm.sampling import labelled
from aislewise.llm.tokens import mix, tokenize

BITS = 18
MAX_ROWS = 20_000
SHARDS = 4
STEPS = 8_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1


class Sparse(NamedTuple):
    """Rows of sparse vectors: row ``i`` has ``slot[at[i]:at[i + 1]]`` with ``value``s."""

    at: np.ndarray
    slot: np.ndarray
    value: np.ndarray


def vectors(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    tokens = tokenize(data, offsets, fold=False)
    h, doc = tokens.hashes[0], tokens.doc
    same = doc[1:] == doc[:-1]
    # A word that follows itself is one n-gram, whichever word it is.
    pair = np.where(h[:-1] == h[1:], np.uint64(0), mix(h[:-1] * np.uint64(3) + h[1:]))[same]
    slots = np.concatenate([h, pair]) >> np.uint64(64 - BITS)
    keys = np.concatenate([doc, doc[1:][same]]).astype(np.uint64) << np.uint64(BITS) | slots
    keys, counts = np.unique(keys, return_counts=True)
    rows = (keys >> np.uint64(BITS)).astype(np.int64)
    at = np.searchsorted(rows, np.arange(len(offsets)))
    value = np.sqrt(counts)
    value /= np.sqrt(np.bincount(rows, counts, len(offsets) - 1))[rows] if len(rows) else 1
    return Sparse(at, (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), value)


class Model(NamedTuple):
    weights: np.ndarray  # by slot
    bias: float


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that minimise the regularised sum of the linearised losses so far."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(batches):
    """One shard: yields its weights, its bias and the number of its rows."""
    rows: list[tuple[np.ndarray, np.ndarray, float]] = []
    for batch in batches:
        for part in slices(batch, "text"):
            x = vectors(*bytes_of(part.column("text")))
            truth = part.column("label").to_numpy(zero_copy_only=False)
            rows += [(x.slot[a:b], x.value[a:b].astype(np.float32), float(y)) for a, b, y in zip(x.at[:-1], x.at[1:], truth, strict=True)]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    order = np.random.default_rng(0)
    picks = np.concatenate([order.permutation(len(rows)) for _ in range(-(-STEPS // len(rows)))]) if rows else []
    for k in picks:
        slot, value, y = rows[k]
        w = leader(z[slot], n[slot])
        miss = 1 / (1 + np.exp(-np.clip(value @ w + bias, -35, 35))) - y
        g = miss * value
        z[slot] += g - (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA * w
        n[slot] += g * g
        zb += miss - (np.sqrt(nb + miss * miss) - np.sqrt(nb)) / ALPHA * bias
        nb += miss * miss
        bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    yield pa.RecordBatch.from_pydict(
        {
            "weights": pa.array([leader(z, n).astype(np.float32).tobytes()], pa.binary()),
            "bias": pa.array([float(bias)]),
            "n": pa.array([len(rows)], pa.int64()),
        }
    )


def fit(rows: DataFrame) -> Model:
    """A model from ``rows(doc_id, text, label)``, a bounded number of them. Without rows every score is one half."""
    rows = cut(rows.repartition(SHARDS, F.xxhash64("doc_id")), "quality-sample")
    found = [r for r in rows.coalesce(SHARDS).mapInArrow(train, "weights binary, bias double, n long").collect() if r.n]
    discard(rows)
    if not found:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    share = np.array([r.n for r in found]) / sum(r.n for r in found)
    weights = sum(s * np.frombuffer(r.weights, np.float32) for s, r in zip(share, found, strict=True))
    return Model(weights.astype(np.float32), float(sum(s * r.bias for s, r in zip(share, found, strict=True))))


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    x = vectors(*bytes_of(texts))
    rows = np.repeat(np.arange(len(texts)), np.diff(x.at))
    margin = np.bincount(rows, model.weights[x.slot] * x.value, len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row. A null or empty text has the score of the bias alone."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probabilities(batch.column(1), model)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, part, "doc_id long, score double, predicted int", "text")


def grade(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on at most ``max_rows`` usable labelled documents and score every row of ``docs``."""
    return score(docs, fit(labelled(docs, labels, "quality", usable, max_rows)), threshold)


def good(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``."""
    model = fit(labelled(docs, labels, "quality", usable, max_rows))
    return kept_rows(docs, lambda texts: probabilities(texts, model) >= threshold)
