"""Toxic spans by a linear-chain conditional random field.

Training: documents are labelled, not tokens, so tokens get their labels first. Words and word beginnings
that are far more frequent in toxic training documents than in clean ones are candidates; a greedy cover keeps
those that explain toxic documents which fewer than three earlier ones explain, so words that merely
occur beside them are not taken. Many candidates with the very same documents are the words of one copied
text or phrase; one of them is kept where no other marks those documents. A token of a toxic document with a kept feature is labelled 1, every other
token 0. The field has two states with hashed word and word-beginning features and transition weights; it
is trained on shards of a bounded sample by the gradient of its log-likelihood (forward-backward) and the
shards' weights are averaged.

Scoring: forward-backward marginals of every token of the whole text. The document's score is the largest
marginal, a span is a run of tokens with a marginal of at least one half.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import bytes_of, cut, discard, kept_rows, map_arrow, slices
from aislewise.llm.sampling import labelled
from aislewise.llm.tokens import Tokens, mix, tokenize

PREFIXES = (4, 5, 6, 7)
BITS = 18
MAX_ROWS = 20_000
SHARDS = 8
STEPS = 240
MIN_SUPPORT = 5
MIN_LIFT = 40
COVER = 3
MAX_BUNDLE = 12


class Field(NamedTuple):
    weights: np.ndarray  # of the toxic state, by hashed feature
    bias: float
    step: np.ndarray  # log potentials of the transitions, 2 x 2


def features(tokens: Tokens) -> np.ndarray:
    """Shape (features, tokens): 64-bit hashes of the word and its beginnings, kinds kept apart."""
    return np.stack([mix(h + np.uint64(n * 0x51ED27)) for n, h in tokens.hashes.items()]) if len(tokens.start) else np.zeros((1 + len(PREFIXES), 0), np.uint64)


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


class Chain(NamedTuple):
    """Tokens of several texts by position, then by text in order of falling length."""

    order: np.ndarray  # place of each token in the sequence
    at: np.ndarray  # first place of each position, and the end
    doc: np.ndarray  # text of each place


def chain(doc: np.ndarray) -> Chain:
    """``doc``: text of each token, tokens of a text together and in order."""
    texts, first, length = np.unique(doc, return_index=True, return_counts=True)
    rank = np.empty(len(texts), np.int64)
    by_length = np.argsort(-length, kind="stable")
    rank[by_length] = np.arange(len(texts))
    at = np.concatenate(([0], np.cumsum(np.searchsorted(-length[by_length], -np.arange(length.max(initial=0))))))
    position = np.arange(len(doc)) - np.repeat(first, length)
    order = at[position] + np.repeat(rank, length)
    placed = np.empty(len(doc), np.int64)
    placed[order] = doc
    return Chain(order, at, placed)


def forward_backward(score: np.ndarray, c: Chain, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state, by place, from the left, from the right, and exp(score).

    With two states both recursions need only the ratio of the states, which stays finite.
    """
    grown = np.exp(np.clip(score, -40, 40))
    (t00, t01), (t10, t11) = np.exp(step)
    left, right = np.empty_like(grown), np.ones_like(grown)
    at = c.at.tolist()
    left[: at[1] if len(at) > 1 else 0] = grown[: at[1] if len(at) > 1 else 0]
    for a, b, e in zip(at[:-2], at[1:-1], at[2:], strict=True):
        before = left[a : a + e - b]
        left[b:e] = grown[b:e] * (t01 + t11 * before) / (t00 + t10 * before)
    for a, b, e in zip(at[-3::-1], at[-2:0:-1], at[:1:-1], strict=True):
        after = grown[b:e] * right[b:e]
        right[a : a + e - b] = (t10 + t11 * after) / (t00 + t01 * after)
    return left, right, grown


def marginals(field: Field, tokens: Tokens) -> np.ndarray:
    """Probability of the toxic state for each token."""
    if not len(tokens.start):
        return np.zeros(0)
    c = chain(tokens.doc)
    score = np.empty(len(tokens.start))
    score[c.order] = field.weights[slot(features(tokens))].sum(axis=0) + field.bias
    left, right, _ = forward_backward(score, c, field.step)
    odds = left * right
    return (odds / (1 + odds))[c.order]


def gradient(field: Field, tokens: Tokens, truth: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood: by feature slot, of all tokens together, of the transitions."""
    c = chain(tokens.doc)
    places = slot(hashes)
    score, y = np.empty(len(truth)), np.empty(len(truth))
    score[c.order] = field.weights[places].sum(axis=0) + field.bias
    y[c.order] = truth
    left, right, grown = forward_backward(score, c, field.step)
    odds = left * right
    miss = (y - odds / (1 + odds))[c.order]
    by_slot = np.bincount(places.ravel(), np.tile(miss, len(places)), 1 << BITS)
    # Places that have a successor are those before it minus the texts that end there.
    size = np.diff(c.at)
    follow = np.arange(c.at[1], len(truth)) if len(size) > 1 else np.zeros(0, np.int64)
    prior = follow - np.repeat(size[:-1], size[1:]) if len(size) > 1 else follow
    (t00, t01), (t10, t11) = np.exp(field.step)
    gain = grown[follow] * right[follow]
    pair = np.stack([np.full(len(follow), t00), t01 * gain, t10 * left[prior], t11 * left[prior] * gain])
    pair /= pair.sum(axis=0)
    seen = np.bincount((2 * y[prior] + y[follow]).astype(np.int64), minlength=4)
    return by_slot, miss.sum(), (seen - pair.sum(axis=1)).reshape(2, 2)


def fit(rows: DataFrame) -> Field:
    """A field from ``rows(doc_id, text, label)``, a bounded number of them (``labelled`` takes them).

    Without toxic rows every text scores close to zero.
    """
    rows = cut(rows.repartition(SHARDS, F.xxhash64("doc_id")), "toxic-sample")
    cues = cue_features(rows)
    found = rows.coalesce(SHARDS).mapInArrow(lambda batches: train(batches, cues), "weights binary, bias double, step array<double>, n long").collect()
    found = [r for r in found if r.n]
    discard(rows)
    if not found:
        return Field(np.zeros(1 << BITS), -20.0, np.zeros((2, 2)))
    share = np.array([r.n for r in found]) / sum(r.n for r in found)
    # A feature is averaged over the shards that met it.
    each = np.stack([np.frombuffer(r.weights, np.float32) for r in found])
    weights = each.sum(axis=0) / np.maximum((each != 0).sum(axis=0), 1)
    return Field(
        weights,
        float(sum(s * r.bias for s, r in zip(share, found, strict=True))),
        sum(s * np.array(r.step).reshape(2, 2) for s, r in zip(share, found, strict=True)),
    )


def cue_features(rows: DataFrame) -> np.ndarray:
    """Features that mark a token of a toxic document as toxic, as signed hashes, sorted.

    Candidates are features of the bounded sample's toxic documents; nothing else bounds their number.
    """

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = tokenize(*bytes_of(batch.column(1)), PREFIXES)
        hashes = features(tokens)
        label = batch.column(2).to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(tokens.doc, np.arange(batch.num_rows + 1))
        sides = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
        for i, y in enumerate(label.tolist()):
            sides[y == 0].append(np.unique(hashes[:, bounds[i] : bounds[i + 1]]))
        (a, n), (b, m) = (np.unique(np.concatenate(side), return_counts=True) for side in sides)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, b]).astype(np.int64)), pa.array(np.concatenate([n, 0 * m])), pa.array(np.concatenate([0 * n, m]))],
            ["feature", "toxic", "clean"],
        )

    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    lift = F.col("toxic") * n.get(0, 0) >= MIN_LIFT * n.get(1, 0) * (F.col("clean") + 0.5)
    candidates = (
        map_arrow(rows.select("doc_id", "text", "label"), counts, "feature long, toxic long, clean long", "text", 1 << 20)
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= MIN_SUPPORT) & lift)
        .select("feature", "clean")
        .toPandas()
        .sort_values("feature")
    )
    known = candidates.feature.to_numpy(np.int64)
    clean = dict(zip(known.tolist(), candidates.clean.tolist(), strict=True))

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = tokenize(*bytes_of(batch.column(1)), PREFIXES)
        hashes = features(tokens).astype(np.int64)
        hit = np.isin(hashes, known)
        docs = np.broadcast_to(tokens.doc, hashes.shape)[hit]
        found = np.unique(np.rec.fromarrays([docs, hashes[hit]], names="doc,feature"))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(ids[found.doc]), pa.array(found.feature)], ["doc_id", "feature"])

    if not len(known):
        return known
    pairs = map_arrow(rows.where("label = 1").select("doc_id", "text"), held, "doc_id long, feature long", "text", 1 << 20).toPandas()
    docs, doc = np.unique(pairs.doc_id.to_numpy(), return_inverse=True)
    names, name = np.unique(pairs.feature.to_numpy(), return_inverse=True)
    # The same set of documents gives the same sum of random numbers.
    mark = np.bincount(name, np.random.default_rng(0).random(len(docs))[doc], len(names)).round(9)
    _, at, bundle = np.unique(mark, return_inverse=True, return_counts=True)
    loose = bundle[at] <= MAX_BUNDLE
    cost = np.array([5 * clean[k] for k in names.tolist()])
    kept, need = [], np.full(len(docs), COVER)
    while len(name):
        gain = np.where(loose, np.bincount(name, need[doc] > 0, len(names)) - cost, 0)
        best = int(gain.argmax())
        if gain[best] < MIN_SUPPORT:
            break
        kept.append(names[best])
        loose[best] = False
        need[doc[name == best]] -= 1
    # Of words that always occur together one marks the documents that no other cue does.
    bundled = bundle[at] > MAX_BUNDLE
    while True:
        gain = np.where(bundled, np.bincount(name, need[doc] == COVER, len(names)) - cost, 0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < MIN_SUPPORT:
            break
        kept.append(names[best])
        need[doc[name == best]] -= 1
    return np.sort(np.array(kept, np.int64))


def train(batches, cues: np.ndarray):
    """One shard: AdaGrad steps over parts of its texts; yields weights, bias, transitions, number of texts."""
    parts, n = [], 0
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            tokens = tokenize(*bytes_of(part.column("text")), PREFIXES)
            if len(tokens.start):
                hashes = features(tokens)
                toxic = part.column("label").to_numpy(zero_copy_only=False)[tokens.doc] > 0
                truth = toxic & np.isin(hashes.astype(np.int64), cues).any(axis=0)
                # Away from labelled tokens one token in a few says as much as all of them.
                parts.append(thinned(tokens, truth, hashes))
                n += part.num_rows
    field = Field(np.zeros(1 << BITS), -3.0, np.zeros((2, 2)))
    squares = [np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    steps = max(STEPS, len(parts)) if parts else 0
    for k in range(steps):
        found = gradient(field, *parts[k % len(parts)])
        squares = [s + g * g for s, g in zip(squares, found, strict=True)]
        moved = [(1 - 0.5 * k / steps) * g / np.sqrt(s) for g, s in zip(found, squares, strict=True)]
        field = Field(field.weights + moved[0], field.bias + moved[1], field.step + moved[2])
    yield pa.RecordBatch.from_pydict(
        {
            "weights": pa.array([field.weights.astype(np.float32).tobytes()], pa.binary()),
            "bias": pa.array([float(field.bias)]),
            "step": pa.array([field.step.ravel().tolist()], pa.list_(pa.float64())),
            "n": pa.array([n], pa.int64()),
        }
    )


def thinned(tokens: Tokens, truth: np.ndarray, hashes: np.ndarray, reach: int = 40) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Training tokens: those within ``reach`` of a toxic one, and every fourth stretch of ``reach`` tokens."""
    near = np.convolve(truth, np.ones(2 * reach + 1), "same") > 0.5 if len(truth) > 2 * reach else np.ones(len(truth), bool)
    keep = near | ((np.arange(len(truth)) // reach) % 4 == 0)
    return Tokens(tokens.start[keep], tokens.end[keep], tokens.doc[keep], {}), truth[keep], hashes[:, keep]


def score(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, score, predicted, spans)`` of every row; spans are character ranges with their largest marginal.

    A null or empty text has score 0 and no spans.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = bytes_of(batch.column(1))
        tokens = tokenize(data, offsets, PREFIXES)
        p = marginals(field, tokens)
        best = largest(tokens, p, batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(best), pa.array((best >= threshold).astype(np.int32)), pa.array(spans(data, offsets, tokens, p, threshold), SPANS)],
            ["doc_id", "score", "predicted", "spans"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, part, "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,p:double>>", "text")


def largest(tokens: Tokens, p: np.ndarray, n: int) -> np.ndarray:
    """Largest marginal of each of ``n`` texts, 0 without tokens."""
    best = np.zeros(n)
    np.maximum.at(best, tokens.doc, p)
    return best


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def spans(data: np.ndarray, offsets: np.ndarray, tokens: Tokens, p: np.ndarray, threshold: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in offsets[:-1]]
    hit = np.flatnonzero(p >= threshold)
    if not len(hit):
        return out
    # Characters before a byte: bytes that do not continue another character.
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    fresh = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(tokens.doc[hit]) > 0)))
    for run in np.split(hit, np.flatnonzero(fresh)[1:]):
        doc = int(tokens.doc[run[0]])
        base = chars[offsets[doc]]
        out[doc].append(
            {"start": int(chars[tokens.start[run[0]]] - base), "end": int(chars[tokens.end[run[-1]]] - base), "p": float(p[run].max())}
        )
    return out


def tag(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on at most ``max_rows`` usable labelled documents and score every row of ``docs``."""
    return score(docs, fit(labelled(docs, labels, "toxic", usable, max_rows)), threshold)


def harmless(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    field = fit(labelled(docs, labels, "toxic", usable, max_rows))

    def keep(texts: pa.Array) -> np.ndarray:
        tokens = tokenize(*bytes_of(texts), PREFIXES)
        return largest(tokens, marginals(field, tokens), len(texts)) < threshold

    return kept_rows(docs, keep)
