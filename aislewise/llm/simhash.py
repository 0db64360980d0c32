"""SimHash near-duplicates by anchor-point covering.

Every text has a 64-bit fingerprint; texts whose fingerprints differ in at most three bits are linked. Of
three differing bits at most one falls in one of the two 32-bit halves, so a half is searched with
threshold one. Anchors of a half are the words of a covering code: the perfect binary Golay code on 23 of
its bits (covering radius 3) times all words of the other 9 bits (radius 0). Each fingerprint lies at its
nearest anchor, its home, and is replicated to every anchor within covering radius plus threshold, about
15 a half; it is compared with the fingerprints whose home that anchor is. No pair can be missed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import ASCII_LOWER, components, cut, discard, map_arrow, spanning, texts_of

THRESHOLD = 3
SEED = 42
# Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0b101011100011
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> bytes:
    """Eight bytes: the bits set in over half the hashes of the word shingles, repeats included.

    A text of fewer words is one shingle, one without words gives zero.
    """
    parts = text.translate(ASCII_LOWER).split()
    if not parts:
        return bytes(8)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    starts, ends = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(starts)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, copy, fingerprint, bits)``: a hash of the text, 16 hex digits, and the same bits as a signed long. A null text has no words."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, words) for t in texts_of(batch.column(1))]
        bits = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([f.hex() for f in found], pa.string()), pa.array(bits)], ["doc_id", "copy", "fingerprint", "bits"]
        )

    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    return map_arrow(rows, part, "doc_id long, copy long, fingerprint string, bits long", "text")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the nearest error pattern, and the error patterns of weight four.

    A word plus one of its patterns is a code word. Words at distance three have five code words at
    distance four, all others have none; absent places hold -1.
    """

    def syndromes(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (GOLAY << bit - 11), x)
        return x

    nearest = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
        nearest[syndromes(patterns)] = patterns
    four = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)])
    at = syndromes(four)
    order = np.argsort(at, kind="stable")
    second = np.full((2048, 5), -1, np.int64)
    place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
    second[at[order], place] = four[order]
    return nearest, second


def anchors_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home anchors, one for each half, and all anchors to replicate to, with -1 where there is none.

    Shapes (n, 2) and (n, 2, 15). An anchor is a non-negative long: half, nine raw bits, 23-bit code word.
    """
    nearest, second = golay_tables()
    x = bits.astype(np.uint64)
    halves = np.stack([x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)
    low, raw = halves & 0x7FFFFF, halves >> 23
    rest = low.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << bit - 11), rest)
    code = low ^ nearest[rest]
    side = np.array([0, 1 << 40])
    home = side | raw << 23 | code
    flips = side[:, None] | (raw[..., None] ^ (1 << np.arange(9))) << 23 | code[..., None]
    errors = second[rest]
    others = np.where(errors < 0, -1, side[:, None] | raw[..., None] << 23 | (low[..., None] ^ errors))
    return home, np.concatenate([home[..., None], flips, others], axis=2)


def links(points: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of the ids of ``points(id, bits)``, distinct bits, that differ in at most three bits.

    Spark takes the 2 homes and about 30 replicas of a point for one row each and would broadcast the replicas of
    a few hundred thousand points, so the join is told to merge.
    """

    def homes(batches):
        for batch in batches:
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            home, _ = anchors_of(bits)
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(home[:, k]), batch.column(0), batch.column(1)], ["anchor", "id", "bits"])

    def replicas(batches):
        for batch in batches:
            ids, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in range(0, len(ids), 20_000):
                part = slice(k, k + 20_000)
                _, near = anchors_of(bits[part])
                flat = near.reshape(len(near), -1)
                row, col = np.nonzero(flat >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[row, col]), pa.array(ids[part][row]), pa.array(bits[part][row])], ["anchor", "other", "other_bits"]
                )

    at_home = points.select("id", "bits").mapInArrow(homes, "anchor long, id long, bits long")
    around = points.select("id", "bits").mapInArrow(replicas, "anchor long, other long, other_bits long")
    near = (F.col("id") < F.col("other")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))) <= THRESHOLD)
    return at_home.hint("merge").join(around, (at_home.anchor == around.anchor) & near).select(F.col("id").alias("a"), F.col("other").alias("b"))


def classes(docs: DataFrame, point: Column, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, copy, fingerprint, bits, component_id)`` of every row of ``docs``; ``copy`` is a hash of its text.

    Equal fingerprints are one point, so copies never meet each other; ``point`` names it by its ``id``, the
    smallest, or by its ``bits``, and a component is named by its smallest point. Rows without an id get their
    fingerprint and a null component. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, words, id_column, text_column), "fingerprints")
    points = prints.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("id"))
    points = cut(points.select("bits", point.alias("id")), "points")
    found = components(spanning(links(points)))
    of_bits = cut(
        points.hint("merge").join(found, points.id == found.node, "left").select(F.col("bits").alias("point"), F.coalesce("component", "id").alias("component")),
        "classes",
    )
    discard(points)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    return prints.hint("merge").join(of_bits, prints.bits == of_bits.point, "left").select("doc_id", "copy", "fingerprint", "bits", component)


def near_duplicates(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, kept`` (see :func:`classes`).

    Rows without an id are kept; repeated ids are one document.
    """
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return classes(docs, F.col("id"), words, id_column, text_column).select("doc_id", "fingerprint", "component_id", kept.alias("kept"))


def representatives(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when one of each group of near copies does.

    The smallest id of a group stays, and under it, if rows repeat an id, the text with the smallest hash; of
    equal rows one stays. Rows without an id all stay. Only keys meet before it is known what stays.
    """
    rows = classes(docs, F.col("bits"), words).where("doc_id is not null").groupBy("component_id", "doc_id", "copy").agg(F.count("*").alias("n"))
    least = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "copy", "n")).alias("x"))
    kept = cut(least.select(F.col("x.doc_id").alias("kept_id"), F.col("x.copy").alias("kept_copy"), F.col("x.n").alias("n")), "kept")
    same = (docs["doc_id"].cast("long") == kept["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == kept["kept_copy"])
    once = docs.join(kept.where("n = 1"), same, "left_semi")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        once = once.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
