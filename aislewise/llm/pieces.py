"""SentencePiece encoding and decoding with the n best segmentations.

A model gives pieces with scores; a segmentation of a text is a path through the lattice of its pieces and
scores the sum of theirs. Spaces become the mark U+2581 and a text gets one in front, as the format
prescribes. A character that is no piece is spelled in byte pieces, at ten below the worst score; so is a
mark that the text itself holds, which makes decoding exact. Pieces of several marks are not used, hence no
piece crosses a mark, nor a character that is in no longer piece: the lattice falls into segments there.

Encoding runs the forward Viterbi recursion over all different segments of many texts at once. The n best
segmentations of a segment come from a backward A-star search whose heuristic, the forward Viterbi score, is
exact, so a path is complete whenever it is popped. The n best of a text differ from its best only in the
n - 1 segments that lose least by their second-best path, so the search runs on those alone.
"""

from __future__ import annotations

import heapq
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import bytes_of, map_arrow

MARK = 0x2581
OWN_MARK = 0x110000  # stands for a mark that the text holds
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 20


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # sorted, of the usable pieces
    ids: np.ndarray
    scores: np.ndarray  # by id
    inside: np.ndarray  # characters of longer pieces
    longest: int
    bytes: list[bytes]  # by id, decoded
    byte_ids: np.ndarray
    unknown: float


def _hash(chars) -> int:
    h = 0
    for c in chars:
        h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def vocabulary(path: str = MODEL) -> Vocabulary:
    """The pieces of a SentencePiece model file with byte pieces. Read on the driver; executors get the arrays."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    usable = [
        i for i, name in enumerate(names)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and chr(MARK) not in name[1:]
    ]
    return from_pieces(
        {i: (names[i], model.get_score(i)) for i in usable}, {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
    )


def from_pieces(pieces: dict[int, tuple[str, float]], byte_ids: dict[int, int]) -> Vocabulary:
    size = 1 + max([*pieces, *byte_ids.values()])
    hashes = np.array([_hash(map(ord, pieces[i][0])) for i in pieces], np.uint64)
    order = np.argsort(hashes)
    scores, decoded, spelled = np.zeros(size), [b""] * size, np.zeros(256, np.int64)
    for i, (name, score) in pieces.items():
        scores[i], decoded[i] = score, name.replace(chr(MARK), " ").encode()
    for b, i in byte_ids.items():
        spelled[b], decoded[i] = i, bytes([b])
    inside = sorted({ord(c) for name, _ in pieces.values() if len(name) > 1 for c in name})
    return Vocabulary(
        hashes[order], np.array(list(pieces))[order], scores, np.array(inside),
        max(len(name) for name, _ in pieces.values()), decoded, spelled, min(s for _, s in pieces.values()) - 10,
    )


def slots(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOTS)


class Lookup:
    """Pieces by hash: a table of first candidates, and for each piece the next one in its slot.

    ``inside`` marks the characters that longer pieces hold. Built once in a task.
    """

    def __init__(self, v: Vocabulary):
        self.hashes = np.append(v.hashes, np.uint64(0))
        self.inside = np.zeros(OWN_MARK + 1, bool)
        self.inside[v.inside] = True
        self.first = np.full(1 << SLOTS, -1, np.int32)
        self.next = np.full(len(v.hashes), -1)
        left = np.arange(len(v.hashes))
        slot = slots(v.hashes).astype(np.int64)
        while len(left):
            _, one = np.unique(slot[left], return_index=True)
            new = left[one]
            self.next[new] = self.first[slot[new]]
            self.first[slot[new]] = new
            left = np.delete(left, one)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold a piece, in order, and the numbers of the pieces."""
        guess = self.first[slots(h)]
        at = np.flatnonzero(guess >= 0)
        guess = guess[at].astype(np.int64)
        wrong = np.flatnonzero(self.hashes[guess] != h[at])
        while len(wrong):
            guess[wrong] = self.next[guess[wrong]]
            wrong = wrong[guess[wrong] >= 0]
            wrong = wrong[self.hashes[guess[wrong]] != h[at[wrong]]]
        found = guess >= 0
        return at[found], guess[found]


def utf8(char: int) -> bytes:
    return chr(MARK if char == OWN_MARK else char).encode()


class Segments(NamedTuple):
    """Best segmentation of each segment: its pieces are ``ids[at[i]:at[i + 1]]``."""

    at: np.ndarray
    ids: np.ndarray
    score: np.ndarray
    gap: np.ndarray  # loss of the second-best path, infinite if there is none


def viterbi(chars: np.ndarray, start: np.ndarray, length: np.ndarray, v: Vocabulary, lookup: Lookup) -> Segments:
    """Two best scores and the best path of the segments ``chars[start[i]:start[i] + length[i]]``.

    All segments advance one character at a time; they are kept in order of falling length, so those
    that go on are always the first ones.
    """
    n = len(start)
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    alive = np.searchsorted(-size, -np.arange(size.max(initial=0) + 1), "right")
    powers = np.cumprod(np.full(v.longest + 1, BASE, np.uint64))
    prefix = [np.zeros(n, np.uint64)]
    best, second = [np.zeros(n)], [np.full(n, -np.inf)]
    width, piece, count = [np.zeros(n, np.int8)], [np.zeros(n, np.int64)], [np.zeros(n, np.int64)]
    for p in range(1, len(alive)):
        k = alive[p]
        char = chars[begin[:k] + p - 1]
        prefix.append(prefix[-1][:k] * BASE + (char + 1).astype(np.uint64))
        b1, b2 = np.full(k, -np.inf), np.full(k, -np.inf)
        back, name, ids = np.zeros(k, np.int8), np.full(k, -1), np.zeros(k, np.int64)
        for w in range(1, min(p, v.longest) + 1):
            h = prefix[p] - prefix[p - w][:k] * powers[w - 1]
            at, found = lookup(h)
            found = v.ids[found]
            if w == 1:
                lost = np.ones(k, bool)
                lost[at] = False
                lost = np.flatnonzero(lost)
                spelled = 1 + (char[lost] >= 0x80) + (char[lost] >= 0x800) + ((char[lost] >= 0x10000) & (char[lost] != OWN_MARK))
                at, found = np.concatenate([at, lost]), np.concatenate([found, -spelled])
            score = np.where(found < 0, v.unknown, v.scores[found])
            c1, c2, o1, o2 = best[p - w][at] + score, second[p - w][at] + score, b1[at], b2[at]
            wins = c1 > o1
            b1[at] = np.where(wins, c1, o1)
            b2[at] = np.where(wins, np.maximum(o1, c2), np.maximum(o2, c1))
            at, found = at[wins], found[wins]
            back[at], name[at], ids[at] = w, found, count[p - w][at] + np.maximum(1, -found)
        for kept, new in zip((best, second, width, piece, count), (b1, b2, back, name, ids), strict=True):
            kept.append(new)
    offset = np.concatenate(([0], np.cumsum([len(x) for x in best])))
    flat = [np.concatenate(x) for x in (best, second, width, piece, count)]
    last = offset[size] + np.arange(n)
    number = np.empty(n, np.int64)
    number[order] = flat[4][last]
    at = np.concatenate(([0], np.cumsum(number)))
    ids = np.empty(at[-1], np.int32)
    where, stop, rank = size.copy(), at[order] + flat[4][last], np.arange(n)
    while len(rank):
        node = offset[where] + rank
        w, found = flat[2][node], flat[3][node]
        known = found >= 0
        ids[stop[known] - 1] = found[known]
        for i in np.flatnonzero(~known):
            code = utf8(int(chars[begin[rank[i]] + where[i] - 1]))
            ids[stop[i] - len(code) : stop[i]] = v.byte_ids[list(code)]
        stop, where = stop - np.maximum(1, -found), where - w
        on = where > 0
        rank, stop, where = rank[on], stop[on], where[on]
    score, gap = np.empty(n), np.empty(n)
    score[order], gap[order] = flat[0][last], flat[0][last] - flat[1][last]
    return Segments(at, ids, score, gap)


def nbest(chars: tuple[int, ...], n: int, v: Vocabulary) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations ``(score, ids)`` of one segment, best first; fewer if there are fewer.

    Forward Viterbi, then A-star from the end. Of equal scores the path found first comes first.
    """
    m = len(chars)
    ahead = [0.0] + [-np.inf] * m
    edges: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(m + 1)]
    for p in range(1, m + 1):
        for w in range(1, min(p, v.longest) + 1):
            h = np.uint64(_hash(chars[p - w : p]))
            i = int(np.searchsorted(v.hashes, h))
            if i < len(v.hashes) and v.hashes[i] == h:
                edges[p].append((p - w, float(v.scores[v.ids[i]]), [int(v.ids[i])]))
            elif w == 1:
                edges[p].append((p - 1, v.unknown, v.byte_ids[list(utf8(chars[p - 1]))].tolist()))
        ahead[p] = max(ahead[a] + s for a, s, _ in edges[p])
    found: list[tuple[float, list[int]]] = []
    agenda, tick = [(-ahead[m], 0, m, 0.0, ())], 1
    while agenda and len(found) < n:
        _, _, p, behind, path = heapq.heappop(agenda)
        if p == 0:
            ids: list[int] = []
            while path:
                ids, path = ids + path[0], path[1]
            found.append((behind, ids))
            continue
        for a, s, piece in edges[p]:
            heapq.heappush(agenda, (-(ahead[a] + behind + s), tick, a, behind + s, (piece, path)))
            tick += 1
    return found


class Split(NamedTuple):
    """Characters of many texts with marks, and the segments they fall into."""

    chars: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray  # first segment of each text, and the end


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Split:
    chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    head = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    filled = head[:-1] < head[1:]
    chars = np.where(chars == MARK, OWN_MARK, np.where(chars == 32, MARK, chars))
    chars = np.insert(chars, head[:-1][filled], MARK)
    head = head + np.concatenate(([0], np.cumsum(filled)))
    alone = ~inside[chars]
    opens = (chars == MARK) | alone
    opens[1:] |= alone[:-1]
    opens[head[:-1][filled]] = True
    start = np.flatnonzero(opens)
    return Split(chars, start, np.diff(np.append(start, len(chars))), np.searchsorted(start, head))


def spread(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the ranges ``at[w]:at[w + 1]`` of each ``w`` in ``which``, one range after another."""
    size = (at[1:] - at[:-1])[which]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - size), size)


SCHEMA = (
    "doc_id long, ids array<int>, n_pieces long, score double, round_trip boolean, "
    "nbest array<struct<score:double,n_pieces:long,changes:array<struct<segment:long,ids:array<int>>>>>"
)
NBEST = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            ("n_pieces", pa.int64()),
            ("changes", pa.list_(pa.struct([("segment", pa.int64()), ("ids", pa.list_(pa.int32()))]))),
        ]
    )
)


def encode(docs: DataFrame, v: Vocabulary, n: int = 4) -> DataFrame:
    """``(doc_id, ids, n_pieces, score, round_trip, nbest)`` of every row of ``docs``.

    ``nbest`` has the ``n`` best segmentations, best first, each as its score, its number of pieces and the
    segments that differ from ``ids``; it is shorter if a text has fewer. ``round_trip`` tells whether
    decoding gives the text again. A null text has null ids and an empty text has none; both have score 0
    and no alternatives.
    """
    known: dict[tuple[int, ...], list[tuple[float, list[int]]]] = {}
    tables: list[Lookup] = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        data, offsets = bytes_of(texts)
        if not tables:
            tables.append(Lookup(v))
        s = split(data, offsets, tables[0].inside)
        sums = np.zeros(len(s.chars) + 1, np.uint64)
        # A segment is known by a hash of its characters, relative to its first.
        rank = np.arange(len(s.chars)) - np.repeat(s.start, s.length)
        power = np.cumprod(np.full(int(rank.max(initial=0)) + 1, BASE, np.uint64))
        np.cumsum((s.chars + 1).astype(np.uint64) * power[rank], out=sums[1:])
        _, one, which = np.unique(sums[s.start + s.length] - sums[s.start], return_index=True, return_inverse=True)
        best = viterbi(s.chars, s.start[one], s.length[one], v, tables[0])
        ids = best.ids[spread(best.at, which)]
        size = np.diff(best.at)[which]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[s.first])
        bounds = np.concatenate(([0], np.cumsum(size)))
        at = bounds[s.first]
        score, gap = best.score[which], best.gap[which]
        scores = np.array([score[a:b].sum() for a, b in zip(s.first[:-1], s.first[1:], strict=True)])
        flat = ids.tolist()
        same, lists = [], []
        for i, text in enumerate(_texts(data, offsets)):
            a, b = int(s.first[i]), int(s.first[i + 1])
            same.append(decode(flat[at[i] : at[i + 1]], v) == text)
            near = a + np.sort(least(gap[a:b], n - 1))
            lists.append(alternatives(near[np.isfinite(gap[near])], a, s, bounds, flat, float(scores[i]), int(at[i + 1] - at[i]), n) if b > a else [])
        arrays = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), arrays, pa.array(total(size)), pa.array(scores), pa.array(same), pa.array(lists, NBEST)],
            ["doc_id", "ids", "n_pieces", "score", "round_trip", "nbest"],
        )

    def alternatives(near: np.ndarray, first: int, s: Split, bounds: np.ndarray, flat: list[int], score: float, pieces: int, n: int) -> list[dict]:
        ways = [(0.0, pieces, ())]
        for i in near.tolist():
            chars = tuple(s.chars[s.start[i] : s.start[i] + s.length[i]].tolist())
            if chars not in known:
                if len(known) >= 100_000:
                    known.clear()
                known[chars] = nbest(chars, n, v)
            found, own = known[chars], flat[bounds[i] : bounds[i + 1]]
            # Of paths with equal scores the two searches may put different ones first.
            others = [(other, ids) for other, ids in found if ids != own][: n - 1]
            more = [
                (loss + found[0][0] - other, count + len(ids) - len(own), (*changes, (i - first, ids)))
                for loss, count, changes in ways
                for other, ids in others
            ]
            ways = sorted(ways + more, key=itemgetter(0))[:n]
        return [
            {"score": score - loss, "n_pieces": count, "changes": [{"segment": i, "ids": ids} for i, ids in changes]}
            for loss, count, changes in ways
        ]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, part, SCHEMA, "text")


def least(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest values, of equal ones the first."""
    if k >= len(values):
        return np.arange(len(values))
    bound = np.partition(values, k - 1)[k - 1]
    below = np.flatnonzero(values < bound)
    return np.concatenate([below, np.flatnonzero(values == bound)[: k - len(below)]])


def _texts(data: np.ndarray, offsets: np.ndarray):
    whole, bounds = data.tobytes(), offsets.tolist()
    return (whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def decode(ids: list[int], v: Vocabulary) -> bytes:
    """The text of a sequence of pieces, in UTF-8, without the space in front."""
    names = v.bytes
    return b"".join([names[i] for i in ids])[1:]
