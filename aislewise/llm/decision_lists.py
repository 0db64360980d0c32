"""Quality rules as a learned decision list.

Whole texts become a few counts. From labelled ones the list is learned by sequential covering: a rule is
grown condition by condition, each the threshold on one statistic that gains most (FOIL), until it covers no
good document or nothing gains; on labelled rows kept aside it is pruned from its end, and it enters the list
if it is right there often enough. What it covers is taken out and the next rule is grown. The list is
emitted as one ordered Spark expression, ``CASE WHEN ... THEN ...``, so it can be read, stored and edited.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import map_arrow, texts_of
from aislewise.llm.sampling import labelled

MAX_ROWS = 20_000
MIN_WORDS = 50
# Characters counted as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_same", "n_distinct")
STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
MARKS = b".,;:!?"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
# Bytes that continue a character.
CONTINUED = bytes(range(0x80, 0xC0))
THRESHOLDS = 64
MAX_CONDITIONS = 4
MIN_COVER = 5
MIN_PRECISION = 0.8


class Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def repeated(ids: np.ndarray) -> int:
    """Number of words in windows of three that occur more than once. Words are compared by number, so no hash decides."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-2] * (ids.max() + 1) + ids[1:-1], return_inverse=True)
    _, window, count = np.unique(pair * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    start = count[window] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= start
    return int(hit.sum())


def count(text: bytes) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``COUNTS`` and ``MORE``."""
    words = text.split()
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    solid = b"".join(words)
    chars = len(solid) - len(solid.translate(None, CONTINUED))
    lines = [x for x in text.split(b"\n") if x.split()]
    kept = lambda some: len(solid) - len(solid.translate(None, some))
    return (
        len(words), len(solid) - chars, kept(SYMBOLS), len(lines) - len(set(lines)), repeated(ids),
        len(lines), kept(UPPER), kept(DIGITS), kept(MARKS), int((ids[1:] == ids[:-1]).sum()), len(numbers),
    )


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, <counts>, ...)`` of every row's whole text; a null text counts as empty. ``more`` columns, longs, are passed on.

    Words are runs without white space, ``word_chars`` their characters, ``n_symbols`` those of ``SYMBOLS``,
    ``n_dup_lines`` lines with a word that equal an earlier line, ``n_repeat_words`` words in windows of three
    found twice or more, ``n_same`` words equal to the one before, ``n_distinct`` different words.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([count(t) for t in texts_of(batch.column(1))], np.int64).reshape(-1, len(COUNTS + MORE))
        columns = [batch.column(0), *(pa.array(found[:, k]) for k in range(found.shape[1])), *batch.columns[2:]]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *MORE, *more])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in more)
    )
    return map_arrow(rows, part, STATISTICS + "".join(f", {c} long" for c in more), "text")


# What conditions compare with thresholds, as SQL over the counts.
FEATURES = {
    "words": "double(n_words)",
    "word length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeated lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated words": "n_repeat_words / greatest(n_words, 1)",
    "words a line": "n_words / greatest(n_lines, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "stutter": "n_same / greatest(n_words, 1)",
    "different words": "n_distinct / greatest(n_words, 1)",
}


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


class DecisionList(NamedTuple):
    """Rules in order; the first that holds rejects, and a text that none rejects is kept."""

    rules: list[list[Condition]]

    def sql(self) -> str:
        whens = "".join(f" WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in self.rules)
        return f"CASE{whens} ELSE true END" if whens else "true"

    def keeps(self) -> Column:
        return F.expr(self.sql())


def covers(rule: list[Condition], x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    return rows & np.logical_and.reduce([c.holds(x) for c in rule]) if rule else rows


def grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    """The condition of most gain is added until no good row is covered, nothing gains, or the rule is full."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (rows & ~bad).any():
        before = np.log2((rows & bad).sum() / rows.sum())
        best, step = 0.0, None
        for name, values in x.items():
            here = values[rows]
            for threshold in np.unique(np.quantile(here, np.linspace(0, 1, THRESHOLDS + 1)[:-1], method="lower")).tolist():
                for above in (True, False):
                    on = here > threshold if above else here <= threshold
                    p = int((bad[rows] & on).sum())
                    gain = p * (np.log2(p / on.sum()) - before) if p else 0.0
                    if gain > best:
                        best, step = gain, Condition(name, above, threshold)
        if step is None:
            break
        rule.append(step)
        rows = covers([step], x, rows)
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    """The beginning of the rule that is worth most on rows it was not grown on, of equal ones the shortest."""

    def worth(n: int) -> float:
        on = covers(rule[:n], x, rows)
        p, k = int((on & bad).sum()), int((on & ~bad).sum())
        return (p - k) / (p + k) if p + k else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, apart: np.ndarray) -> DecisionList:
    """Sequential covering of the ``bad`` rows; rules are pruned and judged on the rows ``apart``, grown on the others."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    while (left & bad & ~apart).sum() >= MIN_COVER:
        rule = grow(x, bad, left & ~apart)
        if not rule:
            break
        rule = prune(rule, x, bad, left & apart)
        on = covers(rule, x, left)
        tested = on & apart
        right = int((on & bad).sum())
        # Laplace's estimate on the rows kept aside.
        if right < MIN_COVER or ((tested & bad).sum() + 1) / (tested.sum() + 2) < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~on
    return DecisionList(rules)


def failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(rows: DataFrame) -> DecisionList:
    """A list from ``rows(doc_id, text, label)``, a bounded number of them (``labelled`` takes them); without any, it keeps all.

    Only the counts of these rows reach the driver. Rows that fail the fixed rules teach nothing. Every third
    row by the hash of its id is kept aside for pruning.
    """
    counts = statistics(rows, "label").where(~failed())
    named = [F.expr(sql).alias(f"f{k}") for k, sql in enumerate(FEATURES.values())]
    found = counts.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart"), (F.col("label") == 0).alias("bad"), *named).toPandas()
    # The order in which rows arrive decides nothing: all choices are made on counts.
    x = {name: found[f"f{k}"].to_numpy(np.float64) for k, name in enumerate(FEATURES)}
    return learn(x, found.bad.to_numpy(bool), found.apart.to_numpy(bool))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``(doc_id, <counts>, base_failed, kept)`` of every row of ``docs``: kept unless a fixed rule or one of the list rejects it."""
    return statistics(docs).withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())


def sift(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """Learn from at most ``max_rows`` usable labelled documents and judge every row of ``docs``.

    Null and empty texts have no words and fail; so does every text of fewer than ``MIN_WORDS``. Rows without
    an id and rows that repeat one are judged by their own text. Memory grows with the longest single text.
    """
    return judge(docs, fit(labelled(docs, labels, "quality", usable, max_rows)))
