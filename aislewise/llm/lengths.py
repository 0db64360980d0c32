"""Token counts by an exact length histogram.

Documents are encoded and counted by their length. Suffix sums over the lengths then answer totals,
quantiles and truncated totals for every context limit without looking at a document again.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.llm.common import cut, map_arrow, texts_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How byte-level BPE of this vocabulary cuts a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


def token_lengths(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; a null or empty text has none.

    The vocabulary is read on the driver and sent with the code.
    """
    with open(ranks, "rb") as file:
        listed = file.read()
    made = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, listed.splitlines())}
            made.append(tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={}))
        encode = made[0].encode_ordinary
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(encode(t.decode())) for t in texts_of(batch.column(1))], pa.int64())], ["doc_id", "n_tokens"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, part, "doc_id long, n_tokens long", "text")


def histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens, n_docs)``; counted within tasks first."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """One row per length that occurs, taken as a context limit.

    ``docs_from`` and ``tokens_from``: documents of at least that length and their tokens;
    ``truncated_tokens``: all tokens if every document is cut at that length; ``docs_share``: share of the
    documents of at most that length; ``total_docs`` and ``total_tokens`` repeat the totals. Sums run within
    blocks of lengths and over the blocks, so no task sees all lengths. An empty histogram gives no rows.
    """
    counts = cut(counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "histogram")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    # A row per block of lengths: few, whatever the number of documents.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("toks").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum("toks").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("tokens_above") + F.sum("tokens").over(inside)).alias("tokens_from"),
        "total_docs",
        "total_tokens",
    )
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs")).alias("docs_share"),
        "total_docs",
        "total_tokens",
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``(limit, docs_over, truncated_tokens)`` for any limits, from the suffix sums alone."""
    # The shortest length above the limit carries the sums of all documents above it.
    over = lambda x: F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > x, F.col("n_tokens")))
    row = sums.agg(F.max("total_tokens").alias("total"), *[over(int(x)).alias(f"at{i}") for i, x in enumerate(limits)])
    docs = lambda i: F.coalesce(F.col(f"at{i}.docs_from"), F.lit(0))
    cut_off = lambda i, x: F.col("total") - F.coalesce(F.col(f"at{i}.tokens_from"), F.lit(0)) + x * docs(i)
    answers = [
        F.struct(F.lit(int(x)).cast("long").alias("limit"), docs(i).alias("docs_over"), cut_off(i, int(x)).alias("truncated_tokens"))
        for i, x in enumerate(limits)
    ]
    return row.select(F.inline(F.array(*answers)))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(share, n_tokens)``: the shortest length that at least that share of the documents does not exceed."""
    columns = [F.min(F.when(F.col("docs_share") >= x, F.col("n_tokens"))).alias(f"q{i}") for i, x in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)])
    return sums.agg(*columns).select(F.inline(pairs))
