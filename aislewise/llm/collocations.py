"""Collocations by top-order marginalisation of n-gram counts.

Every word begins one window, the longest n-gram there is, padded where its piece of text ends. Only these
windows are counted, from a column of words and its leads; counts of shorter n-grams are marginals of the
longest ones, and a ROLLUP over the window's columns sums them prefix by prefix, down to the number of words
of a language. Nothing shorter is ever exploded from a text.

Windows are counted within stretches of text before the shuffle. They are dealt by their place: the shortest
prefix that is not very frequent in a small sample. All windows with a longer prefix are then together, so
what is too rare to be asked for gives its count to the next shorter prefix before the ROLLUP shuffles
anything, and no task holds all windows of a frequent word. The sample steers the layout only.

A phrase scores by the share of its parts' occurrences that it accounts for, at its weakest cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.llm.common import cut, map_arrow, texts_of

ORDER = 3
MIN_COUNT = 10
LIMIT = 2000
# Rows of a language are first cut down in this many parts, then together.
PARTS = 64
STRETCH = 4 << 20
# Layout: prefixes with this share of the sample's words are dealt by their next word too.
SAMPLE_ROWS, OFTEN, LEAST = 4000, 2e-5, 20
# A-Z in lower case, a tab as space, and whatever divides pieces, `.,;:!?` and bytes 10 to 13, as line feed.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class Numbers(dict):
    """Numbers words from one in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def stretches(text: bytes, limit: int = STRETCH) -> Iterator[bytes]:
    """Parts of a folded text of about ``limit`` bytes, divided between pieces only."""
    at = 0
    while len(text) - at > limit:
        stop = text.find(b"\n", at + limit)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


def counted(text: bytes, order: int, often: list[set[tuple[bytes, ...]]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """``(place, rest, n)`` of every different window of a folded text; the window is place and rest in one, spaces at the end apart.

    ``often[k]`` holds the frequent prefixes of ``k + 1`` words.
    """
    words: list[bytes] = []
    ends = [0]
    for piece in text.split(b"\n"):
        words += piece.split()
        ends.append(len(words))
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(ids))
    leads = [ids]
    for k in range(1, order):
        lead = np.zeros(len(ids), np.int64)
        lead[:-k] = ids[k:]
        lead[left <= k] = 0
        leads.append(lead)
    wide = len(numbers) + 1
    key = ids
    for k, lead in enumerate(leads[1:], 2):
        key = key * wide + lead
        if float(wide) ** (k + 1) > 2**62 and k < order:
            _, key = np.unique(key, return_inverse=True)
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    found = [lead[at] for lead in leads]
    length = np.ones(len(at), np.int64)
    prefix = found[0]
    for k in range(1, order):
        # Prefixes of k words by number, among those the stretch has at all.
        known = [p for p in often[k - 1] if all(w in numbers for w in p)]
        listed = np.zeros(len(known), np.int64)
        for j in range(k):
            listed = listed * wide + np.array([numbers[p[j]] for p in known], np.int64)
        length[(length == k) & (found[k - 1] > 0) & np.isin(prefix, listed)] += 1
        if float(wide) ** (k + 1) > 2**62:
            break
        prefix = prefix * wide + found[k]
    # Number zero is no text; a frequent prefix that its piece ends has a space after it, so that it is not taken for its place.
    spaced = pa.array([b"", *(b" " + w for w in numbers), b" "], pa.binary()).cast(pa.string())
    taken = lambda k, keep, pad: spaced.take(pa.array(np.where(keep, np.where(found[k] > 0, found[k], pad), 0)))
    places = [pc.utf8_slice_codeunits(taken(0, True, 0), 1), *(taken(k, length > k, wide) for k in range(1, order))]
    rests = [taken(k, length <= k, 0) for k in range(1, order)]
    joined = lambda parts: pc.binary_join_element_wise(*parts, "")
    return joined(places), joined(rests), pa.array(n)


def windows(docs: DataFrame, order: int = ORDER, often: dict[str, list[set[tuple[bytes, ...]]]] | None = None) -> DataFrame:
    """``(lang, place, rest, n)``: windows of ``docs(lang, text)`` counted by stretches of text.

    A window is a word and the words after it in its piece, at most ``order``, joined by spaces.
    """
    known, none = often or {}, [set() for _ in range(order)]

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            texts.setdefault(lang, []).append(text.translate(FOLDED))
        out = []
        for lang, some in texts.items():
            for text in stretches(b"\n".join(some)):
                found = counted(text, order, known.get(lang, none))
                out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(found[0]), pa.string()), *found], ["lang", "place", "rest", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(len(x) for x in out) else EMPTY

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, part, "lang string, place string, rest string, n long", "text", STRETCH)


EMPTY = pa.RecordBatch.from_pydict({"lang": pa.array([], pa.string()), "place": pa.array([], pa.string()), "rest": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


def frequent_prefixes(docs: DataFrame, order: int = ORDER) -> dict[str, list[set[tuple[bytes, ...]]]]:
    """Prefixes of 1 to ``order`` - 1 words that are frequent in ``SAMPLE_ROWS`` rows, by language: at most 1 / ``OFTEN`` of each length."""
    sample = cut(windows(docs.limit(SAMPLE_ROWS), order), "sample")
    total = sample.agg(F.sum("n")).first()[0] or 0
    words = F.split(F.concat("place", "rest"), " ")
    prefixes = sample.select("lang", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(order - 1), F.size(words)))).alias("k"), words.alias("w"))
    prefixes = prefixes.groupBy("lang", F.slice("w", F.lit(1), F.col("k")).alias("prefix")).agg(F.sum("n").alias("n"))
    found: dict[str, list[set[tuple[bytes, ...]]]] = {}
    for r in prefixes.where(F.col("n") >= max(LEAST, total * OFTEN)).collect():
        found.setdefault(r.lang, [set() for _ in range(order)])[len(r.prefix) - 1].add(tuple(w.encode() for w in r.prefix))
    return found


def gram_counts(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, size, gram, n)``: n-grams of 1 to ``order`` words that occur at least ``min_count`` times, words joined by spaces.

    The row of size 0 has the number of words of the language, however small.
    """
    dealt = windows(docs, order, frequent_prefixes(docs, order)).repartition("lang", "place")
    window = F.rtrim(F.concat("place", "rest"))
    whole = dealt.groupBy("lang", "place", "rest").agg(F.sum("n").alias("n"))
    # One condition, so that both readers of the shuffled windows share them.
    longest = whole.where(F.when(F.col("n") >= min_count, F.size(F.split(window, " ")) == order))
    longest = longest.select("lang", F.lit(order).alias("size"), window.alias("gram"), "n")
    level = dealt.select("lang", "place", F.substring_index(window, " ", order - 1).alias("head"), "n")
    for k in range(order - 1, 0, -1):
        # A prefix that is no shorter than its place has all its windows here; what is rare counts for the next shorter prefix only.
        level = level.groupBy("lang", "place", "head").agg(F.sum("n").alias("n"))
        prefix = F.substring_index("head", " ", k)
        here = F.sum("n").over(Window.partitionBy("lang", "place", prefix)) if k < order - 1 else F.col("n")
        complete = (F.size(F.split("place", " ")) <= k) & (F.size(F.split("head", " ")) >= k)
        level = level.withColumn("head", F.when(complete & (here < min_count), F.substring_index("head", " ", k - 1)).otherwise(F.col("head")))
    names = [f"w{k}" for k in range(1, order)]
    words = F.split("head", " ")
    level = level.select("lang", *(F.coalesce(F.get(words, F.lit(k)), F.lit("")).alias(name) for k, name in enumerate(names)), "n")
    rolled = level.rollup("lang", *names)
    rolled = rolled.agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # Of the last k columns rolled up, the grouping id has the last k bits set.
    size = F.coalesce(*(F.when(F.col("level") == (1 << order - 1 - k) - 1, k) for k in range(order)))
    sized = rolled.where(F.col("level") < 1 << order - 1).withColumn("size", size)
    complete = F.coalesce(*(F.when(F.col("size") == k, F.col(names[k - 1]) != "") for k in range(1, order)), F.lit(True))
    shorter = sized.where(complete & ((F.col("size") == 0) | (F.col("n") >= min_count)))
    return longest.unionByName(shorter.select("lang", "size", F.concat_ws(" ", *names).alias("gram"), "n"))


def run_of(words: Column, start: Column, size: Column) -> Column:
    """``size`` words from number ``start`` on, joined."""
    return F.array_join(F.slice(words, start, size), " ")


def scored(grams: DataFrame) -> DataFrame:
    """``(lang, gram, size, a, l, r, score)``: each phrase of two words or more at its weakest cut, of equal ones the first.

    The score is the whole part of 1,000,000 a^2 / (l r). It is exact for counts below 10^16: products are
    decimals of 38 digits, and the integral division of decimals is exact.
    """
    words = F.split("gram", " ")
    phrases = grams.where("size > 1").select("lang", "gram", "size", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", run_of(words, F.lit(1), F.col("k"))).withColumn("rest", run_of(words, F.col("k") + 1, F.col("size") - F.col("k")))
    known = grams.where("size > 0").select(F.col("lang").alias("of"), F.col("gram").alias("part"), "n")
    left, right = known.withColumnRenamed("n", "l"), known.withColumnRenamed("n", "r")
    met = cuts.join(left, (F.col("lang") == F.col("of")) & (F.col("head") == F.col("part"))).drop("of", "part")
    met = met.join(right, (F.col("lang") == F.col("of")) & (F.col("rest") == F.col("part"))).drop("of", "part")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return met.groupBy("lang", "gram", "size", "a").agg(least.alias("x")).select("lang", "gram", "size", "a", "x.l", "x.r", "x.score")


def longer(grams: DataFrame) -> DataFrame:
    """``(lang, gram, most)``: of phrases within longer ones the count of the most frequent of those."""
    words = F.split("gram", " ")
    inner = grams.where("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    inner = inner.select("lang", run_of(words, F.col("start"), F.col("length")).alias("gram"), "n")
    return inner.groupBy("lang", "gram").agg(F.max("n").alias("most"))


def mine(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, limit: int = LIMIT, share: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``limit`` best phrases of 2 to ``order`` words.

    A phrase within a longer one that has at least ``share`` percent of its occurrences is left out. Ties rank
    by count, then by the phrase's bytes, so the ranks don't depend on layout. Null languages are ``und``, null
    and empty texts have no words; rows that repeat are counted as often as they occur.
    """
    grams = cut(gram_counts(docs, order, min_count), "grams")
    found = scored(grams).join(longer(grams), ["lang", "gram"], "left")
    found = found.where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    found = cut(found.withColumn("lot", F.pmod(F.xxhash64("gram"), F.lit(PARTS))), "phrases")
    order_by = [F.desc("score"), F.desc("a"), F.asc("gram")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    # The best of each lot first, so that the last sort of a language sees no more than PARTS x limit rows.
    best = found.withColumn("rank", rank("lang", "lot")).where(F.col("rank") <= limit)
    best = best.withColumn("rank", rank("lang")).where(F.col("rank") <= limit)
    total = grams.where("size = 0").select("lang", "n")
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score"
    )
