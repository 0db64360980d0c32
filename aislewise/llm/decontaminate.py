"""Benchmark decontamination on a positional inverted index, in DataFrame operations only.

The words of the training texts are counted, every phrase keeps its few rarest words, and the postings
``(word, doc_id, pos)`` of those words are stored. A phrase is looked up from its rarest word: each posting
of it, moved back by the word's offset, is a place where the phrase could start; the moved postings of the
next rarest words are intersected with these places one list after another. What is left is confirmed on
the whole phrase, so matches are exact. Proximity search uses the same lists with a tolerance.

Texts are lower-cased in A-Z only; words are the runs of characters other than ASCII marks and spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.llm.common import cut, discard

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 13
RAREST = 3
# What tells documents apart: the id, and a hash of the text for rows that repeat an id or have none.
KEY = ["doc_id", "copy"]


def offered(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A list of words with the hint to broadcast it, if it has at most ``most`` rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words_of(text: Column) -> Column:
    """Words as written. A null text has none."""
    return F.coalesce(F.filter(F.split(text, BREAKS), lambda w: w != ""), F.array().cast("array<string>"))


def folded(word: Column) -> Column:
    """A-Z in lower case. Few words change, so the costly step is taken only for those that do."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item_id, phrase)``: every run of ``size`` words; an item of fewer words, but not none, is one phrase."""
    texts = items.select(F.col("item_id"), F.transform(words_of(F.col("text").cast("string")), folded).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return texts.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("phrase"))


def keyed(docs: DataFrame) -> DataFrame:
    """``(own_id, doc_id, copy, text)``: ``own_id`` may be null, the key is not. Rows with equal keys have equal texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"))
    return texts.select("own_id", F.coalesce("own_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("copy"), "text")


def phrases_of(wins: DataFrame) -> DataFrame:
    """``(phrase_id, phrase)``: each different phrase once, numbered, and written so that the numbers stay."""
    return cut(wins.select("phrase").distinct().select(F.monotonically_increasing_id().alias("phrase_id"), "phrase"), "phrases")


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(word, n)``: how often each of ``terms(word)`` occurs in all of ``texts``."""
    seen = texts.select(F.explode(words_of(F.col("text"))).alias("word")).select(folded(F.col("word")).alias("word"))
    found = seen.join(offered(terms), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return terms.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def rarest_terms(phrases: DataFrame, counts: DataFrame, keep: int = RAREST) -> DataFrame:
    """``(phrase_id, rank, off, word)``: the ``keep`` rarest places of each phrase, rank 1 the rarest of all.

    A phrase with a word that occurs nowhere can't match and is left out.
    """
    places = phrases.select("phrase_id", F.posexplode("phrase").alias("off", "word")).join(counts, "word")
    order = Window.partitionBy("phrase_id").orderBy("n", "off")
    ranked = places.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("n").over(Window.partitionBy("phrase_id")))
    return ranked.where((F.col("rank") <= keep) & (F.col("least") > 0)).select("phrase_id", "rank", "off", "word")


def index(texts: DataFrame, terms: DataFrame, name: str = "postings") -> DataFrame:
    """Store the postings ``(word, doc_id, copy, pos)`` of ``terms(word)`` in ``texts`` (see ``keyed``); positions count words from zero."""
    seen = texts.select(*KEY, F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return cut(seen.select(folded(F.col("word")).alias("word"), *KEY, "pos").join(offered(terms), "word", "left_semi"), name)


def phrase_starts(postings: DataFrame, rarest: DataFrame, keep: int = RAREST) -> DataFrame:
    """``(phrase_id, doc_id, copy, start)``: places at which all ``keep`` rarest words of a phrase stand rightly.

    One equi-join for each list: the rarest word gives the places, each further word keeps those at which
    it has a posting. Phrases with fewer words than ``keep`` pass the lists they don't have.
    """
    rarest = cut(rarest, "rarest")
    places = (
        postings.join(rarest.where("rank = 1"), "word")
        .select("phrase_id", *KEY, (F.col("pos") - F.col("off")).alias("start"))
        .where("start >= 0")
    )
    for rank in range(2, keep + 1):
        nth = rarest.where(F.col("rank") == rank).select("phrase_id", "off", "word")
        wanted = places.join(nth, "phrase_id", "left").withColumn("pos", F.col("start") + F.col("off"))
        whole = wanted.where("word is not null").join(postings, [*KEY, "pos", "word"], "left_semi")
        places = whole.unionByName(wanted.where("word is null")).select("phrase_id", *KEY, "start")
    return places


def near_matches(postings: DataFrame, rarest: DataFrame, slop: int) -> DataFrame:
    """``(phrase_id, doc_id, copy, start)``: places where each indexed word of a phrase stands at most ``slop`` words off.

    ``start`` counts from the rarest word. Positions are compared by stretches of ``slop`` + 1 words, so
    only neighbours meet.
    """
    width = slop + 1
    rarest = cut(rarest, "rarest")
    places = postings.join(rarest.where("rank = 1"), "word").select("phrase_id", *KEY, (F.col("pos") - F.col("off")).alias("start"))
    wanted = places.join(rarest.where("rank > 1").select("phrase_id", "rank", "off", "word"), "phrase_id")
    wanted = wanted.withColumn("at", F.col("start") + F.col("off"))
    wanted = wanted.withColumn("part", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("at") / width) + k)))
    lists = postings.withColumn("part", F.floor(F.col("pos") / width))
    met = (
        wanted.join(lists, [*KEY, "word", "part"])
        .where(F.abs(F.col("pos") - F.col("at")) <= slop)
        .select("phrase_id", *KEY, "start", "rank")
        .distinct()
        .groupBy("phrase_id", *KEY, "start")
        .agg(F.count("*").alias("n"))
    )
    need = rarest.groupBy("phrase_id").agg((F.count("*") - 1).alias("need"))
    alone = places.join(need.where("need = 0"), "phrase_id").select("phrase_id", *KEY, "start")
    return met.join(need, "phrase_id").where("n = need").select("phrase_id", *KEY, "start").unionByName(alone).distinct()


def exact_matches(texts: DataFrame, starts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(own_id, doc_id, copy, n_words, hits)`` of every row of ``texts``.

    ``hits`` are the places ``(start, length, phrase_id)``, in order and each once, that hold a whole phrase.
    Words are counted in the scan; only texts with a place to look at are read for their words, and if many
    have one, only those are shuffled.
    """
    wanted = starts.join(phrases, "phrase_id").groupBy(*KEY).agg(F.collect_set(F.struct("start", "phrase", "phrase_id")).alias("wanted"))
    wanted = cut(wanted, "wanted")
    read = texts.join(wanted, KEY).select(*KEY, words_of(F.col("text")).alias("words"), "wanted")
    part = lambda c: F.transform(F.slice("words", c["start"] + 1, F.size(c["phrase"])), folded)
    hits = F.transform(
        F.filter("wanted", lambda c: part(c) == c["phrase"]),
        lambda c: F.struct(c["start"].alias("start"), F.size(c["phrase"]).alias("length"), c["phrase_id"].alias("phrase_id")),
    )
    found = read.select(*KEY, F.array_sort(hits).alias("hits")).where(F.size("hits") > 0)
    # Rows with equal keys have equal texts.
    found = cut(found.groupBy(*KEY).agg(F.first("hits").alias("hits")), "hits")
    counted = texts.select("own_id", *KEY, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(found, KEY, "left")


def covered(hits: Column) -> Column:
    """Number of words in the union of the places ``(start, length, ...)``, an array in order of start."""
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0), r["start"] + r["length"] - F.greatest(acc["end"], r["start"]))).alias("n"),
        F.greatest(acc["end"], r["start"] + r["length"]).alias("end"),
    )
    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))


def judge(texts: DataFrame, items: DataFrame, size: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Of each row of ``texts`` (see ``keyed``) its hits and verdict, and the phrases with the items that hold them."""
    wins = cut(windows(items, size), "windows")
    phrases = phrases_of(wins)
    terms = cut(phrases.select(F.explode("phrase").alias("word")).distinct(), "terms")
    rarest = cut(rarest_terms(phrases, cut(term_counts(texts, terms), "counts")), "rarest")
    postings = index(texts, cut(rarest.select("word").distinct(), "terms"))
    found = exact_matches(texts, phrase_starts(postings, rarest), phrases)
    hits = F.coalesce("hits", F.array().cast(found.schema["hits"].dataType))
    verdict = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    judged = found.select(
        "own_id", *KEY, "n_words", covered(hits).alias("n_hit"), F.array_distinct(F.transform(hits, lambda h: h["phrase_id"])).alias("phrases")
    )
    owners = wins.where("item_id IS NOT NULL").join(phrases, "phrase").select("phrase_id", "item_id").distinct()
    written = cut(judged.withColumn("contaminated", verdict), "judged"), cut(owners, "owners")
    discard(postings)
    return written


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row of ``docs``.

    A document word inside any occurrence of a window of an item is hit; a document is contaminated if at
    least one word in ``share`` is. Null texts have no words. Rows without an id or with a repeated one
    are judged by their own text. Items without an id hit words like others, but are neither counted nor listed;
    items without words take no part. No document or no item gives no match.
    """
    judged, owners = judge(keyed(docs), items, size, share)
    of_doc = (
        judged.where("n_hit > 0")
        .select(*KEY, F.explode("phrases").alias("phrase_id"))
        .join(owners, "phrase_id")
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return judged.join(of_doc, KEY, "left").select(
        F.col("own_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        "contaminated",
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    judged, _ = judge(keyed(docs), items, size, share)
    bad = cut(judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("copy").alias("bad_copy")).distinct(), "contaminated")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(0)) == bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_copy"])
    return docs.join(bad, same, "left_anti")
