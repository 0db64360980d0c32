"""Collocations, decision lists and Merkle manifests against brute force, SQL and awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.llm import collocations, decision_lists, merkle, queries
from aislewise.llm.sampling import remainder


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents in several languages with repeated phrases, hot sources, nulls, repeated rows and clashing columns."""
    rng, rows = np.random.default_rng(11), []
    for i in range(700):
        w = [f"w{k}" for k in rng.integers(0, 14, 25)]
        w[3:6] = ["New", "york", "city"] if i % 3 else ["new", "york,", "state"]
        text = " ".join(w) + (". one\ttwo\nthree" if i % 2 else "! Ha ha ha ha")
        rows.append((i, text, ("en", "fr", None)[i % 3], None if i % 50 == 0 else f"src{0 if i % 3 else i % 7}", len(text), 1.5, "x"))
    rows += [rows[5], rows[5], (None, "no id here", "en", "src0", 10, 0.0, "x"), (None, None, None, None, None, None, None)]
    rows += [(5, "other text under an id", "en", "src0", 22, 0.0, "y"), (900, None, "en", "é", None, 0.0, "y"), (901, "", "", "", 0, 0.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, leaf string").repartition(6)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def phrases(rows, order=3, least=10, limit=2000):
    counts, total = Counter(), Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(r.text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[r.lang or "und" if r.lang is None else r.lang] += len(w)
            for n in range(1, order + 1):
                for i in range(len(w) - n + 1):
                    counts["und" if r.lang is None else r.lang, tuple(w[i : i + n])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    out = []
    for lang in total:
        kept = []
        for (of, p), (score, a, left, right) in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if of == lang and not any(x == lang and len(q) > len(p) and inside(q) and 100 * v[1] >= 50 * a for (x, q), v in found.items()):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return Counter(out)


@pytest.mark.parametrize("order, limit", [(3, 2000), (3, 5), (4, 40)])
def test_phrases_match_brute_force(spark, corpus, order, limit):
    rows = [r for r in corpus.collect() if r.doc_id is None or r.doc_id % 4 < 2]
    docs = spark.createDataFrame(rows, corpus.schema)
    got = Counter(tuple(r) for r in collocations.mine(docs, order, 10, limit).collect())
    want = phrases(rows, order, 10, limit)
    assert got == want and len(want) >= min(60, 3 * limit)


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 9 * 10**15, 9_500_000_000_000_001, 9_100_000_000_000_000
    rows = [("en", 0, "", 10**16), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    r = collocations.scored(spark.createDataFrame(rows, "lang string, size int, gram string, n long")).first()
    assert (r.a, r.l, r.r, r.score) == (a, left, right, 10**6 * a * a // (left * right))


def test_phrases_of_awkward_rows(spark, awkward):
    assert collocations.mine(awkward.limit(0)).count() == 0
    once = {(r.lang, r.phrase) for r in collocations.mine(awkward, min_count=1).collect()}
    assert ("fr", "▁ own mark") in once and not any("here," in p for _, p in once)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(at)
    hit = {i + k for i, w in enumerate(at) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark, awkward, table):
    docs = table("documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    odd = [(50, "a a a a"), (51, "a b c a b c"), (52, "x\nx\n \n\nx \r\nx\n#|"), (53, "a b a b"), (54, "é é \x0b\x0c\x1c ü")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = Counter((r.doc_id, *(r[c] for c in decision_lists.COUNTS)) for r in decision_lists.statistics(docs).collect())
    assert got == Counter((r.doc_id, *brute_counts(r.text)) for r in docs.collect())


def test_a_planted_rule_is_learned_and_emitted(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = {"capitals": rng.random(n), "marks": rng.random(n), "symbols": rng.random(n)}
    bad = (x["capitals"] > 0.8) & (x["marks"] <= 0.5) | (x["symbols"] > 0.95)
    found = decision_lists.learn(x, bad ^ (rng.random(n) < 0.01), rng.random(n) < 0.33)
    covered = np.zeros(n, bool)
    for rule in found.rules:
        covered |= decision_lists.covers(rule, x, np.ones(n, bool))
    assert (covered == bad).mean() > 0.97 and 1 < len(found.rules) < 8
    assert found.sql().startswith("CASE WHEN ") and found.sql().endswith("ELSE true END")
    # The expression says of every row what the rules say.
    rows = spark.createDataFrame([(int(c * 1000), int(m * 1000), int(s * 1000), 1000) for c, m, s in zip(x["capitals"], x["marks"], x["symbols"])],
                                 "n_upper long, n_marks long, n_symbols long, word_chars long")
    thousandths = {k: np.floor(v * 1000) / 1000 for k, v in x.items()}
    want = np.zeros(n, bool)
    for rule in found.rules:
        want |= decision_lists.covers(rule, thousandths, np.ones(n, bool))
    assert [r.kept for r in rows.select(found.keeps().alias("kept")).collect()] == (~want).tolist()


def test_verdicts_on_held_out_documents(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        w = [f"word{k}" for k in rng.integers(0, 300, 80)]
        junk = i % 6 == 0
        if junk:
            w = [x.upper() + "!!" if i % 12 else x + "$$$" for x in w]
        rows.append((i, " ".join(w), int(not junk)))
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    found = decision_lists.sift(both.drop("quality"), both.drop("text"), remainder(4) != 2).join(both.drop("text"), "doc_id").collect()
    assert len(found) == 900 and all(r.kept == bool(r.quality) for r in found)


def test_verdicts_of_awkward_rows(spark, awkward, labels):
    rows = decision_lists.sift(awkward, labels, F.lit(True)).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.kept} <= {6} and all(r.base_failed != r.kept for r in rows)
    assert decision_lists.sift(awkward.limit(0), labels, F.lit(True)).count() == 0
    assert decision_lists.sift(awkward, labels.limit(0), F.lit(True)).where("n_words >= 50 and not kept and not base_failed").count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_of(rows):
    """Brute force: all levels of all trees, then every row's proof."""
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(frame, (r.doc_id, r.source, r.lang, r.n_chars, text))))

    def up(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def way(tree, at):
        path = []
        for nodes in tree[:-1]:
            first = at - at % 16
            path.append((nodes[first:at], nodes[at + 1 : first + 16]))
            at //= 16
        return path

    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in sources}
    top = up([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (*_, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = way(trees[s], at) + way(top, k)
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            node = leaf(r, None if r.text is None else lower(r.text)) if changed else own
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def test_proofs_match_brute_force(corpus):
    rows = merkle.proofs(corpus, remainder(5) == 0).collect()
    assert Counter(tuple(r) for r in rows) == manifest_of(corpus.collect())
    assert 0 < sum(not r.verified for r in rows) < len(rows) / 2


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 1), (17, 17), (300, 300), (9000, 1)])
def test_proofs_of_all_shapes(spark, n, sources):
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('Text ', id) AS text", f"concat('s', id % {sources}) AS source", "'en' AS lang", "8L AS n_chars")
    rows = merkle.proofs(docs.repartition(5), remainder(5) == 0).collect()
    assert Counter(tuple(r) for r in rows) == manifest_of(docs.collect())


@pytest.mark.parametrize("size", [1, 2, 16, 17, 256, 257, 4097, 70_000])
def test_positions_are_those_of_completion(size):
    done, runs = [], [[] for _ in range(9)]
    for at in range(size):
        level, last = 0, at == size - 1
        done.append((0, at))
        while merkle.levels(size) > level:
            runs[level].append(at)
            if len(runs[level]) < 16 and not last:
                break
            runs[level].clear()
            level, at = level + 1, at // 16
            done.append((level, at))
    some = range(0, len(done), max(1, len(done) // 4000))
    assert all(merkle.position(size, *done[k]) == k for k in [*some, len(done) - 1])


def test_positions_of_the_log_are_the_order_of_writing(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source", "'en' AS lang", "1L AS n_chars")
    log = merkle.manifest(docs).log
    rows = log.select("size", "level", "at", "pos", merkle.position_of(F.col("size"), F.col("level"), F.col("at")).alias("found")).collect()
    assert sorted(r.pos for r in rows) == list(range(len(rows))) and all(r.pos == r.found for r in rows)


def test_no_proofs_without_rows(corpus):
    assert merkle.proofs(corpus.limit(0), remainder(5) == 0).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = con.execute(queries.ORACLE[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == sorted(df.columns)
    order = [found.index(c) for c in df.columns]
    want = Counter(tuple(r[i] for i in order) for r in cursor.fetchall())
    assert want and Counter(tuple(r) for r in df.collect()) == want
