"""Operators on documents against brute force, round trips and awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from aislewise.llm import common, decontaminate, lengths, licenses, pieces, quality, queries, simhash, tokens, toxicity
from aislewise.llm.common import Forest, components, cut, slices
from aislewise.llm.sampling import remainder


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "A b  c\td a B c"
    words = ["a", "b", "c", "d", "a", "b", "c"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 5)
    assert simhash.fingerprint(text.encode()).hex() == f"{want:016x}"
    assert simhash.fingerprint(b" \n") == bytes(8)
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_digest("one two", 42)


def test_hashes_are_those_of_spark(spark):
    got = spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1
    assert got == int.from_bytes(simhash.fingerprint(b"a b c"), "big")


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(3)
    bits = rng.integers(-(1 << 62), 1 << 62, 400)
    for weight in range(4):
        flips = np.array([sum(1 << int(b) for b in rng.choice(62, weight, replace=False)) for _ in bits], np.int64)
        home, _ = simhash.anchors_of(bits)
        _, near = simhash.anchors_of(bits ^ flips)
        assert ((near == home[:, :, None]) & (home[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_links_match_brute_force(spark, table):
    docs = table("documents")
    rows = simhash.near_duplicates(docs).collect()
    forest, bits = Forest(), {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for a, b in itertools.combinations(bits, 2):
        if (bits[a] ^ bits[b]).bit_count() <= 3:
            forest.join(a, b)
    groups = {}
    for x in bits:
        groups.setdefault(forest.find(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    assert {r.doc_id: r.component_id for r in rows} == want
    assert any(r.doc_id != r.component_id for r in rows)


def test_near_duplicates_of_awkward_rows(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[3].component_id == by[4].component_id == by[5].component_id == 3 and by[4].fingerprint == "0" * 16
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = simhash.representatives(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, None, None, 6, 7])
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_representatives_match_brute_force(spark, table):
    docs = table("documents")
    bits = {r.doc_id: int.from_bytes(simhash.fingerprint((r.text or "").encode()), "big") for r in docs.collect()}
    forest = Forest()
    for a, b in itertools.combinations(sorted(bits), 2):
        if (bits[a] ^ bits[b]).bit_count() <= 3:
            forest.join(a, b)
    smallest = {}
    for x in sorted(bits):
        smallest.setdefault(forest.find(x), x)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and len(smallest) < len(bits)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(smallest.values())


def test_other_texts_under_an_id_stay(spark):
    rows = [(1, "one two three four five six"), (2, "other words of a text that stays here"), (2, "a third text is under that id too"), (2, "ONE two three four five six")]
    kept = simhash.representatives(spark.createDataFrame([*rows, rows[1]], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[:3])
    twice = spark.createDataFrame([(7, "same words in this text"), (7, "Same  words in this text")], "doc_id long, text string")
    assert simhash.representatives(twice).count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[k] for k in range(10, 61)} == {10} and {found[k] for k in range(100, 140)} == {100} and 7 not in found


def test_links_are_merged_whatever_size_spark_takes_points_for(spark):
    # Of two neighbours the second differs in two bits.
    n = 20_000
    points = spark.range(n).select("id", F.expr("xxhash64(id div 2) ^ (id % 2 * 5)").alias("bits"))
    found = simhash.links(points)
    assert {(r.a, r.b) for r in found.collect()} == {(k, k + 1) for k in range(0, n, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    for module in (common, simhash):
        monkeypatch.setattr(module, "cut", noted)
    words = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, "alone here"), (2, words), (3, words), (4, words + " end"), (None, words)], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (None, None)}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_components_read_their_edges_once(spark, tmp_path):
    # Each run keeps another forest of a triangle, as spanning may where rows come in another order.
    def forest(batches):
        for _ in batches:
            runs = len(list(tmp_path.iterdir()))
            (tmp_path / str(runs)).touch()
            a, b = ([1, 1], [2, 3]) if runs == 0 else ([2, 1], [3, 3])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = components(spark.range(0, 1, 1, 1).mapInArrow(forest, "a long, b long"))
    assert dict(found.collect()) == {1: 1, 2: 1, 3: 1}
    assert len(list(tmp_path.iterdir())) == 1


def words(text):
    lower = (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def contaminated(docs, items, size=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wanted.setdefault(tuple(w[i : i + size]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_contamination_matches_brute_force(spark, table):
    docs, items = table("documents"), table("benchmark")
    rows = decontaminate.contamination(docs, items).collect()
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter(tuple(r) for r in rows) == want and any(r.contaminated for r in rows)


def test_contamination_of_awkward_rows(spark, awkward):
    items = spark.createDataFrame(
        [(1, "brown FOX jumps"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (3, None), (4, "..."), (None, "lazy dog"), (10, "Fox"), (9, "fox"), (5, "zz top")],
        "item_id long, text string",
    )
    rows = decontaminate.contamination(awkward, items).collect()
    want = contaminated([(r.doc_id, r.text) for r in awkward.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter(tuple(r) for r in rows) == want
    clean = decontaminate.clean(awkward, items)
    assert clean.columns == awkward.columns and {1, 2}.isdisjoint({r.doc_id for r in clean.collect()})
    assert clean.where("doc_id is null").count() == 2
    assert decontaminate.contamination(awkward.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(awkward, items.limit(0)).collect())


def test_phrases_and_proximity_from_the_index(spark):
    texts = decontaminate.keyed(spark.createDataFrame([(1, "a b c d e a x b c"), (2, "c b a"), (3, "a q q q b")], "doc_id long, text string"))
    phrases = spark.createDataFrame([(7, ["a", "b", "c"])], "phrase_id long, phrase array<string>")
    terms = phrases.select(F.explode("phrase").alias("word"))
    rarest = decontaminate.rarest_terms(phrases, decontaminate.term_counts(texts, terms))
    postings = decontaminate.index(texts, terms)
    starts = decontaminate.phrase_starts(postings, rarest)
    assert [(r.doc_id, r.start) for r in starts.collect()] == [(1, 0)]
    near = decontaminate.near_matches(postings, rarest, 1)
    assert {r.doc_id for r in near.collect()} == {1}
    assert {r.doc_id for r in decontaminate.near_matches(postings, rarest, 4).collect()} == {1, 2}


def test_token_hashes_do_not_depend_on_neighbours(monkeypatch):
    texts = ["Ab c-d!! x", "", "é" * 40 + " the end", "Ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    found = tokens.tokenize(data, offsets, (2,))
    said = [data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    assert said == ["Ab", "c", "-", "d", "!!", "x", "é" * 40, "the", "end", "Ab"]
    assert found.doc.tolist() == [0] * 6 + [2] * 3 + [3]
    assert found.hashes[0][0] == found.hashes[0][-1] and len(set(found.hashes[0].tolist())) == 9
    monkeypatch.setattr(tokens, "CHUNK", 16)
    again = tokens.tokenize(data, offsets, (2,))
    assert again.hashes[0][:6].tolist() == found.hashes[0][:6].tolist() and again.doc[-1] == 3


def test_marginals_match_the_sum_over_all_taggings():
    rng = np.random.default_rng(5)
    doc = np.array([0] * 4 + [2] * 3)
    score, step = rng.normal(size=7), rng.normal(size=(2, 2))
    c = toxicity.chain(doc)
    placed = np.empty(7)
    placed[c.order] = score
    left, right, _ = toxicity.forward_backward(placed, c, step)
    p = (left * right / (1 + left * right))[c.order]
    for start, n in ((0, 4), (4, 3)):
        total, by = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(score[start + i] for i in range(n) if tags[i]) + sum(step[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            by += weight * np.array(tags)
        assert np.allclose(p[start : start + n], by / total)


def test_gradient_matches_differences():
    text = np.frombuffer(b"you are a fool and a fool is bad here", np.uint8)
    found = tokens.tokenize(text, np.array([0, 20, len(text)]), toxicity.PREFIXES)
    hashes, rng = toxicity.features(found), np.random.default_rng(1)
    field = toxicity.Field(rng.normal(size=1 << toxicity.BITS) / 9, -0.3, rng.normal(size=(2, 2)))
    truth = rng.random(len(found.start)) > 0.6

    def value(f):
        total = 0.0
        for d in np.unique(found.doc):
            at = np.flatnonzero(found.doc == d)
            s = f.weights[toxicity.slot(hashes[:, at])].sum(axis=0) + f.bias
            weigh = lambda tags: sum(x for x, t in zip(s, tags) if t) + sum(f.step[a, b] for a, b in zip(tags, tags[1:]))  # noqa: B023, E731
            total += weigh(truth[at].astype(int)) - np.log(sum(np.exp(weigh(t)) for t in itertools.product((0, 1), repeat=len(at))))
        return total

    by_slot, bias, step = toxicity.gradient(field, found, truth, hashes)
    near = lambda **k: (value(field._replace(**k)) - value(field)) / 1e-6
    assert abs(near(bias=field.bias + 1e-6) - bias) < 1e-3
    for a, b in itertools.product((0, 1), repeat=2):
        moved = field.step.copy()
        moved[a, b] += 1e-6
        assert abs(near(step=moved) - step[a, b]) < 1e-3
    one = int(toxicity.slot(hashes)[0, 3])
    weights = field.weights.copy()
    weights[one] += 1e-6
    assert abs(near(weights=weights) - by_slot[one]) < 1e-3


def synthetic(spark, n=600):
    """Documents of plain words; every fifth is toxic by one of three words, every seventh is of shouted junk."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        w = [f"word{k}" for k in rng.integers(0, 300, 60)]
        if i % 5 == 0:
            w[30] = ("scumbag", "moronic", "filthpig")[i % 3]
        if i % 7 == 0:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), int(i % 7 != 0), int(i % 5 == 0)))
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(4)
    return both.drop("quality", "toxic"), both.drop("text")


def test_toxic_spans_on_held_out_documents(spark):
    docs, labels = synthetic(spark)
    rows = toxicity.tag(docs, labels, remainder(5) != 0).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == r.toxic for r in held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in held:
        for s in r.spans:
            assert texts[r.doc_id][s.start : s.end].lower() in ("scumbag", "moronic", "filthpig")


def test_words_that_always_occur_together_mark_their_documents(spark):
    rng, rows = np.random.default_rng(3), []
    copied = " ".join(f"copied{k}text" for k in rng.integers(0, 99999, 50))
    for i in range(600):
        w = [f"word{k}" for k in rng.integers(0, 300, 60)]
        if i % 5 == 0:
            w[30:33] = ["scumbag", "moronic", "filthpig"]
        rows.append((i, copied if i % 20 == 1 else " ".join(w), int(i % 5 == 0 or i % 20 == 1)))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    found = toxicity.tag(both.drop("toxic"), both.drop("text"), remainder(5) != 0).join(both.drop("text"), "doc_id").collect()
    assert sum(r.toxic for r in found) == 150 and all(r.predicted == r.toxic for r in found)


def test_training_reads_every_part(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "STEPS", 1)
    texts = ["plain words here"] * 2 + ["you are scum today"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t], "label": [k // 2]}) for k, t in enumerate(texts)]
    data = np.frombuffer(b"scum", np.uint8)
    word = toxicity.features(tokens.tokenize(data, np.array([0, 4]), toxicity.PREFIXES))[:1, 0]
    trained = next(toxicity.train(batches, word.astype(np.int64))).to_pylist()[0]
    assert trained["n"] == 3 and np.frombuffer(trained["weights"], np.float32)[toxicity.slot(word)[0]] > 0


def test_quality_on_held_out_documents(spark):
    docs, labels = synthetic(spark)
    rows = quality.grade(docs, labels, remainder(4) != 2).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and np.mean([r.predicted == r.quality for r in held]) > 0.98


@pytest.mark.parametrize("module, name", [(toxicity, "tag"), (quality, "grade")])
def test_scores_of_awkward_rows(spark, awkward, labels, module, name):
    score = getattr(module, name)
    rows = score(awkward, labels, F.lit(True)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert score(awkward.limit(0), labels, F.lit(True)).count() == 0
    assert score(awkward, labels.limit(0), F.lit(True)).count() == awkward.count()


def test_filters_keep_all_columns(spark, awkward, labels):
    assert toxicity.harmless(awkward, labels.limit(0), F.lit(True)).columns == awkward.columns
    assert toxicity.harmless(awkward, labels.limit(0), F.lit(True)).count() == awkward.count()
    assert quality.good(awkward, labels.limit(0), F.lit(True), threshold=0.5).exceptAll(awkward).count() == 0


def test_parts_of_a_batch_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 25, "", "c" * 10, "d" * 10])})
    assert [p.num_rows for p in slices(batch, "text", 20)] == [2, 1, 3]


SMALL = {0: ("▁", -9.0), 1: ("a", -2.0), 2: ("b", -2.5), 3: ("ab", -3.0), 4: ("▁a", -1.5), 5: ("▁ab", -4.0), 6: ("ba", -4.5)}


def small_vocabulary():
    return pieces.from_pieces(SMALL, {b: 10 + b for b in range(256)})


def paths(chars, v):
    names = {tuple(map(ord, n)): (i, s) for i, (n, s) in SMALL.items()}
    out = []

    def go(p, score, ids):
        if p == len(chars):
            out.append((round(score, 6), ids))
        for w in range(1, min(v.longest, len(chars) - p) + 1):
            found = names.get(tuple(chars[p : p + w]))
            if found:
                go(p + w, score + found[1], ids + [found[0]])
            elif w == 1:
                go(p + 1, score + v.unknown, ids + v.byte_ids[list(pieces.utf8(chars[p]))].tolist())

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["▁abab", "▁", "▁a", "▁baab", "▁aéb", "ab"])
def test_n_best_of_a_segment_matches_brute_force(text):
    v, chars = small_vocabulary(), tuple(map(ord, text))
    want = paths(chars, v)
    got = pieces.nbest(chars, 5, v)
    assert [round(s, 6) for s, _ in got] == [s for s, _ in want[:5]]
    assert all((round(s, 6), ids) in want for s, ids in got) and len({tuple(i) for _, i in got}) == len(got)
    best = pieces.viterbi(np.array(chars), np.array([0]), np.array([len(chars)]), v, pieces.Lookup(v))
    assert round(float(best.score[0]), 6) == want[0][0] and (want[0][0], best.ids.tolist()) in want


def test_alternatives_of_tied_paths(spark):
    names = {0: ("▁", -1.0), 1: ("a", -1.0), 2: ("b", -1.0), 3: ("ab", -2.0), 4: ("▁a", -2.0)}
    v = pieces.from_pieces(names, {b: 10 + b for b in range(256)})
    r = pieces.encode(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), v, 3).first()
    ways = [r.ids, *(c.ids for x in r.nbest for c in x.changes)]
    assert sorted(map(tuple, ways)) == [(0, 1, 2), (0, 3), (4, 2)] and {x.score for x in r.nbest} == {-3.0}


def test_n_best_of_a_text_matches_brute_force(spark):
    v = small_vocabulary()
    text = "ab ba aab"
    r = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), v, 6).first()
    each = [paths(tuple(map(ord, "▁" + w)), v) for w in text.split(" ")]
    want = sorted((round(sum(s for s, _ in combo), 6) for combo in itertools.product(*each)), reverse=True)[:6]
    assert [round(x.score, 6) for x in r.nbest] == want and round(r.score, 6) == want[0] and r.nbest[0].changes == []


def test_pieces_round_trip(spark, awkward):
    rows = pieces.encode(awkward, pieces.vocabulary()).collect()
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].ids is None and by[4].ids == [] and by[4].nbest == []
    v = pieces.vocabulary()
    assert pieces.decode(by[7].ids, v).decode() == "▁ own mark, été \U0001f600 \x00 end"
    assert all(a.score >= b.score for r in rows for a, b in zip(r.nbest, r.nbest[1:]))
    assert pieces.encode(awkward.limit(0), v).count() == 0


def test_suffix_sums_answer_every_limit(spark, awkward, table):
    found = lengths.token_lengths(table("documents").select("doc_id", "text").union(awkward.select("doc_id", "text"))).cache()
    sums = lengths.suffix_sums(lengths.histogram(found)).cache()
    n = sorted(r.n_tokens for r in found.collect())
    for r in sums.collect():
        assert r.docs_from == sum(x >= r.n_tokens for x in n) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert r.tokens_from == sum(x for x in n if x >= r.n_tokens) and r.total_tokens == sum(n)
    for r in lengths.truncated_totals(sums, [0, 7, 300, 10**9]).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in n) and r.docs_over == sum(x > r.limit for x in n)
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for i, x in enumerate(n) if (i + 1) / len(n) >= r.share)
    assert lengths.suffix_sums(lengths.histogram(found.limit(0))).count() == 0


def test_licenses_are_confirmed_on_the_wording(spark, awkward):
    full = licenses.TEMPLATES["MIT"][2]
    rows = [
        (1, "intro\nLicensed under the Apache License, Version 2.0.\nend"),
        (2, full.replace("Software", "Work")),
        (3, "We have permission to dance, and a driving licence."),
        (4, "nothing"),
        (5, "Copyright (c) 2020 Somebody. All rights reserved.\n\n\n\n\n\nReleased under the MIT License."),
        (6, None),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.license): r for r in found}
    assert set(by) == {(1, "Apache-2.0"), (2, "MIT"), (3, None), (5, "All rights reserved"), (5, "MIT")}
    assert by[1, "Apache-2.0"].exact and rows[0][1][by[1, "Apache-2.0"].start : by[1, "Apache-2.0"].end].startswith("Licensed")
    assert set(by[2, "MIT"].missing) == {"software"} and set(by[2, "MIT"].added) == {"work"} and not by[2, "MIT"].exact
    assert by[5, "All rights reserved"].exact
    assert licenses.scan(awkward).count() == 0


PROSE = "the ship left the old harbour under a grey sky and all of the crew sang as the work of the day was done".split()


@pytest.mark.parametrize("around", [15, 40, 200, 700])
def test_licenses_amid_prose_of_the_same_line(around):
    made = licenses.Templates(licenses.TEMPLATES)
    prose = [PROSE[k % len(PROSE)] for k in range(around)]
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            said = wording.replace("<> <>", "2020 Somebody").split()
            text = " ".join([*prose[: around // 2], *said, *prose[around // 2 :]])
            found = [f for a, b in licenses.windows(text, 0, len(text), 800) for f in made.findings(text[a:b])]
            assert any(f.license == name and not f.missing and not f.added for f in found), (name, wording)
            if len(said) > 30:
                text = text.replace(" ".join(said[10:13]), f"{said[10]} gladly {said[12]}")
                found = [f for a, b in licenses.windows(text, 0, len(text), 800) for f in made.findings(text[a:b])]
                assert any(f.license == name and ("gladly" in f.added or not f.missing) for f in found), (name, wording)
    assert made.findings(" ".join(prose)) == []
    assert made.findings("all of the crew has rights that are reserved for the old, and licensed by sea or land under the grey sky, where MIT or another harbour gives its own new license") == []


def test_every_notice_has_its_own_row(spark):
    long = " ".join(f"clause{k} grants license{k % 7}" for k in range(160))
    own = {**licenses.TEMPLATES, "Own-1.0": (long,)}
    twice = "Released under the MIT License. We sang all day. Released under the MIT License."
    text = " ".join(PROSE * 21) + " " + long + " " + " ".join(PROSE * 30)
    rows = [(1, twice), (1, twice), (2, text), (None, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    found = licenses.scan(df, own).collect()
    mit = sorted(r.start for r in found if r.license == "MIT")
    assert mit == [0, 0, twice.rindex("Released"), twice.rindex("Released")]
    assert [(text[r.start : r.end], r.exact) for r in found if r.license == "Own-1.0"] == [(long, True)]
    assert len([r for r in found if r.doc_id is None]) == 1 and len(found) == 6


def test_the_gain_decides_what_is_aligned_and_what_counts():
    wording = " ".join(f"alpha{k}" for k in range(40))
    made = licenses.Templates({"X": (wording,)})
    # The same words in another order save less, though as many of them are there.
    shuffled = " ".join(np.random.default_rng(0).permutation(wording.split()))
    exact, near = (made.gain(made.wordings[0], t) for t in (wording, shuffled))
    assert exact > licenses.MIN_GAIN and near < exact
    assert [f.missing for f in made.findings(wording)] == [[]] and made.findings(shuffled) == []
    spans = [(m.start(), m.end()) for m in licenses.WORD.finditer(wording)]
    gains = [g for g, *_ in made.candidates(wording, spans)]
    assert gains and gains == sorted(gains, reverse=True) and min(gains) >= licenses.RANK_GAIN


@pytest.mark.parametrize("seed", range(4))
def test_notices_match_brute_force_over_all_windows(seed):
    rng = np.random.default_rng(seed)
    made = licenses.Templates(licenses.TEMPLATES)
    short = [w for w in made.wordings if len(w.words) < 15]
    text = " ".join(" ".join(rng.choice(PROSE, rng.integers(1, 9))) + " " + " ".join(short[k].words).replace("<> <>", "2020 somebody") for k in rng.integers(0, len(short), 5))
    said = licenses.words(text)
    fits = lambda w, i: i + len(w.words) <= len(said) and all(a in (b, "<>") for a, b in zip(w.words, said[i:]))
    want = {(w.license, i) for w in short for i in range(len(said)) if fits(w, i)}
    found = made.findings(text)
    assert all(f.missing == [] for f in found if not f.added)
    # Each place of a wording is within a notice of its license.
    assert all(any(f.license == name and f.first <= i <= f.last for f in found) for name, i in want)


def test_several_licenses_of_a_block_all_stay():
    made = licenses.Templates(licenses.TEMPLATES)
    apache, gpl2, gpl3 = (licenses.TEMPLATES[k][1] for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0"))
    other = apache.replace("Licensed under", "Offered under").replace("writing", "print")
    by = {f.license: f for f in made.findings("Released under the MIT License.\n" + other)}
    assert set(by) == {"MIT", "Apache-2.0"} and not by["MIT"].missing and by["Apache-2.0"].missing
    by = {f.license: f for f in made.findings(other + "\n" + gpl3.replace("Foundation", "Club"))}
    assert set(by) == {"Apache-2.0", "GPL-3.0"} and all(f.missing for f in by.values())
    by = {f.license: f for f in made.findings(gpl2 + " " + gpl3.replace("redistribute", "share"))}
    assert set(by) == {"GPL-2.0", "GPL-3.0"} and not by["GPL-2.0"].missing and by["GPL-3.0"].missing == ["redistribute"]
    assert {f.license for f in made.findings(gpl3.replace("redistribute", "share"))} == {"GPL-3.0"}


def test_documents_queries_return_their_contracts(spark, sf_dir):
    want = {
        "op3_simhash_anchors": ["doc_id", "fingerprint", "component_id"],
        "op6_positional_index": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op7_quality_ftrl": ["doc_id", "held_out", "score", "predicted"],
        "op8_toxic_spans": ["doc_id", "held_out", "score", "predicted"],
    }
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, sf_dir)
        assert df.columns[: len(columns)] == columns and df.count() == n
