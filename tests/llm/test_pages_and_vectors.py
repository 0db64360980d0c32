"""Pages, archives, embeddings and the pipeline."""

from __future__ import annotations

import datetime as dt
import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aislewise.llm import embeddings, html_text, queries, warc
from aislewise.llm.common import Forest

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
<nav><ul><li><a href="/x">Menu entry</a></li></ul></nav><div class="cookie-notice">We use cookies for everything you do here</div>
<div class="content"><h1>Real&nbsp;title</h1><p>First <b>bo</b>ld words &amp; more of them to   read.</p><aside>Related things</aside>
<ul><li>one item</li></ul><p class=ad>Buy this now<p>Second paragraph, a < b, with the <a href=y>link</a> inside.<br>Next line</div>
<div id="comments"><p>Nice post, I liked it very much indeed and would read it again</p></div>
<form><label>Search</label><textarea>typed</textarea></form><script>var x = "</p> not text";</script><footer>(c) somebody</footer></body></html>"""


def test_region_without_any_labelled_page():
    got = html_text.main_text(PAGE, html_text.Weights({}, {}))
    assert got == "Real title First bold words & more of them to read. one item Second paragraph, a < b, with the link inside. Next line"


def test_articles_are_extracted_whole(spark, table):
    pages = table("pages")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(rows) == pages.count()
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|a|em)(?: [^>]*)?>", "", inner))).split())
        assert rows[page.page_id].text == want and rows[page.page_id].n_chars == len(want)


def test_awkward_pages(spark):
    cases = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (4, "u", "<p>a<script>never closed"), (None, "u", "<p>x y</p>"), (5, "u", "<!-- open"),
             (5, "u", "<p title='a>b'>t</p>"), (6, "u", "<p>" + "long " * 100_000), (7, "u", '<p a="x>y</p> z')]
    df = spark.createDataFrame(cases, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect())
    assert [(i, t) for i, t in got if i != 6] == [(0, "x y"), (1, ""), (2, ""), (3, "plain words"), (4, "a"), (5, ""), (5, "t"), (7, "y z")]
    assert dict(got)[6].count("long") == 100_000
    assert html_text.extract(df.limit(0)).count() == 0


def test_best_region_is_the_largest_sum():
    rng = np.random.default_rng(0)
    weights = html_text.Weights({"p": 1.0, "div": 0.1}, {"p": -0.5, "/p": -0.5, "div": -3.0, "/div": -3.0})
    for _ in range(200):
        parts = [(tag, rng.integers(0, 6)) for tag in rng.choice(["p", "div"], 6)]
        page = "".join(f"<{t}>{' '.join(f'{t}{k}x{j}' for j in range(n))}</{t}>" for k, (t, n) in enumerate(parts))
        runs = list(html_text.runs(page))
        value = [weights.tag[r.feature] if r.text is None else len(r.text.split()) * weights.word[r.feature] for r in runs]
        best = max((sum(value[a:b]) for a in range(len(runs)) for b in range(a + 1, len(runs) + 1)), default=0)
        got = html_text.main_text(page, weights).split()
        inside = [k for k, r in enumerate(runs) if r.text and set(r.text.split()) & set(got)]
        assert best <= 0 and not got or abs(sum(value[inside[0] : inside[-1] + 1]) - best) < 1e-9


def awkward_pages(spark):
    big, odd = "x" * 150, "é" * 60 + "\r\n\r\nWARC/1.0\r\n\r\n\r\n"
    rows = [(5, "http://a\nb", big), (3, "u3", big), (9, None, big), (1, "u1", "tiny"), (2, "u2", "tiny"), (4, "u4", None), (None, "n", big), (7, "u7", odd), (8, "u8", odd), (3, "u3", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))


def test_archives_round_trip(spark, tmp_path):
    pages = awkward_pages(spark)
    warc.write_archive(pages, str(tmp_path / "a"), file_bytes=3 * warc.SMALL)
    back = warc.read_archive(spark, str(tmp_path / "a"), payload=True)
    found = sorted(((r.page_id or 0), r.record_type, r.payload_bytes, r.refers_to) for r in warc.resolved(back).collect())
    assert found == [(0, "response", 150, None), (1, "response", 4, None), (2, "response", 4, None), (3, "response", 150, None), (3, "response", 150, None),
                     (4, "response", 0, None), (5, "revisit", 150, 3), (7, "response", 138, None), (8, "revisit", 138, 7), (9, "revisit", 150, 3)]
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.resolved(back).collect()}
    assert all(payloads[r.page_id] == (r.html or "") for r in pages.collect())
    assert warc.deduplicated(pages.limit(0)).count() == 0


def test_large_payloads_go_to_files_of_bounded_size(spark, tmp_path):
    pages = spark.range(6).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('x', IF(id < 3, 1000000, 10))) AS html").coalesce(1)
    warc.write_archive(pages, str(tmp_path / "a"), file_bytes=1 << 22)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(str(tmp_path / "a")).count()
    assert files == 4
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        warc.write_archive(pages.limit(1), str(tmp_path / "b"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(str(tmp_path / "b")).first().content
    stated = dt.datetime.fromisoformat(next(warc.records(bytes(content)))[0]["WARC-Date"])
    assert abs((dt.datetime.now(dt.UTC) - stated).total_seconds()) < 600
    assert [r.payload_bytes for r in warc.read_archive(spark, str(tmp_path / "a")).orderBy("page_id").collect()] == [1000001] * 3 + [11] * 3


ARTICLE = "<body><div class=nav>Menu</div><article><h1>Title</h1><p>" + "word " * 30 + "</p>%s</article><footer>foot</footer></body>"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tr><td>one</td><td>two</td></tr></table>", "one two"),
        ("<dl><dt>term</dt><dd>meaning</dd></dl>", "term meaning"),
        ("<ul><li><a href=x>link</a></li></ul>", "link"),
        ("<figure><img src=x><figcaption>caption</figcaption></figure>", "caption"),
        ("<section><h2>closing</h2></section>", "closing"),
        ("<pre><code>code()</code></pre>", "code()"),
        ("<figure>" + "<img src=x>" * 40 + "</figure><p>seven words are in this last paragraph</p>", "seven words are in this last paragraph"),
        ("<div class=comments><p>a reader says so</p></div>", ""),
    ],
)
def test_an_article_is_kept_whole(html, text):
    weights = html_text.Weights({"p": 1.5, "h1": 1.0}, {"p": -0.05, "/p": -0.05, "h1": -0.05, "/h1": -0.05})
    assert html_text.main_text(ARTICLE % html, weights) == ("Title " + "word " * 30 + text).strip()


@pytest.mark.parametrize("junk", ["<a href='", "<a ", "<button>", '<a href="x>', "<!-- x", "<select><p>", "<<<", "<a b='>"])
def test_broken_markup_takes_linear_time(junk):
    began = time.perf_counter()
    html_text.main_text(junk * (1_000_000 // len(junk)), html_text.Weights({}, {}))
    assert time.perf_counter() - began < 5


def test_weights_of_many_tag_names(spark):
    rows = [(k, "<article><p>" + "".join(f"<x{k}-{j}>a b</x{k}-{j}>" for j in range(60)) + "</p></article>") for k in range(60)]
    assert len(html_text.fit(spark.createDataFrame(rows, "page_id long, html string")).tag) > 3000


def brute(rows, threshold=0.98):
    groups, links, forest = {}, {}, Forest()
    for r in rows:
        e = r.embedding
        if None not in (r.vec_id, r.label, e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            groups.setdefault((r.label, len(e)), []).append((r.vec_id, np.array(e, float)))
    for members in groups.values():
        for i, (a, x) in enumerate(members):
            for b, y in members[i + 1 :]:
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                    forest.join(a, b)
    roots = {}
    for r in rows:
        roots.setdefault(forest.find(r.vec_id), []).append(r.vec_id)
    return {x: (links.get(x, 0), min(g)) for g in roots.values() for x in g}


def test_links_of_clustered_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    rows = []
    for i in range(600):
        # One crowded cluster, equal vectors, and pairs on both sides of the threshold.
        base = centres[0] if i % 3 == 0 else centres[i % 12]
        noise = rng.normal(size=32) * (0.0 if i % 50 == 0 else 0.08 if i % 3 == 0 else 0.16)
        rows.append((i, i % 2 if i % 5 else 0, (base + noise).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    found = embeddings.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(df.collect())
    assert sum(r.n_links for r in found) > 1000 and all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, [0.0, 0.0]), (7, 0, [nan, 1.0]),
            (8, 0, [None, 1.0]), (None, 0, [1.0, 0.0]), (9, 0, [1.0, 0.1, 0.0]), (10, 1, [1.0, 0.0]), (11, 0, []), (12, 0, [inf, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("n_links", F.lit("clash"))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), None: (0, None, True)} | {k: (0, k, True) for k in range(4, 13)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned, code, factor = embeddings.codes_of(x)
    assert np.allclose(turned @ turned.T, x @ x.T)
    error = (code @ turned.T / 8 / factor[:, None] - x @ x.T)[~np.eye(300, dtype=bool)]
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < embeddings.SURE * 0.76 / np.sqrt(63) * 1.2


def test_pipeline_stages_take_effect(spark, sf_dir, table):
    docs = table("documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0, name
        docs = after
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_stages_handle_awkward_rows(spark, sf_dir, awkward):
    for docs in (awkward, awkward.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == awkward.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_page_queries_return_their_contracts(spark, sf_dir):
    assert queries.QUERIES["op1_best_region"](spark, sf_dir).columns == ["page_id", "url", "text", "n_chars"]
    assert queries.QUERIES["op5_rotation_codes"](spark, sf_dir).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert len(queries.QUERIES) == 13
