import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitequarry.llm import html_extract, quality, topk_search

PARAGRAPH = "A paragraph of the article, with commas, and enough words to count as one."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Site</title>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PARAGRAPH}<p>Second &amp; last.</article><footer>Foot</footer>"), f"Title\n\n{PARAGRAPH}\n\nSecond & last."),
    "divs": (page(f"<div class='cookie-notice'>We use cookies, and more cookies, on this site.</div><div id=wrap><div class=menu><a href=x>A</a></div><div class=post><h2>T</h2><div>{PARAGRAPH}</div><div>{PARAGRAPH}</div></div></div>"), f"T\n\n{PARAGRAPH}\n\n{PARAGRAPH}"),
    "comments": (page(f"<main><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></main><section id=comments><p>I think, that this is a comment, as long as one.</p></section>"), f"{PARAGRAPH}\n\n{PARAGRAPH}"),
    "inner noise": (page(f"<article><p>{PARAGRAPH}</p><div class='ad banner'>Buy, buy</div><form><input><p>Subscribe, now, please, it is free of charge</p></form><script>if (a < b) x('</p>')</script><p>End, really.</p></article>"), f"{PARAGRAPH}\n\nEnd, really."),
    "white space": (page(f"<article><p>  a\n\t b&nbsp;c<br>d </p><p>{PARAGRAPH}</p></article>"), f"a b c d\n\n{PARAGRAPH}"),
    "inline": (page(f"<article><p>{PARAGRAPH} <b>bold</b>, <i>it<b>al</i>ic.</p></article>"), f"{PARAGRAPH} bold, italic."),
    "short": (page("<article><p>Tiny.</p></article>"), "Tiny."),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": (page("<nav>only a menu</nav>"), ""),
    "sidebar": (page(f"<div class=layout><aside><p>{PARAGRAPH}</p></aside><div class=sidebar><p>{PARAGRAPH}</p></div><article><p>{PARAGRAPH}</p></article></div>"), PARAGRAPH),
    "links in the article": (page(f"<article><p>{PARAGRAPH}</p><ul><li><a href=1>Reference one</a><li><a href=2>Reference two</a><li><a href=3>Reference three</a></ul></article>"), f"{PARAGRAPH}\n\nReference one\n\nReference two\n\nReference three"),
    "links among paragraphs": (page(f"<div id=wrap><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About</a></ul><div><p>{PARAGRAPH}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{PARAGRAPH}</p></div></div>"), f"{PARAGRAPH}\n\nOne\n\nTwo\n\nThree\n\n{PARAGRAPH}"),
    "names inside the article": (page(f"<article><div class='social-science'>{PARAGRAPH}</div><p id='menu-design'>{PARAGRAPH}</p><h2 id=search>Search</h2><h2 class=header>Head</h2><p title='a hidden place'>{PARAGRAPH}</p><div class='ad-banner'>Buy</div><p class=advertisement>Buy more</p><div class='share-buttons'>Share</div><div id=comments><p>{PARAGRAPH}</p></div><div hidden>{PARAGRAPH}</div></article>"), f"{PARAGRAPH}\n\n{PARAGRAPH}\n\nSearch\n\nHead\n\n{PARAGRAPH}"),
    "text that isn't markup": (page(f"<article><p>{PARAGRAPH} <math><mi>x</mi><mo>+</mo><mn>1</mn></math> <label>labelled</label> <object>drawn</object> <noscript>still</noscript> end</p></article>"), f"{PARAGRAPH} x+1 labelled drawn still end"),
    "a short second div": (page(f"<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div><p>Short end.</p></div><div class=footer>Foot</div>"), f"{PARAGRAPH}\n\n{PARAGRAPH}\n\nShort end."),
    "parts of an article": (page(f"<article><div class=a><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div class=b><p>Tiny.</p></div></article>"), f"{PARAGRAPH}\n\n{PARAGRAPH}\n\nTiny."),
    "enable scripts": (page(f"<noscript>Please enable scripts, for this site, at once.</noscript><article><p>{PARAGRAPH}</p></article>"), PARAGRAPH),
    "unclosed": (f"<html><body><article><h1>T<p>{PARAGRAPH}<p>{PARAGRAPH}", f"T\n\n{PARAGRAPH}\n\n{PARAGRAPH}"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    if name == "unclosed":  # an unclosed heading takes the paragraphs in; the blocks stay apart
        assert html_extract.main_text(html).endswith(f"{PARAGRAPH}\n\n{PARAGRAPH}")
    else:
        assert html_extract.main_text(html) == want


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 200_000 + f"<p>{PARAGRAPH}",
        "<b>" * 200_000 + PARAGRAPH + "</i>" * 200_000,
        f"<article><p>{PARAGRAPH}</p></article>" + "<a " * 350_000,
        f"<article><p>{PARAGRAPH}</p></article>" + "<textarea>" * 100_000,
        f"<article><p>{PARAGRAPH}</p></article><!-- " + "<a href='" * 100_000,
        f"<article><p>{PARAGRAPH}</p></article>" + "<a x='> <a x=\"> " * 60_000,
        f"<article><p>{PARAGRAPH}</p></article><i " + "a" * 1_000_000 + ">",
        "<i><article>" + "<b>" * 100_000 + PARAGRAPH + "</i>" * 100_000,
        "<ul>" + "<li><ul>" * 60_000 + f"</ul><p>{PARAGRAPH}",
    ],
    ids=["divs", "stray ends", "unended tags", "unended raw", "unended comment", "quotes", "attribute", "barrier", "lists"],
)
def test_time_grows_with_the_length_of_a_page(html):
    begin = time.process_time()
    assert PARAGRAPH in html_extract.main_text(html)
    assert time.process_time() - begin < 12


def test_extract_keeps_every_row_and_whole_texts(spark):
    long = page("<article>" + f"<p>{PARAGRAPH}</p>" * 5000 + "</article>")
    deep = "<div>" * 3000 + f"<p>{PARAGRAPH}</p>"
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (None, None, None, None), (2, "v", deep, "y")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 4 and sum(r.n_chars == 5000 * len(PARAGRAPH) + 4999 * 2 for r in out) == 2
    assert [r.text for r in out if r.page_id == 2] == [PARAGRAPH]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_tables_give_their_articles(spark, sf):
    import re
    from html import unescape

    for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    rows = quality.classify(docs, train).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    good = (rows.quality_y if "quality_y" in rows else rows.iloc[:, -2]).astype(bool)
    toxic = rows.toxic.astype(bool)
    keep = rows.keep.astype(bool)
    clean = good & ~toxic
    assert keep[clean].mean() > 0.97
    assert keep[~good].mean() < 0.35


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert quality.classify(odd, labels.limit(0)).count() == odd.count()
    assert quality.classify(none, labels).count() == 0


def test_posteriors_equal_brute_force(spark, sf):
    """Evidence by the models, rates by host and path shrunk by moments, posteriors and verdicts, row by row in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 9 = 0 then null else source end as source", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = docs.selectExpr("doc_id", "text", "source as host", "lang as path")
    good, toxic, good_rate, toxic_rate = quality.fitted(texts, labels, train_rows=150, buckets=1 << 14, seed=42)
    logit, sigmoid = lambda p: math.log(p / (1 - p)), lambda x: 1 / (1 + math.exp(-x))
    bound = lambda p: min(1 - 1e-3, max(1e-3, p))
    rows = []
    for r in texts.collect():
        words, dense = quality.features(r.text or "", 1 << 14)
        rows.append((r.doc_id, r.host, r.path, good.evidence(words, dense), toxic.evidence(words, dense)))
    p = [sigmoid(e + logit(bound(good_rate))) for *_, e, _ in rows]

    def rates(keys, above):
        """keys: the group of each row; above: the rate over each group."""
        n, s = {}, {}
        for k, x in zip(keys, p):
            n[k], s[k] = n.get(k, 0) + 1, s.get(k, 0.0) + x
        between = sum(n[k] * (s[k] / n[k] - above[k]) ** 2 for k in n)
        within = sum(above[k] * (1 - above[k]) for k in n)
        most = sum(n[k] * above[k] * (1 - above[k]) for k in n)
        rho = min(0.5, max(1e-4, (between - within) / max(1e-9, most - within)))
        strength = 1 / rho - 1
        return {k: (s[k] + strength * above[k]) / (n[k] + strength) for k in n}

    hosts, paths = [r[1] for r in rows], [r[1:3] for r in rows]
    by_host = rates(hosts, dict.fromkeys(hosts, sum(p) / len(p)))
    by_path = rates(paths, {k: by_host[k[0]] for k in paths})
    got = {r.doc_id: r for r in quality.classify(docs, labels, train_rows=150, buckets=1 << 14).collect()}
    assert len(got) == len(rows)
    for (i, host, path, e, t) in rows:
        q, x = sigmoid(e + logit(bound(by_path[host, path]))), sigmoid(t + logit(bound(toxic_rate)))
        r = got[i]
        assert (r.evidence, r.toxic_evidence, r.host_rate, r.path_rate, r.quality, r.toxicity) == pytest.approx((e, t, by_host[host], by_path[host, path], q, x), abs=1e-9)
        assert r.keep == (q >= 0.5 and x < 0.25)


def test_rates_shrink_towards_the_level_above(spark):
    level = spark.createDataFrame([("big", 1000, 0.1), ("small", 1, 0.0), ("other", 500, 0.9)], "host string, n long, rate double")
    got = {r.host: r.x for r in quality.shrunk(level, "rate", F.lit(0.5), "x").collect()}
    assert abs(got["big"] - 0.1) < 0.05 and 0.2 < got["small"] < 0.5 and got["other"] > 0.8


def best_by_force(rows, k=10, kind=np.float32):
    """Each row is a query or a candidate of its own, whatever its id."""
    ok = [(i, [math.floor(float(kind(x)) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    end = lambda s: min((1 << 63) - 1, max(-(1 << 63), s))
    out = []
    for n_q, (q, v) in enumerate(ok):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i, n) for n, (i, w) in enumerate(ok) if n != n_q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, end(-s)) for n, (s, i, _) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("dim_block,candidates", [(16, 1 << 20), (5, 16_000)])
def test_top_k_equals_brute_force(spark, sf, dim_block, candidates):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, dim_block=dim_block, candidate_bytes=candidates, query_bytes=1500)
    assert sorted(map(tuple, got.collect())) == best_by_force([(r.vec_id, r.embedding) for r in df.collect()])


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (1, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (100, [-1.0, 0.5]), (100, [-1.0, 0.5]), (100, [3.0, 0.5]), (200, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v string")
    for k in (3, 20):
        got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 100 == 0, k=k).collect()))
        assert got == best_by_force(rows, k)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [30.0, 1e5, 1e8, 1e12])
def test_scores_that_doubles_cannot_hold(spark, size):
    rng = np.random.default_rng(4)
    base = rng.normal(0, size, (1, 12))
    near = base + rng.normal(0, 1e-3, (60, 12))  # scores that agree in their leading digits
    rows = [(i, v) for i, v in enumerate([*near.tolist(), *rng.normal(0, size, (200, 12)).tolist(), *near[:5].tolist()])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 100 == 0, candidate_bytes=5000).collect()))
    assert got == best_by_force(rows, kind=float)
