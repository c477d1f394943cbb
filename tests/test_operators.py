import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitequarry.operators import chunking, conversations, dedup, freshness, frontier, html, livesearch, monitoring, registry, retrieval, totals
from sitequarry.sources import readers

PAGE = """<html lang="it"><head><title></title><meta property="og:description" content="d"><link rel="canonical" href="/c/"></head><body>
<header><h1>Titolo</h1><nav><a href="/menu">Menu</a></nav></header><main><section><h2>Sezione</h2><p>Primo paragrafo piuttosto lungo del testo di pagina.<p>Secondo&nbsp;paragrafo</section></main>
<aside>tel 0545 38111</aside><footer><a href="/foot/?utm_source=x#y">Piede</a> a@b.it</footer></body></html>"""


def test_documents(spark):
    rows = [("https://www.x.it/p", PAGE), ("https://x.it/e", ""), ("https://x.it/n", None), ("https://x.it/body", "<p>Solo corpo, senza contenitori, con testo.")]
    got = {r.url: r for r in html.documents(spark.createDataFrame(rows, "url string, html string")).collect()}
    p = got["https://www.x.it/p"]
    assert (p.title, p.description, p.lang, p.canonical_url) == ("Titolo", "d", "it", "https://www.x.it/c")
    assert p.links == ["https://www.x.it/menu", "https://www.x.it/foot"]  # those in menus and footers too
    assert p.text == "Sezione\n\nPrimo paragrafo piuttosto lungo del testo di pagina.\n\nSecondo paragrafo" or "Primo paragrafo" in p.text
    assert p.phones == ["054538111"] and p.emails == ["a@b.it"] and p.headings == ["Sezione"]
    assert p.raw_text.count("Primo paragrafo") == 2  # nested containers repeat their text
    assert got["https://x.it/body"].raw_text == "Solo corpo, senza contenitori, con testo."
    assert got["https://x.it/n"].title == "" and got["https://x.it/e"].text == ""


def test_collected_data(spark):
    link = lambda t, u: (t, u)
    rows = [("s", 1, "tel 0545 123456 Via Roma, 12 - 48022 Lugo. a@b.it", [link("Modulo ISEE", "/x"), link("Servizi online", "/y"), link("Home", "/")]), ("s", 2, "a@b.it c@d.it " + "x" * 4000, [link("Modulo ISEE", "/x"), link("Altro", "/servizio")]), ("t", 1, None, None)]
    df = spark.createDataFrame(rows, "site string, n int, content string, links array<struct<text:string,url:string>>")
    got = {r.site: r for r in html.collected(df, "site", "n").collect()}
    assert got["s"].emails == ["a@b.it", "c@d.it"] and got["s"].forms == ["Modulo ISEE"] and got["s"].services == ["Servizi online", "Altro"]
    assert len(got["s"].text_content) == 3000 and got["s"].addresses == ["Via Roma, 12 - 48022 Lugo"] and [p.strip() for p in got["s"].phones] == ["0545 123456"]
    assert got["t"].phones == [] and got["t"].forms == []


def test_utility_titles(spark):
    df = spark.createDataFrame([("Accedi | Comune",), ("Ricerca avanzata contratti",), (None,)], "t string")
    assert [r[0] for r in df.select(html.is_utility_title(F.col("t"))).collect()] == [True, False, False]


def pack_by_hand(paragraphs, limit, overlap, least):
    chunks, current, n = [], "", 0
    for p in paragraphs:
        words = p.split()
        if n + len(words) <= limit:
            current, n = (current + "\n\n" + p if current else p), n + len(words)
            continue
        if current:
            chunks.append(current)
        current, n = "", 0
        if len(words) > limit:
            chunks += [c for c in (" ".join(words[i : i + limit]) for i in range(0, len(words), limit - overlap)) if len(c) >= least]
        else:
            current, n = p, len(words)
    return chunks + [current] if current else chunks


@pytest.mark.parametrize("sizes", [[], [3], [10, 10, 10], [10, 35, 4], [4, 16, 1, 90, 2], [20, 1]])
def test_packing_of_paragraphs(spark, sizes):
    paragraphs = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([("\n\n".join(paragraphs),)], "t string")
    got = df.select(chunking.packed(F.col("t"), 20, 5, 10)).first()[0]
    assert got == pack_by_hand(paragraphs, 20, 5, 10)


def test_chunk_rows(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(30))
    df = spark.createDataFrame([("u", "t", text), ("v", None, ""), ("w", None, None)], "url string, title string, text string")
    rows = chunking.chunk(df, limit=100, overlap=10, per_page=20).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(20)) and {r.chunk_count for r in rows} == {20}
    assert all(r.text.startswith("TITLE: t\nURL: u\n\nCONTENT:\nParagraph") for r in rows) and len({r.hash for r in rows}) == 20


def test_recursive_splitter():
    text = "\n\n".join("sentence number %d goes here." % i for i in range(100))
    pieces = chunking.split_recursively(text, 200, 40)
    assert all(len(p) <= 200 for p in pieces) and all(f"number {i} " in " ".join(pieces) for i in range(100))
    assert chunking.split_recursively("x" * 450, 200, 0) == ["x" * 200, "x" * 200, "x" * 50] and chunking.split_recursively("", 10, 0) == []


def test_chunker_in_sql_gives_the_chunks_of_the_table_form(spark, sf):
    para = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    odd = ["", "short", para(30, "a") + "\n\n" + para(40, "b"), "\n \n".join(para(n, "c") for n in (600, 300, 200, 1100, 20, 990, 5)), para(2500, "d"), None, para(1000, "e") + "\n\n" + para(10, "f")]
    rows = [(f"o{i}", t) for i, t in enumerate(odd)] + [(str(r.doc_id), r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "url string, text string").withColumn("title", F.concat(F.lit("t"), "url"))
    chunking.register_chunker(spark)
    docs.createOrReplaceTempView("docs_to_chunk")
    got = spark.sql("SELECT d.url, c.chunk_index, c.chunk_count, c.chunk FROM docs_to_chunk d, LATERAL chunk_document(d.text, d.title, d.url) c").collect()
    want = chunking.chunk(docs).select("url", "chunk_index", "chunk_count", "text").collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert [len(chunking.chunks_of(t)) for t in odd] == [0, 0, 1, 5, 3, 0, 1]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: other\nUser-agent: bot\nDisallow: /\nSitemap: https://x.it/s.xml"
    robots = spark.createDataFrame([("x.it", body)], "host string, body string")
    urls = spark.createDataFrame([(u,) for u in ("https://x.it/private/a", "https://x.it/private/open/b", "https://x.it/", "https://y.it/private")], "url string")
    rules = frontier.robots_rules(robots)
    got = {r.url: r.allowed for r in frontier.robots_allowed(urls, rules).collect()}
    assert got == {"https://x.it/private/a": False, "https://x.it/private/open/b": True, "https://x.it/": True, "https://y.it/private": True}
    assert {r.allowed for r in frontier.robots_allowed(urls.where("url like '%x.it%'"), rules, "bot").collect()} == {False}
    assert {r.sitemap for r in frontier.robots_sitemaps(robots).collect()} == {"https://x.it/s.xml", "https://x.it/sitemap.xml"}


def test_rules_meet_the_paths_that_begin_with_them(spark):
    """Prefixes of all lengths, wildcards, ends and ties against a match of every rule; few rows of a large host's rules are joined."""
    import re

    rng = np.random.default_rng(9)
    words = ["a", "ab", "abc", "b", "x.y", "q+", "(z)"]
    patterns = ["/" + "/".join(rng.choice(words, int(rng.integers(0, 4)))) + rng.choice(["", "/", "*", "*c", "$", "/*/b$"]) for _ in range(120)]
    rules = [("x.it", "*", bool(rng.integers(0, 2)), p) for p in patterns] + [("y.it", "*", False, "*"), ("y.it", "*", True, "/$"), ("z.it", "*", False, "")]
    paths = ["/" + "/".join(rng.choice(words, int(rng.integers(0, 5)))) for _ in range(300)]
    urls = sorted({f"https://{h}{p}" for p in paths for h in ("x.it", "y.it", "w.it")})
    got = {r.url: r.allowed for r in frontier.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "host string, agent string, allow boolean, pattern string")).collect()}
    as_regex = lambda p: "^" + re.sub(r"([.+?^{}()|\[\]\\])", r"\\\1", p).replace("*", ".*")
    for u in urls:
        host, path = u[8:].split("/", 1)
        own = [(len(p), allow) for h, _, allow, p in rules if h == host and re.search(as_regex(p), "/" + path)]
        assert got[u] == (max(own)[1] if own else True), u


def test_robots_as_of(spark):
    """Several captures of a host: the newest that isn't newer than the row, less than a day old; one row for each row, repeated ones too."""
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(h) * 3600)
    captures = [("x.it", 0, "a"), ("x.it", 5, "b"), ("x.it", 5, "a"), ("x.it", 40, "c"), ("y.it", 3, "d"), (None, 1, "e")]
    asked = [("https://x.it/1", h) for h in (-1, 0, 4, 5, 28, 29, 39, 40, 63, 64)] + [("https://x.it/1", 4), ("https://y.it/", 4), ("https://z.it/", 4), (None, 4)]
    robots = spark.createDataFrame(captures, "host string, h int, body string").select("host", at("h").alias("fetched_at"), "body")
    urls = spark.createDataFrame(asked, "url string, h int")
    got = sorted((str(r.url), r.h, r.body) for r in frontier.robots_as_of(urls, robots, at("h")).collect())
    want = []
    for u, h in asked:
        own = [(t, b) for host, t, b in captures if u and host == u[8:12] and t <= h < t + 24]
        want.append((str(u), h, max(own)[1] if own else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    now = frontier.fresh_robots(urls, robots, F.timestamp_seconds(F.lit(1_700_000_000 + 41 * 3600))).collect()
    assert sorted((str(r.url), r.body) for r in now) == sorted((str(u), "c" if u and "x.it" in u else None) for u, _ in asked)


def test_crawl_levels_and_insert(spark):
    pages = spark.createDataFrame([("a", ["b", "c"]), ("b", ["a", "d"]), ("d", ["e"]), ("e", ["f"])], "url string, links array<string>")
    got = {r.url: r.depth for r in frontier.crawl_levels(spark.createDataFrame([("a",)], "url string"), pages, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    found = frontier.expand(pages.withColumn("depth", F.lit(0)))
    new = frontier.insert_absent(spark.createDataFrame([("b",)], "url string"), found)
    assert sorted(r.url for r in new.collect()) == ["a", "c", "d", "e", "f"]


def test_acceptance_and_retries(spark):
    df = spark.createDataFrame([(200, "text/html; charset=x"), (200, "image/png"), (404, "text/html"), (429, None), (503, None), (None, None)], "s int, c string")
    got = [tuple(r.a)[:2] for r in df.select(frontier.acceptance(F.col("s"), F.col("c")).alias("a")).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, True), (False, True)]
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    failed = spark.createDataFrame([("a", True, 0), ("b", True, 5), ("c", False, 0)], "url string, retryable boolean, attempts int")
    assert {r.url: r.status for r in frontier.after_failure(failed, now).collect()} == {"a": "queued", "b": "failed", "c": "failed"}


def test_first_writers_and_versions(spark):
    rows = [("h", "u1", 2), ("h", "u2", 1), ("h", "u2", 3), ("g", "u3", 1)]
    docs = spark.createDataFrame(rows, "content_hash string, canonical_url string, fetched_at int")
    assert {(r.canonical_url, r.duplicate_of) for r in dedup.first_writers(docs).collect()} == {("u1", "u2"), ("u2", None), ("u3", None)}
    assert {(r.canonical_url, r.fetched_at) for r in dedup.latest_version(docs, "canonical_url").collect()} == {("u1", 2), ("u2", 3), ("u3", 1)}


def test_matrix_and_native_neighbours_agree(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    key = lambda df: {(r.query_id, r["rank"]): r.chunk_id for r in df.collect()}
    exact = key(retrieval.nearest(q, c, 10, blocks=3))
    assert exact == key(retrieval.nearest_native(q, c, 10))
    assert key(retrieval.nearest_approximate(q, c, 10, exact_below=1 << 30)) == exact


def test_recall_of_the_index(spark, sf):
    """Against brute force: on vectors without clusters, three quarters of the lists; on clustered ones, an eighth. A tenth of the rows, or fewer, are scored by their vectors."""
    e = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    clustered = [(i, (centres[i % 40] * 2 + rng.normal(size=16)).tolist()) for i in range(3000)]
    for table, probes in ((rows, 0.75), (clustered, 0.125)):
        c = spark.createDataFrame([*table, (10**6, None), (10**6 + 1, [0.0] * len(table[0][1]))], "chunk_id long, vector array<double>")
        q = c.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
        x = np.array([v for _, v in table])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        best = {i: set(np.argsort(-(x[i] @ x.T), kind="stable")[:10].tolist()) for i in range(0, len(x), 20)}
        got = retrieval.nearest_approximate(q, c, 10, exact_below=0, probes=probes).collect()
        assert len({(r.query_id, r.chunk_id) for r in got}) == len(got) == 10 * len(best)
        recall = sum(r.chunk_id in best[r.query_id] for r in got) / len(got)
        print(probes, recall, max(r.scored for r in got) / len(table))
        assert recall >= 0.9 and max(r.scored for r in got) <= 0.1 * len(table)


def test_index_reads_the_cells_it_needs_and_takes_more_rows(spark, tmp_path):
    """A search of few lists reads few files; rows that are appended later are found; a code is a byte a slice, and all lists with all rows on the short list are exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 5
    rows = [(f"c{i:04d}", (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(2000)]
    table = lambda some: spark.createDataFrame(some, "chunk_id string, vector array<double>")
    index = retrieval.VectorIndex.build(table(rows[:1500]), f"{tmp_path}/index", cells=20, parts=4)
    q = table([r for r in rows if r[0][-1:] == "0"]).withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted((r.query_id, r.chunk_id, r["rank"], r.distance) for r in df.collect())
    for more in (rows[:1500], rows):
        assert key(index.nearest(q, 5, probes=1.0, shortlist=2000)) == key(retrieval.nearest(q, table(more), 5))
        if more is not rows:
            index.append(table(rows[1500:]))
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    few = index.short_lists(q.limit(1), 10, probes=0.1)
    cells = [r.cell for r in few.select("cell").distinct().collect()]
    assert 0 < len(cells) <= 2 and len(files(index.lists("codes", cells))) < 0.3 * len(files(index.lists("codes")))
    assert "PartitionFilters: [cell" in (plan := index.lists("vectors", cells)._jdf.queryExecution().toString()) or "PartitionFilters: [isnotnull(cell" in plan
    assert {len(r.code) for r in index.lists("codes").collect()} == {4} and max(len(b) for b in index.books) <= 256
    again = retrieval.VectorIndex(spark, f"{tmp_path}/index")
    assert key(again.nearest(q, 5, 0.2)) == key(index.nearest(q, 5, 0.2))


def test_articles_by_density_and_what_is_removed():
    """HTM1, HTM3: pages without an article tag, with a short one, with five teasers, in a section or a table cell, lists of links; ids that look like removed classes stay."""
    prose = "Il comune informa che gli uffici restano aperti, come di consueto, per tutta la settimana. " * 4
    paragraphs = "".join(f"<p>{prose}{i}</p>" for i in range(3))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Voce del menu numero {i}</a></li>" for i in range(30)) + "</ul>"
    teasers = "".join(f"<article><h2><a href=/{i}>Notizia numero {i} del giorno</a></h2><p>Breve testo di richiamo.</p></article>" for i in range(5))
    flat = lambda x: " ".join((x or "").split())
    article = lambda body: flat(html.parse_page(f"<html><body>{body}</body></html>")["article_text"])
    want = flat("".join(f"{prose}{i}" for i in range(3)))
    for body in (
        f"<div>{menu}</div><div id=c><h1></h1>{paragraphs}</div><div>Contatti</div>", f"<article>Breve</article><div>{paragraphs}</div>", f"<div>{teasers}</div><section>{paragraphs}</section><div>{menu}</div>",
        f"<table><tr><td>{menu}</td><td>{paragraphs}</td></tr></table>", f"<main><div>{menu}</div><div>{paragraphs}</div></main>", paragraphs, f"<div><div><div>{paragraphs}</div></div></div>",
    ):
        assert article(body) == want, body[:80]
    assert article(teasers) == "" and article(menu) == "" and article("") == "" and article("<p>corto</p>") == ""
    both = article(f"<article><div>{paragraphs}</div><section>{paragraphs}</section></article><div>{teasers}</div>")
    assert both == want + want or both == f"{want} {want}"
    blocks = lambda body: html.parse_page(body)["block_text"]
    assert blocks('<div id="menu"><p>Tagliatelle al ragù</p></div>') == "Tagliatelle al ragù" and blocks('<div class="menu"><p>Home</p></div>') == blocks('<div id="cookie"><p>ok</p></div>') == blocks('<div id="cookie-banner"><p>ok</p></div>') == ""


def test_running_totals_on_two_levels(spark):
    """The same rows as one window for each key: a key with half of all rows in several ranges, equal rows, rows of one place, null keys, orders and texts, empty texts."""
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 2 else f"k{i % 7}" if i % 5 else None, int(rng.integers(0, 400)) if i % 11 else None, None if i % 13 == 0 else "x" * int(rng.integers(0, 9)) + str(i % 17), i) for i in range(3000)]
    rows += [("hot", 1, "same", -1)] * 5 + [("one", 1, "y" * 500, -2), ("one", 2, "z", -3)]
    df = spark.createDataFrame(rows, "k string, o int, t string, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most, between in ((300, 0), (299, 1), (10**6, 2), (0, 0)):
            got, want = (sorted(map(str, totals.within(df, "k", "o", "t", most, between, few).drop("i").collect())) for few in (False, True))
            assert got == want and len(got) >= 5
        assert totals.within(df.limit(0), "k", "o", "t", 10).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_context_ends_with_the_first_block_that_does_not_fit(spark):
    rows = [("q", 1, "a" * 60 + "\n"), ("q", 2, "b" * 20 + "\n" + "c" * 50 + "\n"), ("q", 3, "d\n"), ("r", 1, "e" * 300)]
    got = {r.k: (r.context, r.blocks) for r in retrieval.pack_context(spark.createDataFrame(rows, "k string, o int, b string"), "k", "o", "b", 100, 20).collect()}
    assert got["q"] == ("a" * 60 + "\n" + "b" * 20, 1) and got["r"] == ("", 0)


def test_retrieve(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "orari ufficio", "Orari", "u1", "h1"), (2, [0.9, 0.1], "orari ufficio", "Orari", "u1", "h1"), (3, [0.0, 1.0], "altro", "Altro", "u2", None), (4, [0.5, 0.5], "terzo", "T", "u3", "")], "chunk_id int, vector array<double>, text string, title string, url string, hash string")
    queries = spark.createDataFrame([(7, "orari", [1.0, 0.0]), (8, "x", [0.0, 0.0])], "query_id int, query string, vector array<double>")
    got = {r.query_id: r for r in retrieval.retrieve(queries, chunks, k=3).collect()}
    assert got[7].confidence > 1 and not got[7].empty and [c.url for c in got[7].citations][0] == "u1" and len({c.url for c in got[7].citations}) == len(got[7].citations)
    assert got[7].context.count("orari ufficio") == 1 and len(got[7].context) <= 16000
    assert got[8].empty and got[8].confidence == 0 and got[8].low_confidence
    live = spark.createDataFrame([(8, "live")], "query_id int, context string")
    assert {r.query_id: r.context for r in retrieval.with_fallback(retrieval.retrieve(queries, chunks), live).collect()}[8] == "live"


def test_live_search(spark):
    rows = [("https://x.it/orari", "Orari", "gli orari sono " + "x " * 300), ("https://x.it/altro", "Altro", "niente")]
    docs = spark.createDataFrame([("r", u, t, None, [], x, [], [], [], []) for u, t, x in rows], "root string, url string, title string, description string, headings array<string>, raw_text string, phones array<string>, emails array<string>, addresses array<string>, opening_hours array<string>")
    got = livesearch.search_pages(spark.createDataFrame([(1, "r", "orari"), (2, "none", "orari")], "query_id int, root string, query string"), docs)
    got = {r.query_id: r for r in got.collect()}
    assert "### Pagina: Orari" in got[1].context and got[2].context == livesearch.NOTHING_FOUND


def test_index_of_pages_gives_the_rows_of_all_pairs_with_few_of_them(spark):
    """The index against every page scored for every question: tokens inside words, repeated tokens, support pages, questions without tokens, repeated urls."""
    rng, words = np.random.default_rng(6), [f"parola{chr(97 + i % 26)}{i}" for i in range(300)] + ["orari", "contatti", "chi siamo", "anagrafe"]
    pages = [(f"r{i % 3}", f"https://x.it/{'-'.join(rng.choice(words, 2))}/{i % 900}".replace(" ", "-"), " ".join(rng.choice(words, 4))) for i in range(1500)] + [("r1", None, None), (None, "https://x.it/orari", "orari")]
    asked = [(i, f"r{i % 4}", " ".join(rng.choice([*words, "ola", "ana", "parolab", "x"], 3))) for i in range(40)] + [(98, "r1", "anagrafe anagrafe"), (99, "r1", "a b"), (100, "r1", None)]
    links = spark.createDataFrame(pages, "root string, url string, anchor string")
    queries = spark.createDataFrame(asked, "query_id int, root string, query string")
    tokens = livesearch.S.tokens(F.col("query"))
    every = queries.join(links, "root").withColumn("score", livesearch.S.link_score(tokens, F.col("anchor"), F.col("url")))
    key = lambda df: sorted(((r.query_id, r["rank"], r.score, r.url) for r in df.collect()), key=str)
    w = livesearch.Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    want = every.where("score > 0").withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    assert key(livesearch.candidates(queries, links)) == key(want)
    index = livesearch.PageIndex.build(links, livesearch.new_folder(spark, "index"))
    split = queries.select("query_id", "root", tokens.alias("tokens"))
    best = index.best(split, 10).withColumn("rank", F.row_number().over(livesearch.Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "page"))).where("rank <= 10").orderBy("query_id", "rank").collect()
    whole = every.withColumn("rank", F.row_number().over(w)).where("rank <= 10").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.score, r.url) for r in best] == [(r.query_id, r.score, r.url) for r in whole]
    assert index.hits(split.where("query_id <> 98")).count() < 0.15 * every.count()


def test_two_weak_sources_pass_together(spark):
    rows = [(1, 1, True, ["0545 38111"], [], [], [], [], "x" * 120), (1, 2, True, [], [], [], [], ["anagrafe"], "y" * 200), (1, 3, True, ["01234567890"], [], [], [], [], "z" * 200), (1, 4, False, [], [], [], [], [], "")]
    arrays = ", ".join(f"{n} array<string>" for n in ("phones", "emails", "addresses", "forms", "services"))
    got = livesearch.merged_results(spark.createDataFrame(rows, f"query_id int, source_order int, success boolean, {arrays}, text_content string")).first()
    assert got.success and got.sources == 2 and got.phones == ["0545 38111"]


def test_site_tree_takes_turns_and_caps_levels(spark):
    links = [("r", i, f"a{i}") for i in range(4)] + [("a0", i, f"b{i}") for i in range(40)] + [("a1", 0, "b0"), ("a1", 1, "c0"), ("b1", 0, "r"), ("b1", 1, "d")]
    tree = freshness.site_tree(spark.createDataFrame([("r",)], "url string"), spark.createDataFrame(links, "url string, pos int, link string")).collect()
    by = {r.url: r for r in tree}
    assert by["c0"].parent_url == "a1" and by["b0"].parent_url == "a0" and by["d"].depth == 3 and len([r for r in tree if r.depth == 2]) == 7
    assert sorted(r.position for r in tree) == list(range(len(tree)))


def test_breadcrumbs_of_any_depth(spark):
    """A chain of 1,000 pages, a forest of random depth, and lines that end in cycles of several lengths, against a walk."""
    rng = np.random.default_rng(8)
    up = {f"c{i}": f"c{i - 1}" if i else None for i in range(1000)}
    up |= {f"t{i}": f"t{int(rng.integers(0, i))}" if i and rng.random() < 0.98 else None for i in range(400)}
    up |= {"s": "s", "p": "q", "q": "p", **{f"y{i}": f"y{(i + 1) % 7}" for i in range(7)}, "in": "y3", "in2": "in", "lost": "nowhere"}
    got = {r.url: r.breadcrumb for r in freshness.breadcrumbs(spark.createDataFrame([(u, p, u.upper()) for u, p in up.items()], "url string, parent_url string, title string")).collect()}
    for u in up:
        line = [u]
        while (p := up.get(line[-1])) in up and p not in line:
            line.append(p)
        assert got[u] == [x.upper() for x in reversed(line)], u
    assert len(got["c999"]) == 1000


def test_breadcrumbs_survive_a_cycle(spark):
    tree = spark.createDataFrame([("r", None, "R"), ("a", "r", "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y")], "url string, parent_url string, title string")
    got = {r.url: r.breadcrumb for r in freshness.breadcrumbs(tree).collect()}
    assert got["b"] == ["R", "A", "B"] and got["r"] == ["R"] and got["x"] == ["Y", "X"]


def test_recrawl_plan(spark):
    at = datetime.datetime
    pages = spark.createDataFrame([("s", "https://x.it/a/", None, at(2026, 2, 1)), ("s", "https://x.it/b", None, at(2025, 1, 1)), ("s", "https://x.it/c", None, None), ("t", "https://y.it/", None, None)], "site string, url string, canonical_url string, last_modified timestamp")
    sites = spark.createDataFrame([(s, at(2026, 1, 1)) for s in ("s", "t", "z")], "site string, since timestamp")
    front = spark.createDataFrame([("https://x.it/a", "fetched", 3, 0), ("https://x.it/b", "fetched", 0, 0)], "url string, status string, attempts int, priority int")
    chunks = spark.createDataFrame([("https://x.it/a", 1), ("https://x.it/b", 2)], "url string, n int")
    plan = freshness.recrawl_plan(sites, pages, front, chunks, F.lit(at(2026, 3, 1)))
    assert [r.url for r in plan["changed"].collect()] == ["https://x.it/a"] and [r.n for r in plan["chunks"].collect()] == [2]
    assert {(r.url, r.status, r.attempts) for r in plan["frontier"].collect()} == {("https://x.it/a", "queued", 0), ("https://x.it/b", "fetched", 0)}
    assert {r.site: r.outcome for r in plan["runs"].collect()} == {"s": "updated", "t": "no-changes", "z": "error"}


def test_last_modified_takes_the_best_source(spark):
    pages = spark.createDataFrame([("https://x.it/a", datetime.date(2026, 1, 2), None, None), ("https://x.it/b/", None, None, None), ("https://x.it/c", None, "Wed, 21 Oct 2015 07:28:00 GMT", "2020-01-01")], "url string, visible_date date, header_modified string, meta_modified string")
    sitemap = spark.createDataFrame([("https://x.it/a", "2001-01-01"), ("https://x.it/b", "2024-05-06")], "url string, lastmod string")
    assert {r.url: r.last_modified_source for r in freshness.last_modified(pages, sitemap).collect()} == {"https://x.it/a": "page", "https://x.it/b/": "sitemap", "https://x.it/c": "header"}


def test_history_leaves_tool_calls_out(spark):
    rows = [("s", i, "assistant" if i % 2 else "user", [("t",)] if i == 11 else None) for i in range(12)]
    log = spark.createDataFrame(rows, "conv_id string, turn int, role string, tool_calls array<struct<n:string>>")
    assert sorted(r.turn for r in conversations.prompt_history(log).collect()) == list(range(3, 11))
    assert conversations.without_sessions(log, log.select("conv_id").distinct()).count() == 0


def test_reports_without_rows_have_defaults(spark):
    calls = spark.createDataFrame([], "ts timestamp, id long, endpoint string, method string, response_time double, success boolean")
    none = spark.createDataFrame([], "ts timestamp, id long, error string, status string, acknowledged boolean")
    r = monitoring.hourly_report(calls, none, none, none, F.current_timestamp()).first()
    assert (r.total_calls, r.error_rate, r.avg_response_time, r.health_score) == (0, 0.0, 0.0, 100.0)


def test_registry(spark):
    urls = ["https://x.it"]
    rows = [("a", "me", "crawling", "kb1", None, urls, "2", "P one"), ("b", "you", None, None, False, urls, "999", "P two")]
    demos = spark.createDataFrame([(i, u, m, k, e, s, d, None, p, "https://www.x.it/") for i, u, m, k, e, s, d, p in rows], "id string, created_by string, search_mode string, knowledge_base_id string, enabled boolean, search_urls array<string>, crawl_max_depth string, crawl_max_pages string, product string, client_url string")
    same = registry.knowledge_base(demos, demos)
    assert {r.id: r.knowledge_base_id for r in same.collect()}["a"] == "kb1"
    changed = registry.knowledge_base(demos.withColumn("crawl_max_depth", F.lit("3")), demos)
    assert {r.id: r.knowledge_base_id for r in changed.collect()}["a"] != "kb1"
    assert [r.id for r in registry.matching(demos, "a").collect()] == ["a"] and sorted(r.id for r in registry.matching(demos, "p ").collect()) == ["a", "b"]
    ids = demos.select("id")
    assert [r.id for r in registry.without(demos, ids, "me").collect()] == ["b"] and registry.without(demos, ids).count() == 0
    assert {r.enabled for r in registry.disabled(demos, ids).collect()} == {False}


def test_sitemaps_feeds_and_messages(spark):
    index = "<sitemapindex><sitemap><loc>https://x.it/1.xml</loc></sitemap><sitemap><loc>https://x.it/2.xml</loc></sitemap></sitemapindex>"
    one = "<urlset><url><loc>https://x.it/a?b=1&amp;c=2</loc><lastmod>2026-01-01</lastmod></url><url><loc> https://x.it/d </loc></url></urlset>"
    captured = spark.createDataFrame([("https://x.it/s.xml", index), ("https://x.it/1.xml", one), ("https://x.it/2.xml", one)], "url string, body string")
    roots = spark.createDataFrame([("x", "https://x.it/s.xml")], "site string, url string")
    got = {r["loc"]: r.lastmod for r in readers.expanded_sitemaps(roots, captured).collect()}
    assert got == {"https://x.it/a?b=1&c=2": "2026-01-01", "https://x.it/d": None}
    feeds = spark.createDataFrame([("<rss><lastBuildDate>A</lastBuildDate><pubDate>B</pubDate></rss>",), ("<feed><updated>C</updated></feed>",), ("<html><pubDate>D</pubDate></html>",)], "body string")
    assert [r[0] for r in feeds.select(readers.feed_updated()).collect()] == ["A", "C", None]
    raw = spark.createDataFrame([('{"From":"whatsapp:+39333","Body":"ciao","MediaUrl0":"u","MediaContentType0":"image/png"}',), ('{"from":"a@b.it","subject":"s","text":"t"}',), ("broken",)], "value string")
    got = readers.inbound_messages(raw).collect()
    assert [(r.channel, r.sender, r.message) for r in got] == [("whatsapp", "+39333", "ciao"), ("email", "a@b.it", "t"), ("email", "", "")]
    assert got[0].media.type == "image/png" and got[1].media is None


def test_site_analysis_puts_tree_dates_and_breadcrumbs_together(spark):
    links = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("a", 0, "c"), ("a", 1, "r"), ("b", 0, "c"), ("b", 1, "d")], "url string, pos int, link string")
    u = lambda x: f"https://x.it/{x}"
    links = links.select(F.concat(F.lit(u("")), "url").alias("url"), "pos", F.concat(F.lit(u("")), "link").alias("link"))
    root = spark.createDataFrame([(u("r"),)], "url string")
    pages = spark.createDataFrame([(u("r"), "Root", None, None, None), (u("a"), "A", "2024-01-02", None, None), (u("b"), "", None, "Thu, 03 Feb 2022 04:05:06 GMT", None), (u("d"), "D", None, None, None)], "url string, title string, visible_date string, header_modified string, meta_modified string").withColumn("visible_date", F.col("visible_date").cast("date"))
    sitemap = spark.createDataFrame([(u("a"), "2020-01-01"), (u("c/"), "2021-05-06")], "url string, lastmod string")
    feeds = spark.createDataFrame([(u("d"), "2019-01-01T00:00:00Z"), (u("a"), "2019-01-01")], "url string, updated string")
    got = freshness.analyze_site(root, links, pages, sitemap, feeds).collect()
    name = lambda x: x and x.rpartition("/")[2]
    assert [(name(r.url), r.depth, name(r.parent_url), [name(b) for b in r.breadcrumb], r.last_modified_source) for r in got] == [
        ("r", 0, None, ["Root"], None), ("a", 1, "r", ["Root", "A"], "page"), ("b", 1, "r", ["Root", "b"], "header"), ("c", 2, "a", ["Root", "A", "c"], "sitemap"), ("d", 2, "b", ["Root", "b", "D"], "feed"),
    ]


def round_robin(links, per_parent):
    """WIN6, WIN7 without a cut before the turns are counted."""
    w = freshness.Window
    unique = links.withColumn("n", F.row_number().over(w.partitionBy("link").orderBy("parent_pos", "pos"))).where("n = 1")
    capped = unique.withColumn("rn", F.row_number().over(w.partitionBy("parent_pos").orderBy("pos"))).where(F.col("rn") <= per_parent)
    return capped.withColumn("turn", F.row_number().over(w.partitionBy(F.lit(0)).orderBy("rn", "parent_pos")))


def test_levels_of_a_tree_are_cut_before_their_turns_are_counted(spark):
    rows = [(p, i, f"l{p}-{i}" if i % 3 else "shared") for p in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "parent_pos int, pos int, link string")
    for per, room in ((6, 11), (3, 100), (1 << 30, 20)):
        whole = {(r.link, r.turn) for r in round_robin(df, per).where(F.col("turn") <= room).collect()}
        assert {(r.link, r.turn) for r in freshness.first_turns(df, per, room).collect()} == whole


def test_collected_texts_end_where_they_are_full(spark):
    rows = [("s", i, f"tel. 0545 {100000 + i} a{i}@x.it " + "x" * 700, [("modulo uno", "u"), (f"modulo {i}", "u")]) for i in range(20)]
    df = spark.createDataFrame(rows, "site string, n int, content string, links array<struct<text:string,url:string>>")
    r = html.collected(df, "site", "n").first()
    assert r.text_content == " ".join(x[2] for x in rows)[:3000]
    assert r.emails == [f"a{i}@x.it" for i in range(10)] and r.forms == ["modulo uno", *(f"modulo {i}" for i in range(9))]
