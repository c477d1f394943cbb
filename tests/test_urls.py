import pytest
from pyspark.sql import functions as F

from sitequarry.functions import urls as U

CASES = [
    ("HTTP://WWW.Example.com:80/a/b/?z=1&UTM_source=q&a=2#f", None, "http://www.example.com/a/b?a=2&z=1"),
    ("https://x.it", None, "https://x.it/"), ("https://x.it/", None, "https://x.it/"), ("https://x.it/doc.PDF", None, None), ("https://x.it:443/a/", None, "https://x.it/a"),
    ("https://x.it:8443/a", None, "https://x.it:8443/a"), ("mailto:a@b.it", None, None), ("javascript:void(0)", None, None), ("ftp://x.it/a", None, None), ("http://[bad", None, None), ("", None, None), (None, None, None),
    ("/c?b=2&b=1&a", "https://x.it/p/q", "https://x.it/c?a=&b=2&b=1"), ("d", "https://x.it/p/q", "https://x.it/p/d"), ("../d", "https://x.it/p/q/r", "https://x.it/p/d"), ("./d", "https://x.it/p/q", "https://x.it/p/d"),
    ("//y.it/e", "https://x.it/p", "https://y.it/e"), ("?k=1", "https://x.it/p", "https://x.it/p?k=1"), ("#top", "https://x.it/p", "https://x.it/p"), ("tel:123", "https://x.it/p", None),
]


BASE = "https://a.it/1/2/3/p"
#: href, page, canonical URL; as the URL standard's parser resolves them, with the canonical form's own rules on top.
RESOLVED = [
    ("../../x", BASE, "https://a.it/1/x"), ("../../../../x", "https://a.it/1/2/3/4/5/p", "https://a.it/1/x"), ("../../../../../../x", BASE, "https://a.it/x"), ("..", BASE, "https://a.it/1/2"), ("../", BASE, "https://a.it/1/2"),
    ("../..", BASE, "https://a.it/1"), (".", BASE, "https://a.it/1/2/3"), ("././x", BASE, "https://a.it/1/2/3/x"), ("./././.", BASE, "https://a.it/1/2/3"), ("x/./y/../z", BASE, "https://a.it/1/2/3/x/z"), ("/d/..", BASE, "https://a.it/"),
    ("/d/../../e", BASE, "https://a.it/e"), ("/a/b/../c/./d/../..", BASE, "https://a.it/a"), ("%2e%2E/x", BASE, "https://a.it/1/2/x"), (".%2e/./x", BASE, "https://a.it/1/2/x"), ("...", BASE, "https://a.it/1/2/3/..."), ("..x/y", BASE, "https://a.it/1/2/3/..x/y"), (".x", BASE, "https://a.it/1/2/3/.x"),
    ("a//../b", BASE, "https://a.it/1/2/3/a/b"), ("//b.it/../c", BASE, "https://b.it/c"), ("x?y=../z", BASE, "https://a.it/1/2/3/x?y=..%2Fz"), ("?q=/../a", BASE, "https://a.it/1/2/3/p?q=%2F..%2Fa"), ("x", "https://a.it/1/2/..", "https://a.it/1/x"), ("x", "https://a.it", "https://a.it/x"),
    ("\ta\n/b\r", BASE, "https://a.it/1/2/3/a/b"), ("ht\ntps://c.it/x", BASE, "https://c.it/x"), (" \x01 /x \x0b", BASE, "https://a.it/x"), ("a b", BASE, "https://a.it/1/2/3/a%20b"), ("città/à", BASE, "https://a.it/1/2/3/citt%C3%A0/%C3%A0"), ("/𝄞", BASE, "https://a.it/%F0%9D%84%9E"), ('/"<>`{}', BASE, "https://a.it/%22%3C%3E%60%7B%7D"),
    ("/a%20b%zz", BASE, "https://a.it/a%20b%zz"), ("/it's|(x)~", BASE, "https://a.it/it's|(x)~"), ("https://u:p@a.it/x", None, "https://u:p@a.it/x"), ("https://u:@a.it/x", None, "https://u@a.it/x"), ("https://u@v@a.it:443/x", None, "https://u%40v@a.it/x"),
    ("/y", "https://u:p@a.it/x", "https://u:p@a.it/y"), ("\\\\b.it\\c\\..\\d", BASE, "https://b.it/d"), ("\\c", BASE, "https://a.it/c"), ("https:c", BASE, "https://a.it/1/2/3/c"), ("https:/c", BASE, "https://a.it/c"), ("http:c", BASE, "http://c/"), ("https:///c.it/x", None, "https://c.it/x"),
    ("https:c.it/x", None, "https://c.it/x"), ("https://A.It:0443/x", None, "https://a.it/x"), ("http://a.it:443/", None, "http://a.it:443/"), ("https://a.it:/x", None, "https://a.it/x"), ("https://a.it:65536/", None, None), ("https://a.it:8x/", None, None), ("https:///", None, None),
    ("https://a b.it/", None, None), ("https://a%2Eit/x", None, "https://a.it/x"), ("https://[2001:DB8::1]:8080/x", None, "https://[2001:db8::1]:8080/x"), ("relative", None, None), ("about:blank", BASE, None), ("HTTPS://a.it", BASE, "https://a.it/"), ("x", "mailto:a@b.it", None), ("https://c.it/x", "nonsense", None), ("https://c.it/x", "mailto:a@b.it", "https://c.it/x"),
    ("/s?b=a%20b&a=1+2&c=%C3%A0&d=à&e=%zz", BASE, "https://a.it/s?a=1+2&b=a+b&c=%C3%A0&d=%C3%A0&e=%25zz"), ("/s?a=1=2&%61=0", BASE, "https://a.it/s?a=1%3D2&a=0"), ("/s?UTM%5Fsource=x&&=v", BASE, "https://a.it/s?=v"), ("/s?~=*._-", BASE, "https://a.it/s?%7E=*._-"), ("/s?", BASE, "https://a.it/s"), (None, BASE, None),
]


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression.alias("x")).orderBy("i").select("x").collect()]


def test_normalize_url(spark):
    df = spark.createDataFrame([(i, r, b) for i, (r, b, _) in enumerate(CASES)], "i int, raw string, base string")
    got = df.select("i", F.when(F.col("base").isNull(), U.normalize_url(F.col("raw"))).otherwise(U.normalize_url(F.col("raw"), F.col("base"))).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [w for _, _, w in CASES]


def test_hrefs_resolve_as_the_standard_says(spark):
    df = spark.createDataFrame([(i, r, b) for i, (r, b, _) in enumerate(RESOLVED)], "i int, raw string, base string")
    got = df.select("i", F.when(F.col("base").isNull(), U.normalize_url(F.col("raw"))).otherwise(U.normalize_url(F.col("raw"), F.col("base"))).alias("u")).orderBy("i").collect()
    assert [(c[0], r.u) for c, r in zip(RESOLVED, got)] == [(c[0], c[2]) for c in RESOLVED]


def test_light_forms_keep_their_parameters(spark):
    """URL9, URL10: steps and codes as above, parameters in their order, no last slash."""
    hrefs = ["../../x/?b=1&a=2", "../..", "/", "a b?q=x y'", " #top", "mailto:a@b.it", "https://u:p@c.it/", "/x?utm_source=1#f", None]
    want = ["https://a.it/1/x/?b=1&a=2", "https://a.it/1", "https://a.it", "https://a.it/1/2/3/a%20b?q=x%20y%27", None, None, "https://u:p@c.it", "https://a.it/x?utm_source=1", None]
    assert column(spark, hrefs, U.light_normalize(F.col("v"), F.lit(BASE))) == want
    assert column(spark, ['../x" target="_blank"', '../../y rel="x" class="b"'], U.clean_href(F.col("v"), F.lit(BASE)))[1] == "https://a.it/1/y"
    assert column(spark, ["https://u:p@WWW.a.it/x", "https://[::1]/x"], U.host_of(F.col("v"))) == ["www.a.it", "[::1]"]


def test_normalizing_again_changes_nothing(spark, sf):
    u = U.normalize_url(F.col("url"))
    assert spark.read.parquet(f"{sf}/pages.parquet").where(~U.normalize_url(u).eqNullSafe(u)).count() == 0


@pytest.mark.parametrize("f,true,false", [
    (U.is_news_like, ["https://x.it/notizie/x", "https://x.it/a/News"], ["https://x.it/newsletter", "https://x.it/a?p=/news/", "nonsense"]),
    (U.is_likely_non_page, ["https://x.it/media/1891", "https://x.it/download/2/x"], ["https://x.it/media/photo", "https://x.it/media/"]),
    (U.is_utility, ["https://x.it/ricerca", "https://x.it/Login?x"], ["https://x.it/ricercatori", "https://x.it/cercasi"]),
    (U.is_binary, ["https://x.it/a.PDF", "https://x.it/a.jpg?x=1"], ["https://x.it/a.pdfx", "https://x.it/a"]),
    (U.is_valid_url, ["https://x.it", "mailto:a@b.c"], ["x.it", "", "a b"]),
])
def test_classes_of_paths(spark, f, true, false):
    assert column(spark, [*true, *false], f(F.col("v"))) == [True] * len(true) + [False] * len(false)


def test_hosts_slugs_and_cities(spark):
    urls = ["https://WWW.Comune.Lugo.it/Uffici/orari_apertura-x/", "https://forli.gov.it/", "https://x.it/"]
    assert column(spark, urls, U.site_of(F.col("v"))) == ["comune.lugo.it", "forli.gov.it", "x.it"]
    assert column(spark, urls, U.slug(F.col("v")))[0] == " uffici orari apertura x "
    assert column(spark, urls, U.city_code(F.col("v"))) == ["LUGO", "FORLI", None]
    assert column(spark, urls, U.light_normalize(F.col("v")))[1:] == ["https://forli.gov.it", "https://x.it"]
    assert column(spark, ['https://x.it/a" ', 'https://x.it/b target="_blank" rel="x"'], U.clean_href(F.col("v")))[1] == "https://x.it/b"
    assert column(spark, ["see https://a.it/x and https://b.it https://a.it/x"], U.urls_in(F.col("v"))) == [["https://a.it/x", "https://b.it"]]
