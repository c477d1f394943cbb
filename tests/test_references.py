import duckdb
import pytest

import __spark_entry__ as entry
from sitequarry.operators import html

QUERIES = ["chunk_pages", "page_texts", "knowledge_base", "page_raw_texts"]


@pytest.mark.parametrize("name", QUERIES)
def test_references_that_are_cut_stay_as_their_page_has_them(spark, tmp_path, name):
    """Titles and headings cut inside `&amp;`, `&quot;` and `&copy;`, as in some pages of the larger tables."""
    body = " ".join(f"word{i}" for i in range(150))
    cuts = ["x &amp;&amp;&amp", "x &amp;&am", "x &a", "x &", "x &quot", "x &copy", "x &amp;amp"]
    page = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav><a href="/a">link</a></nav><article><h1>{0}</h1><p>{1} &amp; {2}</p></article><footer>&copy; x</footer></body></html>'
    rows = [(i, f"https://www.x{i % 2}.org/{i}", page.format(c, body, i)) for i, c in enumerate(cuts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_open_references():
    """Read as browsers do, unless they are asked to stay; closed ones are always read."""
    text = lambda body, **how: html.parse_page(f"<p>{body}</p>", **how)["body_text"]
    written = "a &amp &copyx &#65 &#x41 &notit; &amp;lt &lt;b &unknown &unknown; & b &&amp;"
    assert text(written) == "a & ©x A A ¬it; &lt <b &unknown &unknown; & b &&"
    assert text(written, open_references=False) == "a &amp &copyx &#65 &#x41 &notit; &lt <b &unknown &unknown; & b &&"
