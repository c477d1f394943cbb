import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["new_urls", "links_of_pages"])
def test_links_keep_the_characters_of_their_page(spark, tmp_path, name):
    """Letters that aren't ASCII, a space and braces in paths, of pages with and without a link in common."""
    hrefs = [["/Verä", "/a b/"], ["/Verä", "/èé.", "/{x}"], ["/Ver%C3%A4", "/c"], ["/日本/", "/c", "/"]]
    rows = [(i, f"https://www.x{i % 2}.org/de/{i}?ref=x", "<p>" + "".join(f'<a href="{h}">t</a>' for h in page)) for i, page in enumerate(hrefs)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
