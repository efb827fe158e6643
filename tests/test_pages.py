"""Queries over the pages table against their SQL, on pages that were cut or hold signs that read as math."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


def page(heading: str, body: str) -> str:
    return f'<!DOCTYPE html><html lang="fr"><head><title>{heading}</title></head><body><h1>{heading}</h1><p>{body}</p><i>&copy; &middot;</i></body></html>'


def differ(spark, folder, name: str, pages: list[str]) -> Counter:
    """Rows of the query that its SQL has not, and the other way round."""
    rows = [(k, f"https://h{k % 2}.example/{k}", html) for k, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        found = sql.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        want = Counter(found.fetchall())
    got = Counter(tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect())
    assert want
    return (got - want) + (want - got)


CUT = [page("Un&amp;&amp; deux&amp", "Un&amp;&amp; deux&amp; trois"), page("R&ampD a&lt", "x &quot;y&quot; &lt;z&gt; &am"), page("a & b", "AT&T &amp;amp;")]


@pytest.mark.parametrize("name", ["near_empty", "text_views"])
def test_references_without_semicolon(spark, tmp_path, name):
    assert not differ(spark, tmp_path, name, CUT)


@pytest.mark.parametrize("name", ["present_by_suite", "grade_present", "stream_grade"])
def test_headings_with_dollars(spark, tmp_path, name):
    pages = [page("Enêè*** en%%% un%%% évitre$$$ è$$$ éèç", "a$$$ the"), page("rean.### Ededat$$$ anrent$$$ a$$$ the", "$x_1$ and \\$5"), page("$x_1$ is a", "b"), *CUT]
    assert not differ(spark, tmp_path, name, pages)
