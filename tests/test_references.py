"""Titles that end within a character reference, or hold one that the SQL leaves, against the SQL."""

import duckdb
import pytest
from test_catalogue import shown

from docketlake.plans import catalogue
from docketlake.sources import html as H

TITLES = ["the&amp;&amp;&amp", "as &quot;said&quot; &am", "a &amp;quot; &quo", "b & c &lt x", "plain"]


@pytest.fixture(scope="module")
def odd_pages(spark, sf_dir, tmp_path_factory):
    import re

    folder = str(tmp_path_factory.mktemp("pages"))
    rows = [(r["page_id"], r["url"], re.sub(r"(?s)<(h1|title)>.*?</\1>", lambda m, t=TITLES[i % len(TITLES)]: f"<{m[1]}>{t}</{m[1]}>", r["html"])) for i, r in enumerate(spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20).collect())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["page_contents", "page_strategies", "page_texts"])
def test_matches_sql(spark, odd_pages, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{odd_pages}/pages.parquet/*.parquet'")
    ours, sql = catalogue.QUERIES[name](spark, odd_pages).toPandas(), c.sql(catalogue.ORACLE_SQL[name]).df()
    assert len(ours) == 20 and shown(ours) == shown(sql)


def test_only_references():
    html = "<p>a &amp;&amp b &lt; &quot;</p><script>x && y &amp</script>"
    assert H.parse_page(html)["body_text"] == 'a && b < "'
    assert H.parse_page(html, ("amp",))["body_text"] == "a &&amp b &lt; &quot;"
    assert H.parse_page(html, ("amp",))["inline_script_chars"] == H.parse_page(html)["inline_script_chars"] == len("x && y &amp")
