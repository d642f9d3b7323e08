"""Every registered query that SQL can state, against DuckDB on the smallest data; the others for rows and stable schemas."""

import glob
import os
from urllib.parse import urljoin

import duckdb
import pytest

from chainloom.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 5) + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), list(want.columns))
    else:
        assert rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
def test_no_page_or_url_is_left_out(spark):
    pages = {r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").where("url is not null").select("page_id").collect()}
    assert {r.a for r in QUERIES["url_key_match"](spark, SF).collect()} == pages


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
def test_crawled_tables_are_not_broadcast(spark):
    df = QUERIES["crawl_chain_graph"](spark, SF)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_link_is_resolved(spark, tmp_path):
    hrefs = ["/plain", "/caf\u00e9", "rel/x.html", "../up", "./here/../there", "//other.org/a", "https://abs.net/z?q=1#f", "?only=query", "#frag", "/ends.", "../../../too/far", ""]
    urls = ["http://example.com/a/b/c.html?x=1", "https://h.org/"]
    rows = [(i, u, "<html><body>" + "".join(f'<a href="{h}">t</a>' for h in hrefs) + "<a>none</a></body></html>") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.href, r.target) for r in QUERIES["resolved_links"](spark, str(tmp_path)).collect())
    assert got == sorted((i, h, urljoin(u, h)) for i, u in enumerate(urls) for h in hrefs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
