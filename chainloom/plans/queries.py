"""The engine's queries over the supplied tables, each with the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions import urls as U
from chainloom.functions.geometry import covers_view, intersection, rect
from chainloom.functions.suffix import with_suffix
from chainloom.operators import chaingraph, hmg, initiators, ml, requests, tags, tree
from chainloom.sources import adapters, logs
from chainloom.sources.adapters import CHAIN_STEPS_SQL, EVENT_LOG_SQL, HMG_SQL, REQUESTS_SQL, SHAPE_SQL, TREE_SQL, table
from chainloom.sources.scratch import discard, large, materialize
from chainloom.sources.tables import last_of_key
from chainloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RFC = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in columns])


# ---- chains of line items


@query(CHAIN_STEPS_SQL + """
SELECT rule, count(DISTINCT sample_id) AS n_chains, CAST(max(n) AS BIGINT) AS max_len, CAST(min(n) AS BIGINT) AS min_len, CAST(max(CASE WHEN url = previous THEN 1 ELSE 0 END) AS BIGINT) AS self_loop
FROM (SELECT *, lag(url) OVER (PARTITION BY sample_id ORDER BY pos) AS previous FROM steps) GROUP BY rule""")  # fmt: skip
def chain_graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = adapters.chain_steps(spark, sf_dir).withColumn("label", F.lit(0))
    out = chaingraph.chain_counts(steps).join(chaingraph.step_flags(steps), ["rule", "label"])
    return out.select("rule", "n_chains", F.col("max_len").cast("long").alias("max_len"), F.col("min_len").cast("long").alias("min_len"), F.col("self_loop").cast("long").alias("self_loop"))


@query(CHAIN_STEPS_SQL + """
, passed AS (SELECT DISTINCT rule, label, sample_id, url FROM steps), most AS (
  SELECT rule, label, max(c) AS most FROM (SELECT rule, label, url, count(*) AS c FROM passed WHERE url <> rule GROUP BY ALL) GROUP BY ALL
), n AS (SELECT rule, label, count(DISTINCT sample_id) AS n FROM steps GROUP BY ALL)
SELECT rule, label, CASE WHEN n >= 5 THEN round(coalesce(most, 0) / n, 6) END AS top_share FROM n LEFT JOIN most USING (rule, label)""")  # fmt: skip
def chain_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaingraph.hubs(adapters.chain_steps(spark, sf_dir)).select("rule", "label", F.round("top_share", 6).alias("top_share"))


@query(CHAIN_STEPS_SQL + """
SELECT rule, label, CAST(max(CASE WHEN domain = previous THEN 1 ELSE 0 END) AS BIGINT) AS intra_domain
FROM (SELECT *, lag(domain) OVER (PARTITION BY sample_id ORDER BY pos) AS previous FROM steps) GROUP BY rule, label""")  # fmt: skip
def chain_intra_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaingraph.step_flags(adapters.chain_steps(spark, sf_dir)).select("rule", "label", F.col("intra_domain").cast("long").alias("intra_domain"))


@query(CHAIN_STEPS_SQL + """
, seen AS (SELECT rule, url, min(struct_pack(a := sample_id, b := pos)) AS first FROM steps GROUP BY rule, url)
SELECT rule, url, row_number() OVER (PARTITION BY rule ORDER BY first) - 1 AS vertex FROM seen""")  # fmt: skip
def chain_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaingraph.vertices(adapters.chain_steps(spark, sf_dir), "sample_id").select("rule", "url", F.col("vertex").cast("long").alias("vertex"))


@query(CHAIN_STEPS_SQL + "SELECT DISTINCT rule, previous AS src, url AS dst FROM (SELECT *, lag(url) OVER (PARTITION BY sample_id ORDER BY pos) AS previous FROM steps) WHERE previous IS NOT NULL")
def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaingraph.edges(adapters.chain_steps(spark, sf_dir))


def _ratios_sql(which: str) -> str:
    return (
        CHAIN_STEPS_SQL
        + f"""
, ends AS (SELECT DISTINCT rule, label, url, params, tld FROM steps WHERE {which}), n AS (SELECT rule, label, count(DISTINCT sample_id) AS n FROM steps GROUP BY ALL)
SELECT rule, label, round(count(*) / any_value(n), 6) AS f1, round(count(DISTINCT CASE WHEN params <> '' THEN params END) / any_value(n), 6) AS f2,
       round(sum(CASE WHEN params <> '' THEN 1 ELSE 0 END) / any_value(n), 6) AS f3
FROM ends JOIN n USING (rule, label) GROUP BY rule, label"""
    )


def _ratios(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    steps = adapters.chain_steps(spark, sf_dir)
    out = chaingraph.end_ratios(steps, first).join(chaingraph.chain_counts(steps), ["rule", "label"])
    per = lambda c: F.round(F.col(c) / F.col("n_chains"), 6)
    return out.select("rule", "label", per("urls").alias("f1"), per("param_sets").alias("f2"), per("with_params").alias("f3"))


@query(_ratios_sql("pos = 0"))
def referer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir, True)


@query(_ratios_sql("pos = n - 1"))
def final_page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir, False)


@query(CHAIN_STEPS_SQL + """
, ends AS (SELECT DISTINCT rule, label, url, tld FROM steps WHERE pos = n - 1), freq AS (SELECT tld, count(*) AS f FROM ends GROUP BY tld)
SELECT rule, label, round(sum(f) / (SELECT sum(f) FROM freq), 6) AS share FROM (SELECT DISTINCT rule, label, tld FROM ends) JOIN freq USING (tld) GROUP BY rule, label""")  # fmt: skip
def tld_frequency_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaingraph.final_share(adapters.chain_steps(spark, sf_dir), "tld").select("rule", "label", F.round("share", 6).alias("share"))


@query(CHAIN_STEPS_SQL + """
, paired AS (SELECT *, lag(url) OVER w AS previous, lag(domain) OVER w AS previous_domain FROM steps WINDOW w AS (PARTITION BY sample_id ORDER BY pos)
), n AS (SELECT rule, label, count(DISTINCT sample_id) AS n_chains, max(n) AS max_len, min(n) AS min_len FROM steps GROUP BY ALL
), firsts AS (SELECT DISTINCT rule, label, url, params FROM steps WHERE pos = 0
), lasts AS (SELECT DISTINCT rule, label, url, params, tld FROM steps WHERE pos = n - 1
), r AS (SELECT rule, label, count(*) AS ru, count(DISTINCT CASE WHEN params <> '' THEN params END) AS rp, sum(CASE WHEN params <> '' THEN 1 ELSE 0 END) AS rw FROM firsts GROUP BY ALL
), f AS (SELECT rule, label, count(*) AS fu, count(DISTINCT CASE WHEN params <> '' THEN params END) AS fp, sum(CASE WHEN params <> '' THEN 1 ELSE 0 END) AS fw, max(CASE WHEN tld IS NULL THEN 1 ELSE 0 END) AS no_tld FROM lasts GROUP BY ALL
), pages_of AS (SELECT DISTINCT rule, label, url, page FROM steps WHERE pos = n - 1
), tf AS (SELECT tld, count(*) AS c FROM (SELECT DISTINCT rule, label, url, tld FROM lasts) GROUP BY tld), pf AS (SELECT page, count(*) AS c FROM pages_of GROUP BY page
), ts AS (SELECT rule, label, sum(c) / (SELECT sum(c) FROM tf) AS tld_share FROM (SELECT DISTINCT rule, label, tld FROM lasts) JOIN tf USING (tld) GROUP BY ALL
), ps AS (SELECT rule, label, sum(c) / (SELECT sum(c) FROM pf) AS page_share FROM (SELECT DISTINCT rule, label, page FROM pages_of) JOIN pf USING (page) GROUP BY ALL
), flags AS (SELECT rule, label, max(CASE WHEN domain = previous_domain THEN 1 ELSE 0 END) AS intra_domain, max(CASE WHEN url = previous THEN 1 ELSE 0 END) AS self_loop FROM paired GROUP BY ALL
), hub AS (SELECT rule, label, max(c) AS most FROM (SELECT rule, label, url, count(DISTINCT sample_id) AS c FROM steps WHERE url <> rule GROUP BY ALL) GROUP BY ALL)
SELECT rule, label, n_chains, round(ru / n_chains, 9) AS referer_ratio, round(rp / n_chains, 9) AS referer_param_ratio, round(rw / n_chains, 9) AS referer_with_param_ratio, round(fu / n_chains, 9) AS final_ratio,
       round(fp / n_chains, 9) AS final_param_ratio, round(fw / n_chains, 9) AS final_with_param_ratio, round(tld_share, 9) AS tld_share, round(page_share, 9) AS page_share, CAST(no_tld AS BIGINT) AS final_is_ip, CAST(max_len AS BIGINT) AS max_len, CAST(min_len AS BIGINT) AS min_len,
       CAST(intra_domain AS BIGINT) AS intra_domain, CAST(CASE WHEN n_chains >= 5 AND coalesce(most, 0) / n_chains >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS hub_30,
       CAST(CASE WHEN n_chains >= 5 AND coalesce(most, 0) / n_chains >= 0.8 THEN 1 ELSE 0 END AS BIGINT) AS hub_80, CAST(self_loop AS BIGINT) AS self_loop
FROM n JOIN r USING (rule, label) JOIN f USING (rule, label) JOIN ts USING (rule, label) JOIN ps USING (rule, label) JOIN flags USING (rule, label) LEFT JOIN hub USING (rule, label)""")  # fmt: skip
def chain_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 features of each chain graph together."""
    f = chaingraph.features(adapters.chain_steps(spark, sf_dir))
    return f.select("rule", "label", "n_chains", *[F.round(c, 9).alias(c) if c.endswith(("_ratio", "_share")) else F.col(c).cast("long").alias(c) for c in chaingraph.FEATURES])


@query(CHAIN_STEPS_SQL + """
, e AS (SELECT DISTINCT previous AS src, url AS dst FROM (SELECT *, lag(url) OVER (PARTITION BY sample_id ORDER BY pos) AS previous FROM steps) WHERE previous IS NOT NULL)
SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node""")  # fmt: skip
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(initiators.graph_degrees(chaingraph.edges(adapters.chain_steps(spark, sf_dir))), "node", "in_degree", "out_degree", "degree")


@query("""
SELECT l_partkey AS init_url, count(*) AS freq, count(DISTINCT l_orderkey) AS n_samples, count(DISTINCT 'n' || CAST(s_nationkey AS VARCHAR) || '.com') AS n_e2lds,
       arg_min(CAST(l_linenumber AS BIGINT), l_orderkey * 1000 + l_linenumber) AS type
FROM (SELECT l_partkey, l_orderkey, l_linenumber, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY l_partkey""")  # fmt: skip
def initiator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as initiators of line items; a hop's host is named by the supplier's nation."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = lines.select(
        F.col("l_partkey").alias("init_url"), F.col("l_orderkey").alias("sample_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("http://w.n"), F.col("s_nationkey").cast("string"), F.lit(".com/"), F.col("l_suppkey").cast("string")).alias("hop_url"), F.col("l_linenumber").cast("long").alias("init_type"),
    )
    return initiators.initiator_summary(rows)


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F') GROUP BY o_custkey")
def entries_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists under each other; of each key the last row counts."""
    o = table(spark, sf_dir, "orders")
    both = o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus <> 'F'"))
    return last_of_key(both, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


# ---- urls of pages


@query(f"""
SELECT page_id, lower(regexp_extract(url, '{RFC}', 2)) AS scheme, regexp_extract(url, '{RFC}', 4) AS netloc, regexp_extract(url, '{RFC}', 5) AS path, regexp_extract(url, '{RFC}', 7) AS query, regexp_extract(url, '{RFC}', 9) AS fragment
FROM pages""")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query(f"""
SELECT page_id, array_to_string(list_transform(string_split(q, '&'), lambda p: split_part(p, '=', 1)), ';') AS params, CAST(len(string_split(q, '&')) AS BIGINT) AS n_params, CAST(length(q) AS BIGINT) AS query_len,
       CAST(length(url) AS BIGINT) AS url_len, CAST(length(path) - length(replace(path, '/', '')) AS BIGINT) AS depth
FROM (SELECT page_id, url, regexp_extract(url, '{RFC}', 7) AS q, regexp_extract(url, '{RFC}', 5) AS path FROM pages)""")  # fmt: skip
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.url_query(F.col("url")).alias("q"), U.url_path(F.col("url")).alias("path"))
    long = lambda c: c.cast("long")
    return p.select("page_id", U.parameter_names(F.col("q")).alias("params"), long(U.parameter_count(F.col("q"))).alias("n_params"), long(F.length("q")).alias("query_len"), long(F.length("url")).alias("url_len"), long(U.path_depth(F.col("path"))).alias("depth"))


@query(f"SELECT page_id, list_extract(string_split(regexp_extract(url, '{RFC}', 5), '/'), -1) AS filename, split_part(url, '#', 1) AS plain, substr(url, length(split_part(url, '#', 1)) + 1) AS fragment FROM pages")
def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.file_name(U.url_path(url)).alias("filename"), U.without_fragment(url).alias("plain"), U.fragment_with_mark(url).alias("fragment"))


@query("SELECT a.page_id AS a, b.page_id AS b FROM pages a JOIN pages b ON lower(a.url) = lower(upper(b.url))")
def url_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found again by an upper-cased and percent-encoded spelling of their url: an equi-join of all pages with all pages."""
    p = table(spark, sf_dir, "pages")
    left = p.select(F.col("page_id").alias("a"), U.url_key(F.col("url")).alias("key"))
    right = p.select(F.col("page_id").alias("b"), U.url_key(U.percent_encode(F.upper("url"), ":/?&=#")).alias("key"))
    return left.join(right, "key").select("a", "b")


@query("SELECT page_id, url FROM pages")
def valid_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls, which are their own canonical spelling, also when they come with a default port and a doubled escape."""
    ported = F.replace(F.regexp_replace("url", "^(http://[^/]+)/", "$1:80/"), F.lit("&"), F.lit("&amp;"))
    return table(spark, sf_dir, "pages").select("page_id", U.valid_url(ported).alias("url"))


@query("""
SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages)""")  # fmt: skip
def valid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical spelling of every link's target; many have letters that must be encoded."""
    return _links(spark, sf_dir).select("page_id", U.valid_url(U.url_join(F.col("url"), F.col("href"))).alias("url"))


@query(rf"""
SELECT e2ld, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(host, '[.](com|net|org)$') THEN regexp_extract(host, '([^.]+[.](com|net|org))$', 1) END AS e2ld FROM (SELECT regexp_extract(url, '{RFC}', 4) AS host FROM pages)) GROUP BY e2ld""")
def e2ld_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(U.url_netloc(F.col("url")).alias("host"))
    return with_suffix(hosts, "host").groupBy("e2ld").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) AS BIGINT) AS n_links FROM pages")
def page_anchor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    links = tags.of_type(tags.page_tags(pages), "a").groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(links, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_links"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.of_type(tags.page_tags(table(spark, sf_dir, "pages").select("page_id", "html")), "a").select("page_id", F.col("attributes")["href"].alias("href"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags.of_type(tags.page_tags(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "a")
    return found.select("page_id", "url", F.col("attributes")["href"].alias("href")).where(F.col("href").isNotNull())


@query("""
SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]*)', 1) || href END AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages)""")  # fmt: skip
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page; those of the pages begin with a slash, other forms are tested by url_join's cases."""
    return _links(spark, sf_dir).select("page_id", "href", U.url_join(F.col("url"), F.col("href")).alias("target"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(1664, x + w) - greatest(0, x)) * greatest(0, least(919, y + h) - greatest(0, y)), 4) AS area,
       greatest(0, least(1664, x + w) - greatest(0, x)) * greatest(0, least(919, y + h) - greatest(0, y)) >= 0.4 * 1664 * 919 AS large
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 700 - 100 AS DOUBLE) AS x, CAST(l_suppkey % 500 - 50 AS DOUBLE) AS y, l_quantity * 40 AS w, l_quantity * 25 AS h FROM lineitem)""")  # fmt: skip
def rect_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rect(F.col("l_partkey") % 700 - 100, F.col("l_suppkey") % 500 - 50, F.col("l_quantity") * 40, F.col("l_quantity") * 25)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("r"))
    common = intersection(rect(0, 0, 1664, 919), F.col("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(common["width"] * common["height"], 4).alias("area"), covers_view(F.col("r")).alias("large"))


# ---- logs of events


@query(EVENT_LOG_SQL + "SELECT sample_id, seq, kind, url FROM log WHERE seq >= first_view")
def log_start_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.from_start(adapters.browser_events(adapters.event_log(spark, sf_dir))).select("sample_id", "seq", "kind", "url")


@query(EVENT_LOG_SQL + "SELECT kind, count(*) AS n FROM log WHERE seq >= first_view AND kind IN ('view', 'signup', 'purchase') GROUP BY kind")
def log_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, jumps to anchors and downloads, by the methods' numbers."""
    started = requests.from_start(adapters.browser_events(adapters.event_log(spark, sf_dir)))
    return requests.of_methods(started, [requests.METHODS.index(m) for m in (requests.SENT, requests.ANCHOR, requests.DOWNLOAD)]).groupBy("kind").agg(F.count("*").alias("n"))


@query(EVENT_LOG_SQL + """
, walk AS (
  SELECT sample_id, k, seq, kind, sum(CASE WHEN kind = 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY sample_id, k ORDER BY seq) AS s FROM log WHERE kind IN ('view', 'error')
), height AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY sample_id, k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM walk
), failed AS (
  SELECT *, coalesce(lag(h) OVER (PARTITION BY sample_id, k ORDER BY seq), 0) AS h0 FROM height
)
SELECT f.sample_id, f.k, max(r.seq) AS request_seq, f.seq AS failure_seq
FROM failed f JOIN height r ON r.sample_id = f.sample_id AND r.k = f.k AND r.seq < f.seq AND r.kind = 'view' AND r.h = f.h0
WHERE f.kind = 'error' AND f.h0 > 0 GROUP BY f.sample_id, f.k, f.seq""")  # fmt: skip
def failed_load_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.event_log(spark, sf_dir).withColumn("sent", F.col("kind") == "view").withColumn("failed", F.col("kind") == "error")
    return requests.failed_requests(log, ["sample_id", "k"], "seq", "sent", "failed")


@query(REQUESTS_SQL + "SELECT sample_id, seq, url, parent_url FROM requests")
def frame_asof_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_requests(adapters.event_log(spark, sf_dir)).select("sample_id", "seq", "url", "parent_url")


@query(EVENT_LOG_SQL + """
SELECT d.sample_id, d.seq, d.url, max(v.seq) AS match_seq FROM log d JOIN log v ON v.sample_id = d.sample_id AND v.url = d.url AND v.kind = 'view' AND v.seq < d.seq
WHERE d.kind = 'purchase' GROUP BY d.sample_id, d.seq, d.url""")  # fmt: skip
def download_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.event_log(spark, sf_dir)
    return requests.backward_matches(log, ["sample_id", "url"], "seq", F.col("kind") == "view", F.col("kind") == "purchase").select("sample_id", "seq", "url", "match_seq")


@query(EVENT_LOG_SQL + """
SELECT n.sample_id, n.seq AS nav_seq, r.seq AS request_seq FROM log n JOIN log r ON n.sample_id = r.sample_id AND n.url = r.url AND abs(n.ts_ms - r.ts_ms) < 43200000
WHERE n.kind = 'click' AND r.kind = 'view' QUALIFY row_number() OVER (PARTITION BY n.sample_id, n.seq ORDER BY abs(n.ts_ms - r.ts_ms), r.seq) = 1""")  # fmt: skip
def navigation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest request of each navigation within half a day."""
    log = adapters.event_log(spark, sf_dir)
    nav = log.where("kind = 'click'").select("sample_id", "url", F.col("seq").alias("nav_seq"), F.col("ts_ms").alias("nav_ts"))
    req = log.where("kind = 'view'").select("sample_id", "url", F.col("seq").alias("request_seq"), F.col("ts_ms").alias("request_ts"))
    pairs = requests.band_matches(nav, req, ["sample_id", "url"], "nav_ts", "request_ts", 43_200_000)
    w = Window.partitionBy("sample_id", "nav_seq").orderBy(F.abs(F.col("nav_ts") - F.col("request_ts")), "request_seq")
    return pairs.withColumn("place", F.row_number().over(w)).where("place = 1").select("sample_id", "nav_seq", "request_seq")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of the event log's requests, with whole urls and the events' kinds."""
    t = tree.build_trees(adapters.document_requests(adapters.event_requests(adapters.event_log(spark, sf_dir))))
    return t.select(
        F.col("sample_id").cast("long").alias("sample_id"), F.col("node_seq").cast("long").alias("node_seq"), F.col("parent_seq").cast("long").alias("parent_seq"), F.concat("url", "url_fragment").alias("url"),
        F.lit("").alias("url_fragment"), F.when(F.col("resource_type") == "Document", "view").otherwise("signup").alias("kind"), F.col("ts").alias("ts_ms"), "depth", F.col("path").cast("array<bigint>").alias("path"), "path_ord",
    )


@query(TREE_SQL + "SELECT sample_id, node_seq, parent_seq, CAST(depth AS BIGINT) AS depth, array_to_string(path, '/') AS path FROM tree")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return t.select("sample_id", "node_seq", "parent_seq", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(TREE_SQL + "SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM tree GROUP BY depth")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query(TREE_SQL + "SELECT sample_id, node_seq FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.sample_id = t.sample_id AND c.parent_seq = t.node_seq)")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves(_tree(spark, sf_dir)).select("sample_id", "node_seq")


@query(TREE_SQL + "SELECT a.sample_id, a.node_seq, CAST(max(d.depth) - any_value(a.depth) + 1 AS BIGINT) AS height FROM tree a JOIN tree d ON a.sample_id = d.sample_id AND list_contains(d.path, a.node_seq) GROUP BY a.sample_id, a.node_seq")
def tree_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.heights(_tree(spark, sf_dir)).select("sample_id", "node_seq", F.col("height").cast("long").alias("height"))


@query(TREE_SQL + "SELECT sample_id, node_seq, row_number() OVER (PARTITION BY sample_id ORDER BY depth, path_ord) - 1 AS bfs_id, row_number() OVER (PARTITION BY sample_id ORDER BY path_ord) - 1 AS dfs_id FROM tree")
def tree_bfs_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(tree.dfs(tree.bfs(_tree(spark, sf_dir))), "sample_id", "node_seq", "bfs_id", "dfs_id")


@query(TREE_SQL + """
, ends AS (SELECT sample_id, max(node_seq) AS end_seq FROM tree GROUP BY sample_id)
SELECT e.sample_id, e.end_seq, unnest(range(0, len(t.path))) AS at, unnest(t.path) AS node_seq FROM ends e JOIN tree t ON t.sample_id = e.sample_id AND t.node_seq = e.end_seq""")  # fmt: skip
def chain_intermediaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = materialize(_tree(spark, sf_dir), "event-trees")
    ends = t.groupBy("sample_id").agg(F.max("node_seq").alias("end_seq"))
    return counted(tree.intermediaries(t, ends), "sample_id", "end_seq", "at", "node_seq")


@query(TREE_SQL + """
, asked AS (SELECT sample_id, node_seq AS base_seq, ts_ms AS base_ts, split_part(url, '#', 1) AS want FROM tree WHERE kind = 'signup'), hits AS (
  SELECT a.sample_id, a.base_seq, t.node_seq AS init_seq, t.ts_ms, a.base_ts, list_transform(t.path_ord, lambda x: -x) AS visit
  FROM asked a JOIN tree t ON t.sample_id = a.sample_id AND split_part(t.url, '#', 1) = a.want AND t.ts_ms <= a.base_ts
), met AS (SELECT *, row_number() OVER (PARTITION BY sample_id, base_seq ORDER BY visit) AS met FROM hits)
SELECT sample_id, base_seq, init_seq FROM met
QUALIFY row_number() OVER (PARTITION BY sample_id, base_seq ORDER BY CASE WHEN met = 1 AND init_seq = base_seq THEN 0 ELSE 1 END, CASE WHEN init_seq = base_seq THEN 1 ELSE 0 END, ts_ms DESC, visit) = 1""")  # fmt: skip
def initiator_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = materialize(_tree(spark, sf_dir), "event-trees")
    plain = t.withColumn("url", U.without_fragment(F.col("url"))).withColumn("ts", F.col("ts_ms")).withColumn("resource_type", F.col("kind"))
    asked = plain.where("kind = 'signup'").select("sample_id", F.col("node_seq").alias("base_seq"), F.col("ts").alias("base_ts"), F.col("url").alias("initiator_url"))
    return tree.nearest_initiator(plain, asked).select("sample_id", "base_seq", "init_seq")


@query(TREE_SQL + """
SELECT sample_id, node_seq FROM tree QUALIFY row_number() OVER (PARTITION BY sample_id, url ORDER BY path_ord) = 1""")  # fmt: skip
def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First depth-first node of every distinct url of a tree, asked for in capitals."""
    t = _tree(spark, sf_dir)
    return tree.search_node(t, t.select("sample_id", F.upper("url").alias("wanted_url")).distinct()).select("sample_id", "node_seq")


# ---- message graphs of events


@query(HMG_SQL + "SELECT sample_id, sn, url, referer, host, method, location, CAST(status AS BIGINT) AS status FROM hmg_nodes")
def hmg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return n.select("sample_id", F.col("sn").cast("long").alias("sn"), "url", "referer", "host", "method", "location", F.col("status").cast("long").alias("status"))


@query(HMG_SQL + "SELECT sample_id, src, dst, edge_type FROM hmg_edges")
def hmg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = hmg.edges(hmg.nodes(adapters.event_messages(spark, sf_dir)))
    return e.select("sample_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "edge_type")


@query(HMG_SQL + """
SELECT sample_id, count(*) AS node_cnt, round(avg(CASE WHEN status // 10 = 40 THEN 1.0 ELSE 0.0 END), 6) AS status_40x_ratio, round(avg(CASE WHEN referer IS NOT NULL AND referer <> '' THEN 1.0 ELSE 0.0 END), 6) AS referer_ratio,
       0.0::DOUBLE AS ip_ratio, round(avg(CASE WHEN method = 'POST' THEN 1.0 ELSE 0.0 END), 6) AS post_ratio
FROM hmg_nodes GROUP BY sample_id""")  # fmt: skip
def hmg_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = hmg.node_features(hmg.nodes(adapters.event_messages(spark, sf_dir)))
    return f.select("sample_id", "node_cnt", *[F.round(c, 6).alias(c) for c in ("status_40x_ratio", "referer_ratio", "ip_ratio", "post_ratio")])


@query(HMG_SQL + """
, moved AS (SELECT sample_id, src, dst FROM hmg_edges WHERE edge_type = 'location'), walk AS (
  SELECT sample_id, src, dst AS at, 2 AS n FROM moved UNION ALL SELECT w.sample_id, w.src, m.dst, w.n + 1 FROM walk w JOIN moved m ON m.sample_id = w.sample_id AND m.src = w.at
), counts AS (
  SELECT m.sample_id, count(*) AS redirect_cnt, CAST(sum(CASE WHEN a.host <> b.host THEN 1 ELSE 0 END) AS BIGINT) AS cross_domain_cnt
  FROM moved m JOIN hmg_nodes a ON a.sample_id = m.sample_id AND a.sn = m.src JOIN hmg_nodes b ON b.sample_id = m.sample_id AND b.sn = m.dst GROUP BY m.sample_id
)
SELECT s.sample_id, coalesce(redirect_cnt, 0) AS redirect_cnt, coalesce(cross_domain_cnt, 0) AS cross_domain_cnt, CAST(coalesce(longest, 0) AS BIGINT) AS max_path_len
FROM (SELECT DISTINCT sample_id FROM hmg_nodes) s LEFT JOIN counts USING (sample_id) LEFT JOIN (SELECT sample_id, max(n) AS longest FROM walk GROUP BY sample_id) USING (sample_id)""")  # fmt: skip
def hmg_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return counted(hmg.redirect_features(n, hmg.edges(n)), "sample_id", "redirect_cnt", "cross_domain_cnt", "max_path_len")


@query(HMG_SQL + "SELECT sample_id, sn FROM hmg_nodes n WHERE NOT EXISTS (SELECT 1 FROM hmg_edges e WHERE e.sample_id = n.sample_id AND (e.src = n.sn OR e.dst = n.sn))")
def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return counted(hmg.isolates(n, hmg.edges(n)), "sample_id", "sn")


@query(HMG_SQL + """
, pairs AS (SELECT DISTINCT sample_id, src, dst FROM hmg_edges UNION SELECT DISTINCT sample_id, dst, src FROM hmg_edges), reach AS (
  SELECT sample_id, sn AS a, sn AS b FROM hmg_nodes UNION SELECT r.sample_id, r.a, e.dst FROM reach r JOIN pairs e ON e.sample_id = r.sample_id AND e.src = r.b
), part AS (SELECT sample_id, a, min(b) AS low FROM reach GROUP BY sample_id, a)
SELECT sample_id, count(DISTINCT low) AS component_cnt FROM part GROUP BY sample_id""")  # fmt: skip
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return counted(hmg.shapes(n, hmg.edges(n)), "sample_id", "component_cnt")


@query(HMG_SQL + """
, walk AS (
  SELECT sample_id, sn AS at_sn, 0 AS n FROM hmg_nodes UNION SELECT w.sample_id, e.dst, w.n + 1 FROM walk w JOIN hmg_edges e ON e.sample_id = w.sample_id AND e.src = w.at_sn
)
SELECT sample_id, CAST(max(n) AS BIGINT) AS longest_path_len FROM walk GROUP BY sample_id""")  # fmt: skip
def longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return counted(hmg.shapes(n, hmg.edges(n)), "sample_id", "longest_path_len")


@query(SHAPE_SQL + "SELECT sample_id, mpr_node_sn, round(mpr_node_pr, 6) AS mpr_node_pr FROM shape")
def pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return hmg.shapes(n, hmg.edges(n)).select("sample_id", "mpr_node_sn", F.round("mpr_node_pr", 6).alias("mpr_node_pr"))


@query(SHAPE_SQL + "SELECT sample_id, mdc_node_sn, round(mdc_closeness, 6) AS mdc_closeness, round(max_betweenness, 6) AS max_betweenness, nonzero_betweenness_cnt FROM shape")
def betweenness_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return hmg.shapes(n, hmg.edges(n)).select("sample_id", "mdc_node_sn", F.round("mdc_closeness", 6).alias("mdc_closeness"), F.round("max_betweenness", 6).alias("max_betweenness"), "nonzero_betweenness_cnt")


@query(HMG_SQL + """
, once AS (SELECT DISTINCT sample_id, src, dst FROM hmg_edges), ends AS (SELECT sample_id, src AS sn FROM once UNION ALL SELECT sample_id, dst FROM once), degree AS (
  SELECT n.sample_id, n.sn, count(e.sn) AS d, count(*) OVER (PARTITION BY n.sample_id) AS size FROM hmg_nodes n LEFT JOIN ends e ON e.sample_id = n.sample_id AND e.sn = n.sn GROUP BY n.sample_id, n.sn
)
SELECT sample_id, sn AS mdc_node_sn, round(d / (size - 1), 6) AS mdc_node_dc FROM degree WHERE size > 1 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d DESC, sn) = 1""")  # fmt: skip
def degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hmg.nodes(adapters.event_messages(spark, sf_dir))
    return hmg.shapes(n, hmg.edges(n)).select("sample_id", "mdc_node_sn", F.round("mdc_node_dc", 6).alias("mdc_node_dc"))


@query(SHAPE_SQL + """
, moved AS (SELECT sample_id, src, dst FROM hmg_edges WHERE edge_type = 'location'), steps AS (
  SELECT sample_id, src, dst AS at, 2 AS n FROM moved UNION ALL SELECT w.sample_id, w.src, m.dst, w.n + 1 FROM steps w JOIN moved m ON m.sample_id = w.sample_id AND m.src = w.at
), redirects AS (
  SELECT m.sample_id, count(*) AS redirect_cnt, sum(CASE WHEN a.host <> b.host THEN 1 ELSE 0 END) AS cross_domain_cnt
  FROM moved m JOIN hmg_nodes a ON a.sample_id = m.sample_id AND a.sn = m.src JOIN hmg_nodes b ON b.sample_id = m.sample_id AND b.sn = m.dst GROUP BY m.sample_id
), longest AS (SELECT sample_id, max(n) AS n FROM steps GROUP BY 1
), told AS (
  SELECT sample_id, avg(CASE WHEN status // 10 = 40 THEN 1.0 ELSE 0.0 END) AS s40, avg(CASE WHEN coalesce(referer, '') <> '' THEN 1.0 ELSE 0.0 END) AS ref, avg(CASE WHEN method = 'POST' THEN 1.0 ELSE 0.0 END) AS post FROM hmg_nodes GROUP BY 1
), same AS (
  SELECT s.sample_id, p.url, (SELECT count(*) FROM hmg_nodes x WHERE x.sample_id = s.sample_id AND x.host = p.host) - 1 AS of_pr, (SELECT count(*) FROM hmg_nodes x WHERE x.sample_id = s.sample_id AND x.host = d.host) - 1 AS of_dc
  FROM shape s JOIN hmg_nodes p ON p.sample_id = s.sample_id AND p.sn = s.mpr_node_sn JOIN hmg_nodes d ON d.sample_id = s.sample_id AND d.sn = s.mdc_node_sn
), f AS (
  SELECT sample_id, size AS node_cnt, s40 AS status_40x_ratio, ref AS referer_ratio, 0 AS ip_ratio, post AS post_ratio, coalesce(redirect_cnt, 0) AS redirect_cnt, coalesce(cross_domain_cnt, 0) AS cross_domain_cnt, coalesce(longest.n, 0) AS max_path_len,
         longest_path_len, component_cnt, isolate_ratio, mpr_node_sn, of_pr / (size - 1) AS same_pr_domain_ratio, length(url) AS mpr_url_len, length(url) - length(replace(url, '/', '')) - 2 AS mpr_url_path_depth, 0 AS mpr_url_query_len, 1 AS mpr_url_query_cnt,
         mpr_node_pr, mdc_node_dc, mdc_node_sn, of_dc / (size - 1) AS same_dc_domain_ratio, mdc_closeness, max_betweenness, nonzero_betweenness_cnt
  FROM shape JOIN told USING (sample_id) JOIN same USING (sample_id) LEFT JOIN redirects USING (sample_id) LEFT JOIN longest USING (sample_id) WHERE size > 1
)
SELECT sample_id, round(CAST(COLUMNS(* EXCLUDE sample_id) AS DOUBLE), 6) FROM f""")  # fmt: skip
def hmg_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 message-graph features of each sample."""
    f = hmg.features(hmg.nodes(adapters.event_messages(spark, sf_dir)))
    return f.select("sample_id", *[F.round(c, 6).alias(c) for c in f.columns[1:]])


@query()
def rf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that tells chain graphs of finished orders from others by their features."""
    f = chaingraph.features(adapters.chain_steps(spark, sf_dir)).withColumn("sample", F.concat_ws(":", "rule", "label"))
    return ml.evaluate(f, chaingraph.FEATURES, trees=20, depth=5).select("n_train", "n_test", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"))


@query("""
WITH s AS (SELECT CAST(l_quantity AS BIGINT) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem), g AS (
  SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score
)
SELECT CAST(score AS DOUBLE) AS threshold, round(sum(n) OVER w / sum(n) OVER (), 6) AS fp, round(sum(p) OVER w / sum(p) OVER (), 6) AS tp FROM g WINDOW w AS (ORDER BY score DESC)
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")  # fmt: skip
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").cast("double").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return ml.roc(rows).select("threshold", F.round("fp", 6).alias("fp"), F.round("tp", 6).alias("tp"))


# ---- windows of events


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "1 day", "event_type").select(F.col("window.start").alias("start"), "event_type", "n")


@query("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")  # fmt: skip
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "1 day", "user_id").select("user_id", F.col("session_window.start").alias("start"), "n")


# ---- logs as a crawler leaves them, made of events


def _crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, requests, trees and end urls of printed log lines; the whole way from text to trees, each made once."""
    log = event_lines(spark, sf_dir)
    read = materialize(logs.events(log, F.col("domain")), "log-events")  # the filters read events twice
    parsed = large(materialize(requests.target_events(read), "target-events"))
    discard(read)
    asked = large(materialize(requests.resolve_parents(parsed), "requests"))
    trees = large(materialize(tree.build_trees(asked), "trees"))
    ends = asked.where("resource_type = 'Document'").groupBy("sample_id").agg(F.max_by("request_url", "seq").alias("end_url"))
    return parsed, asked, trees, large(ends)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, domain, seq, line): printed dicts of browser messages, one for each event."""
    log = adapters.event_log(spark, sf_dir)
    url = F.concat("url", F.lit("/"))
    text = lambda c: F.to_json(c)
    frame = F.lit("f").alias("frameId")
    request = F.concat(F.lit("r"), F.col("seq").cast("string"))
    earlier = F.coalesce(F.last(F.when(F.col("kind") == "view", url), ignorenulls=True).over(adapters.before("sample_id")), F.lit(""))
    log = log.withColumn("earlier", earlier)
    calls = F.struct(F.array(F.struct(F.col("earlier").alias("url"))).alias("callFrames")).alias("stack")
    sent = F.struct(
        request.alias("requestId"), frame, F.concat(F.lit("l"), F.col("seq").cast("string")).alias("loaderId"), F.lit("Document").alias("type"), url.alias("documentURL"),
        F.struct(url.alias("url"), F.lit("GET").alias("method"), F.create_map().cast("map<string,string>").alias("headers")).alias("request"), F.struct(F.lit("script").alias("type"), calls).alias("initiator"),
    )
    params = (
        F.when(F.col("kind") == "view", text(sent)).when(F.col("kind") == "click", text(F.struct(frame, url.alias("url"), F.lit("scriptInitiated").alias("reason"))))
        .when(F.col("kind") == "error", text(F.struct(F.concat(F.lit("r"), (F.col("seq") - 1).cast("string")).alias("requestId"))))
        .when(F.col("kind") == "purchase", text(F.struct(url.alias("url")))).otherwise(text(F.struct(frame, F.concat(url, F.lit("#a")).alias("url"))))
    )
    method = F.coalesce(*[F.when(F.col("kind") == k, F.lit(m)) for k, m in adapters.MESSAGES.items()])
    domain = F.substring(F.first(F.when(F.col("kind") == "view", F.col("url")), ignorenulls=True).over(Window.partitionBy("sample_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 8, 1000)
    line = F.concat(F.lit("{'level': 'INFO', 'message': '{\"message\": {\"method\": \""), method, F.lit("\", \"params\": "), params, F.lit("}}', 'timestamp': "), F.col("ts_ms").cast("string"), F.lit("}"))
    return log.select(F.col("sample_id").cast("string").alias("folder"), domain.alias("domain"), "seq", line.alias("line"))


#: What the printed logs say: a view that the next event fails is gone, and with the first view all of its sample; everything happens in one
#: frame, so a request's parent is the one before it; the last request of a url before a download is that download. No navigation is
#: within 20 ms of a request of its url in these tables.
CRAWL_SQL = (
    EVENT_LOG_SQL
    + """
, followed AS (
  SELECT *, lead(kind) OVER (PARTITION BY sample_id ORDER BY seq) AS next_kind FROM log WHERE seq >= first_view
), kept AS (
  SELECT *, min(seq) OVER (PARTITION BY sample_id) AS least FROM followed WHERE NOT (kind = 'view' AND coalesce(next_kind, '') = 'error')
), marked AS (
  SELECT *, CASE WHEN kind = 'signup' THEN url || '/#a' ELSE url || '/' END AS request_url FROM kept WHERE kind IN ('view', 'signup', 'purchase')
    AND sample_id IN (SELECT sample_id FROM kept WHERE seq = first_view)
), asked AS (
  SELECT *, lead(kind) OVER (PARTITION BY sample_id, request_url ORDER BY seq) AS then_kind FROM marked
), crawled AS (
  SELECT sample_id, seq, kind, request_url, CASE WHEN coalesce(then_kind, '') = 'purchase' THEN 'Download' ELSE 'Document' END AS resource_type, ts_ms,
         coalesce(lag(request_url) OVER w, '') AS parent_url, CASE WHEN lag(request_url) OVER w IS NULL THEN 'root' WHEN kind = 'view' THEN 'script' ELSE 'navigatedWithinDocument' END AS parent_source,
         row_number() OVER w - 1 AS node
  FROM asked WHERE kind IN ('view', 'signup') WINDOW w AS (PARTITION BY sample_id ORDER BY seq)
), grown AS (
  SELECT * FROM crawled WHERE sample_id IN (SELECT sample_id FROM crawled WHERE node = 0 AND resource_type = 'Document')
), ends AS (
  SELECT sample_id, arg_max(request_url, seq) AS end_url FROM crawled WHERE resource_type = 'Document' GROUP BY sample_id
), ended AS (
  SELECT g.sample_id, min(g.node) AS end_node FROM grown g JOIN ends e ON e.sample_id = g.sample_id AND e.end_url = g.request_url GROUP BY g.sample_id
), steps AS (
  SELECT g.* FROM grown g JOIN ended e ON e.sample_id = g.sample_id AND g.node <= e.end_node
)
"""
)


@query(CRAWL_SQL + "SELECT CAST(sample_id AS VARCHAR) AS sample_id, seq, request_url, resource_type, parent_url, parent_source, ts_ms AS ts, 'f' AS frame_id FROM crawled")
def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with parents of printed logs."""
    return _crawl(spark, sf_dir)[1]


@query(CRAWL_SQL + """
SELECT CAST(s.sample_id AS VARCHAR) AS sample_id, urls, methods, hops, false AS has_iframe, d.url IS NOT NULL AS has_download, coalesce(d.url, '') AS download_url
FROM (SELECT sample_id, string_agg(request_url, ' ' ORDER BY seq) AS urls, string_agg(parent_source, ';' ORDER BY seq) AS methods, CAST(count(*) - 1 AS INTEGER) AS hops FROM steps GROUP BY sample_id) s
LEFT JOIN (SELECT sample_id, arg_max(request_url, seq) AS url FROM crawled WHERE resource_type = 'Download' GROUP BY sample_id) d USING (sample_id)""")  # fmt: skip
def crawl_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from the start to the last document of printed logs."""
    _, asked, trees, ends = _crawl(spark, sf_dir)
    return initiators.chains(trees, asked, ends).select("sample_id", F.array_join("urls", " ").alias("urls"), F.array_join("methods", ";").alias("methods"), "hops", "has_iframe", "has_download", "download_url")


INITIATORS_SQL = (
    CRAWL_SQL
    + """
, calls AS (
  SELECT sample_id, seq, last_value(CASE WHEN kind = 'view' THEN url || '/' END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caller FROM log
), hops AS (
  SELECT s.*, c.caller FROM steps s JOIN calls c ON c.sample_id = s.sample_id AND c.seq = s.seq WHERE s.node > 0 AND s.parent_source = 'script' AND s.resource_type = 'Document'
), hits AS (
  SELECT h.sample_id, h.node AS base, h.request_url AS hop_url, h.resource_type AS hop_type, h.ts_ms AS hop_ts, g.node, CASE WHEN g.node = 0 THEN g.request_url ELSE split_part(g.request_url, '#', 1) END AS init_url, g.resource_type AS init_type, g.ts_ms AS init_ts
  FROM hops h JOIN grown g ON g.sample_id = h.sample_id AND g.ts_ms <= h.ts_ms AND split_part(g.request_url, '#', 1) = h.caller
), met AS (SELECT *, row_number() OVER (PARTITION BY sample_id, base ORDER BY node) AS place FROM hits
), issued AS (
  SELECT sample_id, hop_url, hop_type, hop_ts, init_url, init_type, init_ts FROM met
  QUALIFY row_number() OVER (PARTITION BY sample_id, base ORDER BY CASE WHEN place = 1 AND node = base THEN 0 ELSE 1 END, CASE WHEN node = base THEN 1 ELSE 0 END, init_ts DESC, node) = 1
)
"""
)


@query(INITIATORS_SQL + "SELECT CAST(sample_id AS VARCHAR) AS sample_id, hop_url, hop_type, hop_ts, init_url, init_type, init_ts FROM issued")
def crawl_initiators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who issued each hop of these chains."""
    parsed, _, trees, ends = _crawl(spark, sf_dir)
    return initiators.hop_initiators(trees, parsed, ends)


def _graph_sql(nodes: str) -> str:
    return (
        INITIATORS_SQL
        + f"""
, pairs AS (
  SELECT DISTINCT i.sample_id, a.node AS src, b.node AS dst FROM issued i JOIN grown a ON a.sample_id = i.sample_id AND a.request_url = i.init_url AND a.ts_ms = i.init_ts JOIN grown b ON b.sample_id = i.sample_id AND b.request_url = i.hop_url AND b.ts_ms = i.hop_ts
), e AS (SELECT sample_id, node - 1 AS src, node AS dst FROM {nodes} WHERE node > 0 UNION SELECT * FROM pairs)
SELECT CAST(sample_id AS VARCHAR) AS sample_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree
FROM (SELECT sample_id, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT sample_id, dst, 1, 0 FROM e) GROUP BY ALL"""
    )


@query(_graph_sql("grown"))
def crawl_tree_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in the graphs of whole trees, with edges from initiators to hops."""
    parsed, _, trees, ends = _crawl(spark, sf_dir)
    pairs = initiators.initiator_pairs(trees, initiators.hop_initiators(trees, parsed, ends))
    return initiators.graph_degrees(initiators.whole_tree_edges(trees, pairs)).withColumn("node", F.col("node").cast("long"))


@query(_graph_sql("steps"))
def crawl_chain_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in the graphs of chains, with edges from initiators to hops."""
    parsed, _, trees, ends = _crawl(spark, sf_dir)
    pairs = initiators.initiator_pairs(trees, initiators.hop_initiators(trees, parsed, ends))
    return initiators.graph_degrees(initiators.chain_edges(trees, ends, pairs)).withColumn("node", F.col("node").cast("long"))
