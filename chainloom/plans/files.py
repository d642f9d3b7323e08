"""Queries over files: what the sinks write is read back by the sources, and compared with the tables it was made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions import urls as U
from chainloom.functions.geometry import area_rect, rect
from chainloom.operators import hmg, requests, tags, tree
from chainloom.plans.queries import CRAWL_SQL, _tree, event_lines, query
from chainloom.plans.queries import hmg_features as all_hmg_features
from chainloom.plans.queries import roc_points as all_roc_points
from chainloom.plans.queries import ORACLES
from chainloom.sources import adapters, logs, schemas, tables
from chainloom.sources.adapters import CHAIN_STEPS_SQL, EVENT_LOG_SQL, SHAPE_SQL, TREE_SQL, table
from chainloom.sources.scratch import materialize, new_folder

#: A sample's number in the form of the time stamp that ends a folder's name.
STAMP = (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3-$4-$5-$6")


def _log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Printed logs of all samples, in a folder for each that is named by domain and stamp."""
    root = new_folder(spark, "logs")
    lines = event_lines(spark, sf_dir)
    name = F.concat(F.coalesce("domain", F.lit("none")), F.lit("_"), F.regexp_replace(F.lpad("folder", 14, "0"), *STAMP))
    logs.save_lines(lines.select(name.alias("folder"), "seq", "line"), root)
    return root


def _number(folder):
    return F.regexp_replace(F.right(folder, F.lit(19)), "-", "").cast("long")


@query(CRAWL_SQL + "SELECT CAST(sample_id AS VARCHAR) AS sample_id, seq, request_url, resource_type, parent_url, parent_source, ts_ms AS ts, 'f' AS frame_id FROM crawled")
def files_log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with parents of log files; folders tell domains. Places in files are from 0 on, numbers of events from 1."""
    parsed = logs.read_logs(spark, _log_folder(spark, sf_dir), "*.txt")
    return requests.resolve_parents(requests.target_events(parsed)).withColumn("sample_id", _number(F.col("sample_id")).cast("string")).withColumn("seq", F.col("seq") + 1)


@query(EVENT_LOG_SQL + "SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY seq) - 1 AS sn, url || '/' AS url, 'GET' AS method, CAST(200 AS BIGINT) AS status FROM log WHERE kind = 'view'")
def files_message_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of message graphs of log files."""
    n = hmg.nodes(hmg.messages(logs.read_logs(spark, _log_folder(spark, sf_dir), "*.txt")))
    return n.select(_number(F.col("sample_id")).alias("sample_id"), F.col("sn").cast("long").alias("sn"), "url", "method", F.col("status").cast("long").alias("status"))


@query(EVENT_LOG_SQL + "SELECT CAST(sample_id AS VARCHAR) AS sample_id, 'r' || CAST(k AS VARCHAR) AS request_id, arg_max(kind || ' of ' || url, seq) AS body, arg_max(ts_ms, seq) AS ts FROM log GROUP BY sample_id, k")
def files_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last body of each request of response files."""
    root = new_folder(spark, "responses")
    log = adapters.event_log(spark, sf_dir)
    line = F.concat(F.lit("{'requestId': 'r"), F.col("k").cast("string"), F.lit("', 'body': '"), "kind", F.lit(" of "), "url", F.lit("', 'timestamp': "), F.col("ts_ms").cast("string"), F.lit("}"))
    logs.save_lines(log.select(F.col("sample_id").cast("string").alias("folder"), "seq", line.alias("line")), root)
    return logs.read_responses(spark, root, files="*.txt")


@query(EVENT_LOG_SQL + """
, boxes AS (SELECT sample_id, seq, url, CAST(k * 10 - 100 AS DOUBLE) AS x, CAST(k % 7 * 30 - 60 AS DOUBLE) AS y, CAST(k % 20 * 100 AS DOUBLE) AS w, CAST(seq % 12 * 100 AS DOUBLE) AS h, seq % 4 <> 0 AS visible FROM log)
SELECT CAST(sample_id AS VARCHAR) AS sample_id, arg_min(url, seq) AS src FROM boxes
WHERE visible AND greatest(0, least(1664, x + w) - greatest(0, x)) * greatest(0, least(919, y + h) - greatest(0, y)) >= 0.4 * 1664 * 919 GROUP BY sample_id""")  # fmt: skip
def files_large_iframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first large iframe of each sample's tag file."""
    root = new_folder(spark, "tags")
    log = adapters.event_log(spark, sf_dir)
    box = F.to_json(F.array(rect(F.col("k") * 10 - 100, F.col("k") % 7 * 30 - 60, F.col("k") % 20 * 100, F.col("seq") % 12 * 100)))
    found = log.select("sample_id", F.lit("").alias("frame_path"), F.lit("iframe").alias("tag_type"), "seq", (F.col("seq") % 4 != 0).alias("visible"), box.alias("rects"), F.concat(F.lit('<iframe src=" '), "url", F.lit('">')).alias("outer_html"))
    tables.save_tag_files(found, root)
    return tags.large_iframes(tables.read_tags(spark, root, "*.txt"))


def _chain_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Chains of finished and other orders in two entries files."""
    steps = adapters.chain_steps(spark, sf_dir)
    urls = F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"].cast("string"))
    rows = steps.groupBy("sample_id", "label").agg(urls.alias("urls"), F.count("*").alias("n")).select(
        F.concat(F.lit("d"), F.col("sample_id").cast("string")).alias("domain"), F.when(F.col("label") == 1, "malicious").otherwise("benign").alias("label"), F.lit("s").alias("source"), F.element_at("urls", -1).alias("end_url"), "urls",
        F.array_repeat(F.lit("script"), F.col("n").cast("int")).alias("methods"), (F.col("n") - 1).cast("int").alias("hops"), F.lit(False).alias("has_iframe"), F.lit(False).alias("has_download"), F.lit("").alias("download_url"),
    )
    out = {}
    for label in ("benign", "malicious"):
        out[label] = new_folder(spark, f"chains-{label}")
        tables.save_chains(rows.where(F.col("label") == label), out[label])
    return out


@query(CHAIN_STEPS_SQL + "SELECT 'd' || CAST(sample_id AS VARCHAR) || ':s' AS sample_id, CASE WHEN label = 1 THEN 'malicious' ELSE 'benign' END AS label, string_agg(CAST(url AS VARCHAR), ' ' ORDER BY pos) AS urls FROM steps GROUP BY ALL")
def files_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of entries files."""
    return tables.load_chains(spark, _chain_files(spark, sf_dir)).select("sample_id", "label", F.array_join("urls", " ").alias("urls"))


@query(CHAIN_STEPS_SQL + "SELECT CASE WHEN label = 1 THEN 'malicious' ELSE 'benign' END AS origin, count(DISTINCT sample_id) AS n, CAST(sum(CASE WHEN pos = 0 THEN n - 1 ELSE 0 END) AS BIGINT) AS hops FROM steps GROUP BY ALL")
def files_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of several files under each other, by the file they are from; all of them redirect."""
    rows = tables.with_redirects(tables.read_union(spark, _chain_files(spark, sf_dir), schemas.CHAINS))
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.sum("hops").alias("hops"))


@query("SELECT 'd' || CAST(l_orderkey AS VARCHAR) || ':s' AS sample_id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def files_initiators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initiators of an initiator file, by sample."""
    path = new_folder(spark, "initiators")
    lines = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    rows = lines.select(
        F.concat(F.lit("d"), text("l_orderkey")).alias("domain"), F.lit("benign").alias("label"), F.lit("s").alias("source"), text("l_suppkey").alias("hop_url"), F.lit("Document").alias("hop_type"), F.col("l_linenumber").cast("long").alias("hop_ts"),
        text("l_partkey").alias("init_url"), F.lit("Script").alias("init_type"), F.lit(0).cast("long").alias("init_ts"),
    )
    tables.write_tsv(rows, path)
    found = tables.load_initiators(spark, path)
    return found.select("sample_id", F.size("initiators").cast("long").alias("n"), F.aggregate("initiators", F.lit(0).cast("long"), lambda a, x: a + x["hop_ts"]).alias("total"))


def _event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.build_trees(adapters.document_requests(adapters.event_requests(adapters.event_log(spark, sf_dir))))


@query(TREE_SQL + """
, walked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY depth, path_ord) - 1 AS bfs FROM tree)
SELECT 'u' || CAST(w.sample_id AS VARCHAR) || ':s' AS sample_id, w.bfs AS node_seq, p.bfs AS parent_seq, CAST(w.depth AS BIGINT) AS depth, w.url
FROM walked w LEFT JOIN walked p ON p.sample_id = w.sample_id AND p.node_seq = w.parent_seq""")  # fmt: skip
def files_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that are recovered from node files, one file for samples with a long tree and one for others."""
    t = materialize(_event_trees(spark, sf_dir), "event-trees")
    entries = t.groupBy("sample_id").agg(F.count("*").alias("n")).select("sample_id", F.concat(F.lit("u"), "sample_id").alias("domain"), F.when(F.col("n") > 20, "malicious").otherwise("benign").alias("label"), F.lit("s").alias("source"))
    paths = {}
    for label in ("malicious", "benign"):
        paths[label] = new_folder(spark, f"nodes-{label}")
        tables.save_node_file(t, entries.where(F.col("label") == label), paths[label])
    got = tree.recover_trees(tables.load_nodes(spark, paths))
    return got.select("sample_id", F.col("node_seq").cast("long").alias("node_seq"), F.col("parent_seq").cast("long").alias("parent_seq"), F.col("depth").cast("long").alias("depth"), "url")


@query(TREE_SQL + """
SELECT sample_id, array_to_string(path_ord, '.') AS place, CASE WHEN depth = 1 THEN url ELSE repeat('--', depth - 2) || '-> ' || url || ' (Type: ' || CASE WHEN kind = 'view' THEN 'Document' ELSE 'Anchor' END || '; Method: script; Timestamp: ' || CAST(ts_ms AS VARCHAR) || ')' END AS line
FROM tree""")  # fmt: skip
def printed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as text."""
    return tables.printed_tree(_event_trees(spark, sf_dir)).select(F.col("sample_id").cast("long").alias("sample_id"), F.array_join(F.col("path_ord").cast("array<string>"), ".").alias("place"), "line")


@query(SHAPE_SQL + "SELECT CAST(sample_id AS VARCHAR) AS sample, 'benign' AS label, CAST(size AS DOUBLE) AS node_cnt, CAST(longest_path_len AS DOUBLE) AS longest_path_len, round(mpr_node_pr, 6) AS mpr_node_pr FROM shape WHERE size > 1")
def files_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature file, written and read."""
    path = new_folder(spark, "features")
    f = all_hmg_features(spark, sf_dir)
    tables.save_features(f.select(F.col("sample_id").cast("string").alias("sample"), F.lit("benign").alias("label"), *schemas.HMG_FEATURES), path)
    return tables.read_features(spark, path).select("sample", "label", "node_cnt", "longest_path_len", "mpr_node_pr")


@query(ORACLES["roc_points"])
def files_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of an ROC curve, written and read."""
    path = new_folder(spark, "roc")
    tables.save_roc(all_roc_points(spark, sf_dir), path)
    return tables.read_tsv(spark, path, schemas.ROC)


@query("""
SELECT 'c' || CAST(o_custkey AS VARCHAR) || ':c' || CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) AS sample_id, 'http://c' || CAST(o_custkey AS VARCHAR) || '/' AS start_url, 'http://o' || CAST(o_orderkey AS VARCHAR) || '/' AS end_url FROM orders""")  # fmt: skip
def files_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a manifest that is written in two pieces."""
    path = new_folder(spark, "manifest")
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    rows = o.select(
        F.concat(F.lit("c"), text("o_custkey")).alias("domain"), F.concat(F.lit("c"), text("o_custkey"), F.lit("_"), text("o_orderkey")).alias("sample_tag"), F.lit(1).cast("long").alias("start_time"), F.lit(3).cast("long").alias("end_time"), F.lit(2).cast("long").alias("cost_time"),
        U.start_url(F.concat(F.lit("c"), text("o_custkey"))).alias("start_url"), F.concat(F.lit("http://o"), text("o_orderkey"), F.lit("/")).alias("end_url"), F.col("o_orderstatus").alias("end_title"), "o_orderstatus",
    )
    for part in (rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'")):
        tables.save_manifest(part, path)
    return tables.manifest_samples(spark, path).select("sample_id", "start_url", "end_url")


@query("SELECT 'u' || CAST(user_id AS VARCHAR) AS domain, event_type || ' failed: ' || CAST(event_id AS VARCHAR) AS exception FROM events WHERE event_type = 'error'")
def files_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure list; texts of several lines are on one."""
    path = new_folder(spark, "failures")
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    tables.save_failures(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), F.concat("event_type", F.lit("\nfailed:\t"), F.col("event_id").cast("string")).alias("exception")), path)
    return tables.read_tsv(spark, path, schemas.FAILURES)


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '/near/c' || CAST(c_custkey AS VARCHAR) ELSE '/all/n' || CAST(c_nationkey AS VARCHAR) END AS path FROM customer")
def entry_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of entries: under the root that is known for their source, else under the default one."""
    entries = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("domain"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"))
    roots = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("/near").alias("root"))
    return tables.sample_paths(entries, roots, "/all").select("c_custkey", "path")


@query("""
SELECT s_suppkey, unnest([
  {'tag_type': 'a', 'name': 'a', 'outer_html': '<a href="/s' || CAST(s_suppkey AS VARCHAR) || '"><b>x</b> y</a>', 'inner': CAST(1 AS BIGINT), 'map': CAST(NULL AS VARCHAR)},
  {'tag_type': 'area', 'name': 'area', 'outer_html': '<area shape="rect" coords="1,2,' || CAST(s_nationkey + 3 AS VARCHAR) || ',9" href="/a">', 'inner': CAST(0 AS BIGINT), 'map': 'm' || CAST(s_nationkey AS VARCHAR)},
  {'tag_type': 'img', 'name': 'img', 'outer_html': '<img usemap="#m" src="i">', 'inner': CAST(0 AS BIGINT), 'map': NULL},
  {'tag_type': 'onclick', 'name': 'div', 'outer_html': '<div onclick="go(' || CAST(s_suppkey AS VARCHAR) || ')">click me</div>', 'inner': CAST(0 AS BIGINT), 'map': NULL},
  {'tag_type': 'iframe', 'name': 'iframe', 'outer_html': '<iframe src="/f"></iframe>', 'inner': CAST(0 AS BIGINT), 'map': NULL},
  {'tag_type': 'iframe', 'name': 'frame', 'outer_html': '<frame src="/g">', 'inner': CAST(0 AS BIGINT), 'map': NULL}], recursive := true) FROM supplier""")  # fmt: skip
def page_tag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of tags, of a page for each supplier."""
    s = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    html = F.concat(
        F.lit('<html><body><p><a href="/s'), key, F.lit('"><b>x</b> y</a></p><map name="m'), nation.cast("string"), F.lit('"><area shape="rect" coords="1,2,'), (nation + 3).cast("string"),
        F.lit(',9" href="/a"></map><img usemap="#m" src="i"><div onclick="go('), key, F.lit(')">click\nme</div><iframe src="/f"></iframe><frame src="/g"></body></html>'),
    )
    return tags.page_tags(s.select("s_suppkey", html.alias("html"))).select("s_suppkey", "tag_type", "name", "outer_html", F.col("inner").cast("long").alias("inner"), F.col("parent_map").alias("map"))


@query("""
SELECT page_id, split_part(regexp_extract(url, '://([^/]*)', 1), ':', 1) AS host, 'http://' || regexp_extract(url, '://([^/]*)', 1) || '/' AS start, strftime(make_timestamp(page_id * 1000000), '%Y-%m-%d-%H-%M-%S') AS stamp,
       replace(replace(substr(html, 1, 400), chr(10), ' '), chr(13), '') AS line, 'x' || CAST(page_id AS VARCHAR) AS key,
       regexp_extract(url, '://([^/]*)', 1) || '_' || strftime(make_timestamp(page_id * 1000000), '%Y-%m-%d-%H-%M-%S') || '_' || CASE WHEN regexp_extract(url, '://[^/]*([^?#]*)', 1) LIKE '%/' THEN '.html' ELSE list_extract(string_split(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/'), -1) END AS stored
FROM pages""")  # fmt: skip
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts without ports, start urls, stamps, texts on one line, keys of plain urls and names of stored resources."""
    netloc = U.url_netloc(F.col("url"))
    at = F.timestamp_seconds(F.col("page_id"))
    return table(spark, sf_dir, "pages").select(
        "page_id", U.host_without_port(F.concat(netloc, F.lit(":8080"))).alias("host"), U.start_url(netloc).alias("start"), U.stamp(at).alias("stamp"), U.strip_newlines(F.substring("html", 1, 400)).alias("line"),
        U.plain_key(F.concat(F.lit("X"), F.col("page_id").cast("string"))).alias("key"), U.resource_file_name(F.col("url"), at).alias("stored"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(10 + l_linenumber AS DOUBLE) AS x, CAST(20 + l_partkey % 9 AS DOUBLE) AS y, CAST(l_suppkey % 50 + 1 AS DOUBLE) AS width, CAST(l_partkey % 30 + 1 AS DOUBLE) AS height FROM lineitem""")  # fmt: skip
def area_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of image-map areas on their image."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x, y = F.col("l_linenumber"), F.col("l_partkey") % 9
    coords = F.concat_ws(",", *[c.cast("string") for c in (x, y, x + F.col("l_suppkey") % 50 + 1, y + F.col("l_partkey") % 30 + 1)])
    r = area_rect(F.lit("rect"), coords, rect(F.lit(10), F.lit(20), F.lit(500), F.lit(500)))
    return lines.select("*", r.alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.x", "r.y", "r.width", "r.height")


@query(TREE_SQL + """
, ends AS (SELECT sample_id, max(node_seq) AS last FROM tree GROUP BY sample_id), wanted AS (SELECT t.sample_id, lower(t.url) AS url FROM tree t JOIN ends e ON e.sample_id = t.sample_id AND e.last = t.node_seq), first AS (
  SELECT w.sample_id, t.node_seq, t.path FROM wanted w JOIN tree t ON t.sample_id = w.sample_id AND lower(t.url) = w.url QUALIFY row_number() OVER (PARTITION BY w.sample_id ORDER BY t.path_ord) = 1)
SELECT sample_id, node_seq AS end_seq, CAST(len(path) AS BIGINT) AS n FROM first""")  # fmt: skip
def chain_between_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from the root to the first node with the url of each tree's last node, compared as text."""
    t = materialize(_tree(spark, sf_dir), "event-trees")
    asked = t.groupBy("sample_id").agg(F.upper(F.max_by("url", "node_seq")).alias("end_url"))
    found = tree.intermediaries(t, tree.ends_by_url(t, asked, strict=True))
    return found.groupBy("sample_id", "end_seq").agg(F.count("*").alias("n"))
