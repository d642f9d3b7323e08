"""The engine's inputs made from the supplied tables: chains from line items, browser-like logs from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.operators.requests import ANCHOR, DOWNLOAD, FAILED, NAVIGATION, SENT, frame_parents

#: The browser's message for each kind of event.
MESSAGES = {"view": SENT, "click": NAVIGATION, "error": FAILED, "purchase": DOWNLOAD, "signup": ANCHOR}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps (rule, label, sample_id, at, n, url, domain, tld, page, params) of one chain an order.

    A step is a line item in the order of line number, part and supplier; its url is the supplier, its domain the supplier's
    nation, its TLD the region; the rule is the last supplier, the label whether the order is finished. Orders of one line go."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    whole = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = lines.select(
        F.col("l_orderkey").alias("sample_id"), (F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"),
        F.col("l_suppkey").alias("url"), F.last("l_suppkey").over(whole).alias("rule"), F.col("l_partkey").alias("part"),
    ).where("n > 1")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("domain"), F.col("n_regionkey").alias("tld"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    joined = steps.join(suppliers, F.col("url") == F.col("s_suppkey")).join(orders, F.col("sample_id") == F.col("o_orderkey"))
    return joined.select("rule", "label", "sample_id", "at", "n", "url", "domain", "tld", (F.col("part") % 50).alias("page"), F.when(F.col("part") % 3 == 0, F.concat(F.lit("p"), (F.col("part") % 7).cast("string"))).otherwise(F.lit("")).alias("params"), "part")


CHAIN_STEPS_SQL = """
WITH numbered AS (
  SELECT l_orderkey AS sample_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey AS url, l_partkey AS part,
         last_value(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rule
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
), steps AS (
  SELECT rule, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, sample_id, pos, n, url, s_nationkey AS domain, n_regionkey AS tld, part % 50 AS page,
         CASE WHEN part % 3 = 0 THEN 'p' || CAST(part % 7 AS VARCHAR) ELSE '' END AS params, part
  FROM numbered JOIN supplier ON url = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON sample_id = o_orderkey
  WHERE n > 1
)
"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows (sample_id, seq, event_id, kind, k, url, frame_id, ts_ms, value, first_view) of users' events.

    A user is a sample; props.k names the resource; a view is a document request, a click a navigation, an error a failed load, a
    purchase a download, a sign-up a jump to an anchor."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(
        F.col("user_id").alias("sample_id"), F.row_number().over(order).cast("long").alias("seq"), "event_id", F.col("event_type").alias("kind"), k.alias("k"),
        F.concat(F.lit("http://h"), (k % 10).cast("string"), F.lit(".example.com/p"), k.cast("string")).alias("url"), (k % 3).alias("frame_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value",
    )
    first = F.min(F.when(F.col("kind") == "view", F.col("seq"))).over(Window.partitionBy("sample_id"))
    return rows.withColumn("first_view", first)


def browser_events(log: DataFrame) -> DataFrame:
    """An event log in the columns that the request filters read: the start url is the first view's."""
    method = F.coalesce(*[F.when(F.col("kind") == k, F.lit(m)) for k, m in MESSAGES.items()])
    start = F.first(F.when(F.col("kind") == "view", F.col("url")), ignorenulls=True).over(
        Window.partitionBy("sample_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return log.select("*", method.alias("method"), start.alias("start_url"), F.lit(None).cast("map<string,string>").alias("response_headers"))


EVENT_LOG_SQL = """
WITH RECURSIVE raw AS (
  SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type AS kind,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS ts_ms, value
  FROM events
), log AS (
  SELECT sample_id, seq, event_id, kind, k, 'http://h' || CAST(k % 10 AS VARCHAR) || '.example.com/p' || CAST(k AS VARCHAR) AS url, k % 3 AS frame_id, ts_ms, value,
         min(CASE WHEN kind = 'view' THEN seq END) OVER (PARTITION BY sample_id) AS first_view
  FROM raw
)
"""


def before(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def event_requests(log: DataFrame) -> DataFrame:
    """Requests (sample_id, seq, url, frame_id, ts_ms, parent_url) of an event log: views and anchors from the first view on; an anchor
    before its frame's first view goes. A parent is the frame's latest earlier url, else that of the first view's frame."""
    kept = log.where((F.col("seq") >= F.col("first_view")) & F.col("kind").isin("view", "signup"))
    seen = F.max((F.col("kind") == "view").cast("int")).over(before("sample_id", "frame_id"))
    kept = kept.withColumn("seen", seen).where((F.col("kind") == "view") | (F.col("seen") == 1))
    kept = kept.withColumn("url", F.when(F.col("kind") == "signup", F.concat("url", F.lit("#a"))).otherwise(F.col("url")))
    root = F.first("frame_id").over(Window.partitionBy("sample_id").orderBy("seq"))
    kept = kept.withColumn("root_frame", root)
    return frame_parents(kept.withColumn("is_root_frame", F.col("frame_id") == F.col("root_frame"))).select("sample_id", "seq", "kind", "url", "frame_id", "ts_ms", "parent_url")


REQUESTS_SQL = (
    EVENT_LOG_SQL
    + """
, kept AS (
  SELECT sample_id, seq, kind, CASE WHEN kind = 'signup' THEN url || '#a' ELSE url END AS url, frame_id, ts_ms,
         first_value(frame_id) OVER (PARTITION BY sample_id ORDER BY seq) AS root_frame
  FROM (SELECT *, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, frame_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM log WHERE seq >= first_view AND kind IN ('view', 'signup'))
  WHERE kind = 'view' OR seen = 1
), requests AS (
  SELECT sample_id, seq, kind, url, frame_id, ts_ms,
         coalesce(lag(url) OVER (PARTITION BY sample_id, frame_id ORDER BY seq),
                  last_value(CASE WHEN frame_id = root_frame THEN url END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS parent_url
  FROM kept
)
"""
)


def document_requests(requests: DataFrame) -> DataFrame:
    """Requests of an event log in the columns of schemas.REQUESTS that trees are built of."""
    parent = F.col("parent_url")
    return requests.select(
        F.col("sample_id").cast("string").alias("sample_id"), "seq", F.col("url").alias("request_url"), F.when(F.col("kind") == "view", "Document").otherwise("Anchor").alias("resource_type"),
        F.coalesce(parent, F.lit("")).alias("parent_url"), F.when(parent.isNull(), "root").otherwise("script").alias("parent_source"), F.col("ts_ms").alias("ts"),
    )


TREE_SQL = (
    REQUESTS_SQL
    + """
, numbered_requests AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq) - 1 AS number FROM requests
), nodes AS (
  SELECT r.sample_id, r.number AS node_seq, (SELECT max(p.number) FROM numbered_requests p WHERE p.sample_id = r.sample_id AND p.url = r.parent_url AND p.seq < r.seq) AS parent_seq, r.url, r.kind, r.ts_ms
  FROM numbered_requests r
), ordinal AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, parent_seq ORDER BY node_seq) AS INTEGER) AS nth FROM nodes
), tree AS (
  SELECT sample_id, node_seq, parent_seq, url, kind, ts_ms, 1 AS depth, [node_seq] AS path, CAST([] AS INTEGER[]) AS path_ord FROM ordinal WHERE parent_seq IS NULL
  UNION ALL
  SELECT c.sample_id, c.node_seq, c.parent_seq, c.url, c.kind, c.ts_ms, t.depth + 1, list_append(t.path, c.node_seq), list_append(t.path_ord, c.nth)
  FROM ordinal c JOIN tree t ON c.sample_id = t.sample_id AND c.parent_seq = t.node_seq
)
"""
)


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for the message graph: a view is a request of resource k, whose group is (sample, k); what the user does next with k answers it.

    An error answers 404, a click redirects to resource (7k + 1) % 100 with 302 and asks for it as the next request of the group, else 200."""
    log = event_log(spark, sf_dir)
    location = F.concat(F.lit("http://h"), ((F.col("k") * 7 + 1) % 100 % 10).cast("string"), F.lit(".example.com/p"), ((F.col("k") * 7 + 1) % 100).cast("string"))
    views = F.when(F.col("kind") == "view", F.col("url"))
    rows = log.withColumn("seen_url", views).withColumn("earlier", F.last("seen_url", ignorenulls=True).over(before("sample_id")))
    return rows.select(
        "sample_id", F.col("k").alias("request_id"), "seq", F.col("kind").isin("view", "click").alias("is_request"), F.when(F.col("kind") == "click", location).otherwise(F.col("url")).alias("url"),
        F.when(F.col("event_id") % 2 == 0, F.col("earlier")).alias("referer"), F.when(F.col("event_id") % 7 == 0, "POST").otherwise("GET").alias("http_method"),
        F.when(F.col("kind") == "error", 404).otherwise(200).alias("status"), (F.col("kind") == "click").alias("is_redirect"), F.when(F.col("kind") == "click", location).alias("redirect_location"), F.when(F.col("kind") == "click", 302).alias("redirect_status"),
    )


HMG_SQL = (
    EVENT_LOG_SQL
    + """
, messages AS (
  SELECT sample_id, k AS request_id, seq, kind IN ('view', 'click') AS is_request,
         CASE WHEN kind = 'click' THEN 'http://h' || CAST((k * 7 + 1) % 100 % 10 AS VARCHAR) || '.example.com/p' || CAST((k * 7 + 1) % 100 AS VARCHAR) ELSE url END AS url,
         CASE WHEN event_id % 2 = 0 THEN last_value(CASE WHEN kind = 'view' THEN url END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS referer,
         CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN kind = 'error' THEN 404 ELSE 200 END AS status, kind = 'click' AS is_redirect
  FROM log
), followed AS (
  SELECT *, min(seq) OVER (PARTITION BY sample_id, request_id) AS group_seq, lead(is_request) OVER g AS next_is_request, lead(status) OVER g AS next_status, lead(is_redirect) OVER g AS next_is_redirect, lead(url) OVER g AS next_url
  FROM messages WINDOW g AS (PARTITION BY sample_id, request_id ORDER BY seq)
), hmg_nodes AS (
  SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY group_seq, seq) - 1 AS sn, url, referer, regexp_extract(url, 'http://([^/]*)', 1) AS host, method,
         CASE WHEN next_is_request AND next_is_redirect THEN next_url END AS location,
         CASE WHEN next_is_request = false THEN next_status WHEN next_is_request AND next_is_redirect THEN 302 ELSE 200 END AS status
  FROM followed WHERE is_request
), hmg_edges AS (
  SELECT n.sample_id, n.sn AS src, f.dst, 'location' AS edge_type
  FROM hmg_nodes n JOIN (SELECT sample_id, url, min(sn) AS dst FROM hmg_nodes GROUP BY sample_id, url) f ON n.sample_id = f.sample_id AND n.location = f.url WHERE n.sn < f.dst
  UNION ALL
  SELECT n.sample_id, p.sn, n.sn, 'referer' FROM hmg_nodes n JOIN hmg_nodes p ON n.sample_id = p.sample_id AND n.referer = p.url WHERE p.sn < n.sn
)
"""
)

#: Graph measures of each sample: page ranks by rounds until they change little, shortest paths by counting walks (edges lead to larger numbers, so
#: the shortest walks are the shortest paths), and what the top nodes have.
SHAPE_SQL = (
    HMG_SQL
    + """
, once AS (SELECT DISTINCT sample_id, src, dst FROM hmg_edges
), sizes AS (SELECT sample_id, count(*) AS size FROM hmg_nodes GROUP BY sample_id
), outs AS (SELECT sample_id, src, count(*) AS d FROM once GROUP BY ALL
), ranks AS (
  SELECT n.sample_id, n.sn, CAST(1.0 / size AS DOUBLE) AS x, 0 AS round, false AS done FROM hmg_nodes n JOIN sizes USING (sample_id)
  UNION ALL
  SELECT sample_id, sn, fresh, round + 1, sum(abs(fresh - x)) OVER (PARTITION BY sample_id) < size * 1e-6
  FROM (
    SELECT r.sample_id, r.sn, r.x, r.round, z.size, 0.85::DOUBLE * (coalesce(f.flow, 0) + coalesce(k.x, 0) / z.size) + 0.15::DOUBLE / z.size AS fresh
    FROM ranks r JOIN sizes z ON z.sample_id = r.sample_id
    LEFT JOIN (SELECT e.sample_id, e.dst, sum(q.x / o.d) AS flow FROM ranks q JOIN once e ON q.sample_id = e.sample_id AND q.sn = e.src JOIN outs o ON o.sample_id = e.sample_id AND o.src = e.src GROUP BY 1, 2) f ON f.sample_id = r.sample_id AND f.dst = r.sn
    LEFT JOIN (SELECT q.sample_id, sum(q.x) AS x FROM ranks q LEFT JOIN outs o ON o.sample_id = q.sample_id AND o.src = q.sn WHERE o.d IS NULL GROUP BY 1) k ON k.sample_id = r.sample_id
    WHERE NOT r.done AND r.round < 100)
), ranked AS (SELECT sample_id, sn, x FROM ranks QUALIFY round = max(round) OVER (PARTITION BY sample_id)
), top_rank AS (SELECT sample_id, sn AS mpr_node_sn, x AS mpr_node_pr FROM ranked QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(x, 12) DESC, sn) = 1
), touched AS (SELECT sample_id, src AS sn FROM once UNION ALL SELECT sample_id, dst FROM once
), degrees AS (SELECT n.sample_id, n.sn, count(t.sn) AS d FROM hmg_nodes n LEFT JOIN touched t ON t.sample_id = n.sample_id AND t.sn = n.sn GROUP BY n.sample_id, n.sn
), top_degree AS (
  SELECT d.sample_id, sn AS mdc_node_sn, CASE WHEN size > 1 THEN d / (size - 1) ELSE 1.0 END AS mdc_node_dc FROM degrees d JOIN sizes USING (sample_id) QUALIFY row_number() OVER (PARTITION BY d.sample_id ORDER BY d DESC, sn) = 1
), walks AS (
  SELECT sample_id, src AS s, dst AS v, 1 AS len, CAST(1 AS DOUBLE) AS c FROM once
  UNION ALL
  SELECT w.sample_id, w.s, e.dst, w.len + 1, sum(w.c) FROM walks w JOIN once e ON e.sample_id = w.sample_id AND e.src = w.v GROUP BY 1, 2, 3, 4
), short AS (SELECT sample_id, s, v, min(len) AS d, arg_min(c, len) AS paths FROM walks GROUP BY 1, 2, 3
), middles AS (
  SELECT a.sample_id, a.v AS sn, sum(a.paths * b.paths / t.paths) AS b
  FROM short a JOIN short b ON b.sample_id = a.sample_id AND b.s = a.v JOIN short t ON t.sample_id = a.sample_id AND t.s = a.s AND t.v = b.v AND t.d = a.d + b.d GROUP BY 1, 2
), between_of AS (SELECT sample_id, max(b) AS most, count(*) AS amid FROM middles GROUP BY 1
), near AS (
  SELECT m.sample_id, count(*) AS reached, sum(d) AS far FROM top_degree m JOIN short t ON t.sample_id = m.sample_id AND t.v = m.mdc_node_sn GROUP BY 1
), both_ways AS (SELECT DISTINCT sample_id, src, dst FROM once UNION SELECT DISTINCT sample_id, dst, src FROM once
), reach AS (SELECT sample_id, sn AS a, sn AS b FROM hmg_nodes UNION SELECT r.sample_id, r.a, e.dst FROM reach r JOIN both_ways e ON e.sample_id = r.sample_id AND e.src = r.b
), parts AS (SELECT sample_id, count(DISTINCT low) AS component_cnt FROM (SELECT sample_id, a, min(b) AS low FROM reach GROUP BY 1, 2) GROUP BY 1
), shape AS (
  SELECT z.sample_id, z.size, coalesce((SELECT max(len) FROM walks w WHERE w.sample_id = z.sample_id), 0) AS longest_path_len, component_cnt, (SELECT count(*) FROM degrees g WHERE g.sample_id = z.sample_id AND g.d = 0) / z.size AS isolate_ratio,
         mpr_node_sn, mpr_node_pr, mdc_node_sn, mdc_node_dc, CASE WHEN far > 0 THEN reached / far * reached / (z.size - 1) ELSE 0.0 END AS mdc_closeness,
         CASE WHEN z.size > 2 THEN coalesce(most, 0) / ((z.size - 1) * (z.size - 2)) ELSE 0.0 END AS max_betweenness, coalesce(amid, 0) AS nonzero_betweenness_cnt
  FROM sizes z JOIN parts USING (sample_id) JOIN top_rank USING (sample_id) JOIN top_degree USING (sample_id) LEFT JOIN near USING (sample_id) LEFT JOIN between_of USING (sample_id)
)
"""
)
