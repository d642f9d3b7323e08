"""HTTP message graphs: requests of a page load as nodes, redirects and referers as edges, and 24 features.

Node and edge features are windows and grouped aggregates. Longest paths and centralities are a grouped map per sample, whose
graph is one page load.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.suffix import with_suffix
from chainloom.functions.urls import path_depth, url_join, url_netloc, url_path, url_query
from chainloom.operators.requests import RECEIVED, SENT
from chainloom.sources.scratch import materialize


def messages(events: DataFrame) -> DataFrame:
    """Requests and responses of a log (schemas.LOG) in the form that ``nodes`` takes."""
    h = F.col("redirect_headers")
    location = F.coalesce(F.try_element_at(h, F.lit("location")), F.try_element_at(h, F.lit("Location")), F.try_element_at(h, F.lit("LOCATION")))
    return events.where(F.col("method").isin(SENT, RECEIVED)).select(
        "sample_id", "request_id", "seq", (F.col("method") == SENT).alias("is_request"), "url", F.try_element_at("request_headers", F.lit("Referer")).alias("referer"), "http_method", "status",
        F.col("redirect_url").isNotNull().alias("is_redirect"), location.alias("redirect_location"), "redirect_status",
    )


def nodes(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(sample_id, sn, url, referer, host, e2ld, method, location, status) of messages.

    A request's status is that of the response right after it in its group, or of the redirect that the next request names;
    200 where neither is there. Numbers follow the order in which request groups begin. Hosts without a listed suffix go."""
    group = Window.partitionBy("sample_id", "request_id")
    order = group.orderBy("seq")
    follow = lambda c: F.lead(c).over(order)
    marked = rows.select(
        "*", F.min("seq").over(group).alias("group_seq"), follow("is_request").alias("next_is_request"), follow("status").alias("next_status"),
        follow("is_redirect").alias("next_is_redirect"), follow("redirect_location").alias("next_location"), follow("redirect_status").alias("next_redirect_status"),
    ).where("is_request")
    redirected = F.coalesce(F.col("next_is_request") & F.col("next_is_redirect"), F.lit(False))
    status = F.when(F.col("next_is_request") == F.lit(False), F.col("next_status")).when(redirected, F.col("next_redirect_status"))
    absolute = F.col("next_location").rlike("^https?://")
    target = F.when(F.col("next_location").isNull(), F.col("url")).when(absolute, F.col("next_location")).otherwise(url_join(F.when(~absolute, F.col("url")), F.when(~absolute, F.col("next_location"))))
    full = marked.select("sample_id", "group_seq", "seq", "url", "referer", url_netloc(F.col("url")).alias("host"), F.col("http_method").alias("method"), F.when(redirected, target).alias("location"), F.coalesce(status, F.lit(200)).cast("int").alias("status"))
    named = with_suffix(full, "host", rules).where(F.col("e2ld").isNotNull()).drop("suffix")
    sn = F.row_number().over(Window.partitionBy("sample_id").orderBy("group_seq", "seq")) - 1
    return named.select("sample_id", sn.alias("sn"), "url", "referer", "host", "e2ld", "method", "location", "status")


def edges(n: DataFrame) -> DataFrame:
    """(sample_id, src, dst, edge_type): a redirect to the first node with its location, a referer to all earlier nodes with its url;
    always from the smaller number to the larger. Both are equi-joins on the url."""
    first = n.groupBy("sample_id", F.col("url").alias("location")).agg(F.min("sn").alias("dst"))
    moved = n.where(F.col("location").isNotNull()).select("sample_id", F.col("sn").alias("src"), "location").join(first, ["sample_id", "location"]).where("src < dst").select("sample_id", "src", "dst", F.lit("location").alias("edge_type"))
    named = n.where(F.coalesce(F.col("referer"), F.lit("")) != "").select("sample_id", F.col("sn").alias("dst"), F.col("referer").alias("url"))
    referred = named.join(n.select("sample_id", F.col("sn").alias("src"), "url"), ["sample_id", "url"]).where("src < dst").select("sample_id", "src", "dst", F.lit("referer").alias("edge_type"))
    return moved.unionByName(referred)


def graph(e: DataFrame) -> DataFrame:
    """A simple graph: of parallel edges one, named by the type that comes last (in the order of nodes: a node's redirect, then its referers)."""
    written = F.when(F.col("edge_type") == "location", F.struct(F.col("src").alias("at"), F.lit(0).alias("kind"))).otherwise(F.struct(F.col("dst").alias("at"), F.lit(1).alias("kind")))
    return e.groupBy("sample_id", "src", "dst").agg(F.max_by("edge_type", written).alias("edge_type"))


def node_features(n: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return n.groupBy("sample_id").agg(
        F.count("*").alias("node_cnt"), share(F.floor(F.col("status") / 10) == 40).alias("status_40x_ratio"), share(F.coalesce(F.col("referer"), F.lit("")) != "").alias("referer_ratio"),
        share(F.col("e2ld").isNull() & (F.size(F.split("host", r"\.")) == 4)).alias("ip_ratio"), share(F.coalesce(F.col("method") == "POST", F.lit(False))).alias("post_ratio"),
    )


def redirect_features(n: DataFrame, e: DataFrame) -> DataFrame:
    """(sample_id, redirect_cnt, cross_domain_cnt, max_path_len): redirects, those between hosts, and nodes on the longest redirect chain
    plus one, 0 without redirects. A node has one redirect at most, so a chain is a walk."""
    moved = e.where("edge_type = 'location'").select("sample_id", "src", "dst")
    host = n.select("sample_id", "sn", "host")
    ends = moved.join(host.select("sample_id", F.col("sn").alias("src"), F.col("host").alias("from_host")), ["sample_id", "src"]).join(host.select("sample_id", F.col("sn").alias("dst"), F.col("host").alias("to_host")), ["sample_id", "dst"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        step = dict(zip(pdf["src"], pdf["dst"], strict=True))
        length: dict[int, int] = {}
        for s in sorted(step, reverse=True):  # edges lead to larger numbers
            length[s] = 1 + length.get(step[s], 1)
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[:1], "max_path_len": [max(length.values())]})

    longest = moved.groupBy("sample_id").applyInPandas(walk, f"sample_id {moved.schema['sample_id'].dataType.simpleString()}, max_path_len long")
    counts = ends.groupBy("sample_id").agg(F.count("*").alias("redirect_cnt"), F.sum((F.col("from_host") != F.col("to_host")).cast("long")).alias("cross_domain_cnt"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return n.select("sample_id").distinct().join(counts, "sample_id", "left").join(longest, "sample_id", "left").select("sample_id", zero("redirect_cnt"), zero("cross_domain_cnt"), zero("max_path_len"))


def isolates(n: DataFrame, e: DataFrame) -> DataFrame:
    ends = e.select("sample_id", F.explode(F.array("src", "dst")).alias("sn")).distinct()
    return n.join(ends, ["sample_id", "sn"], "left_anti")


# ---- graph algorithms of one sample


def pagerank(size: int, src: np.ndarray, dst: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Power iteration from the uniform vector; nodes without out-edges spread evenly; stops when the L1 change is under size * tolerance."""
    out = np.bincount(src, minlength=size).astype(float)
    x = np.full(size, 1 / size)
    for _ in range(rounds):
        flow = np.bincount(dst, (x / np.maximum(out, 1))[src], size)
        new = damping * (flow + x[out == 0].sum() / size) + (1 - damping) / size
        done = np.abs(new - x).sum() < size * tolerance
        x = new
        if done:
            break
    return x


def neighbours(size: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(size)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        out[a].append(b)
    return out


def betweenness(size: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Shares of shortest paths through each node by accumulation from each source, normalised by (size - 1)(size - 2)."""
    step, total = neighbours(size, src, dst), np.zeros(size)
    for s in range(size):
        dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            for w in step[v]:
                if w not in dist:
                    dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        credit = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                credit[v] += paths[v] / paths[w] * (1 + credit[w])
            if w != s:
                total[w] += credit[w]
    return total / ((size - 1) * (size - 2)) if size > 2 else total


def closeness(size: int, src: np.ndarray, dst: np.ndarray, node: int) -> float:
    """By distances towards ``node``, scaled by the share of nodes that reach it."""
    back = neighbours(size, dst, src)
    dist, order = {node: 0}, [node]
    for v in order:
        for w in back[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                order.append(w)
    far, reached = sum(dist.values()), len(dist) - 1
    return reached / far * reached / (size - 1) if far and size > 1 else 0.0


def longest_path(size: int, src: np.ndarray, dst: np.ndarray) -> int:
    """Edges on the longest path of a graph whose edges lead to larger numbers."""
    best = np.zeros(size, int)
    for a, b in sorted(zip(src.tolist(), dst.tolist(), strict=True)):
        best[b] = max(best[b], best[a] + 1)
    return int(best.max()) if size else 0


def component_count(size: int, src: np.ndarray, dst: np.ndarray) -> int:
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        root[find(a)] = find(b)
    return sum(find(i) == i for i in range(size))


SHAPE = "longest_path_len long, component_cnt long, isolate_ratio double, mpr_node_sn long, mpr_node_pr double, mdc_node_sn long, mdc_node_dc double, mdc_closeness double, max_betweenness double, nonzero_betweenness_cnt long, mpr_same long, mdc_same long, mpr_url string"


def shapes(n: DataFrame, e: DataFrame) -> DataFrame:
    """(sample_id, ...SHAPE): what takes the whole graph of a sample. Ties of rank and degree go to the smaller number.

    mpr_same and mdc_same count the nodes of the top node's host, itself included."""
    kind = n.schema["sample_id"].dataType.simpleString()

    def measure(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=["sample_id", *(x.split()[0] for x in SHAPE.split(", "))])
        a = a.sort_values("sn")
        ids, host = a["sn"].to_numpy(), a["host"].to_numpy()
        size = len(ids)
        src, dst = np.searchsorted(ids, b["src"].to_numpy(int)), np.searchsorted(ids, b["dst"].to_numpy(int))
        pr = pagerank(size, src, dst)
        degree = np.bincount(np.concatenate([src, dst]), minlength=size) / max(1, size - 1) if size > 1 else np.ones(size)
        between = betweenness(size, src, dst)
        p, d = int(np.argmax(np.round(pr, 12))), int(np.argmax(degree))  # sums in another order differ in later places
        alone = size - len(np.unique(np.concatenate([src, dst])))
        row = [a["sample_id"].iloc[0], longest_path(size, src, dst), component_count(size, src, dst), alone / size, ids[p], pr[p], ids[d], degree[d], closeness(size, src, dst, d), between.max(), int((between > 0).sum())]
        row += [int((host == host[p]).sum()), int((host == host[d]).sum()), a["url"].iloc[p]]
        return pd.DataFrame([row], columns=["sample_id", *(x.split()[0] for x in SHAPE.split(", "))])

    left, right = n.select(F.col("sample_id").alias("sample_id"), "sn", "host", "url"), graph(e).select(F.col("sample_id").alias("sample_id"), "src", "dst")
    return left.groupBy("sample_id").cogroup(right.groupBy("sample_id")).applyInPandas(measure, f"sample_id {kind}, {SHAPE}")


def features(n: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """sample_id and the 24 features, in the order of schemas.HMG_FEATURES, of samples with more than one node. Nodes and edges (by default those
    of the nodes) are stored first, as each is read several times."""
    from chainloom.sources.schemas import HMG_FEATURES

    n = materialize(n, "message-nodes")
    e = materialize(edges(n) if e is None else e, "message-edges")
    full = node_features(n).where("node_cnt > 1").join(redirect_features(n, e), "sample_id").join(shapes(n, e), "sample_id")
    url = F.col("mpr_url")
    others = F.col("node_cnt") - 1
    named = full.select(
        "*", ((F.col("mpr_same") - 1) / others).alias("same_pr_domain_ratio"), ((F.col("mdc_same") - 1) / others).alias("same_dc_domain_ratio"), F.length(url).alias("mpr_url_len"),
        path_depth(url_path(url)).alias("mpr_url_path_depth"), F.length(url_query(url)).alias("mpr_url_query_len"), F.size(F.split(url_query(url), "&")).alias("mpr_url_query_cnt"),
    )
    return named.select("sample_id", *[F.col(c).cast("double").alias(c) for c in HMG_FEATURES])


def weak_components(vertices: DataFrame, e: DataFrame, materialize=None) -> DataFrame:
    """(id, component) of one large graph: vertices (id), edges (src, dst). Labels spread over edges and then over labels, so that rounds
    grow with the logarithm of a path. ``materialize`` cuts lineage; by default a checkpoint."""
    cut = materialize or (lambda df: df.checkpoint())
    both = cut(e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(vertices.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("least"))
        fresh = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = fresh.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = cut(fresh.join(jump, "component").select("id", F.least("component", "further").alias("component")))
        changed = fresh.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = fresh
        if not changed:
            return labels
