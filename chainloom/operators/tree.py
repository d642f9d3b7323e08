"""Redirection trees as tables.

A tree is rows of (sample_id, node_seq, parent_seq); one grouped map per sample adds depth, the path of ancestors and the path of
sibling ordinals. Everything else is plain relational work on these columns: arrays sort prefixes first, so ``path_ord`` is
depth-first pre-order, and (depth, path_ord) is breadth-first order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.urls import url_key
from chainloom.sources.schemas import TREE


def link(urls: list[str], parents: list[str | None]) -> list[int | None]:
    """For each request the place of its parent: the latest earlier kept request with the parent's url. None: not kept; the first is -1."""
    latest: dict[str, int] = {}
    out: list[int | None] = []
    for i, (u, p) in enumerate(zip(urls, parents, strict=True)):
        at = -1 if i == 0 else latest.get(p)
        out.append(at)
        if at is not None:
            latest[u] = i
    return out


def closure(parent: list[int]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Depth (root 1), path of node numbers from the root, and path of sibling ordinals, of nodes whose parents come before them."""
    depth, path, order, children = [], [], [], [0] * len(parent)
    for i, p in enumerate(parent):
        if p < 0:
            depth.append(1)
            path.append([i])
            order.append([])
        else:
            children[p] += 1
            depth.append(depth[p] + 1)
            path.append([*path[p], i])
            order.append([*order[p], children[p]])
    return depth, path, order


def build_trees(requests: DataFrame) -> DataFrame:
    """Tree nodes (schemas.TREE) of requests. A sample whose first request is no root document has no tree."""

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("seq", kind="stable").itertuples(index=False))
        first = rows[0]
        if first.resource_type != "Document" or first.parent_url or first.parent_source != "root":
            rows = []
        found = link([r.request_url for r in rows], [r.parent_url for r in rows])
        kept = [i for i, at in enumerate(found) if at is not None]
        number = {i: n for n, i in enumerate(kept)}
        parent = [number.get(found[i], -1) for i in kept]
        depth, path, order = closure(parent)
        out = []
        for n, i in enumerate(kept):
            r = rows[i]
            url, mark, rest = (r.request_url, "", "") if n == 0 else r.request_url.partition("#")
            out.append((key[0], r.seq, n, url, mark + rest, None if parent[n] < 0 else parent[n], r.parent_source, r.resource_type, r.ts, depth[n], path[n], order[n]))
        names = "sample_id seq node_seq url url_fragment parent_seq parent_source resource_type ts depth path path_ord".split()
        return pd.DataFrame(out, columns=names, dtype=object)

    columns = ["sample_id", "seq", "request_url", "resource_type", "parent_url", "parent_source", "ts"]
    return requests.select(*columns).groupBy("sample_id").applyInPandas(grow, TREE)


def close_trees(edges: DataFrame) -> DataFrame:
    """(sample_id, node_seq, parent_seq) with depth, path and path_ord; samples with two roots or a missing parent give nothing.

    Siblings are in node_seq order, and a parent's number is smaller than its children's."""

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_seq")
        number = {int(s): n for n, s in enumerate(pdf["node_seq"])}
        ids = list(number)
        parent = [-1 if pd.isna(p) else number.get(int(p), -2) for p in pdf["parent_seq"]]
        sound = parent.count(-1) == 1 and -2 not in parent and len(ids) == len(pdf) and all(p < n for n, p in enumerate(parent))
        depth, path, order = closure(parent) if sound else ([], [], [])
        n = len(depth)
        columns = {"sample_id": [key[0]] * n, "node_seq": ids[:n], "depth": depth, "path": [[ids[x] for x in p] for p in path], "path_ord": order}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    made = edges.select("sample_id", "node_seq", "parent_seq").groupBy("sample_id").applyInPandas(grow, f"sample_id {edges.schema['sample_id'].dataType.simpleString()}, node_seq long, depth int, path array<long>, path_ord array<int>")
    return edges.join(made, ["sample_id", "node_seq"])


def recover_trees(nodes: DataFrame) -> DataFrame:
    """Trees of a node file (sample_id, node_id like node_7, parent_id, ...): the ids are the node numbers."""
    number = lambda c: F.when(F.col(c) == "", None).otherwise(F.split_part(c, F.lit("_"), F.lit(2)).try_cast("long"))
    return close_trees(nodes.withColumn("node_seq", number("node_id")).withColumn("parent_seq", number("parent_id")))


def first_in_order(nodes: DataFrame, *keys: str) -> DataFrame:
    """The first node of each key in depth-first order."""
    w = Window.partitionBy(*keys).orderBy("path_ord")
    return nodes.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def search_node(tree: DataFrame, wanted: DataFrame, with_fragment: bool = True) -> DataFrame:
    """First depth-first node of each wanted (sample_id, wanted_url) by percent-decoded, case-blind equality."""
    url = F.concat("url", "url_fragment") if with_fragment else F.col("url")
    hits = tree.withColumn("key", url_key(url)).join(wanted.withColumn("key", url_key(F.col("wanted_url"))), ["sample_id", "key"])
    return first_in_order(hits, "sample_id", "wanted_url").drop("key")


def exact_match(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``search_node``, with equal time stamps (wanted_ts)."""
    hits = tree.withColumn("key", url_key(F.concat("url", "url_fragment"))).join(wanted.withColumn("key", url_key(F.col("wanted_url"))), ["sample_id", "key"]).where(F.col("ts") == F.col("wanted_ts"))
    return first_in_order(hits, "sample_id", "wanted_url", "wanted_ts").drop("key")


def of_resource_type(tree: DataFrame, resource_type: str) -> DataFrame:
    """Nodes of a type with their breadth-first place."""
    return bfs(tree.where(F.col("resource_type") == resource_type))


def bfs(tree: DataFrame) -> DataFrame:
    return tree.withColumn("bfs_id", F.row_number().over(Window.partitionBy("sample_id").orderBy("depth", "path_ord")) - 1)


def dfs(tree: DataFrame) -> DataFrame:
    return tree.withColumn("dfs_id", F.row_number().over(Window.partitionBy("sample_id").orderBy("path_ord")) - 1)


def leaves(tree: DataFrame) -> DataFrame:
    parents = tree.where(F.col("parent_seq").isNotNull()).select("sample_id", F.col("parent_seq").alias("node_seq")).distinct()
    return tree.join(parents, ["sample_id", "node_seq"], "left_anti")


def heights(tree: DataFrame) -> DataFrame:
    """(sample_id, node_seq, height): nodes on the longest way down, leaves 1. Each node tells all of its ancestors."""
    told = tree.select("sample_id", F.posexplode("path").alias("at", "node_seq"), "depth")
    return told.groupBy("sample_id", "node_seq").agg((F.max("depth") - F.max("at")).cast("int").alias("height"))


def intermediaries(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(sample_id, end_seq, start_seq, at, node_seq): nodes from start to end (both in) on one way to the root.

    ends: sample_id, end_seq and, if there is one, start_seq (null: the root). Pairs that are not on one way give nothing."""
    if "start_seq" not in ends.columns:
        ends = ends.withColumn("start_seq", F.lit(None).cast("long"))
    found = ends.join(tree.select("sample_id", F.col("node_seq").alias("end_seq"), "path"), ["sample_id", "end_seq"])
    at = F.when(F.col("start_seq").isNull(), 1).otherwise(F.array_position("path", F.col("start_seq").cast(tree.schema["path"].dataType.elementType)))
    part = found.withColumn("from", at).where(F.col("from") > 0)
    nodes = F.slice("path", F.col("from").cast("int"), (F.size("path") - F.col("from") + 1).cast("int"))
    return part.select("sample_id", "end_seq", "start_seq", F.posexplode(nodes).alias("at", "node_seq"))


def ends_by_url(tree: DataFrame, asked: DataFrame, strict: bool = False) -> DataFrame:
    """(sample_id, start_seq, end_seq) of urls (sample_id, end_url and, if there is one, start_url; null: the root), compared case-blind as
    texts with fragments. A node that is the start is no end. strict: the walk that looks for both stops at a root which is neither."""
    if "start_url" not in asked.columns:
        asked = asked.withColumn("start_url", F.lit(None).cast("string"))
    nodes = tree.select("sample_id", "node_seq", "path_ord", F.lower(F.concat("url", "url_fragment")).alias("text"), F.col("parent_seq").isNull().alias("is_root"))
    first = first_in_order(nodes, "sample_id", "text")
    named = lambda kind: first.select("sample_id", F.col("text").alias(f"{kind}_text"), F.col("node_seq").cast("long").alias(f"{kind}_seq"), F.col("is_root").alias(f"{kind}_is_root"))
    found = asked.withColumn("end_text", F.lower("end_url")).withColumn("start_text", F.lower("start_url"))
    found = found.join(named("end"), ["sample_id", "end_text"]).join(named("start"), ["sample_id", "start_text"], "left").where(F.col("start_url").isNull() | F.col("start_seq").isNotNull())
    if strict:
        found = found.where(F.col("start_url").isNull() | F.col("start_is_root") | F.col("end_is_root"))
    return found.select("sample_id", "start_seq", "end_seq")


def nearest_initiator(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (sample_id, base_seq, base_ts, initiator_url) the node that issued it: same url (without fragment), not later,
    the latest of these; among equals the one that a walk which takes the last child first meets first.

    The base node itself counts only if that walk meets it before all others."""
    key = F.transform("path_ord", lambda x: -x)
    nodes = tree.select("sample_id", F.col("node_seq").alias("init_seq"), F.col("url").alias("init_url"), F.col("resource_type").alias("init_type"), F.col("ts").alias("init_ts"), key.alias("visit"), url_key(F.col("url")).alias("key"))
    hits = asked.withColumn("key", url_key(F.col("initiator_url"))).join(nodes, ["sample_id", "key"]).where(F.col("init_ts") <= F.col("base_ts"))
    own = (F.col("init_seq") == F.col("base_seq")).cast("int")
    hits = hits.withColumn("met", F.row_number().over(Window.partitionBy("sample_id", "base_seq").orderBy("visit")))
    itself = (F.col("met") == 1) & (own == 1)
    w = Window.partitionBy("sample_id", "base_seq").orderBy(F.desc(itself), own, F.desc("init_ts"), "visit")
    return hits.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "visit", "key", "met")


def tree_edges(tree: DataFrame) -> DataFrame:
    """(sample_id, src, dst) urls of parents and children."""
    parent = tree.select("sample_id", F.col("node_seq").alias("parent_seq"), F.concat("url", "url_fragment").alias("src"))
    return tree.where(F.col("parent_seq").isNotNull()).select("sample_id", "parent_seq", F.concat("url", "url_fragment").alias("dst")).join(parent, ["sample_id", "parent_seq"]).select("sample_id", "src", "dst")
