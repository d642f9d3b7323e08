"""Chains of samples and the scripts and pages that issued their hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.suffix import with_suffix
from chainloom.functions.urls import url_join, url_netloc, url_scheme, valid_url, without_fragment
from chainloom.operators.requests import SENT
from chainloom.operators.tree import exact_match, intermediaries, nearest_initiator, search_node

# Sources of hops that a script or click issues.
ISSUED = ("anchorClick", "script", "scriptInitiated")


def chain_ends(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(sample_id, end_seq) of the nodes that ends (sample_id, end_url) name."""
    return search_node(tree, ends.withColumnRenamed("end_url", "wanted_url")).select("sample_id", F.col("node_seq").cast("long").alias("end_seq"))


def chains(tree: DataFrame, requests: DataFrame, ends: DataFrame, iframes: DataFrame | None = None) -> DataFrame:
    """One row a sample: urls and sources along its chain, hops, whether a large iframe covers the page and whether something was
    downloaded. iframes (sample_id, src): the first large iframe, which adds a hop; a sample whose iframe is not in its tree goes."""
    nodes = tree.select("sample_id", F.col("node_seq").cast("long").alias("node_seq"), F.concat("url", "url_fragment").alias("full_url"), "parent_source")
    steps = intermediaries(tree, chain_ends(tree, ends)).withColumn("node_seq", F.col("node_seq").cast("long")).join(nodes, ["sample_id", "node_seq"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "full_url", "parent_source")))
    base = steps.groupBy("sample_id").agg(ordered.alias("s")).select("sample_id", F.transform("s", lambda x: x["full_url"]).alias("urls"), F.transform("s", lambda x: x["parent_source"]).alias("methods"), (F.size("s") - 1).alias("hops"))
    loaded = requests.where(F.col("resource_type") == "Download").groupBy("sample_id").agg(F.max_by("request_url", "seq").alias("download_url"))
    base = base.join(loaded, "sample_id", "left").withColumn("has_download", F.col("download_url").isNotNull()).withColumn("download_url", F.coalesce("download_url", F.lit("")))
    if iframes is None:
        return base.withColumn("has_iframe", F.lit(False))
    src = F.col("src")
    whole = F.when((url_scheme(src) == "") | (url_netloc(src) == ""), url_join(F.element_at("urls", -1), src)).otherwise(src)
    asked = base.join(iframes, "sample_id", "left").withColumn("wanted_url", valid_url(whole))
    found = search_node(tree, asked.where(F.col("wanted_url").isNotNull()).select("sample_id", "wanted_url")).select("sample_id", F.concat("url", "url_fragment").alias("iframe_url"), F.col("parent_source").alias("iframe_source"))
    full = asked.join(found, "sample_id", "left").withColumn("has_iframe", F.col("src").isNotNull()).where(~F.col("has_iframe") | F.col("iframe_url").isNotNull())
    extra = lambda c, x: F.when(F.col("has_iframe"), F.array_append(c, F.col(x))).otherwise(F.col(c))
    return full.select("sample_id", extra("urls", "iframe_url").alias("urls"), extra("methods", "iframe_source").alias("methods"), (F.col("hops") + F.col("has_iframe").cast("int")).alias("hops"), "download_url", "has_download", "has_iframe")


def log_entries_of(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes with the first log event of their type, time and url (node columns, then initiator columns); nodes without one go."""
    sent = events.where(F.col("method") == SENT).select("sample_id", F.col("seq").alias("event_seq"), "resource_type", "ts", F.concat("url", F.coalesce("url_fragment", F.lit(""))).alias("full_url"), "initiator_url", "has_stack", "call_urls")
    hits = nodes.withColumn("full_url", F.concat("url", "url_fragment")).join(sent, ["sample_id", "resource_type", "ts", "full_url"])
    w = Window.partitionBy("sample_id", "node_seq").orderBy("event_seq")
    return hits.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "event_seq")


def hop_initiators(tree: DataFrame, events: DataFrame, ends: DataFrame) -> DataFrame:
    """One row for each issued hop of a chain: hop and initiator with url, type and time.

    The initiator's url is the log's; where the log has a stack instead, the first call's, else the parent's without fragment. Hops of which the
    log has neither have no initiator. ends: sample_id, end_url."""
    steps = intermediaries(tree, chain_ends(tree, ends)).where("at > 0").select("sample_id", F.col("node_seq").alias("node_seq"))
    hops = tree.join(steps, ["sample_id", "node_seq"], "left_semi").where(F.col("parent_source").isin(*ISSUED))
    parent = tree.select("sample_id", F.col("node_seq").alias("parent_seq"), F.col("url").alias("parent_url"))
    known = log_entries_of(hops, events).join(parent, ["sample_id", "parent_seq"])
    url = F.coalesce("initiator_url", F.when(F.col("has_stack"), F.coalesce(F.try_element_at("call_urls", F.lit(1)), without_fragment(F.col("parent_url")))))
    asked = known.select("sample_id", F.col("node_seq").alias("base_seq"), F.col("ts").alias("base_ts"), F.col("full_url").alias("hop_url"), F.col("resource_type").alias("hop_type"), url.alias("initiator_url"))
    return nearest_initiator(tree, asked.where(F.col("initiator_url").isNotNull())).select("sample_id", "hop_url", "hop_type", F.col("base_ts").alias("hop_ts"), "init_url", "init_type", "init_ts")


def initiator_pairs(tree: DataFrame, issued: DataFrame) -> DataFrame:
    """(sample_id, src, dst): node numbers of initiators and their hops, both looked up by url and time. issued: rows of ``hop_initiators``."""
    node = lambda url, ts, name: exact_match(tree, issued.select("sample_id", F.col(url).alias("wanted_url"), F.col(ts).alias("wanted_ts")).distinct()).select("sample_id", F.col("wanted_url").alias(url), F.col("wanted_ts").alias(ts), F.col("node_seq").alias(name))
    found = issued.join(node("init_url", "init_ts", "src"), ["sample_id", "init_url", "init_ts"]).join(node("hop_url", "hop_ts", "dst"), ["sample_id", "hop_url", "hop_ts"])
    return found.select("sample_id", "src", "dst").distinct()


def end_urls(entries: DataFrame) -> DataFrame:
    """The url at which a sample's chain ends: the last of the chain where a large iframe covers the page."""
    return entries.withColumn("end_url", F.when(F.col("iframe") == "has_iframe", F.element_at(F.split("urls", " "), -1)).otherwise(F.col("end_url")))


def initiator_samples(rows: DataFrame) -> DataFrame:
    """(init_url, sample_id, n, urls): the hops that an initiator issues in one sample, in the log's order. rows: sample_id, seq, hop_url, init_url."""
    urls = F.transform(F.array_sort(F.collect_list(F.struct("seq", "hop_url"))), lambda x: x["hop_url"])
    return rows.groupBy("init_url", "sample_id").agg(F.count("*").alias("n"), urls.alias("urls"))


def initiator_names(rows: DataFrame) -> DataFrame:
    """(init_url, e2ld): registrable names of an initiator's hops, once each."""
    hosts = rows.select("init_url", url_netloc(F.col("hop_url")).alias("host")).distinct()
    return with_suffix(hosts, "host").where(F.col("e2ld").isNotNull()).select("init_url", "e2ld").distinct()


def initiator_summary(rows: DataFrame) -> DataFrame:
    """(init_url, freq, n_samples, n_e2lds, type) of each initiator: hops, samples, registrable names of hops, and the type first seen.

    rows: sample_id, seq, hop_url, init_url, init_type. A common initiator is a row of counts here; what it did in each sample is in
    ``initiator_samples`` and ``initiator_names``, a row for each."""
    by_sample = rows.groupBy("init_url", "sample_id").agg(F.count("*").alias("n"), F.min(F.struct("seq", "init_type")).alias("first"))
    counted = by_sample.groupBy("init_url").agg(F.sum("n").alias("freq"), F.count("*").alias("n_samples"), F.min("first")["init_type"].alias("type"))
    names = initiator_names(rows).groupBy("init_url").agg(F.count("*").alias("n_e2lds"))
    return counted.join(names, "init_url", "left").select("init_url", "freq", "n_samples", F.coalesce("n_e2lds", F.lit(0)).alias("n_e2lds"), "type")


def graph_degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree) of distinct edges (src, dst); of each sample's graph where edges have a sample_id."""
    key = ["sample_id"] if "sample_id" in edges.columns else []
    once = edges.select(*key, "src", "dst").distinct()
    ends = once.select(*key, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select(*key, "e.*")
    return ends.groupBy(*key, "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def whole_tree_edges(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_id, src, dst): edges between the nodes of each tree, from parents to children and from initiators to hops, once each."""
    children = tree.where(F.col("parent_seq").isNotNull()).select("sample_id", F.col("parent_seq").alias("src"), F.col("node_seq").alias("dst"))
    return children.unionByName(pairs.select("sample_id", "src", "dst")).distinct()


def chain_edges(tree: DataFrame, ends: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_id, src, dst): edges between the nodes of each chain, and from initiators to hops, once each. ends: sample_id, end_url."""
    steps = intermediaries(tree, chain_ends(tree, ends)).where("at > 0").select("sample_id", "node_seq")
    return whole_tree_edges(tree.join(steps, ["sample_id", "node_seq"], "left_semi"), pairs)
