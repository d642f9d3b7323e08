"""Chain graphs: chains that end on alike pages, their vertices, edges and 15 features.

Chains come as steps (sample_id, at, url) with a page's fields; every feature is a grouped aggregate over exploded steps.
Groups may be large (a common landing page): counts and sets are aggregated before they are shuffled, and no group is ever
collected into one row but for its few distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.suffix import with_suffix
from chainloom.functions.urls import file_name, host_without_port, parameter_names, url_netloc, url_path, url_query

#: Graphs with fewer chains have no hubs.
LEAST_CHAINS = 5

FEATURES = (
    "referer_ratio referer_param_ratio referer_with_param_ratio final_ratio final_param_ratio final_with_param_ratio tld_share page_share final_is_ip "
    "max_len min_len intra_domain hub_30 hub_80 self_loop"
).split()


def final_rule(url: Column) -> Column:
    """Host (with its port), page and parameter names of the url that a chain ends on."""
    return F.concat_ws("+", url_netloc(url), file_name(url_path(url)), parameter_names(url_query(url)))


def steps_of(chains: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Steps of chains (sample_id, label, urls): rule, at, n, url and the page's fields. Chains of one url go."""
    long = chains.where(F.size("urls") > 1).withColumn("rule", final_rule(F.element_at("urls", -1)))
    steps = long.select("rule", "label", "sample_id", F.size("urls").alias("n"), F.posexplode("urls").alias("at", "url"))
    steps = steps.withColumn("domain", host_without_port(url_netloc(F.col("url"))))
    steps = with_suffix(steps, "domain", rules).withColumnRenamed("suffix", "tld").drop("e2ld")
    return steps.withColumn("page", file_name(url_path(F.col("url")))).withColumn("params", parameter_names(url_query(F.col("url"))))


def vertices(steps: DataFrame, order: str = "chain_no") -> DataFrame:
    """(rule, url, vertex): the urls of a graph in the order in which they are first met; ``order`` numbers the chains."""
    first = steps.groupBy("rule", "url").agg(F.min(F.struct(order, "at")).alias("first"))
    return first.select("rule", "url", (F.row_number().over(Window.partitionBy("rule").orderBy("first")) - 1).alias("vertex"))


def step_pairs(steps: DataFrame, *columns: str) -> DataFrame:
    """Steps with ``previous_<column>`` of the step before; first steps have nulls."""
    w = Window.partitionBy("rule", "sample_id").orderBy("at")
    return steps.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns])


def edges(steps: DataFrame) -> DataFrame:
    """(rule, src, dst): distinct pairs of neighbours."""
    return step_pairs(steps, "url").where(F.col("at") > 0).select("rule", F.col("previous_url").alias("src"), F.col("url").alias("dst")).distinct()


def chain_counts(steps: DataFrame) -> DataFrame:
    """(rule, label, n_chains, max_len, min_len)."""
    return steps.where("at = 0").groupBy("rule", "label").agg(F.count("*").alias("n_chains"), F.max("n").alias("max_len"), F.min("n").alias("min_len"))


def end_ratios(steps: DataFrame, first: bool) -> DataFrame:
    """(rule, label, urls, param_sets, with_params, no_tld) over the distinct first or last urls of a graph."""
    ends = steps.where(F.col("at") == (F.lit(0) if first else F.col("n") - 1)).select("rule", "label", "url", "params", "tld").distinct()
    return ends.groupBy("rule", "label").agg(
        F.count("*").alias("urls"), F.count_distinct(F.when(F.col("params") != "", F.col("params"))).alias("param_sets"), F.sum((F.col("params") != "").cast("int")).alias("with_params"), F.max(F.col("tld").isNull().cast("int")).alias("no_tld")
    )


def final_frequencies(steps: DataFrame, column: str) -> DataFrame:
    """(column, freq): how many distinct final urls of graphs have each value, over both labels."""
    ends = steps.where(F.col("at") == F.col("n") - 1).select("rule", "label", "url", column).distinct()
    return ends.groupBy(column).agg(F.count("*").alias("freq"))


def final_share(steps: DataFrame, column: str) -> DataFrame:
    """(rule, label, share): the part of all final urls that have one of the graph's values."""
    freq = final_frequencies(steps, column)
    total = freq.agg(F.sum("freq").alias("total"))
    own = steps.where(F.col("at") == F.col("n") - 1).select("rule", "label", column).distinct()
    met = own.join(freq.withColumnRenamed(column, "value"), F.col(column).eqNullSafe(F.col("value")))
    return met.groupBy("rule", "label").agg(F.sum("freq").alias("freq")).crossJoin(F.broadcast(total)).select("rule", "label", (F.col("freq") / F.col("total")).alias("share"))


def step_flags(steps: DataFrame) -> DataFrame:
    """(rule, label, intra_domain, self_loop): whether neighbours ever share a domain or a url."""
    pairs = step_pairs(steps, "domain", "url")
    return pairs.groupBy("rule", "label").agg(F.max(F.coalesce(F.col("domain") == F.col("previous_domain"), F.lit(False)).cast("int")).alias("intra_domain"), F.max(F.coalesce(F.col("url") == F.col("previous_url"), F.lit(False)).cast("int")).alias("self_loop"))


def hubs(steps: DataFrame) -> DataFrame:
    """(rule, label, top_share): the largest share of chains that pass one url which is no final url; null under LEAST_CHAINS chains."""
    finals = steps.where(F.col("at") == F.col("n") - 1).select("rule", "label", "url").distinct()
    passed = steps.select("rule", "label", "sample_id", "url").distinct().join(finals, ["rule", "label", "url"], "left_anti")
    most = passed.groupBy("rule", "label", "url").count().groupBy("rule", "label").agg(F.max("count").alias("most"))
    return chain_counts(steps).join(most, ["rule", "label"], "left").select("rule", "label", F.when(F.col("n_chains") >= LEAST_CHAINS, F.coalesce("most", F.lit(0)) / F.col("n_chains")).alias("top_share"))


def features(steps: DataFrame) -> DataFrame:
    """rule, label, n_chains and the 15 features of each graph."""
    key = ["rule", "label"]
    per = lambda c: F.col(c) / F.col("n_chains")
    ref, fin = end_ratios(steps, True), end_ratios(steps, False)
    out = (
        chain_counts(steps).join(ref.select(*key, F.col("urls").alias("ru"), F.col("param_sets").alias("rp"), F.col("with_params").alias("rw")), key)
        .join(fin.select(*key, F.col("urls").alias("fu"), F.col("param_sets").alias("fp"), F.col("with_params").alias("fw"), "no_tld"), key)
        .join(final_share(steps, "tld").withColumnRenamed("share", "tld_share"), key).join(final_share(steps, "page").withColumnRenamed("share", "page_share"), key)
        .join(step_flags(steps), key).join(hubs(steps), key)
    )
    hub = lambda least: F.coalesce((F.col("top_share") >= least).cast("int"), F.lit(0))
    return out.select(
        *key, "n_chains", per("ru").alias("referer_ratio"), per("rp").alias("referer_param_ratio"), per("rw").alias("referer_with_param_ratio"), per("fu").alias("final_ratio"), per("fp").alias("final_param_ratio"),
        per("fw").alias("final_with_param_ratio"), "tld_share", "page_share", F.col("no_tld").alias("final_is_ip"), "max_len", "min_len", "intra_domain", hub(0.3).alias("hub_30"), hub(0.8).alias("hub_80"), "self_loop",
    )
