"""Trees, chains and initiators on small hand-made trees."""

import random

from pyspark.sql import functions as F

from chainloom.operators import initiators as I
from chainloom.operators import tree as T
from chainloom.sources import tables


def make(spark, parents, urls=None, ts=None, sample="s", types=None):
    """parents[i]: place of the parent of node i, or None."""
    n = len(parents)
    edges = [(sample, i, parents[i], (urls or [f"u{i}" for i in range(n)])[i], "", (ts or list(range(n)))[i], (types or ["Document"] * n)[i], "script" if i else "root") for i in range(n)]
    df = spark.createDataFrame(edges, "sample_id string, node_seq long, parent_seq long, url string, url_fragment string, ts long, resource_type string, parent_source string")
    return T.close_trees(df)


DEMO = [None, 0, 0, 1, 1, 3, 2]


def test_demo_tree(spark):
    t = make(spark, DEMO)
    depth = {r.node_seq: r.depth for r in t.collect()}
    assert depth == {0: 1, 1: 2, 2: 2, 3: 3, 4: 3, 5: 4, 6: 3}
    height = {r.node_seq: r.height for r in T.heights(t).collect()}
    assert height == {0: 4, 1: 3, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1}
    assert sorted(r.node_seq for r in T.leaves(t).collect()) == [4, 5, 6]
    assert [r.node_seq for r in T.bfs(t).orderBy("bfs_id").collect()] == [0, 1, 2, 3, 4, 6, 5]
    assert [r.node_seq for r in T.dfs(t).orderBy("dfs_id").collect()] == [0, 1, 3, 5, 4, 2, 6]


def test_intermediaries(spark):
    t = make(spark, DEMO)
    ends = spark.createDataFrame([("s", 5, None), ("s", 6, 1), ("s", 5, 1)], "sample_id string, end_seq long, start_seq long")
    got = {}
    for r in T.intermediaries(t, ends).orderBy("at").collect():
        got.setdefault((r.end_seq, r.start_seq), []).append(r.node_seq)
    assert got == {(5, None): [0, 1, 3, 5], (5, 1): [1, 3, 5]}


def test_search_prefers_depth_first(spark):
    t = make(spark, DEMO, ["r", "a", "X", "b", "c", "x", "d"])
    wanted = spark.createDataFrame([("s", "%58")], "sample_id string, wanted_url string")
    assert [r.node_seq for r in T.search_node(t, wanted).collect()] == [5]
    exact = spark.createDataFrame([("s", "x", 2)], "sample_id string, wanted_url string, wanted_ts long")
    assert [r.node_seq for r in T.exact_match(t, exact).collect()] == [2]


def test_broken_trees_are_void(spark):
    edges = spark.createDataFrame([("two", 0, None), ("two", 1, None), ("gap", 0, None), ("gap", 1, 7), ("ok", 0, None)], "sample_id string, node_seq long, parent_seq long")
    assert [r.sample_id for r in T.close_trees(edges).collect()] == ["ok"]


def brute_initiator(children, url, ts, base, want):
    """Walk that takes the last child first; the first hit stays unless a later one is strictly nearer and not the base."""
    found, stack, order = [], [0], []
    while stack:
        x = stack.pop()
        order.append(x)
        if url[x] == want and ts[x] <= ts[base]:
            found.append(x)
        stack += children[x]
    best = None
    for x in found:
        if best is None or (ts[x] > ts[best] and x != base):
            best = x
    return best


def test_nearest_initiator_against_a_walk(spark):
    r = random.Random(2)
    asked, trees, want = [], [], {}
    for k in range(30):
        n = 12
        parent = [None] + [r.randrange(i) for i in range(1, n)]
        url, ts = [r.choice("abc") for _ in range(n)], [r.randint(0, 6) for _ in range(n)]
        children = [[j for j in range(n) if parent[j] == i] for i in range(n)]
        trees += [(f"s{k}", i, parent[i], url[i], "", ts[i], "Script", "script") for i in range(n)]
        for base in range(1, n):
            w = r.choice("abc")
            asked.append((f"s{k}", base, ts[base], w))
            want[(f"s{k}", base)] = brute_initiator(children, url, ts, base, w)
    t = T.close_trees(spark.createDataFrame(trees, "sample_id string, node_seq long, parent_seq long, url string, url_fragment string, ts long, resource_type string, parent_source string"))
    got = {(x.sample_id, x.base_seq): x.init_seq for x in T.nearest_initiator(t, spark.createDataFrame(asked, "sample_id string, base_seq long, base_ts long, initiator_url string")).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_chains_and_flags(spark):
    t = make(spark, DEMO, ["http://r/", "http://a/", "http://b/", "http://c/", "http://d/", "http://e/", "http://f/"])
    requests = spark.createDataFrame([("s", 0, "http://r/", "Document"), ("s", 1, "http://x/", "Download"), ("s", 2, "http://y/", "Download")], "sample_id string, seq long, request_url string, resource_type string")
    ends = spark.createDataFrame([("s", "http://e/")], "sample_id string, end_url string")
    row = I.chains(t, requests, ends).first()
    assert (row.urls, row.methods, row.hops, row.has_download, row.download_url, row.has_iframe) == (["http://r/", "http://a/", "http://c/", "http://e/"], ["root", "script", "script", "script"], 3, True, "http://y/", False)
    framed = I.chains(t, requests, ends, spark.createDataFrame([("s", "//f/")], "sample_id string, src string")).first()
    assert (framed.urls[-1], framed.hops, framed.has_iframe) == ("http://f/", 4, True)
    assert I.chains(t, requests, ends, spark.createDataFrame([("s", "http://nowhere/")], "sample_id string, src string")).count() == 0


def test_summary_and_degrees(spark):
    rows = [("s1", 1, "http://www.a.com/1", "i", "Script"), ("s1", 2, "http://a.com/2", "i", "Other"), ("s2", 3, "http://b.org/", "i", "Other"), ("s2", 4, "http://10.0.0.1/", "j", "Script")]
    got = {r.init_url: r for r in I.initiator_summary(spark.createDataFrame(rows, "sample_id string, seq long, hop_url string, init_url string, init_type string")).collect()}
    df = spark.createDataFrame(rows, "sample_id string, seq long, hop_url string, init_url string, init_type string")
    assert (got["i"].freq, got["i"].n_samples, got["i"].n_e2lds, got["i"].type) == (3, 2, 2, "Script") and got["j"].n_e2lds == 0
    assert {(r.init_url, r.sample_id, r.n, tuple(r.urls)) for r in I.initiator_samples(df).collect()} == {("i", "s1", 2, ("http://www.a.com/1", "http://a.com/2")), ("i", "s2", 1, ("http://b.org/",)), ("j", "s2", 1, ("http://10.0.0.1/",))}
    assert {tuple(r) for r in I.initiator_names(df).collect()} == {("i", "a.com"), ("i", "b.org")}
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("b", "c")], "src string, dst string")
    assert {(r.node, r.in_degree, r.out_degree, r.degree) for r in I.graph_degrees(edges).collect()} == {("a", 1, 2, 3), ("b", 1, 1, 2), ("c", 1, 0, 1)}


def test_graphs_have_nodes_not_urls(spark):
    """Two nodes with one url, and two samples, stay apart."""
    t = make(spark, DEMO, ["http://r/", "http://a/", "http://a/", "http://c/", "http://d/", "http://e/", "http://f/"])
    ends = spark.createDataFrame([("s", "http://e/")], "sample_id string, end_url string")
    at = {r.node_seq: (r.url, r.ts) for r in t.collect()}
    issued = spark.createDataFrame([("s", at[3][0], at[3][1], at[2][0], at[2][1]), ("s", at[3][0], at[3][1], "http://nowhere/", 1)], "sample_id string, hop_url string, hop_ts long, init_url string, init_ts long")
    pairs = I.initiator_pairs(t, issued)
    (found,) = pairs.collect()
    assert found.dst == 3 and at[found.src][0] == "http://a/"
    both = t.unionByName(t.withColumn("sample_id", F.lit("other")))
    whole = {tuple(r) for r in I.whole_tree_edges(both, pairs).collect()}
    assert len(whole) == 2 * 6 + 1 - (("s", found.src, 3) in {(r.sample_id, r.parent_seq, r.node_seq) for r in t.collect()})
    chain = {tuple(r) for r in I.chain_edges(both, ends, pairs).collect()}
    assert chain < whole and all(s == "s" for s, _, _ in chain)
    assert {r.sample_id for r in I.graph_degrees(I.whole_tree_edges(both, pairs)).collect()} == {"s", "other"}


def test_ends_by_url(spark):
    t = make(spark, DEMO, ["http://r/", "http://a/", "http://b/", "http://c/", "http://d/", "http://e/", "http://f/"])
    asked = spark.createDataFrame([("s", None, "HTTP://E/"), ("s", "http://a/", "http://e/"), ("s", "http://R/", "http://c/"), ("s", "http://x/", "http://c/"), ("s", None, "http://x/")], "sample_id string, start_url string, end_url string")
    at = {r.url: r.node_seq for r in t.collect()}
    loose = {(None, at["http://e/"]), (at["http://a/"], at["http://e/"]), (at["http://r/"], at["http://c/"])}
    assert {(r.start_seq, r.end_seq) for r in T.ends_by_url(t, asked).collect()} == loose
    assert {(r.start_seq, r.end_seq) for r in T.ends_by_url(t, asked, True).collect()} == loose - {(at["http://a/"], at["http://e/"])}


def test_node_file_round_trip(spark):
    t = make(spark, DEMO)
    nodes = tables.node_rows(t)
    rows = {r.node_id: (r.url, r.parent_id, r.children) for r in nodes.collect()}
    assert rows["node_0"] == ("u0", "", "node_1 node_2")
    assert rows["node_6"] == ("u5", "node_3", "")
    back = T.recover_trees(nodes)
    assert sorted((r.url, r.depth) for r in back.collect()) == sorted((r.url, r.depth) for r in t.collect())
    text = [r.line for r in tables.printed_tree(t).collect()]
    assert text[0] == "u0" and text[1].startswith("-> u1 (Type: Document; Method: script") and text[2].startswith("---> u3") and text[3].startswith("-----> u5".replace("-----", "-----"))


def test_end_urls(spark):
    df = spark.createDataFrame([("has_iframe", "a b", "x"), ("no_iframe", "a b", "x")], "iframe string, urls string, end_url string")
    assert [r.end_url for r in I.end_urls(df).select("end_url", F.lit(1)).collect()] == ["b", "x"]
