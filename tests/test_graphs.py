"""Chain graphs and message graphs on hand-made cases and against plain Python."""

import random

import numpy as np
import pytest

from chainloom.operators import chaingraph as C
from chainloom.operators import hmg as H
from chainloom.operators import ml
from chainloom.sources.schemas import HMG_FEATURES


def test_chain_pair_is_one_graph(spark):
    chains = [
        ("s1", "malicious", ["http://a.com/x?p=1", "http://m.com/", "http://f.com/land.php?id=1"]),
        ("s2", "malicious", ["http://b.com/", "http://f.com/land.php?id=2"]),
        ("s3", "benign", ["http://b.com/"]),
        ("s4", "malicious", ["http://c.com/", "http://c.com/", "http://10.0.0.1/z"]),
    ]
    steps = C.steps_of(spark.createDataFrame(chains, "sample_id string, label string, urls array<string>"))
    f = {r.rule: r for r in C.features(steps).collect()}
    assert set(f) == {"f.com+land.php+id", "10.0.0.1+z+"}
    g = f["f.com+land.php+id"]
    assert (g.n_chains, g.max_len, g.min_len, g.referer_ratio, g.referer_param_ratio, g.referer_with_param_ratio) == (2, 3, 2, 1.0, 0.5, 0.5)
    assert (g.final_ratio, g.final_param_ratio, g.final_with_param_ratio, g.final_is_ip, g.intra_domain, g.self_loop, g.hub_30, g.hub_80) == (1.0, 0.5, 1.0, 0, 0, 0, 0, 0)
    assert (round(g.tld_share, 6), round(g.page_share, 6)) == (round(2 / 3, 6), round(2 / 3, 6))
    h = f["10.0.0.1+z+"]
    assert (h.final_is_ip, h.intra_domain, h.self_loop) == (1, 1, 1)


def test_hubs_need_five_chains(spark):
    def chains(n, through):
        return [(f"s{i}", "m", ["http://r%d.com/" % i, *(["http://hub.com/"] if i < through else []), "http://f.com/p"]) for i in range(n)]

    for n, through, want in ((5, 4, (1, 1)), (5, 2, (1, 0)), (5, 1, (0, 0)), (4, 4, (0, 0))):
        row = C.features(C.steps_of(spark.createDataFrame(chains(n, through), "sample_id string, label string, urls array<string>"))).first()
        assert (row.hub_30, row.hub_80) == want


def test_vertices_are_numbered_as_met(spark):
    rows = [("g", "m", 1, k, u) for k, u in enumerate("abca")] + [("g", "m", 2, k, u) for k, u in enumerate("dba")]
    steps = spark.createDataFrame(rows, "rule string, label string, chain_no int, at int, url string")
    assert {r.url: r.vertex for r in C.vertices(steps).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


MESSAGES = "sample_id string, request_id string, seq long, is_request boolean, url string, referer string, http_method string, status int, is_redirect boolean, redirect_location string, redirect_status int"


def test_redirect_nodes_and_edges(spark):
    rows = [
        ("s", "1", 0, True, "http://a.com/", None, "GET", None, False, None, None),
        ("s", "1", 1, True, "http://a.com/b", None, "GET", None, True, "/b", 302),
        ("s", "1", 2, False, "http://a.com/b", None, None, 200, False, None, None),
        ("s", "2", 3, True, "http://c.com/x?q=1&r", "http://a.com/b", "POST", None, False, None, None),
        ("s", "2", 4, False, "http://c.com/x", None, None, 404, False, None, None),
        ("s", "3", 5, False, "http://lone.com/", None, None, 200, False, None, None),
        ("s", "4", 6, True, "http://10.0.0.1/", None, "GET", None, False, None, None),
    ]
    n = H.nodes(spark.createDataFrame(rows, MESSAGES))
    e = H.edges(n)
    assert [(r.sn, r.url, r.status, r.location) for r in n.orderBy("sn").collect()] == [(0, "http://a.com/", 302, "http://a.com/b"), (1, "http://a.com/b", 200, None), (2, "http://c.com/x?q=1&r", 404, None)]
    assert {(r.src, r.dst, r.edge_type) for r in e.collect()} == {(0, 1, "location"), (1, 2, "referer")}
    f = H.features(n, e).first().asDict()
    assert list(f) == ["sample_id", *HMG_FEATURES]
    want = {"node_cnt": 3, "status_40x_ratio": 1 / 3, "referer_ratio": 1 / 3, "ip_ratio": 0, "post_ratio": 1 / 3, "redirect_cnt": 1, "cross_domain_cnt": 0, "max_path_len": 2, "longest_path_len": 2, "component_cnt": 1, "isolate_ratio": 0,
            "mpr_node_sn": 2, "same_pr_domain_ratio": 0, "mpr_url_len": 20, "mpr_url_path_depth": 1, "mpr_url_query_len": 5, "mpr_url_query_cnt": 2, "mdc_node_sn": 1, "mdc_node_dc": 1, "same_dc_domain_ratio": 0.5, "mdc_closeness": 0.5, "max_betweenness": 0.5, "nonzero_betweenness_cnt": 1}
    for k, v in want.items():
        assert f[k] == pytest.approx(v), k


def test_parallel_edges_keep_the_last_type(spark):
    e = spark.createDataFrame([("s", 0, 1, "location"), ("s", 0, 1, "referer")], "sample_id string, src int, dst int, edge_type string")
    assert [(r.src, r.dst, r.edge_type) for r in H.graph(e).collect()] == [(0, 1, "referer")]


def random_dag(r, n):
    e = sorted({(a, b) for a, b in (sorted(r.sample(range(n), 2)) for _ in range(2 * n))})
    return np.array([a for a, _ in e]), np.array([b for _, b in e])


def test_graph_measures_against_plain_python():
    r = random.Random(7)
    for _ in range(30):
        n = r.randint(3, 9)
        src, dst = random_dag(r, n)
        step = {(a, b) for a, b in zip(src.tolist(), dst.tolist(), strict=True)}
        paths = {(i,): 0 for i in range(n)}
        frontier = list(paths)
        while frontier:
            frontier = [(*p, b) for p in frontier for a, b in step if a == p[-1]]
            paths.update(dict.fromkeys(frontier, 0))
        assert H.longest_path(n, src, dst) == max(len(p) - 1 for p in paths)
        short = {}
        for p in paths:
            k = (p[0], p[-1])
            if len(p) > 1 and (k not in short or len(p) < len(short[k][0])):
                short[k] = [p]
            elif len(p) > 1 and len(p) == len(short[k][0]):
                short[k].append(p)
        want = np.zeros(n)
        for ps in short.values():
            for p in ps:
                for v in p[1:-1]:
                    want[v] += 1 / len(ps)
        assert np.allclose(H.betweenness(n, src, dst), want / ((n - 1) * (n - 2)))
        v = r.randrange(n)
        far = [len(ps[0]) - 1 for (a, b), ps in short.items() if b == v]
        assert H.closeness(n, src, dst, v) == pytest.approx(len(far) / sum(far) * len(far) / (n - 1) if far else 0)
        pr = H.pagerank(n, src, dst)
        assert pr.sum() == pytest.approx(1)
        matrix = np.full((n, n), 0.15 / n)
        out = np.bincount(src, minlength=n)
        for a in range(n):
            for b in range(n):
                matrix[b, a] += 0.85 * ((1 / out[a] if (a, b) in step else 0) if out[a] else 1 / n)
        exact = np.linalg.matrix_power(matrix, 200) @ np.full(n, 1 / n)
        assert np.abs(pr - exact).max() < 1e-4


def test_components_of_a_large_graph(spark):
    r = random.Random(4)
    n = 300
    e = [(i, i + 1) for i in range(100)] + [tuple(r.sample(range(150, n), 2)) for _ in range(100)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    spark.sparkContext.setCheckpointDir("/tmp/chainloom-test-checkpoints")
    got = {x.id: x.component for x in H.weak_components(spark.range(n), spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in range(n)}


def test_split_and_roc(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 2, float(i % 7), float(i % 2)) for i in range(200)], "sample string, label int, x double, y double")
    parts = ml.split(rows)
    assert {(r.label, r.is_train): r["count"] for r in parts.groupBy("label", "is_train").count().collect()} == {(0, True): 90, (0, False): 10, (1, True): 90, (1, False): 10}
    assert sorted(r.sample for r in parts.where("is_train").collect()) == sorted(r.sample for r in ml.split(rows.repartition(3)).where("is_train").collect())
    points = sorted((r.fp, r.tp) for r in ml.roc(rows.withColumnRenamed("y", "score")).collect())
    assert points == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    row = ml.evaluate(rows, ["x", "y"], trees=5, depth=3).first()
    assert (row.n_train, row.n_test, row.accuracy, row.auc) == (180, 20, 1.0, 1.0)


