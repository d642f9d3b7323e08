"""From a raw log to chains, initiators and their graphs."""

import json

from pyspark.sql import functions as F

from chainloom.operators import hmg
from chainloom.operators import initiators as I
from chainloom.operators import requests as R
from chainloom.operators.tree import build_trees, tree_edges
from chainloom.sources.logs import events
from tests.test_requests import ATTACH, D, nav, sent


def lines(spark, log):
    rows = [("s", i, repr({"level": "INFO", "message": json.dumps({"message": {"method": m, "params": p}}), "timestamp": t})) for i, (m, p, t) in enumerate(log)]
    return spark.createDataFrame(rows, "folder string, seq long, line string")


LOG = [
    sent("r0", D, ts=0),
    sent("r1", D + "a.js", "Script", initiator="parser", ts=5),
    sent("r2", D + "b.js", "Script", initiator="parser", ts=6),
    nav("http://e/#top", "scriptInitiated", 10),
    sent("r3", "http://e/", fragment="#top", loader="l2", initiator="script", ts=12, init={"stack": {"callFrames": [{"url": ""}, {"url": D + "A.js"}, {"url": D + "b.js"}]}}),
    ATTACH("f"),
    sent("r4", "http://frame/", frame="f", loader="l3", initiator="script", ts=20, init={"url": D + "b.js"}),
    sent("r5", "http://end/x", loader="l4", initiator="other", ts=30, redirect="http://e/"),
    sent("r6", "http://end/file.zip", loader="l4", initiator="script", ts=40, init={"stack": {"callFrames": [{"url": ""}]}}),
    ("Page.downloadWillBegin", {"url": "http://end/file.zip"}, 41),
]


def test_log_to_initiators(spark):
    log = R.target_events(events(lines(spark, LOG), F.lit("d")))
    requests = R.resolve_parents(log)
    tree = build_trees(requests)
    urls = {r.url + r.url_fragment: (r.depth, r.parent_source, r.resource_type) for r in tree.collect()}
    assert urls == {
        D: (1, "root", "Document"), D + "a.js": (2, "parser", "Script"), D + "b.js": (2, "parser", "Script"), "http://e/#top": (2, "scriptInitiated", "Document"),
        "http://frame/": (3, "script", "Document"), "http://end/x": (3, "redirectResponse", "Document"), "http://end/file.zip": (4, "script", "Download"),
    }
    ends = spark.createDataFrame([("s", "http://END/x")], "sample_id string, end_url string")
    chain = I.chains(tree, requests, ends).first()
    assert (chain.urls, chain.methods, chain.hops, chain.has_download, chain.download_url) == ([D, "http://e/#top", "http://end/x"], ["root", "scriptInitiated", "redirectResponse"], 2, True, "http://end/file.zip")
    found = I.hop_initiators(tree, log, ends).collect()
    assert [(r.hop_url, r.hop_type, r.hop_ts, r.init_url, r.init_type, r.init_ts) for r in found] == [("http://e/#top", "Document", 12, D + "a.js", "Script", 5)]
    framed = I.chains(tree, requests, ends, spark.createDataFrame([("s", "http://frame")], "sample_id string, src string")).first()
    assert (framed.urls[-1], framed.methods[-1], framed.hops, framed.has_iframe) == ("http://frame/", "script", 3, True)
    deep = I.hop_initiators(tree, log, spark.createDataFrame([("s", "http://frame/")], "sample_id string, end_url string")).collect()
    assert sorted((r.hop_url, r.init_url) for r in deep) == [("http://e/#top", D + "a.js"), ("http://frame/", D + "b.js")]
    name = {r.node_seq: r.url + r.url_fragment for r in tree.collect()}
    edges = I.whole_tree_edges(tree, I.initiator_pairs(tree, I.hop_initiators(tree, log, ends)))
    assert {(D, "http://e/#top"), (D + "a.js", "http://e/#top"), ("http://e/#top", "http://end/x")} <= {(name[r.src], name[r.dst]) for r in edges.collect()}
    bare = log.withColumn("initiator_url", F.lit(None).cast("string")).withColumn("has_stack", F.lit(False))
    assert I.hop_initiators(tree, bare, ends).count() == 0


def test_log_to_message_graph(spark):
    raw = [
        ("Network.requestWillBeSent", {"requestId": "1", "request": {"url": "http://a.com/", "method": "GET", "headers": {}}}, 0),
        ("Network.requestWillBeSent", {"requestId": "1", "request": {"url": "http://b.com/x", "method": "GET", "headers": {"Referer": "http://a.com/"}}, "redirectResponse": {"url": "http://a.com/", "status": 301, "headers": {"LOCATION": "http://b.com/x"}}}, 1),
        ("Network.responseReceived", {"requestId": "1", "response": {"url": "http://b.com/x", "status": 403, "headers": {}}}, 2),
    ]
    n = hmg.nodes(hmg.messages(events(lines(spark, raw), F.lit("a.com"))))
    assert [(r.sn, r.status, r.location, r.referer) for r in n.orderBy("sn").collect()] == [(0, 301, "http://b.com/x", None), (1, 403, None, "http://a.com/")]
    assert {(r.src, r.dst, r.edge_type) for r in hmg.edges(n).collect()} == {(0, 1, "location"), (0, 1, "referer")}
    row = hmg.features(n, hmg.edges(n)).first()
    assert (row.node_cnt, row.redirect_cnt, row.cross_domain_cnt, row.max_path_len, row.status_40x_ratio) == (2, 1, 1, 2, 0.5)
