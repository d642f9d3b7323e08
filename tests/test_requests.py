"""Golden micro-logs: one rule of the log extraction or the parent resolution each."""

import json
import random

from chainloom.operators import requests as R
from chainloom.operators.tree import build_trees
from chainloom.sources.logs import events, log_lines, read_responses

D = "http://d/"


def sent(rid, url, kind="Document", frame="m", loader="l", initiator="other", ts=0, **more):
    request = {"url": url, "method": "GET", "headers": more.pop("headers", {})}
    if "fragment" in more:
        request["urlFragment"] = more.pop("fragment")
    params = {"requestId": rid, "frameId": frame, "loaderId": loader, "type": kind, "documentURL": more.pop("document", url), "request": request, "initiator": {"type": initiator, **more.pop("init", {})}}
    if "redirect" in more:
        params["redirectResponse"] = {"url": more.pop("redirect"), "status": 302, "headers": {"Location": url}}
    return ("Network.requestWillBeSent", params, ts)


def load(spark, log, domain="d"):
    rows = [("s", i, repr({"message": json.dumps({"message": {"method": m, "params": p}}), "timestamp": t})) for i, (m, p, t) in enumerate(log)]
    from pyspark.sql import functions as F

    return events(spark.createDataFrame(rows, "folder string, seq long, line string"), F.lit(domain))


def parents(spark, log, strict=False):
    rows = R.resolve_parents(R.target_events(load(spark, log)), strict).orderBy("seq").collect()
    return [(r.request_url, r.resource_type, r.parent_url, r.parent_source) for r in rows]


ROOT = sent("r0", D)
FAIL = lambda rid: ("Network.loadingFailed", {"requestId": rid}, 0)
ATTACH = lambda f, p="m": ("Page.frameAttached", {"frameId": f, "parentFrameId": p}, 0)


def test_root_only(spark):
    assert parents(spark, [ROOT]) == [(D, "Document", "", "root")]


def test_leftovers_go(spark):
    log = [sent("x", "http://old/"), ("Page.frameDetached", {"frameId": "q"}, 0), ROOT]
    assert [r.seq for r in R.from_start(load(spark, log)).collect()] == [2]
    assert R.from_start(load(spark, log[:2])).count() == 0


def test_crash_empties_the_sample(spark):
    assert parents(spark, [ROOT, sent("x", "http://e/", document=R.CRASH_PAGE)]) == []


def test_failures_take_the_latest_request(spark):
    log = [ROOT, sent("r1", D + "a"), sent("r1", D + "b"), FAIL("r1"), FAIL("r1"), FAIL("r1")]
    kept = [(r.seq, r.method) for r in R.target_events(load(spark, log)).orderBy("seq").collect()]
    assert kept == [(0, R.SENT), (3, R.FAILED), (4, R.FAILED), (5, R.FAILED)]


def test_failed_requests_against_a_stack(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 3), i, r.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame([(g, i, s, not s) for g, i, s in rows], "g int, seq long, sent boolean, failed boolean")
    got = {(x.g, x.request_seq, x.failure_seq) for x in R.failed_requests(df, ["g"], "seq", "sent", "failed").collect()}
    want, open_ = set(), {}
    for g, i, s in rows:
        if s:
            open_.setdefault(g, []).append(i)
        elif open_.get(g):
            want.add((g, open_[g].pop(), i))
    assert got == want


def test_redirect_takes_the_fragment(spark):
    log = [sent("r0", D, fragment="#x"), sent("r0", "http://e/", redirect=D)]
    assert parents(spark, log)[1] == ("http://e/", "Document", D + "#x", "redirectResponse")


def test_frames(spark):
    log = [ROOT, ATTACH("f"), sent("r1", "http://f/", frame="f", initiator="parser")]
    assert parents(spark, log)[1] == ("http://f/", "Document", D, "parser")
    nested = [ROOT, ATTACH("e"), ATTACH("f", "e"), sent("r1", "http://f/", frame="f", initiator="parser")]
    assert parents(spark, nested)[1][2] == D
    orphan = [ROOT, ATTACH("f", "zz"), sent("r1", "http://f/", frame="f"), sent("r2", "http://f/x.js", "Script", "f", "lf", "script")]
    assert parents(spark, orphan) == [(D, "Document", "", "root")]
    assert [r.why for r in R.rejects(R.target_events(load(spark, orphan))).collect()] == ["unknown frame"]


def test_anchor_moves_frame_and_loader(spark):
    log = [ROOT, ("Page.navigatedWithinDocument", {"frameId": "m", "url": D + "#x"}, 5), sent("r1", D + "a.js", "Script", initiator="parser")]
    assert parents(spark, log)[1:] == [(D + "#x", "Document", D, "navigatedWithinDocument"), (D + "a.js", "Script", D + "#x", "parser")]
    assert parents(spark, [ROOT, ("Page.navigatedWithinDocument", {"frameId": "none", "url": D + "#x"}, 5)]) == parents(spark, [ROOT])


def test_download_marks_the_latest_request(spark):
    log = [ROOT, sent("r1", D + "f"), sent("r2", D + "f"), ("Page.downloadWillBegin", {"url": D + "f"}, 9)]
    assert [k for _, k, _, _ in parents(spark, log)] == ["Document", "Document", "Download"]


def nav(url, reason, ts, frame="m"):
    return ("Page.frameRequestedNavigation", {"frameId": frame, "url": url, "reason": reason}, ts)


def test_navigation_gives_the_source(spark):
    log = [ROOT, nav(D + "a", "scriptInitiated", 100), sent("r1", D + "a", ts=119), nav(D + "b", "anchorClick", 200), sent("r2", D + "b", ts=220)]
    assert [s for *_, s in parents(spark, log)] == ["root", "scriptInitiated", "other"]


def test_strict_navigation_is_used_up(spark):
    log = [ROOT, nav("http://never/", "reload", 1), nav(D + "a", "scriptInitiated", 100), sent("r1", D + "a", ts=100)]
    assert parents(spark, log, strict=True)[1][3] == "other"
    assert parents(spark, log)[1][3] == "scriptInitiated"


def test_unknown_initiator(spark):
    log = [ROOT, sent("r1", D + "a", "Script", initiator="preload"), sent("r2", D + "b", "Script", initiator="script")]
    assert len(parents(spark, log, strict=True)) == 1
    assert parents(spark, log)[1][0] == D + "b"


def test_methods_by_index(spark):
    log = [ROOT, ("Network.responseReceived", {"requestId": "r0", "response": {"url": D, "status": 200, "headers": {"Refresh": "0"}}}, 0), ("Network.responseReceived", {"requestId": "r0", "response": {"url": D, "status": 200, "headers": {}}}, 0)]
    assert [r.seq for r in R.of_methods(load(spark, log)).collect()] == [0, 1]
    assert [r.seq for r in R.of_methods(load(spark, log), [0]).collect()] == [0]


def test_window_form_equals_the_fold(spark):
    r = random.Random(5)
    log, known = [ROOT], {"m"}
    for i in range(60):
        f = r.choice(["m", "a", "b"])
        if f not in known:
            known.add(f)
            log.append(ATTACH(f))
        log.append(sent(f"q{i}", f"{D}{r.randint(0, 9)}", frame=f, loader=f, initiator="script"))
    fold = [(x.seq, x.parent_url) for x in R.resolve_parents(R.target_events(load(spark, log))).orderBy("seq").collect()]
    from pyspark.sql import functions as F

    docs = R.target_events(load(spark, log)).where(F.col("method") == R.SENT).withColumn("is_root_frame", F.col("frame_id") == "m")
    window = [(x.seq, x.parent_url) for x in R.frame_parents(docs).orderBy("seq").collect()]
    for (s, p), (t, w) in zip(fold[1:], window[1:], strict=True):
        assert s == t
        first_of_frame = next(e for e in log[: s + 1] if e[0] == R.SENT and e[1]["frameId"] == log[s][1]["frameId"]) is log[s]
        if log[s][1]["frameId"] == "m" or first_of_frame:
            assert p == w


def test_logs_are_read_from_folders(spark, tmp_path):
    d = tmp_path / "d_2024-01-02-03-04-05"
    d.mkdir()
    lines = [repr({"level": "INFO", "message": json.dumps({"message": {"method": m, "params": p}}), "timestamp": t}) for m, p, t in [ROOT, sent("r1", D + "it's\x07", "Image", initiator="parser")]]
    (d / "performance_log.txt").write_text("\n".join(lines) + "\n")
    got = events(log_lines(spark, f"{tmp_path}/*/performance_log.txt")).orderBy("seq").collect()
    assert [(r.sample_id, r.start_url, r.url) for r in got] == [(d.name, D, D), (d.name, D, D + "it's\x07")]
    (d / "response_log.txt").write_text(repr({"requestId": "r", "body": "a", "base64Encoded": False, "timestamp": 1}) + "\n" + repr({"requestId": "r", "body": "b", "timestamp": 2}) + "\n" + repr({"requestId": "q", "body": "c", "timestamp": 3}))
    assert sorted((r.request_id, r.body) for r in read_responses(spark, str(tmp_path)).collect()) == [("q", "c"), ("r", "b")]
    assert read_responses(spark, str(tmp_path), spark.createDataFrame([("q",)], "request_id string")).count() == 1


def test_band_matches(spark):
    r = random.Random(1)
    a = [(i, r.randint(0, 2), r.randint(0, 500)) for i in range(80)]
    b = [(i, r.randint(0, 2), r.randint(0, 500)) for i in range(80)]
    left, right = spark.createDataFrame(a, "i int, k int, t long"), spark.createDataFrame(b, "j int, k int, u long")
    got = sorted((x.i, x.j) for x in R.band_matches(left, right, ["k"], "t", "u", 20).collect())
    assert got == sorted((i, j) for i, k, t in a for j, m, u in b if k == m and abs(t - u) < 20)


def test_loop_goes_to_the_newest(spark):
    rows = [("A", "", "root"), ("B", "A", "x"), ("C", "B", "x"), ("B", "C", "x"), ("D", "B", "x"), ("E", "nowhere", "x")]
    df = spark.createDataFrame([("s", i, u, "Document", p, s, i, "m") for i, (u, p, s) in enumerate(rows)], "sample_id string, seq long, request_url string, resource_type string, parent_url string, parent_source string, ts long, frame_id string")
    t = {r.node_seq: (r.parent_seq, r.depth) for r in build_trees(df).collect()}
    assert t == {0: (None, 1), 1: (0, 2), 2: (1, 3), 3: (2, 4), 4: (3, 5)}
