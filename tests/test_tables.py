"""Tags, TSV sources and sinks, and streams."""

import json

from chainloom.operators import tags as G
from chainloom.sources import schemas, tables
from chainloom.streaming import ingest

PAGE = """<html><head><script>var a='<a href=x>';</script></head><body>
<a href="/1">one</a><a href='/2'><img src=i><b>two</b></a>
<map name="m"><area shape="rect" coords="1,2,3,4" href="/3"><area shape="circle" coords="9,9,2"></map><img usemap="#m" src="p">
<div onclick="go('x')">click
me</div><frame src="/f"><iframe src="/g"></iframe>
</body></html>"""


def test_tags_of_a_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    rows = G.page_tags(df).orderBy("at").collect()
    assert [(r.id, r.tag_type, r.name) for r in rows] == [(1, "a", "a"), (1, "a", "a"), (1, "area", "area"), (1, "area", "area"), (1, "img", "img"), (1, "onclick", "div"), (1, "iframe", "frame"), (1, "iframe", "iframe")]
    assert rows[1].outer_html == "<a href='/2'><img src=i><b>two</b></a>" and rows[1].inner == 2
    assert rows[2].attributes["coords"] == "1,2,3,4" and rows[2].parent_map == "m"
    assert rows[5].outer_html == "<div onclick=\"go('x')\">click me</div>"
    assert [r.name for r in G.of_type(G.page_tags(df), "iframe").orderBy("order").collect()] == ["iframe", "frame"]


def test_rects_of_links_and_areas(spark):
    R = "struct<x:double,y:double,width:double,height:double>"
    box = (1.0, 2.0, 3.0, 4.0)
    links = spark.createDataFrame([(1, True, box, []), (2, False, box, []), (3, True, box, [(True, box), (True, box), (False, (9.0, 9.0, 9.0, 9.0))])], f"id int, visible boolean, rect {R}, inner array<struct<visible:boolean,rect:{R}>>")
    assert {r.id: len(r.rects) for r in G.link_rects(links).collect()} == {1: 1, 2: 0, 3: 1}
    areas = spark.createDataFrame([("p", "m", None, "rect", "1,2,3,4"), ("p", None, "n", "circle", "5,5,1"), ("p", "m", None, "poly", "1"), ("p", "other", None, "rect", "1,2,3,4")], "page string, map_name string, map_id string, shape string, coords string")
    images = spark.createDataFrame([("p", "#m", True, (10.0, 10.0, 5.0, 5.0)), ("p", "#n", True, (20.0, 20.0, 5.0, 5.0)), ("p", "#other", False, box)], f"page string, usemap string, visible boolean, rect {R}")
    assert sorted(tuple(r.rect) for r in G.area_rects(areas, images).collect()) == [(11.0, 12.0, 2.0, 2.0), (24.0, 24.0, 2.0, 2.0)]


def test_tag_files_of_both_layouts(spark, tmp_path):
    rect = "[{'x': 0, 'y': 0, 'width': 1664, 'height': 919}]"
    small = "[{'x': 0, 'y': 0, 'width': 100, 'height': 100}]"
    a = tmp_path / "root" / "s1"
    (a / "iframe_0").mkdir(parents=True)
    (a / "redirection_tags.txt").write_text(f'iframe_0\t1\t{small}\t<iframe src="/small">\niframe_1\t1\t{rect}\t<iframe id=x src=" /big?a=1&amp;b ">\niframe_2\t0\t{rect}\t<iframe src="/hidden">\na_0\t1\t[]\t<a href="x">\n')
    (a / "iframe_0" / "redirection_tags.txt").write_text(f"iframe_0\t1\t{rect}\t<iframe src=/nested>\n")
    b = tmp_path / "root" / "s2"
    b.mkdir()
    (b / "redirection_tags.txt").write_text(f"x_0\tiframe\t1\t{rect}\t<frame name='f' src='/typed'>\n")
    tags = tables.read_tags(spark, str(tmp_path / "root"))
    assert {(r.sample_id, r.frame_path, r.tag_id, r.tag_type) for r in tags.collect()} >= {("s1", "", "iframe_1", "iframe"), ("s1", "iframe_0", "iframe_0", "iframe"), ("s2", "", "x_0", "iframe"), ("s1", "", "a_0", "a")}
    assert {(r.sample_id, r.src) for r in G.large_iframes(tags).collect()} == {("s1", "/big?a=1&b"), ("s2", "/typed")}


def test_chain_files(spark, tmp_path):
    line = lambda d, urls, label="malicious", hops=1: "\t".join([d, label, "src", urls.split()[-1], urls, "root;script", str(hops), "no_iframe", "no_download", ""])
    paths = {}
    for name, lines in {"malicious": [line("a", "u v"), line("b", "w x"), line("a", "u y")], "current": [line("b", "n m")], "benign": [line("c", "k l", "benign", 0)]}.items():
        p = tmp_path / f"{name}.txt"
        p.write_text("\n".join(lines) + "\n")
        paths[name] = str(p)
    got = lambda **k: {r.sample_id: r.urls for r in tables.load_chains(spark, paths, **k).collect()}
    assert got() == {"a:src": ["u", "y"], "b:src": ["n", "m"], "c:src": ["k", "l"]}
    assert got(label="benign") == {"c:src": ["k", "l"]}
    assert got(label="malicious", sample="a:src") == {"a:src": ["u", "y"]}
    assert tables.load_chains(spark, paths, label="odd") is None
    both = tables.read_union(spark, {k: paths[k] for k in ("malicious", "benign")}, schemas.CHAINS)
    assert {r.origin: r["count"] for r in both.groupBy("origin").count().collect()} == {"malicious": 3, "benign": 1}
    assert tables.with_redirects(both).count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "benign", "s", "v", ["u", "v"], ["root", "script"], 1, False, True, "x")], "domain string, label string, source string, end_url string, urls array<string>, methods array<string>, hops int, has_iframe boolean, has_download boolean, download_url string")
    tables.save_chains(rows, str(tmp_path / "chains"))
    back = tables.read_tsv(spark, str(tmp_path / "chains"), schemas.CHAINS).first()
    assert tuple(back) == ("d", "benign", "s", "v", "u v", "root;script", 1, "no_iframe", "has_download", "x")
    tags = spark.createDataFrame([("s", "", "a", 5, True, "[]", "<a>"), ("s", "", "a", 2, True, "[]", "<b>"), ("s", "", "odd", 1, True, "[]", "<i>")], "sample_id string, frame_path string, tag_type string, seq int, visible boolean, rects string, outer_html string")
    tables.save_tags(tags, str(tmp_path / "tags"))
    assert {(r.tag_id, r.outer_html) for r in spark.read.parquet(str(tmp_path / "tags")).collect()} == {("a_0", "<b>"), ("a_1", "<a>"), ("iframe_0", "<i>")}
    features = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0)], "sample string, label string, node_cnt double")
    assert tables.save_features(features, str(tmp_path / "f")) == 1
    points = spark.createDataFrame([(0.0, 0.5, 1.0)], "fp double, tp double, threshold double")
    tables.save_roc(points, str(tmp_path / "roc"))
    assert tables.read_tsv(spark, str(tmp_path / "roc"), schemas.ROC).count() == 1
    init = spark.createDataFrame([("d", "m", "s", "h", "Script", 1, "i", "Script", 0)], schemas.INITIATORS)
    tables.save_initiators(init, str(tmp_path / "init"))
    tables.write_tsv(init, str(tmp_path / "init_tsv"))
    assert tables.load_initiators(spark, str(tmp_path / "init_tsv")).first().sample_id == "d:s"


def test_sample_paths(spark):
    entries = spark.createDataFrame([("d", "known"), ("e", "e_2024")], "domain string, source string")
    roots = spark.createDataFrame([("known", "/r")], "source string, root string")
    assert {r.path for r in tables.sample_paths(entries, roots, "/default").collect()} == {"/r/d", "/default/e_2024"}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*20,0) AS ts, id % 2 AS user_id FROM range(12)")
    rows.write.parquet(folder)
    stream = ingest.follow_events(spark, folder, rows.schema)
    got = ingest.run_available(ingest.tumbling(stream, "ts", "1 hour", "0 seconds", "user_id"), "tumbling_out", str(tmp_path / "c1"), "complete")
    assert sum(r.n for r in got.collect()) == 12 and got.count() == 8
    ses = ingest.run_available(ingest.sessions(ingest.follow_events(spark, folder, rows.schema), "ts", "30 minutes", "0 seconds", "user_id"), "sessions_out", str(tmp_path / "c2"), "append")
    assert all(r.n == 1 for r in ses.collect())
    uniq = ingest.run_available(ingest.unique_samples(ingest.follow_events(spark, folder, rows.schema), "ts", "user_id"), "unique_out", str(tmp_path / "c3"))
    assert uniq.count() == 2


def test_page_load_state_gives_what_is_new():
    """The resolver behind the stream: reading in two pieces gives the same requests as reading at once."""
    send = lambda seq, url, frame, kind="Document": (seq, seq, "Network.requestWillBeSent", frame, None, "l", kind, url, None, "script", None, None)
    rows = [send(0, "http://d/", "m"), send(1, "http://d/a.js", "m", "Script"), send(2, "http://d/b", "m"), (3, 3, "Page.downloadWillBegin", None, None, None, None, "http://d/b", None, None, None, None)]
    whole = ingest.PageLoad.resolve(rows)
    first = ingest.PageLoad.resolve(rows[:3])
    assert json.loads(json.dumps(first[:2])) == whole[:2]
    assert first[2][2] == "Document" and whole[2][2] == "Download"


def test_manifest(spark, tmp_path):
    p = tmp_path / "cur.txt"
    p.write_text("d\td_2024\t1\t2\t1\thttp://d/\thttp://e/\ttitle\n")
    assert tables.manifest_samples(spark, str(p)).select("sample_id", "end_url").first() == ("d:d_2024", "http://e/")


def test_stream_of_parents(spark, tmp_path):
    """A log that arrives in two files gives the requests of the whole log, the changed ones again."""
    rows = [
        ("s", 0, 0, "Network.requestWillBeSent", "m", None, "l", "Document", "http://d/", None, "other", None, None),
        ("s", 1, 1, "Network.requestWillBeSent", "m", None, "l", "Script", "http://d/a.js", None, "parser", None, None),
        ("s", 2, 2, "Network.requestWillBeSent", "m", None, "l2", "Document", "http://d/b", None, "script", None, None),
        ("s", 3, 3, "Page.downloadWillBegin", None, None, None, None, "http://d/b", None, None, None, None),
    ]
    schema = "sample_id string, " + ingest.PageLoad.STATE
    folder = str(tmp_path / "log")
    got = []
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.stream_parents(ingest.follow_events(spark, folder, spark.createDataFrame([], schema).schema))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(got) == (3, 4)[k]
    assert got[-1][1:6] == (2, "http://d/b", "Download", "http://d/", "script")
