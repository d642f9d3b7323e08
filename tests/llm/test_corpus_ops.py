"""Toxicity, top-k, suffix arrays, URL filters, near-duplicates and the pipeline against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import neardup, suffix, topk, toxicity, urls
from chainloom.llm.common import words


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("value", F.lit(1)).withColumn("fp", F.lit(1)).withColumn("key", F.lit(2)).withColumn("marks", F.lit(3))


# ---- toxicity


def toy_labels(spark, n=400):
    r = random.Random(1)
    clean = ["river", "mountain", "letter", "window", "garden", "paper", "summer", "market", "village", "teacher"]
    bad = ["idiot", "moron", "loser", "scum"]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(clean, k=30)
        if i % 4 == 0:
            w[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = toy_labels(spark)
    return toxicity.train(docs, labels)


def test_clean_and_toxic_are_told_apart(scorer):
    assert scorer.score("river mountain letter you idiot window garden") >= 0.5
    assert scorer.score("river mountain letter window garden market") < 0.5
    assert scorer.score("") < 0.5


@pytest.mark.parametrize("written", ["1d10t", "i d i o t", "idiooooot", "i.d.i.o.t", "!diot", "m0r0n", "l0ser!", "$cum", "s-c-u-m", "MORON", "iiidiot,", "iiddiioott", "r i v e r i d i o t", "i d i o t p a p e r", "i  d\ni o\tt", "1 d 1 0 t", "m o r o n l o s e r"])
def test_disguises_are_restored(scorer, written):
    assert scorer.score(f"river mountain letter {written} window garden market village teacher") >= 0.5


@pytest.mark.parametrize("written", ["2024", "3.14", "a b c d", "www.example.com/page1", "x" * 5000, "1" * 5000, "- - - - -", "٣٤"])
def test_harmless_oddities_stay_clean(scorer, written):
    assert scorer.score(f"river mountain letter {written} window garden market village teacher") < 0.5


def test_viterbi_finds_the_cheapest_path():
    model = toxicity.CharModel({"^^a": 5, "^ab": 4, "ab$": 4, "^^b": 1, "^ba": 1, "ba$": 1})
    for unit in ("4b", "a8", "aab", "a.b", "48", "a b", "a b a b"):
        def walk(i, h, cost, out, unit=unit):
            lattice = toxicity.lattice(unit)
            if i == len(lattice):
                yield cost + model.cost(h, "$"), out
                return
            for c, k in lattice[i]:
                to = "^^" if c == " " else h[1] + c if c else h
                yield from walk(i + 1, to, cost + k + (model.cost(h, c.replace(" ", "$")) if c else 0), out + c)

        best = min(walk(0, "^^", 0.0, ""))
        assert toxicity.viterbi(unit, model) == best[1]


def test_copies_count_once_and_shared_lines_do_not():
    r = random.Random(3)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line, base = w(12), w(100)
    near = [*base[:50], "x", *base[51:]]
    texts = {5: base, 3: near, 9: base, 20: line + w(100), 21: line + w(100), 30: ["short"], 31: ["short"]}
    rows = [(i, 0, toxicity.sketch(" ".join(t))) for i, t in texts.items()]
    assert toxicity.without_copies(rows) == toxicity.without_copies(rows[::-1]) == [3, 20, 21, 30]
    assert toxicity.without_copies([(1, 0, rows[0][2]), (2, 1, rows[0][2])]) == [1, 2]


def test_too_many_marks_fail(spark, monkeypatch):
    docs, labels = toy_labels(spark, 100)
    monkeypatch.setattr(toxicity, "MAX_MARKS", 2)
    with pytest.raises(ValueError, match="marks"):
        toxicity.train(docs, labels)


def test_the_score_is_what_its_parts_say(spark, scorer):
    """By hand: marks of plain words, the summary, the logistic function."""
    docs, _ = toy_labels(spark)
    for row in docs.limit(40).collect():
        units = set(row.text.split())
        found = []
        for u in units:
            variants = {u} | ({toxicity.viterbi(u, toxicity.CharModel(scorer.trigrams))} if any(a == b for a, b in zip(u, u[1:], strict=False)) else set())
            found.append(max(max([scorer.marks.get("=" + x, 0.0)] + [scorer.marks.get("^" + x[:k], 0.0) for k in (4, 5, 6) if len(x) > k]) for x in variants))
        found = [x for x in found if x]
        z = scorer.beta[0] + scorer.beta[1] * max(found, default=0) / 4 + scorer.beta[2] * np.log1p(sum(found)) + scorer.beta[3] * min(4.0, 10 * sum(found) / (10 + len(units)))
        assert scorer.score(row.text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_tokens_that_are_not_decoded_have_no_mark(scorer):
    r = random.Random(14)
    scorer.score("x")
    for _ in range(3000):
        w = r.choice(["idiot", "moron", "loser", "scum", "river", "letter", "idle", "school", "looser"])
        t = "".join(c * r.choice([1, 1, 2, 3]) + r.choice(["", "", "", ".", "-", ","]) for c in w)
        if not scorer.may_mark(t):
            assert scorer.weight(t) == max((scorer.marks.get(n, 0.0) for x in toxicity.restore(t, scorer.chars) for n in toxicity.names_of(x)), default=0.0)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = toy_labels(spark, 600)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [r for r in labels.select("doc_id", "toxic").collect() if __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all((scored[r.doc_id] >= 0.5) == (r.toxic == 1) for r in held)


def test_toxicity_with_clashing_columns(spark, scorer):
    docs, labels = toy_labels(spark, 60)
    odd = docs.selectExpr("doc_id", "text", "'a' score", "'b' toxic", "1 units", "2 shingle", "3 sketch", "4 other")
    assert {r.doc_id: r.score for r in toxicity.score(odd, scorer).collect()} == {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
    assert toxicity.train(odd, labels.withColumn("other", F.lit("x")).withColumn("text", F.lit("y"))).marks == toxicity.train(docs, labels).marks
    assert toxicity.reject(odd, scorer).columns == odd.columns
    assert toxicity.train(docs.where("false"), labels).score("x") < 1


def test_toxicity_tables(spark, scorer):
    docs = docs_of(spark, [(1, "you idiot moron"), (2, None), (3, ""), (1, "you idiot moron")])
    got = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, scorer).collect())
    assert got[0] == got[1] and got[2][1] == got[3][1]
    assert toxicity.score(docs.where("false"), scorer).count() == 0
    assert [r.doc_id for r in toxicity.reject(docs, scorer).orderBy("doc_id").collect()] == [2, 3] and toxicity.reject(docs, scorer).columns == docs.columns


def test_no_labels(spark):
    docs, labels = toy_labels(spark, 8)
    for subset, want in ((labels.where("false"), 0), (labels.where("toxic = 1"), 1), (labels.where("toxic = 0"), 0)):
        s = toxicity.train(docs, subset)
        assert round(s.score("anything")) == want
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert round(toxicity.train(docs, both).score("anything")) == 0


def test_trigrams_cover_all_documents(spark):
    docs, labels = toy_labels(spark, 40)
    more = [(1000 + i, f"Квашня kvas{chr(97 + i)}t zzzz kvassa") for i in range(20)] + [(2000, None)]
    whole = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = collections.Counter()
    for r in whole.collect():
        for w in set((r.text or "").lower().split()):
            if w.isalpha() and w != "zzzz":
                want.update(("^^" + w + "$")[i : i + 3] for i in range(len(w) + 1))
    assert toxicity.train(whole, labels).trigrams == want and want["^^к"] == 20


# ---- top-k


def brute_top(vectors, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for qi, q in ok:
        if qi % every == 0:  # equal rows give equal results
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ok if i != qi and len(v) == len(q))[:k]
            out |= {(qi, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def test_topk_against_brute_force(spark):
    r = random.Random(4)
    v = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (450, []), (451, []), (500, [0.0] * 6), (550, [1.0, 2.0]), (551, [3.0, 4.0]), (600, [-1.5e30, 0.0, 0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("dim", F.lit("x"))
    want = {x for x in brute_top(v) if abs(x[3]) < 2**63}
    for block in (64, 10_000):
        got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df.where("vec_id <> 600"), block=block, query_block=3).collect()}
        assert got == brute_top([x for x in v if x[0] != 600])
    assert len(topk.top_k(df).collect()) == len(brute_top(v)) and want
    assert topk.top_k(df.where("false")).count() == 0


def test_repeated_queries(spark):
    r = random.Random(7)
    v = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(21)]
    rows = [*v, v[0], (0, [1.0, -2.0, 0.5, 3.0]), v[7]]
    got = collections.Counter((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = collections.Counter()
    for q in (v[0][1], [1.0, -2.0, 0.5, 3.0]):
        best = sorted((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(q, x, strict=True)), i) for i, x in rows if i != 0)[:5]
        want.update((0, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert got == want
    import duckdb

    embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<float>").toArrow()  # noqa: F841
    assert collections.Counter(duckdb.sql(topk.OP2_SQL).fetchall()) == want


def test_threshold_stops_early():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(5000, 3)))
    q = x[:3]
    got = topk.threshold_search(q, np.arange(3), x, np.arange(5000))
    for i in range(3):
        s = x @ q[i]
        want = sorted((-int(s[j]), j) for j in range(5000) if j != i)[:5]
        assert [(a, b) for c, b, a in got if c == i] == [(-s, j) for s, j in want]


# ---- suffix arrays


def test_suffix_array_is_sorted():
    for seed in range(150):
        r = random.Random(seed)
        d = bytes(r.choice(b"ab\x00\xff"[: r.randint(1, 4)]) for _ in range(r.randint(0, 60)))
        places, common = suffix.suffix_array(d)
        want = sorted(range(len(d)), key=lambda i: d[i:])
        assert places.tolist() == want
        for k in range(1, len(want)):
            x, y = d[want[k - 1] :], d[want[k] :]
            assert common[k] == next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


def brute_repeats(rows, n):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(d[s : s + n] for _, d in data for s in range(len(d) - n + 1))
    out = []
    for i, d in data:
        cover = bytearray(len(d))
        for s in range(len(d) - n + 1):
            if count[d[s : s + n]] > 1:
                cover[s : s + n] = b"\1" * n
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        out.append((i, len(d), sum(cover), sum(1 for k in range(len(d)) if cover[k] and (k == 0 or not cover[k - 1])), kept))
    return collections.Counter(out)


def brute_clean(rows, n, width):
    """Texts without bytes covered by repeated strings of n bytes or repeated passages of ``width`` words."""
    import re

    data = [(i, (t or "").encode()) for i, t in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", d)] for _, d in data]
    strings = collections.Counter(d[s : s + n] for _, d in data for s in range(len(d) - n + 1))
    passages = collections.Counter(tuple(d[x:y] for x, y in w[s : s + width]) for (_, d), w in zip(data, spans, strict=True) for s in range(len(w) - width + 1))
    out = []
    for (i, d), w in zip(data, spans, strict=True):
        cover = bytearray(len(d))
        for s in range(len(d) - n + 1):
            if strings[d[s : s + n]] > 1:
                cover[s : s + n] = b"\1" * n
        for s in range(len(w) - width + 1):
            if passages[tuple(d[x:y] for x, y in w[s : s + width])] > 1:
                x, y = w[s][0], w[s + width - 1][1]
                cover[x:y] = b"\1" * (y - x)
        out.append((i, bytes(b for b, c in zip(d, cover, strict=True) if not c).decode("utf-8", "ignore")))
    return collections.Counter(out)


@pytest.mark.parametrize("group", [2, 256])
def test_passages_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 2000)
    r = random.Random(group)
    w = lambda n: " ".join(r.choice(["of", "é", "river", "Of", "b", "c\td", "long-word"]) for _ in range(n))
    shared = [w(30), w(14), w(20)]
    texts = [w(r.randint(0, 20)) + " " + r.choice(shared) + "\n" + w(r.randint(0, 20)) for _ in range(40)] + ["a " * 100, "", None, " ", w(200), "x" * 500] + [w(40)] * 3
    rows = [*enumerate(texts), (5, texts[5]), (None, shared[0])]
    got = collections.Counter((x.doc_id, x.clean) for x in suffix.remove_repeats(docs_of(spark, rows).repartition(5), 200, 12).collect())
    assert got == brute_clean(rows, 200, 12)


@pytest.mark.parametrize("group", [2, 4, 256])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "SEGMENT", 128)
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 300)
    r = random.Random(group)
    w = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [w(90), w(45), w(60)]
    texts = [w(r.randint(0, 60)) + r.choice(shared)[r.randint(0, 3) :] + w(r.randint(0, 60)) for _ in range(50)] + ["a" * 300, "ab" * 150, "", None, w(500)] + [w(120)] * 3
    rows = [*enumerate(texts), (5, texts[5]), (None, shared[0])]
    got = collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix.remove_repeats(docs_of(spark, rows).repartition(5), 40).collect())
    assert got == brute_repeats(rows, 40)


def test_repeats_of_odd_tables(spark):
    assert suffix.remove_repeats(docs_of(spark, [(1, "x")]).where("false"), 40).count() == 0
    only = suffix.remove_repeats(docs_of(spark, [(1, None), (2, "short")]), 40).collect()
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in only) == [(1, 0, b""), (2, 0, b"short")]
    docs = docs_of(spark, [(1, "é" * 40), (2, "xé" + "é" * 40 + "tail"), (3, None)]).withColumn("n_chars", F.lit(0).cast("long"))
    cut = {r.doc_id: (r.text, r.n_chars) for r in suffix.cut_repeats(docs, 60).collect()}
    assert cut[1] == ("", 0) and cut[2][0].startswith("x") and cut[2][0].endswith("tail") and cut[3] == (None, 0)
    assert sorted(r.doc_id for r in suffix.cut_repeats(docs, 60, drop_emptied=True).collect()) == [2, 3]
    assert suffix.cut_repeats(docs, 60).columns == docs.columns


# ---- url filters


def test_rules_and_hosts(spark):
    cases = [
        ("http://Example.COM/en/x?q", "example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://a.example.com/de/", "a.example.com", "/de/", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://com", "com", "", None, None), (None, "", "", None, None), ("nothing", "", "", None, None),
        ("a://b://c/d#e", "b:", "//c/d", None, None), ("http://h.net/fr/#x", "h.net", "/fr/", "net/fr/", "block"), ("http://ÄB.org?x", "Äb.org", "", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "<p>some words of text</p>") for i, c in enumerate(cases)], "page_id long, url string, html string").withColumn("word", F.lit(1)).withColumn("part", F.lit(1)).withColumn("host", F.lit(7))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), cases[i]
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert urls.judge(df.where("false")).count() == 0


def brute_split(part, cost, letter):
    best = None
    for mask in range(1 << max(0, len(part) - 1)):
        pieces, start = [], 0
        for i in range(1, len(part) + 1):
            if i == len(part) or mask >> (i - 1) & 1:
                pieces.append(part[start:i])
                start = i
        total = sum(cost.get(p, letter if len(p) == 1 else 1e9) for p in pieces)
        best = total if best is None else min(best, total)
    return best


def test_viterbi_split_is_cheapest():
    r = random.Random(6)
    for _ in range(100):
        part = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        cost = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): r.uniform(0.5, 6) for _ in range(8)}
        pieces = urls.best_split(part, cost, 5.0)
        assert "".join(pieces) == part
        total = sum(min(cost.get(p, 1e9), 5.0 * len(p)) for p in pieces)
        assert total <= brute_split(part, {k: v for k, v in cost.items() if len(k) > 1 or v <= 5}, 5.0) + 1e-9


def test_method_follows_what_rules_say(spark):
    rows = [(i, f"http://w.spamcasino{i}.net/es/spam", "<p>spam casino good garden news</p>") for i in range(20)] + [(100 + i, f"http://gardennews{i}.com/de/good", "<p>good garden news</p>") for i in range(20)]
    rows += [(200, "http://spamcasino.org/x/spam", ""), (201, "http://gardennews.org/x/good", "")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[200], got[201]) == ("block", "allow")


def test_long_words_and_common_tokens(spark, monkeypatch):
    word = "antidisestablishmentarianism"
    parts = spark.createDataFrame([(f"x{word}good".replace("x", "news"),), (word,), (word[:25],), ("a" * 3000,)], "part string")
    counts = spark.createDataFrame([(word, 50), ("good", 40), ("news", 30), (word[:22] + "zzz", 5)], "word string, n long")
    got = {r.part: r.words for r in urls.segment(parts, counts).collect()}
    assert got[word] == [word] and got[f"news{word}good"] == ["news", word, "good"] and got["a" * 3000] == ["a" * 3000] and "".join(got[word[:25]]) == word[:25]
    rows = [(i, f"http://w{'abcdefgh'[i % 8]}.{'net' if i % 3 else 'com'}/{'es' if i % 2 else 'de'}/{'xyz'[i % 3]}", None) for i in range(60)] + [(i, f"http://w.org/{'xyzes'[i % 5]}", "<p>es de com</p>") for i in range(60, 70)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit("x")).withColumn("w", F.lit(2))
    want = sorted((r.page_id, r.verdict, r.log_odds) for r in urls.judge(table).collect())
    monkeypatch.setattr(urls, "COMMON", 1)
    assert sorted((r.page_id, r.verdict, r.log_odds) for r in urls.judge(table).collect()) == want
    monkeypatch.setattr(urls, "COMMON", 10**9)
    assert sorted((r.page_id, r.verdict, r.log_odds) for r in urls.judge(table).collect()) == want


def test_verdicts_by_hand(spark):
    """Naive Bayes over host and path tokens, by plain counting."""
    r = random.Random(11)
    rows = [(i, f"http://{r.choice(['casino', 'garden', 'news'])}{r.choice(['spam', 'shop'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['es', 'fr', 'de'])}/{r.choice(['win', 'read', 'buy'])}", "<p>casino garden news spam shop com net org es fr de win read buy</p>") for i in range(120)]
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")).collect()}
    counts, seen, urls_of = {"allow": collections.Counter(), "block": collections.Counter()}, collections.Counter(), {}
    for i, url, _ in [*rows, rows[0]]:
        host, _, path = url[7:].partition("/")
        pieces = [w for w in ("casino", "garden", "news", "spam", "shop") if w in host.split(".")[0]]
        pieces.sort(key=host.index)
        urls_of[i] = [f"h:{w}" for w in [*pieces, host.split(".")[1]]] + [f"p:{w}" for w in path.split("/")]
        rule = "allow" if host.endswith(".com") else "block" if host.endswith(".net") and path[:3] in ("es/", "fr/") else None
        if rule:
            seen[rule] += 1
            counts[rule].update(urls_of[i])
    v = len({*counts["allow"], *counts["block"]})
    total = {k: sum(c.values()) for k, c in counts.items()}
    for i, tokens in urls_of.items():
        odds = np.log(seen["block"] / seen["allow"]) + sum(np.log((counts["block"][t] + 1) / (total["block"] + v + 1)) - np.log((counts["allow"][t] + 1) / (total["allow"] + v + 1)) for t in tokens if t in counts["allow"] or t in counts["block"])
        assert got[i].log_odds == pytest.approx(odds, abs=1e-5)
        assert got[i].rule is not None or got[i].verdict == ("block" if odds > 0 else "allow")


# ---- near-duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("short", "block", "spread"), [(32, 512, 128), (2, 8, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, short, block, spread):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SPREAD", spread)
    monkeypatch.setattr(neardup, "FREQUENT_FROM", 3)
    r = random.Random(short)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for n in (200, 100, 60, 30, 8):
        base = r.choices(vocabulary, k=n)
        for _ in range(25):
            t = base[:]
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                t[r.randrange(n)] = r.choice(vocabulary)
            texts.append(" ".join(t))
    chain = r.choices(vocabulary, k=120)
    for _ in range(12):  # each is near the one before, far from the first
        chain = chain[:]
        chain[r.randrange(120)] = r.choice(vocabulary)
        texts.append(" ".join(chain))
    passage = " ".join(r.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(r.choices(vocabulary, k=20)) for _ in range(15)]
    texts += ["", None, "one", "one", "ONE", "a b c d", "a b c d e", "A b c d\te", " ", "x " * 3000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_crowds_of_one_passage_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "FREQUENT_FROM", 3)
    r = random.Random(8)
    passage = [f"p{i}" for i in range(200)]
    texts = []
    for own in (10, 14, 18, 25, 60, 90):  # from linked all over to never linked
        texts += [" ".join(passage + [f"x{r.randrange(10**6)}" for _ in range(own)]) for _ in range(14)]
    for k in range(0, len(texts), 5):  # and near copies of some
        w = texts[k].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_crowd_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 2)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "FREQUENT_FROM", 2)
    r = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    texts = {}
    for i in range(40):
        t = base[:]
        for _ in range(r.randrange(4)):
            t[r.randrange(80)] = f"n{r.randrange(1000)}"
        texts[i] = " ".join(t) + f" end{i}"
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in texts.items()}
    component = {i: 0 if i < 30 else i for i in texts}  # most are known to belong together
    want = {(a, b) for a in texts for b in texts if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    table = docs_of(spark, list(texts.items()))
    classes = neardup.sketches(table.select("doc_id", "text")).selectExpr("doc_id AS id", "n_shingles AS n", "sketch", "buckets")
    crowd = spark.createDataFrame(list(component.items()), "id long, component long")
    got = {(x.a, x.b) for x in neardup.crowd_pairs(crowd, table.selectExpr("doc_id AS node", "text"), classes, 85).collect()}
    assert want and want <= got and all(component[a] != component[b] for a, b in got)
    assert [neardup.prefix_length(n, 85) for n in (1, 2, 6, 7, 20, 100)] == [1, 1, 1, 2, 4, 16]


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(docs_of(spark, [(1, "x")]).where("false")).count() == 0
    rows = neardup.near_duplicates(docs_of(spark, [(2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_an_id_with_different_texts_is_one_document(spark):
    w = lambda x, n=30: " ".join(f"{x}{i}" for i in range(n))
    rows = [(5, w("a")), (5, w("b")), (3, w("a") + " end"), (9, w("b")), (9, w("c")), (12, w("c") + " end"), (20, w("d")), (20, ""), (21, w("d")), (30, w("e")), (None, w("a"))]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, rows)).collect())
    want = [(5, 26, 3, False), (5, 26, 3, False), (3, 27, 3, True), (9, 26, 3, False), (9, 26, 3, False), (12, 27, 3, False), (20, 26, 20, True), (20, 0, 20, True), (21, 26, 20, False), (30, 26, 30, True), (None, 26, None, True)]
    assert got == collections.Counter(want)


def test_threshold_of_links(spark):
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:30] + ["x"] + base[31:70] + ["y"] + base[71:])), (3, " ".join(base[:84]))]  # 90 of 110 and 80 of 100 are shared with the first
    kept = lambda *a: sorted(r.doc_id for r in neardup.near_duplicates(docs_of(spark, rows), *a).where("kept").collect())
    assert kept() == [1, 2, 3] and kept(81) == [1, 3] and kept(80) == [1]
    assert (neardup.shared_at_least(85), neardup.estimate_at_least(85)) == (42, 0.60)
    assert neardup.shared_at_least(80) < 42 and neardup.estimate_at_least(80) < 0.60


def test_pipeline_links_from_four_fifths(spark, tmp_path):
    import corpus_pipeline as p

    base = [f"w{i}" for i in range(104)]
    docs = docs_of(spark, [(1, " ".join(base)), (2, " ".join(base[:84])), (3, " ".join(base[:83]))])
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs.where("doc_id <> 3"), str(tmp_path)).collect()) == [1]
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs.where("doc_id <> 2"), str(tmp_path)).collect()) == [1, 3]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 450: 400, 500: 400}


# ---- pipeline


def test_pipeline(spark, tmp_path, monkeypatch):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs, labels = toy_labels(spark, 200)
    r = random.Random(9)
    passage = " ".join(f"shared{i}" for i in range(80))
    w = lambda n: " ".join(f"t{r.randrange(5000)}" for _ in range(n))
    more = [(1000, passage + " " + w(300)), (1001, w(300) + " " + passage), (1002, "copy " + w(100))]
    more += [(1003, more[2][1]), (1004, more[2][1] + " end"), (1005, None), (1006, "")]
    whole = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "packing"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = {x.doc_id: x.text for x in at.collect()}
        at = stage(spark, at, str(tmp_path))
        assert at.columns == whole.columns
        kept[name] = ({x.doc_id: x.text for x in at.collect()}, before)
    toxic = {x.doc_id for x in labels.where("toxic = 1").collect()}
    after, before = kept["toxicity"]
    assert set(before) - set(after) == toxic
    after, before = kept["near_dedup"]
    assert set(after) == {i for i, (_, _, k) in brute_components(list(before.items())).items() if k}
    after, before = kept["suffix_dedup"]
    want = dict(brute_clean(list(before.items()), p.PASSAGE_BYTES, p.PASSAGE_WORDS).keys())
    assert {i: t or "" for i, t in after.items()} == {i: t for i, t in want.items() if t.strip() or not (before[i] or "")}
    assert "shared40" not in after[1000] and 1005 in after and 1006 in after
    t = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    rows = p.run(spark, str(tmp_path)).collect()
    total = collections.Counter()
    for x in rows:
        total[x.doc_id] += x.length
    assert total == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in after.items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs, labels = toy_labels(spark, 60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    w = lambda x, n=60: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, w("a")), (1, w("a")), (2, w("a")), (2, w("b")), (3, w("b")), (4, None), (4, ""), (None, w("c")), (None, w("c")), (5, w("d") + " x" * 20_000), (6, ""), (7, w("e"))]
    odd = docs_of(spark, rows).withColumn("score", F.lit(1)).withColumn("node", F.lit("n")).withColumn("spans", F.lit(1.5)).withColumn("row", F.lit(2)).withColumn("many", F.lit("m"))
    for table, left in ((odd, None), (odd.where("false"), 0)):
        at = table
        for name, stage in p.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == odd.columns and at.schema.simpleString() == odd.schema.simpleString(), name
            if name == "near_dedup" and left is None:
                assert collections.Counter((r.doc_id, (r.text or "")[:2]) for r in at.collect()) == collections.Counter({(1, "a0"): 1, (4, ""): 2, (None, "c0"): 1, (5, "d0"): 1, (6, ""): 1, (7, "e0"): 1})
        assert p.packing(spark, at, str(tmp_path)).count() == 0 if left == 0 else p.packing(spark, at, str(tmp_path)).count() > 6


@pytest.mark.parametrize(("master", "alone"), [("local", True), ("local[8]", True), ("local-cluster[3,2,1000]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_shared_folder(master, alone):
    from types import SimpleNamespace

    from chainloom.llm import common

    set_to = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=set_to.append)
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    if alone:
        assert common.shared_dir(bare) == set_to[0]
    else:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(bare)


def test_scratch_tables_are_deleted(spark):
    from chainloom.llm import common

    t = common.materialize(spark.range(3), "scratch")
    path = t.scratch_path.removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.isdir(path) and t.count() == 3
    common.discard(t)
    common.discard(t, spark.range(3))
    assert not os.path.isdir(path)
