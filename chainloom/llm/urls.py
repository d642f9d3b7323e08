"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

Words of host labels and path parts are split by unigram Viterbi: word counts come from the text of all pages. Every substring of a distinct
part up to ``INDEXED`` letters is looked up by a join; longer words are found by their first ``INDEXED`` letters. So the dictionary has no
bound in words or letters and is never broadcast. Naive Bayes learns token counts from the urls that a rule decides and judges the
others; its token table is joined as well, but for the tokens of at least one in ``COMMON`` token rows, of which there can't be more than
``COMMON``: these are broadcast, so that no task gets all urls with a token like com.

Cases: null urls and urls without :// have an empty host and path and fit no rule; null html has no words; without learnt urls of both
verdicts the method says allow; equal urls get equal verdicts, repeated rows are judged one by one; very long parts are split in
time linear in their length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import arrow_map, batch, discard, materialize, read

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Longest substrings that are looked up as they are; longer words are found by so many of their letters.
INDEXED = 20
#: A token of more than one in so many token rows is common.
COMMON = 1000
#: A worker's counts are handed on when it holds so many.
HOLD = 200_000
VISIBLE = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)|&[#\w]+;?", re.S | re.I)
LETTERS = re.compile(r"[a-z]+")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, lower case; path: then up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits: its text like net/ and its verdict, or null."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): runs of a-z in the visible text of all pages."""
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                held.update(LETTERS.findall(VISIBLE.sub(" ", page or "").lower()))
            if len(held) > HOLD:
                yield batch(arrow, [list(held), list(held.values())])
                held = Counter()
        if held:
            yield batch(arrow, [list(held), list(held.values())])

    counted = arrow_map(pages.select("html"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def best_split(part: str, cost: dict[str, float], letter: float) -> list[str]:
    """The cheapest sequence of words; a letter that no word covers costs ``letter`` and joins its neighbours like it."""
    n = len(part)
    lengths = sorted({len(w) for w in cost})
    best = [0.0] + [math.inf] * n
    back = [0] * (n + 1)
    for i in range(n):
        base = best[i]
        if base + letter < best[i + 1]:
            best[i + 1], back[i + 1] = base + letter, -1
        for k in lengths:
            j = i + k
            if j > n:
                break
            c = cost.get(part[i:j])
            if c is not None and base + c < best[j]:
                best[j], back[j] = base + c, j - i
    out: list[str] = []
    i, loose = n, ""
    while i:
        if back[i] < 0:
            loose, i = part[i - 1] + loose, i - 1
            continue
        if loose:
            out.append(loose)
            loose = ""
        out.append(part[i - back[i] : i])
        i -= back[i]
    if loose:
        out.append(loose)
    return out[::-1]


def segment(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, words array<string>) of distinct lower-case ``part``s of letters, by unigram Viterbi over ``counts`` (word, n)."""
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = sizes["total"], sizes["kinds"]
    scale = math.log(total + kinds + 1)
    letter = scale + 2.0
    places = parts.select("part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("at"))
    room = F.length("part") - F.col("at") + 1
    pieces = places.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(INDEXED), room)), lambda k: F.substring(F.col("part"), F.col("at"), k))).alias("word"))
    short = pieces.distinct().join(counts, "word").select("part", "word", "n")
    beyond = counts.where(F.length("word") > INDEXED).withColumn("start", F.substring("word", 1, INDEXED))
    long = places.where(room > INDEXED).withColumn("start", F.substring(F.col("part"), F.col("at"), F.lit(INDEXED))).join(beyond, "start")
    long = long.where(F.substring(F.col("part"), F.col("at"), F.length("word")) == F.col("word")).select("part", "word", "n").distinct()
    known = short.unionByName(long).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", (F.lit(scale) - F.log(F.col("n") + 1.0)).alias("cost")))).alias("costs"))
    joined = parts.join(known, "part", "left")
    arrow = pa.schema([("part", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best_split(p, dict(c or ()), letter) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield batch(arrow, [b.column(0), found])

    return arrow_map(joined.select("part", "costs"), run, "part string, words array<string>")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's log odds of block where no rule decides."""
    host, path = host_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    table = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))

    # one row for each distinct url shape, with the number of pages that rules allow and block
    kinds = table.groupBy("host", "path").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("ruled") == "block").cast("long")).alias("b"))
    raw = F.concat(
        F.transform(F.filter(F.split("host", "[^a-z]+"), lambda x: x != ""), lambda x: F.struct(F.lit("h").alias("where"), x.alias("part"))),
        F.transform(F.filter(F.split(lower_ascii(F.col("path")), "[^a-z]+"), lambda x: x != ""), lambda x: F.struct(F.lit("p").alias("where"), x.alias("part"))),
    )
    parts = materialize(kinds.select("host", "path", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), F.explode_outer(raw).alias("x")).select("host", "path", "a", "b", "x.where", "x.part"), "url-parts")
    counts = materialize(word_counts(pages), "url-words")
    words = segment(parts.where(F.col("part").isNotNull()).select("part").distinct(), counts)
    tokens = materialize(parts.join(words, "part").select("host", "path", "a", "b", F.explode("words").alias("word"), "where").select("host", "path", "a", "b", F.concat("where", F.lit(":"), "word").alias("token")), "url-tokens")
    discard(parts, counts)
    table_of = materialize(tokens.groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")), "url-token-counts")
    s = table_of.where((F.col("a") + F.col("b")) > 0).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    c = table.agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("ruled") == "block").cast("long")).alias("b")).first()
    na, nb, v = s["a"] or 0, s["b"] or 0, s["v"] or 0
    ca, cb = c["a"] or 0, c["b"] or 0
    if not (ca and cb):
        return table.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("log_odds"))
    weight = F.when((F.col("a") + F.col("b")) > 0, F.log((F.col("b") + 1.0) / (nb + v + 1.0)) - F.log((F.col("a") + 1.0) / (na + v + 1.0))).otherwise(F.lit(0.0))
    weights = table_of.select("token", weight.alias("w"), "n")
    rows = table_of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    common = F.col("n") * COMMON > rows  # of fewer than COMMON tokens
    told = tokens.select("host", "path", "token").join(F.broadcast(weights.where(common).select("token", F.col("w").alias("often"))), "token", "left")
    seldom = told.where(F.col("often").isNull()).join(weights.where(~common).select("token", "w"), "token").select("host", "path", "w")
    odds = told.where(F.col("often").isNotNull()).select("host", "path", F.col("often").alias("w")).unionByName(seldom).groupBy("host", "path").agg(F.round(F.sum("w"), 6).alias("odds"))
    prior = math.log(cb / ca)
    scored = table.join(odds, ["host", "path"], "left")
    method = F.coalesce(F.col("odds"), F.lit(0.0)) + prior
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(method > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), method.alias("log_odds"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).drop("log_odds")
