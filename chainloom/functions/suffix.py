"""Public suffixes and registrable names by a table of rules that is given, or by a small built-in one.

A name without a listed suffix has none. Rules may begin with ``*.`` (any label) or ``!`` (an exception), as in the public list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Common public suffixes; a full list can be read with ``suffix_rules``.
COMMON = (
    "com net org info biz name pro edu gov mil int io co me tv cc xyz top club online site shop app dev ai us uk de fr es it nl be ch at se no dk fi pl "
    "pt cz hu ro gr ie ru ua tr cn jp kr tw hk sg in id th vn my ph au nz br ar mx cl pe za eg ng il ae sa ir pk "
    "co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.nz co.jp or.jp ne.jp ac.jp com.cn net.cn org.cn gov.cn com.br net.br org.br "
    "com.mx co.in com.tr com.tw com.hk com.sg co.kr co.za com.ar com.ua com.ru *.ck !www.ck"
).split()


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(suffix, kind): kind is exact, any or except. ``path``: a file with one rule a line and // comments."""
    if path:
        lines = spark.read.text(path).select(F.trim("value").alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    else:
        lines = spark.createDataFrame([(r,) for r in COMMON], "rule string")
    kind = F.when(F.col("rule").startswith("*."), "any").when(F.col("rule").startswith("!"), "except").otherwise("exact")
    return lines.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"), kind.alias("kind")).distinct()


def candidates(host: Column) -> Column:
    """Every tail of a host name that begins at a label, longest first."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_suffix(df: DataFrame, host: str, rules: DataFrame | None = None) -> DataFrame:
    """``df`` with ``suffix`` (public suffix) and ``e2ld`` (one label more), null where there is none.

    Distinct hosts are matched once; the rule table goes to the executors whole only if Spark finds it small."""
    rules = suffix_rules(df.sparkSession) if rules is None else rules
    hosts = df.select(F.col(host).alias("host key")).where(F.col("host key").isNotNull()).distinct()
    tails = hosts.select("host key", F.posexplode(candidates(F.col("host key"))).alias("at", "tail"))
    size = lambda c: F.size(F.split(c, r"\."))
    plain = tails.join(rules.where("kind = 'exact'"), tails["tail"] == F.col("suffix")).select("host key", size(F.col("tail")).alias("n"), F.lit(0).alias("rank"))
    rest = F.regexp_replace("tail", r"^[^.]*\.", "")
    wild = tails.where(F.col("tail").contains(".")).withColumn("rest", rest)
    starred = wild.join(rules.where("kind = 'any'"), F.col("rest") == F.col("suffix")).select("host key", size(F.col("tail")).alias("n"), F.lit(0).alias("rank"))
    spared = tails.join(rules.where("kind = 'except'"), F.col("tail") == F.col("suffix")).select("host key", (size(F.col("tail")) - 1).alias("n"), F.lit(1).alias("rank"))
    best = plain.unionByName(starred).unionByName(spared).groupBy("host key").agg(F.max(F.struct("rank", "n"))["n"].alias("n"))
    labels = F.split(F.lower(F.col("host key")), r"\.")
    tail_of = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    found = best.select("host key", tail_of(F.col("n")).alias("suffix"), F.when(F.size(labels) > F.col("n"), tail_of(F.col("n") + 1)).alias("e2ld"))
    return df.join(found, df[host] == found["host key"], "left").drop("host key")
