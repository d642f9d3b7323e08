"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks; each block keeps one list of its vectors for every dimension, sorted by that component. The lists of a block
are built once for ``QUERY_BLOCK`` queries, which all read them where they are. A query
reads the lists of its non-zero dimensions from their better end, scores each vector at first sight, and stops when even
a vector with the components last read in every list can't beat its k-th score. The best of all blocks are merged.

Cases: vectors that are null or hold null or non-finite components take no part; empty vectors score 0; only vectors of
one length are compared; equal scores go to the smaller vec_id; rows that share a query's vec_id are its own and no candidates; a query
row that is repeated with its vector is one query, and with another vector another query of that id, with ranks of its own; repeated
candidates take a rank each; scores beyond a long are given as the nearest long; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.llm.common import read, ship

K, EVERY, SCALE = 5, 50, 256
BLOCK, QUERY_BLOCK, FIRST_DEPTH = 16_384, 16_384, 16
LONG_MAX = 2**63 - 1

RESULT = "query_id long, query_no long, vec_id long, score long"


def integers(column: pd.Series) -> np.ndarray:
    """floor(SCALE * x) of each component; float64 where inner products are exact in it, else Python's integers."""
    x = np.floor(np.array([np.asarray(v, dtype=np.float64) for v in column]).reshape(len(column), -1) * SCALE)
    return x if x.size == 0 or float(np.abs(x).max()) ** 2 * x.shape[1] < 2**52 else np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K, depth: int = FIRST_DEPTH) -> list[tuple[int, int, int]]:
    """(place of the query, vec_id, score) of each query's k best among ``vectors``."""
    if object in (queries.dtype, vectors.dtype):
        queries, vectors = queries.astype(object), vectors.astype(object)
    n, d = vectors.shape
    lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
    out = []
    for at_query, (q, qid) in enumerate(zip(queries, query_ids, strict=True)):
        used = np.flatnonzero(q != 0)
        seen = np.zeros(n, bool)
        best: list[tuple] = []
        if not len(used):
            best = sorted((0, int(i)) for i in ids if i != qid)[:k]
            out += [(at_query, i, 0) for _, i in best]
            continue
        down = q[used] > 0
        at, step = 0, depth
        while at < n:
            to = min(n, at + step)
            rows = np.arange(at, to)[:, None]
            met = lists[np.where(down[None], n - 1 - rows, rows), used[None]].ravel()
            met = np.unique(met[~seen[met]])
            seen[met] = True
            met = met[ids[met] != qid]
            if len(met):
                score = vectors[met] @ q
                if len(met) > k and score.dtype != object:
                    worth = np.flatnonzero(score >= (-best[-1][0] if len(best) == k else np.partition(score, -k)[-k]))
                    met, score = met[worth], score[worth]
                best = sorted(best + [(-int(s), int(ids[i])) for s, i in zip(score, met, strict=True)])[:k]
            last = lists[np.where(down, n - to, to - 1), used]
            bound = (vectors[last, used] * q[used]).sum()
            if len(best) == k and -best[-1][0] > bound:
                break
            at, step = to, step * 2
            if seen.all():
                break
        out += [(at_query, i, -s) for s, i in best]
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's (vec_id divisible by ``every``) k best other vectors: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    fine = ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    table = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    # equal query rows are one query, known by its id and 64 bits of id and vector
    asked = table.where((F.col("vec_id") % every) == 0).dropDuplicates(["vec_id", "embedding"]).withColumn("query_no", F.xxhash64("vec_id", "embedding"))
    n, q = table.count(), asked.count()
    blocks, query_blocks = -(-n // block) or 1, -(-q // query_block) or 1
    of = lambda seed, k: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int")
    every_block = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    # each block of vectors meets each block of queries: the stated query set against all rows
    queries = asked.select("vec_id", "query_no", "embedding", "dim", of(1, query_blocks).alias("qb"), every_block(blocks, "vb"))
    rows = table.select("vec_id", "embedding", "dim", of(2, blocks).alias("vb"), every_block(query_blocks, "qb"))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(v):
            found = threshold_search(integers(q["embedding"]), q["vec_id"].to_numpy(), integers(v["embedding"]), v["vec_id"].to_numpy(), k)
        ids, numbers = q["vec_id"].tolist(), q["query_no"].tolist()
        found = [(ids[a], numbers[a], b, max(-LONG_MAX - 1, min(LONG_MAX, s))) for a, b, s in found]
        return pd.DataFrame(found, columns=["query_id", "query_no", "vec_id", "score"]).astype("int64")

    local = queries.groupBy("dim", "qb", "vb").cogroup(rows.groupBy("dim", "qb", "vb")).applyInPandas(search, RESULT)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
  SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e, v.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])), 0) AS BIGINT) AS score
  FROM asked AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
