"""Op 1, exact top-k search by columnar branch and bound.

Vectors become integers. Candidates and queries are dealt into blocks of BLOCK_BYTES and every block of queries
meets every block of candidates in a task of its own, tile by tile. There scores are summed over blocks of
dimensions held column by column, strongest dimensions first. After each block the norms of what remains bound
every score from both sides; candidates that can't reach a query's k-th lower bound are compacted away. A query
starts with the k-th score that it has among a sample of candidates, and takes along what earlier tiles gave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bucket, table

#: Rows of a tile of candidates and of queries, and dimensions summed before bounds are tested.
CANDIDATES, QUERIES, DIMENSIONS = 2048, 512, 16
#: Bytes of a block's vectors, fewest tasks where there are tiles enough, and candidates of the sample that the first bounds come from.
BLOCK_BYTES, LEAST_TASKS, SAMPLE = 32 << 20, 64, 2048
#: Share of pairs under which they are listed one by one instead of in a rectangle.
SPARSE = 0.1
_LONG = (-(1 << 63), (1 << 63) - 1)


def _ints(lists: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row for each vector; whole floats."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def search_block(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For every query, (its place, the candidates' places, their scores): a superset of its k best, ties included.

    own tells which candidates (columns) each query (row) does not meet; least, which scores its k best don't fall below.
    """
    d = q.shape[1]
    if d and float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d >= 2.0**52:
        exact = q.astype(object) @ c.T.astype(object)  # too large for whole floats: Python's integers, held to the range of long
        exact = np.array([[min(max(int(x), _LONG[0]), _LONG[1]) for x in row] for row in exact], dtype=object).reshape(len(q), len(c))
        return [(i, np.flatnonzero(~own[i]), exact[i][~own[i]]) for i in range(len(q))]
    order = np.argsort(-(c * c).sum(0), kind="stable")
    q, c = np.ascontiguousarray(q[:, order].T), np.ascontiguousarray(c[:, order].T)  # vertical: a row for each dimension
    begins = list(range(0, d, DIMENSIONS)) or [0]
    rest = lambda x: [np.sqrt((x[b + DIMENSIONS :] ** 2).sum(0)) for b in begins]
    rest_q, rest_c = rest(q), rest(c)
    n_q = q.shape[1]
    alive = np.arange(c.shape[1])
    score = np.where(own, -np.inf, 0.0)
    least = np.full(n_q, -np.inf) if least is None else least.copy()
    pairs = None
    for n, b in enumerate(begins):
        block = slice(b, b + DIMENSIONS)
        if pairs is None:
            score += q[block].T @ c[block][:, alive]
            bound = np.outer(rest_q[n], rest_c[n][alive]) * (1 + 1e-9)
            if len(alive) > k:
                least = np.maximum(least, _kth(score - bound, k))
            keep = score + bound >= least[:, None] - 0.5
            keep &= score > -np.inf
            if n + 1 < len(begins) and keep.mean() < SPARSE:
                at, col = np.nonzero(keep)
                pairs = (at, alive[col], score[at, col])
            else:
                cols = keep.any(0)
                alive, score = alive[cols], score[:, cols]
        else:
            at, cand, s = pairs
            s = s + np.einsum("ij,ij->j", q[block][:, at], c[block][:, cand])
            bound = rest_q[n][at] * rest_c[n][cand] * (1 + 1e-9)
            ends = np.searchsorted(at, np.arange(n_q + 1))
            low = s - bound
            for i in np.flatnonzero(np.diff(ends) >= k):
                least[i] = max(least[i], np.partition(low[ends[i] : ends[i + 1]], -k)[-k])
            keep = s + bound >= least[at] - 0.5
            pairs = (at[keep], cand[keep], s[keep])
    if pairs is None:
        at, col = np.nonzero((score >= least[:, None] - 0.5) & (score > -np.inf))
        pairs = (at, alive[col], score[at, col])
    at, cand, s = pairs
    ends = np.searchsorted(at, np.arange(n_q + 1))
    return [(i, cand[ends[i] : ends[i + 1]], s[ends[i] : ends[i + 1]]) for i in range(n_q)]


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k candidates of largest integer inner product for every query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Every row is a candidate but for the query itself; ties go to the
    smaller id. Vectors that are null or hold null, NaN or infinite components, and rows without id, take
    no part. Rows that share an id are candidates each, for one another too, and ask each, with ranks of
    their own; rows equal in id and vector are as many candidates but ask once. Vectors meet only those of
    their own length. Scores beyond the range of long are held to it. An empty table gives no rows.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"), is_query.alias("asks")).where(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    rows = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"), F.max("asks").alias("asks")).withColumn("row", F.xxhash64("vec_id", "v"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.size(x)).alias("d")).first()
    together = max(1, BLOCK_BYTES // (8 * max(n["d"] or 1, 1)))
    n_q = max(1, math.ceil(n["q"] / together))
    n_c = max(1, math.ceil(n["n"] / together), min(math.ceil(n["n"] / CANDIDATES), math.ceil(LEAST_TASKS / n_q)))
    size = F.size("v").alias("d")
    queries = rows.where("asks").select("row", "vec_id", "v", size, hash_bucket(n_q, F.lit(1), "row").alias("qb"))
    candidates = rows.select("row", "vec_id", "v", "times", size, hash_bucket(n_c, F.lit(2), "row").alias("cb"))
    each = lambda parts, name: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)

    def tiles(q: pa.Table, c: pa.Table):
        """(places of the tile's queries, best): for each query of a tile its best (score, row) among all candidates, best first."""
        ids, rows, times = (c[x].to_numpy() for x in ("vec_id", "row", "times"))
        parts = [(i, _ints(c["v"].slice(i, CANDIDATES), scale)) for i in range(0, c.num_rows, CANDIDATES)]
        for a in range(0, q.num_rows, QUERIES):
            tile = q.slice(a, QUERIES)
            vectors, query_ids, query_rows = _ints(tile["v"], scale), tile["vec_id"].to_numpy(), tile["row"].to_numpy()
            least = tile["least"].cast(pa.float64()).fill_null(-np.inf).to_numpy().copy() if "least" in tile.column_names else np.full(tile.num_rows, -np.inf)
            best: list[list[tuple[int, int, int]]] = [[] for _ in range(tile.num_rows)]
            for at, part in parts:
                here = slice(at, at + len(part))
                same = (query_ids[:, None] == ids[here]) & (query_rows[:, None] == rows[here])
                for i, found, s in search_block(vectors, part, same & (times[here] == 1), k, least):
                    if len(found):
                        near = range(len(found)) if s.dtype == object else np.lexsort((ids[here][found], -s))[:k]
                        now = [(-int(s[j]), int(ids[at + found[j]]), int(at + found[j])) for j in near]
                        best[i] = sorted(best[i] + now)[:k]
                        if len(best[i]) == k:
                            least[i] = max(least[i], -best[i][-1][0])
            yield a, query_ids, query_rows, best

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if q.num_rows and c.num_rows:
            rows, times = c["row"].to_numpy(), c["times"].to_numpy()
            for _, query_ids, query_rows, found in tiles(q, c):
                for i, own in enumerate(found):
                    out += [(query_ids[i], query_rows[i], vec_id, -less, times[at] - (query_ids[i] == vec_id and query_rows[i] == rows[at])) for less, vec_id, at in own]
        return pa.table({name: pa.array([int(r[x]) for r in out], type=pa.int64()) for x, name in enumerate(("query_id", "query", "vec_id", "score", "times"))})

    def seeded(q: pa.Table, c: pa.Table) -> pa.Table:
        least: list[int | None] = [None] * q.num_rows
        if q.num_rows and c.num_rows:
            for a, _, _, found in tiles(q, c):
                for i, own in enumerate(found):
                    least[a + i] = -own[-1][0] if len(own) == k else None
        return q.append_column("least", pa.array(least, type=pa.int64()))

    if n_c > 1:
        share = max(1, n["n"] // SAMPLE)
        sample = candidates.where(F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(share)) == 0).drop("cb").select("*", each(n_q, "qb"))
        kinds = "row long, vec_id long, v array<double>, d int, qb int, least long"
        queries = queries.groupBy("d", "qb").cogroup(sample.groupBy("d", "qb")).applyInArrow(seeded, kinds)
    asked, there = queries.select("*", each(n_c, "cb")), candidates.select("*", each(n_q, "qb"))
    key = ["d", "qb", "cb"]
    found = asked.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(best, "query_id long, query long, vec_id long, score long, times long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))  # no more than k copies can be among the k best
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose vec_id is divisible by 20, against all other rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP1_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT min(id) AS id, vec_id, any_value(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, embedding),
p AS (SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
