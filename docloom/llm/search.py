"""Exact top-k search: branch-and-bound over columns.

Vectors of integers are held in vertical layout, one row of a tile for each dimension. A block of queries adds up the
products of one block of dimensions at a time; after each block, what the other dimensions can still give is at most the product of the
two remaining lengths (Cauchy-Schwarz), and candidates whose bound is below the query's k-th best score so
far are dropped: the survivors are compacted before the next block is read. Dimensions go in order of falling mean square of the tile, so
bounds close early. Bounds are rounded up and only candidates strictly below are dropped, so results are exact, ties included.

Queries are cut into groups and candidates into shards; each task takes one (group, shard) cell and gives its k best for
each query, and the cells' bests meet in one aggregation. A cell's size is bounded by GROUP and SHARD rows.

Components are floor(256 * x) with x as double. Vectors that are null or hold a null or non-finite component take no part.
Shorter vectors act as if filled with zeros, an empty one scores 0 with all. Rows with equal vec_id are separate queries and candidates: each
row is asked for among all other rows, so a repeated query row gives as many lists. A null vec_id takes no part. Scores beyond the range
of long end at its limits. An empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored

GROUP, SHARD, DIMS, SLICE = 4096, 4096, 16, 256
#: Below this bound every partial sum is exact in double precision.
EXACT = float(1 << 53)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def cell_top_k(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's place, score) of the k best candidates of each query, its own row aside. q, c: rows of whole numbers as double."""
    order = np.argsort(-(c * c).mean(axis=0), kind="stable")
    q, tile = q[:, order], np.ascontiguousarray(c[:, order].T)
    cuts = [*range(0, len(tile), DIMS), len(tile)]
    tails_c = [np.sqrt((tile[a:] ** 2).sum(axis=0)) for a in cuts]
    tails_q = [np.sqrt((q[:, a:] ** 2).sum(axis=1)) for a in cuts]
    # A first floor for each query: exact scores of the candidates that lead after the first block.
    lead = min(8 * k, len(c_ids))
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        if i % SLICE == 0:
            start = q[i : i + SLICE, : cuts[1]] @ tile[: cuts[1]]
        first = start[i % SLICE]
        some = np.argpartition(-first, lead - 1)[:lead] if lead < len(c_ids) else np.arange(len(c_ids))
        some = some[c_rows[some] != q_rows[i]]
        sure = np.sort(q[i] @ tile[:, some])[::-1]
        floor = sure[k - 1] if len(sure) >= k else -np.inf
        live, acc = None, first
        for b in range(1, len(cuts)):
            bound = acc + tails_q[b][i] * (tails_c[b] if live is None else tails_c[b][live]) * (1 + 1e-12) + 1e-6
            keep = np.flatnonzero(bound >= floor)
            live, acc = keep if live is None else live[keep], acc[keep]
            if b < len(cuts) - 1:
                acc = acc + q[i, cuts[b] : cuts[b + 1]] @ tile[cuts[b] : cuts[b + 1], live]
        other = c_rows[live] != q_rows[i]
        live, acc = live[other], acc[other]
        top = _best(acc, c_ids[live], k)
        out_q.append(np.full(len(top), q_rows[i]))
        out_c.append(live[top])
        out_s.append(acc[top])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def cell_top_k_wide(q: list, q_rows: np.ndarray, c: list, c_rows: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The same in whole numbers of any size, for vectors whose products leave the exact range of double."""
    out_q, out_c, out_s = [], [], []
    edge = (1 << 63) - 1
    for x, row in zip(q, q_rows):
        near = sorted((-max(-edge - 1, min(edge, sum(a * b for a, b in zip(x, y)))), i, at) for at, (y, r, i) in enumerate(zip(c, c_rows, c_ids)) if r != row)[:k]
        for s, _, at in near:
            out_q.append(row), out_c.append(at), out_s.append(-s)
    return out_q, out_c, out_s


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows by integer inner product."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"), sound.alias("sound"), is_query.alias("is_query"))
    rows = stored(rows.where("sound").select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda v: F.floor(v.cast("double") * 256.0).cast("double")).alias("v"), "is_query"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    shards, groups = max(1, -(-n // SHARD)), max(1, -(-(n_queries or 0) // GROUP))
    seats = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = rows.where("is_query").select("row", "vec_id", "v", F.lit(True).alias("asks"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), seats.alias("s"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    candidates = rows.select("row", "vec_id", "v", F.lit(False).alias("asks"), turns.alias("g"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int").alias("s"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        ids, at, lists = pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), pdf["v"].tolist()
        if not asks.any() or asks.all():
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(1, *map(len, lists))
        m = np.zeros((len(lists), width))
        for i, v in enumerate(lists):
            m[i, : len(v)] = v
        if width * float(np.abs(m[asks]).max()) * float(np.abs(m[~asks]).max()) < EXACT:
            got = cell_top_k(m[asks], at[asks], m[~asks], at[~asks], ids[~asks], k)
        else:
            whole = [[int(c) for c in row] for row in m]
            pick = lambda flag: [whole[i] for i in np.flatnonzero(flag)]
            got = cell_top_k_wide(pick(asks), at[asks], pick(~asks), at[~asks], ids[~asks], k)
        names = dict(zip(at[asks].tolist(), ids[asks].tolist()))
        asked = np.array(got[0], np.int64)
        return pd.DataFrame({"row": asked, "query_id": np.array([names[r] for r in asked.tolist()], np.int64), "vec_id": ids[~asks][np.array(got[1], np.int64)], "score": np.array(got[2]).astype(np.int64)})

    parts = queries.unionAll(candidates).groupBy("g", "s").applyInPandas(cell, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th id asks all other rows for its five best."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


#: The same result by computing every product; DuckDB runs it at the sizes of the correctness check.
ORACLE_SQL = {
    "op4_topk": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q JOIN v ON q.row <> v.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
QUERIES = {"op4_topk": op4_topk}
