"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, one list per dimension.

Candidates are dealt into blocks of some BLOCK rows and queries into chunks of at most some CHUNK rows; each pair of
block and chunk is one task's group, of bounded size. In a block every dimension has its list of candidates in order
of value. A query walks the lists from the end that its sign asks for, all to the same depth; each candidate met is
scored exactly, and the values at the depth bound what is yet unmet. It stops when the k-th best score is above that
bound: not at equality, since an unmet candidate of equal score may have the smaller id. Depth doubles from step to
step. The best k of each block are merged per query, which is exact.

A vector that is NULL, or has a NULL or non-finite component or a NULL id, takes no part; nor does a pair of different
lengths. All rows of an id are candidates, but none of the query's own id; of several rows of one query id the
greatest vector asks. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.session import written

K = 10
BLOCK = 8192
CHUNK = 8192
FIRST_DEPTH = 16


def whole_components(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of every component x, of the vectors that take part."""
    infinite = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"),
    )


class Lists:
    """The candidates of a block with one list per dimension, in order of value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        # doubles hold the products and sums of whole numbers exactly up to 2**53
        self.top = float(np.abs(vectors.astype(float)).max(initial=0)) * max(vectors.shape[1], 1)
        self.real = vectors.astype(float)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best, and their order: score down, then id up."""
        n = len(self.ids)
        small = self.top * float(np.abs(query.astype(float)).max(initial=0)) < 2.0**53
        vectors, q = (self.real, query.astype(float)) if small else (self.exact, query)
        used = np.flatnonzero(query)
        down = query[used] > 0
        met = np.zeros(n, bool)
        met[self.ids == query_id] = True
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, depth = 0, FIRST_DEPTH
        while done < n:
            upto = min(n, depth) if len(used) else n
            at = np.arange(done, upto)
            rows = np.where(down, self.order[n - 1 - at][:, used], self.order[at][:, used]).ravel() if len(used) else at
            new = np.zeros(n, bool)
            new[rows] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            ids = np.concatenate((ids, self.ids[new]))
            scores = np.concatenate((scores, (vectors[new] @ q).astype(np.int64)))
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            if len(used):
                edge = np.where(down, self.order[n - upto, used], self.order[upto - 1, used])
                bound = sum(int(a) * int(b) for a, b in zip(self.exact[edge, used], query[used]))
                if len(scores) == k and int(scores[-1]) > bound:
                    break
            done, depth = upto, 2 * depth
        return ids, scores


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best; ``vectors`` holds vec_id and whole-number ``vec``."""
    rows = written(vectors.select("vec_id", "vec", is_query.alias("asks")), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks, chunks = -(-n // block) or 1, -(-n_queries // chunk) or 1
    key = ["dim", "block", "chunk"]
    dim = F.size("vec").alias("dim")
    candidates = rows.select(
        "vec_id", "vec", dim, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    queries = rows.filter("asks").groupBy("vec_id").agg(F.max("vec").alias("vec")).select(
        "vec_id", "vec", dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"),
    )

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        lists = Lists(own["vec_id"].to_numpy(), _matrix(own["vec"]))
        ids, found, scores = [], [], []
        for query_id, query in zip(asked["vec_id"].to_numpy(), _matrix(asked["vec"])):
            best, score = lists.best(query_id, query, k)
            ids.append(np.full(len(best), query_id))
            found.append(best)
            scores.append(score)
        return pa.table([np.concatenate(x) for x in (ids, found, scores)], schema=_FOUND)

    best = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
