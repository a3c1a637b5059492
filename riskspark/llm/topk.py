"""Exact top-k inner products over norm-sorted vectors.

Components become integers, `floor(1024 x)`. Vectors are rotated by the singular vectors of a second-moment
matrix, so that the first coordinates carry most of the product, and are laid out by descending length in
range partitions. A block of queries (bounded, sent to every task) walks a partition from its longest vector:
a vector is left out as soon as the query's length times the vector's, and then the product over the first
rotated coordinates plus the lengths of what is left (Cauchy-Schwarz), can't reach the query's k-th best
score. What remains is scored exactly in integers. The first bounds come from the longest vectors of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import materialize

K = 10
SCALE = 1_024
QUERY_BLOCK = 4_096
HEAD_ROWS = 1_024
STEP_ROWS = 512


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(key, v, norm): floor(scale * x) as array<long>; vectors that are null or hold a null or non-finite number are left out.

    A null key is left out too, as it can't be reported; an empty vector has norm 0 and scores 0.
    """
    xs = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(xs, lambda x: F.floor(x * scale).cast("long"))
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & fine).select(key, ints.alias("v")).withColumn("norm", norm)


def rotation(table: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of this width, from their second moments, summed map-side."""
    if dim == 0:
        return np.zeros((0, 0))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = table.select("v").coalesce(max(1, min(64, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(moments, "m binary")
    total = sum((np.frombuffer(bytes(r["m"])).reshape(dim, dim) for r in parts.toLocalIterator()), np.zeros((dim, dim)))
    return np.linalg.eigh(total)[1][:, ::-1].copy()


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((queries, k), -(1 << 62))
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor

    def bound(self) -> np.ndarray:
        """A score that the k-th best surely reaches, as a float; minus infinity while there is none."""
        own = np.where(self.ids[:, -1] == np.iinfo(np.int64).max, -np.inf, self.scores[:, -1].astype(float))
        return own if self.floor is None else np.maximum(own, self.floor)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        top = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[top], scores[top]


def walk(q_ids, q, q_rot, head: int, batches: Iterator[tuple], best: Best) -> None:
    """Offer every vector of `batches` (ids, integers, rotated; longest first) that may belong to a query's best."""
    q_len = np.linalg.norm(q_rot, axis=1)
    q_rest = np.linalg.norm(q_rot[:, head:], axis=1)
    for ids, x, rot in batches:
        length = np.linalg.norm(rot, axis=1)
        rest = np.linalg.norm(rot[:, head:], axis=1)
        slack = 1e-6 * (1 + length.max(initial=0.0) * q_len)  # rounding of the rotation
        bound = best.bound()
        live = np.flatnonzero(q_len * length.max(initial=0.0) + slack >= bound)
        if not len(live):
            continue
        reach = q_rot[live, :head] @ rot[:, :head].T
        reach += np.outer(q_rest[live], rest)
        hits = reach + slack[live, None] >= bound[live, None]
        for i, row in zip(live.tolist(), hits):
            at = np.flatnonzero(row)
            at = at[ids[at] != q_ids[i]]
            if len(at):
                best.offer(i, ids[at], x[at] @ q[i])


def top_k(table: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, <key>, score): the k best of `table` for each row of `queries`, its own key aside.

    Both come from `integer_vectors`. Ties go to the smaller key; fewer candidates give fewer rows; repeated
    rows are candidates of their own. Vectors of different widths don't meet. One job for each `query_block`
    queries reads the vectors in place; only queries and the longest `HEAD_ROWS` vectors are sent to tasks.
    """
    spark = table.sparkSession
    table = table.withColumn("dim", F.size("v"))
    dims = [r["dim"] for r in table.select("dim").distinct().collect()]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for dim in dims:
        own = table.where(F.col("dim") == dim)
        turn = rotation(own, dim)
        laid = materialize(own.repartitionByRange(parts, F.desc("norm"), F.col(key)).sortWithinPartitions(F.desc("norm")), "by-length")
        asked = materialize(queries.where(F.size("v") == dim).select(key, "v"), "queries")
        longest = _columns(laid.orderBy(F.desc("norm"), key).limit(HEAD_ROWS).toArrow(), key, dim)
        for block in _blocks(asked, key, query_block):
            q_ids, q = _columns(block.toArrow(), key, dim)
            if len(q_ids):
                found = _search(laid, q_ids, q, turn, longest, k, key, dim)
                out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "_copy").orderBy(F.desc("score"), key))
    return materialize(out, "candidates").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _blocks(asked: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """The queries in hash blocks of about `rows`; a block's number is the hash's, so blocks part the table."""
    n = -(-asked.count() // rows) if rows else 1
    return [asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def _columns(found: pa.Table, key: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = found.column(key).to_numpy().astype(np.int64)
    flat = found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
    return ids, flat.astype(np.int64).reshape(len(ids), dim)


def _search(laid: DataFrame, q_ids, q, turn, longest, k: int, key: str, dim: int) -> DataFrame:
    q_rot = q @ turn
    energy = np.cumsum((q_rot**2).sum(axis=0))
    head = int(np.searchsorted(energy, 0.8 * energy[-1])) + 1 if dim and energy[-1] > 0 else dim
    ids, x = longest
    first = Best(len(q_ids), k)
    walk(q_ids, q, q_rot, head, [(ids, x, x @ turn)], first)
    floor = first.bound()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(q_ids), k, floor)

        def steps():
            for batch in batches:
                got, v = _columns(pa.Table.from_batches([batch]), key, dim)
                for a in range(0, len(got), STEP_ROWS):
                    yield got[a : a + STEP_ROWS], v[a : a + STEP_ROWS], v[a : a + STEP_ROWS] @ turn

        walk(q_ids, q, q_rot, head, steps(), best)
        at, rank = np.nonzero(best.ids != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_ids[at]), pa.array(at.astype(np.int64)), pa.array(best.ids[at, rank]), pa.array(best.scores[at, rank])],
            names=["query_id", "_copy", key, "score"],
        )

    return laid.select(key, "v").mapInArrow(search, f"query_id long, _copy long, {key} long, score long")


def embedding_top_k(embeddings: DataFrame) -> DataFrame:
    """The 10 best of all other vectors for every vector whose id is divisible by 100."""
    table = materialize(integer_vectors(embeddings.select("vec_id", "embedding")), "integer-vectors")
    return top_k(table, table.where(F.pmod("vec_id", F.lit(100)) == 0))
