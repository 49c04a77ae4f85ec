"""Exact top-k inner products by descending vector length.

Candidates are range-partitioned and sorted by length. A block of queries, bounded in size,
starts with thresholds from the longest vectors of all; each task walks its candidates from
the longest on. A query needs no more of a batch once |q| |x| stays below its k-th best score
(Cauchy-Schwarz); for the rest the first dimensions of an SVD rotation give a partial sum, and
what |q'| |x'| of the remaining dimensions can add decides which pairs get their exact integer
product. The rotation is fitted on a bounded sample; it only decides how early pairs drop out,
never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgrid.llm.common import map_arrow, stored, table, work_dir

K = 5
#: Queries of a block, by their bytes; vectors that give the first thresholds; vectors the rotation is fitted on.
BLOCK_BYTES, SEEDS, SAMPLE = 16 << 20, 1024, 4096
#: Share of the dimensions in the partial sums.
HEAD = 0.25
BATCH = 2048
EXACT = float(1 << 53)
_BEST = "q long, query_id long, score long, vec_id long"


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.n, self.k, self.floor = n, k, floor
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, id)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; beyond 2^53 in Python's integers, held to the range of a long."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if np.sqrt((q * q).sum(1).max()) * np.sqrt((x * x).sum(1).max()) < EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(q: np.ndarray, ids: np.ndarray, rotation: np.ndarray, floor: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Best:
    """The k best of each query among batches of (vec_id, vectors) in descending order of length."""
    best = Best(len(q), k, floor.copy())
    head = max(1, int(HEAD * q.shape[1]))
    turned = q @ rotation
    length = np.sqrt((q * q).sum(1))
    rest = np.sqrt(np.maximum((turned[:, head:] ** 2).sum(1), 0))
    for vec, x in batches:
        norms = np.sqrt((x * x).sum(1))
        slack = 1e-9 * length * norms.max() + 1
        on = np.flatnonzero(length * norms.max() + slack >= best.floor)
        if not len(on):
            continue
        own = x @ rotation
        bound = turned[on, :head] @ own[:, :head].T + np.outer(rest[on], np.sqrt((own[:, head:] ** 2).sum(1))) + slack[on, None]
        row, col = np.nonzero(bound >= best.floor[on, None])
        differ = vec[col] != ids[on[row]]
        row, col = row[differ], col[differ]
        if not len(row):
            continue
        if len(row) > 0.1 * bound.size or np.outer(length, norms).max() >= EXACT:
            score = products(q[on], x)[row, col]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[on[row[i : i + 65536]]], x[col[i : i + 65536]]) for i in range(0, len(row), 65536)]).astype(np.int64)
        keep = score >= best.floor[on[row]]
        best.add(on[row[keep]], score[keep], vec[col[keep]])
    return best


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def top_products(vectors: DataFrame, every: int = 50, k: int = K, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Components become floor(256 x). Queries are the rows whose id is divisible by ``every``;
    candidates are all rows but those of the query's own id, ties go to the smaller id. Null
    vectors and ids, null and non-finite components and empty vectors take no part; vectors of
    different dimension have no product; equal rows are one query but several candidates; other
    columns are ignored; an empty table gives an empty result. Scores are held to the range of a
    long. The driver gets ``SEEDS`` and ``SAMPLE`` vectors and one block of queries at a time.
    """
    spark = vectors.sparkSession
    fit = vectors.where(F.col(id).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    # floor gives a long: beyond its range the double itself, which has no fraction, is meant.
    x = F.transform(F.col(vector), lambda e: F.when(F.abs(e) < 1e15, F.floor(F.lit(256.0) * e.cast("double")).cast("double")).otherwise(F.lit(256.0) * e.cast("double")))
    rows = fit.select(F.col(id).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = stored(rows.repartitionByRange(parts, F.desc("norm")).sortWithinPartitions(F.desc("norm"), "vec_id"), "vectors")
    found, number = work_dir(spark, "best"), 0
    spark.createDataFrame([], _BEST).write.parquet(f"{found}/none")
    for (dimension,) in data.select(F.size("x")).distinct().collect():
        own = data.where(F.size("x") == dimension)
        fixed = lambda got: (np.array([r.vec_id for r in got], np.int64), np.array([r.x for r in got], float).reshape(len(got), -1))
        sample = fixed(own.orderBy(F.xxhash64("vec_id"), "x").limit(SAMPLE).collect())[1]
        rotation = np.linalg.svd(sample.T @ sample)[0]
        seeds = fixed(own.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect())
        queries = own.where(F.col("vec_id") % every == 0).select("vec_id", "x").distinct()
        for ids, q in _blocks(queries, max(1, BLOCK_BYTES // (8 * dimension))):
            scores = products(q, seeds[1])
            floor = np.full(len(q), -(1 << 63), np.int64)
            other = [np.sort(s[seeds[0] != i])[::-1] for s, i in zip(scores, ids)]
            for n, s in enumerate(other):
                if len(s) >= k:
                    floor[n] = s[k - 1]
            shared = spark.sparkContext.broadcast((q, ids, rotation, floor))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, first=number) -> Iterator[pa.RecordBatch]:
                q, ids, rotation, floor = shared.value

                def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    for batch in batches:
                        for at in range(0, batch.num_rows, BATCH):
                            part = batch.slice(at, BATCH)
                            yield part.column(0).to_numpy(), matrix(part.column(1))

                best = search(q, ids, rotation, floor, parts(), k)
                yield pa.RecordBatch.from_arrays([pa.array(best.query + first), pa.array(ids[best.query]), pa.array(best.score), pa.array(best.id)], names=["q", "query_id", "score", "vec_id"])

            # A block is done, and gone from the executors, before the next one comes.
            map_arrow(own.select("vec_id", "x"), run, _BEST).write.parquet(f"{found}/{number}")
            shared.destroy()
            number += len(q)
    out = spark.read.schema(_BEST).option("recursiveFileLookup", True).parquet(found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks, read one partition at a time."""
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.toLocalIterator():
        ids.append(r.vec_id)
        rows.append(r.x)
        if len(ids) == most:
            yield np.array(ids, np.int64), np.array(rows, float)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, float)


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return top_products(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
