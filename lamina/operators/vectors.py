"""Embeddings, the vector table, exact search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored

#: Queries of a block, which every task of a search is sent.
BROADCAST_QUERIES = 20_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def build_index(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id and float vectors: a table is the index. Needs columns chunk_id and embedding."""
    return chunks.withColumn("embedding", F.col("embedding").cast("array<float>"))


def with_dense_ids(chunks: DataFrame, *order: str) -> DataFrame:
    """chunk_id 0..n-1 in the given order: places within a range partition, moved by the sizes of those before. The range
    sort is the only shuffle; its result is written, since bounds of ranges are sampled and must not differ between the
    two reads. The sizes are a row per partition."""
    ranged = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    ranged = stored(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("chunk_id", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def metadata(index: DataFrame) -> DataFrame:
    return index.select("chunk_id", "doc_id", "page_start", "page_end", "text")


def sanity(index: DataFrame) -> DataFrame:
    """One row: (n, dense, one_dim): ids are 0..n-1, and all vectors have one length."""
    d = F.size("embedding")
    ids = (F.min("chunk_id") == 0) & (F.max("chunk_id") == F.count(F.lit(1)) - 1) & (F.countDistinct("chunk_id") == F.count(F.lit(1)))
    return index.agg(F.count(F.lit(1)).alias("n"), ids.alias("dense"), (F.min(d) == F.max(d)).alias("one_dim"))


def top_k(queries: DataFrame, index: DataFrame, k: int = 30, keys: tuple[str, ...] = ("note_id", "q_no")) -> DataFrame:
    """(keys, rank, chunk_id, score): the k best inner products of each query over all rows of the index, ties to smaller ids.

    Queries meet the whole index in blocks of at most about BROADCAST_QUERIES, which are counted before they are sent to
    the tasks; a task multiplies matrices and keeps k rows a query, so that is all that is shuffled. More queries than a
    block holds cost one scan of the vectors each. Text never enters the scan; null vectors take no part.
    """
    asked = queries.select(*keys, F.col("embedding").cast("array<double>").alias("_q")).filter("_q is not null")
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    kinds = ", ".join(f"{c} {t}" for c, t in asked.drop("_q").dtypes)
    ship(index.sparkSession)
    found = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == b)
        block = own.toArrow()
        found.append(index.select("chunk_id", F.col("embedding").cast("array<double>")).filter("embedding is not null").mapInArrow(_searching(block, k), f"{kinds}, chunk_id {dict(index.dtypes)['chunk_id']}, score double"))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*keys, "rank", "chunk_id", "score")


def _searching(block: pa.Table, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's search of its rows for a block of queries, whose last column is their vectors."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = matrix(block.column(block.num_columns - 1).combine_chunks())
        best, least = [[] for _ in q], np.full(len(q), -np.inf)
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            ids, x = batch.column(0).to_pylist(), matrix(batch.column(1))
            error = (x.shape[1] + 8) * 4e-16 * max(1.0, float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1])
            step = max(1, 4_000_000 // len(q))
            for at in range(0, len(x), step):
                near = q @ x[at : at + step].T
                may = near >= least[:, None] - error
                for r in np.flatnonzero(may.any(1)).tolist():
                    own = np.flatnonzero(may[r])
                    if len(own) > k:
                        own = own[near[r, own] >= np.partition(near[r, own], -k)[-k] - 2 * error]
                    # one sum for each pair, whatever the batch, so that equal vectors have equal scores
                    scores = (x[at + own] * q[r]).sum(1)
                    best[r] = sorted(best[r] + [(-s, ids[at + i]) for s, i in zip(scores.tolist(), own.tolist(), strict=True)])[:k]
                    if len(best[r]) == k:
                        least[r] = -best[r][-1][0]
        rows = pa.array([r for r, b in enumerate(best) for _ in b], pa.int64())
        keys = [block.column(i).combine_chunks().take(rows) for i in range(block.num_columns - 1)]
        chunk_ids, scores = [i for b in best for _, i in b], [-s for b in best for s, _ in b]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(chunk_ids, pa.int64()), pa.array(scores, pa.float64())], [*block.schema.names[:-1], "chunk_id", "score"])

    return run
