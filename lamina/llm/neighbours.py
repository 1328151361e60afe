"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors: the exact neighbour graph, cut into parts of equal size by recursive spectral
bisection, then small classifiers, one for each depth of the bisection, that learn each sampled vector's distribution of
parts among itself and its neighbours. A second sample, not fitted on, tells for each depth how many of the most probable
parts a query must search to find RECALL of its true neighbours (by the lower bound of that share, so that few measured
ones ask for more parts), and the depth that searches least is taken: many small parts where vectors form clusters, few
where they don't. Parts grow in number with the sample, and so with the table, up to MAX_PARTS. Every row of the table is
put into its most probable part; a query searches its most probable ones and reranks by the exact cosine. Equal vectors
are one candidate that carries its least ids: more of them than are asked for can't enter a result, as ties go to smaller
ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, stored, table, tune

#: Vectors fitted on and vectors measured on at most, least of the fitted ones in a part, parts at most, neighbours in the graph.
SAMPLE, MEASURED, PER_PART, MAX_PARTS, DEGREE = 8_192, 2_048, 32, 256, 10
#: Share of true neighbours that the searched parts must hold.
RECALL = 0.95
#: What a query's copy to one more part costs, as a share of a search through the whole table.
COPY = 0.001
#: Rows of a task: candidates and queries.
BLOCK, QUERIES = 16_384, 2_048


def neighbour_graph(x: np.ndarray, k: int, rows: int | None = None) -> np.ndarray:
    """The k nearest of each of the first rows, its own left out."""
    k, out, rows = min(k, len(x) - 1), [], len(x) if rows is None else rows
    for i in range(0, rows, 256):
        s = x[i : min(i + 256, rows)] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, 1)[:, :k] if k else np.zeros((len(s), 0), np.int64))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part per node, all within one of the same size: each set is halved at the median of its graph's second eigenvector."""
    n = len(graph)
    part = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    while part.max() + 1 < parts and part.max() + 1 < n:
        inside = part[a] == part[b]
        i, j = np.concatenate([a[inside], b[inside]]), np.concatenate([b[inside], a[inside]])
        degree = np.bincount(i, minlength=n) + 1.0
        v, root, size = rng.standard_normal(n), np.sqrt(degree), np.bincount(part)
        for _ in range(60):  # power iterations of every set at once, without its first eigenvector
            v -= root * (np.bincount(part, v * root) / np.bincount(part, degree))[part]
            v = v / root
            v = (np.bincount(i, v[j], n) + v) / root + v * root
            v /= np.sqrt(np.bincount(part, v * v))[part] + 1e-30
        order = np.lexsort((v / root, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        part = 2 * part + (place - start[part] >= (size[part] + 1) // 2)
        part = np.unique(part, return_inverse=True)[1]
    return part


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 600, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(7)
        d, p = x.shape[1], target.shape[1]
        w = [rng.standard_normal((d, hidden)) * np.sqrt(2), np.zeros(hidden), rng.standard_normal((hidden, p)) / np.sqrt(hidden), np.zeros(p)]
        m, s = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        for t in range(1, steps + 1):
            own = rng.integers(0, len(x), min(512, len(x)))
            h = np.maximum(x[own] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            q = np.exp(z - z.max(1, keepdims=True))
            g = (q / q.sum(1, keepdims=True) - target[own]) / len(own)
            gh = (g @ w[2].T) * (h > 0)
            for i, grad in enumerate((x[own].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.99 * s[i] + 0.01 * grad * grad
                w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
        self.w = [v.astype(np.float64) for v in w]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def fit(sample: np.ndarray, other: np.ndarray, k: int, recall: float = RECALL, most: int = MAX_PARTS) -> tuple[Router, int, int]:
    """The router that searches least, how many parts it has and how many a query searches. sample, other: unit rows; fewer than 4 * PER_PART of the first stay in one part."""
    rng = np.random.default_rng(11)
    best = (1.0, Router(np.zeros((1, max(1, sample.shape[1]))), np.ones((1, 1)), steps=0), 1, 1)
    depth = int(np.log2(max(1, min(most, len(sample) // PER_PART))))
    if depth >= 2 and len(other) > k:
        graph = neighbour_graph(sample.astype(np.float32), DEGREE)
        finest = balanced_parts(graph, 2**depth, rng)
        n = min(len(other), 1024)
        near = neighbour_graph(other.astype(np.float32), k, n)
        for up in range(depth - 2, -1, -2):
            part = finest >> up
            target = np.zeros((len(sample), part.max() + 1))
            np.add.at(target, (np.arange(len(sample)), part), 1 + graph.shape[1])
            np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph.ravel()]), 1)
            router = Router(sample, target / target.sum(1, keepdims=True), rng=rng)
            probes = probes_for(router, other, near, recall)
            best = min(best, (probes / target.shape[1] + COPY * probes, router, target.shape[1], probes), key=lambda b: b[0])
    return best[1:]


def probes_for(router: Router, other: np.ndarray, near: np.ndarray, recall: float = RECALL) -> int:
    """The fewest parts whose search finds, by a lower bound of two deviations, this share of near: the neighbours of the first of other unit rows among all of these."""
    z = router.logits(other)
    rank = np.argsort(np.argsort(-z[: len(near)], 1, kind="stable"), 1)
    found = np.take_along_axis(rank, z.argmax(1)[near], 1).ravel()
    reached = np.cumsum(np.bincount(found, minlength=z.shape[1])) / max(1, len(found))
    sure = reached - 2 * np.sqrt(reached * (1 - reached) / max(1, len(found)))
    return min(int(np.searchsorted(sure, recall)) + 1, z.shape[1])


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; in double precision, scaled first so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine by a bit, so that no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack([v.values.to_numpy(zero_copy_only=False) for v in column]).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>): rows whose vector is neither null nor zero and holds only finite numbers, of the most frequent length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    v = v.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    length = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return v.join(F.broadcast(length.select("d")), F.size("embedding") == F.col("d"), "left_semi")


def distinct_vectors(v: DataFrame, least: int) -> DataFrame:
    """(ids, embedding): each different vector once, with the least ids that have it."""
    keyed = v.withColumn("a", F.xxhash64("embedding")).withColumn("b", F.hash("embedding"))
    few = keyed.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).filter(F.col("r") <= least)
    return few.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")).select("ids", "embedding")


def routed(df: DataFrame, ident: str, kind: str, router: Router, probes: int) -> DataFrame:
    """(ident, embedding, part): each row with its most probable parts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not len(batch):
            return None
        z = router.logits(unit(matrix(batch.column(1))))
        best = np.argsort(-z, 1, kind="stable")[:, :probes]
        rows = pa.array(np.repeat(np.arange(len(z)), best.shape[1]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(best.ravel().astype(np.int32))], [ident, "embedding", "part"])

    return per_batch(df.select(ident, "embedding"), run, f"{ident} {kind}, embedding array<double>, part int")


def nearest(vectors: DataFrame, every: int, k: int = 5, sample: int = SAMPLE, most: int = MAX_PARTS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest of each row whose vec_id is divisible by every, its own row left out.

    Rows that take no part are those of usable(). A repeated vec_id counts as one more candidate, but no row of the
    query's own id is. Fewer than k candidates: all that the searched parts hold. Candidates of equal scores, whether
    their vectors are equal or not, go by their ids. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    v = stored(usable(vectors), "vectors")
    different = stored(distinct_vectors(v, k + 1), "distinct")
    some = different.orderBy(F.xxhash64("embedding"), "ids").limit(sample + MEASURED).select("embedding").toArrow()
    some = unit(matrix(some.column(0).combine_chunks())) if some.num_rows else np.zeros((0, 1))
    measured = min(MEASURED, len(some) // 2)
    router, _, probes = fit(some[measured:], some[:measured], k, recall, most)

    candidates = stored(routed(different, "ids", "array<long>", router, 1), "candidates")
    queries = stored(routed(v.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "vec_id", "long", router, probes), "queries")
    # a part's candidates and queries are dealt to as many tasks as their numbers ask for; a row of counts per part
    count = lambda df, size, name: df.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias(name))
    grid = F.broadcast(count(candidates, BLOCK, "rows").join(count(queries, QUERIES, "columns"), "part"))
    all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    c = candidates.join(grid, "part").withColumn("i", F.pmod(F.xxhash64("ids"), "rows").cast("int")).withColumn("j", all_of("columns")).select("part", "i", "j", F.lit(1).alias("kind"), "ids", "embedding")
    q = queries.join(grid, "part").withColumn("j", F.pmod(F.xxhash64("vec_id"), "columns").cast("int")).withColumn("i", all_of("rows")).select("part", "i", "j", F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), "embedding")
    dealt = q.unionByName(c).repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Search | None = None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if state is None or state.key != tuple(key[a, :3].tolist()):
                    if state is not None:
                        yield state.result()
                    state = Search(tuple(key[a, :3].tolist()), k)
                ids, x = batch.column(4).slice(a, b - a), matrix(batch.column(5).slice(a, b - a))
                state.add(ids, x) if key[a, 3] else state.ask(ids, x)
        if state is not None:
            yield state.result()

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Search:
    """The best candidates of one block so far, for each of its queries."""

    def __init__(self, key: tuple, k: int):
        self.key, self.k, self.queries, self.x, self.best, self.least = key, k, [], [], {}, np.zeros(0)

    def ask(self, ids: pa.Array, x: np.ndarray) -> None:
        self.queries += ids.flatten().to_pylist()
        self.x.append(scaled(x))

    def add(self, ids: pa.Array, x: np.ndarray) -> None:
        if not self.queries:
            return
        if len(self.least) < len(self.queries):
            self.x = [np.concatenate(self.x)]
            self.units, self.least = unit(self.x[0]), np.full(len(self.queries), -np.inf)
        x, more = scaled(x), self.k + 1
        error = (x.shape[1] + 8) * 4e-16  # of a sum of products: what is nearer than this is told apart by the exact score alone
        near, ids = self.units @ unit(x).T, ids.to_pylist()
        may = near >= self.least[:, None] - error
        for r in np.flatnonzero(may.any(1)).tolist():
            at = np.flatnonzero(may[r])
            if len(at) > more:
                at = at[near[r, at] >= np.partition(near[r, at], -more)[-more] - 2 * error]
            # the same sum whatever the block's shape, so that ties are ties
            q, c = self.x[0][r], x[at]
            score = (c * q).sum(1) / np.sqrt((c * c).sum(1) * (q * q).sum())
            own = self.queries[r]
            found = self.best.get(r, []) + [(-s, i) for s, j in zip(score.tolist(), at.tolist(), strict=True) for i in ids[j] if i != own]
            best = self.best[r] = sorted(found)[: self.k]
            if len(best) == self.k:
                self.least[r] = -best[-1][0]

    def result(self) -> pa.RecordBatch:
        rows = [(self.queries[r], i, -s) for r, found in self.best.items() for s, i in found]
        a, b, c = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50)
