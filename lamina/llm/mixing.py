"""Sources mixed to target weights: iterative proportional fitting over source, language and topic, then sampling.

Topics are learned: spherical k-means over hashed tokens, less what is usual in a text's language, on every different
text. Documents are tokenized once; the texts' vectors lie in files of the shared folder, and each step of the fit is one
pass over these that sends a sum for each topic to the driver. Documents are counted into cells of equal source, language and topic, with their tokens (those that
packing counts). The cells' weights are raked in turn to each target marginal until none moves by more than TOLERANCE. A
document of a cell is kept with the probability weight / greatest weight, decided by a hash of its id, so the kept tokens
have the targets' shares in expectation, no document is repeated, and the sample is the largest of its kind. One rare cell
of a great weight makes that sample small: expected_share tells how small, and bound cuts weights off where it matters
more than the last decimals of the targets.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, per_batch, raw, scratch_path, stored, table, tune
from .tokens import default_vocabulary, word_ids

AXES = ("source", "lang", "topic")
#: Targets by default: each axis's own shares to this power, so that what is rare gains and nothing vanishes.
TEMPER = 0.9
TOLERANCE, ROUNDS = 1e-9, 60
#: Cells up to this many are raked on the driver, a few dozen bytes each; more are raked as a table, with the same result.
DRIVER_CELLS = 200_000
#: Topics, entries of a text's vector, steps of the fit at most.
TOPICS, WIDTH, STEPS = 8, 256, 25
#: Steps from 0 to 1 of a vector's entries in the fit: sums of whole numbers are the same in any order.
GRID = 1 << 14
#: Vectors of a block, about.
ROWS = 4096
#: The topic of texts without tokens.
NONE = -1


def vector(ids: np.ndarray) -> np.ndarray:
    """A text's token ids, hashed by their remainders, counted, dampened and scaled to length 1."""
    return scaled(np.bincount(ids % WIDTH, minlength=WIDTH))


def scaled(counts: np.ndarray) -> np.ndarray:
    v = np.log1p(counts)
    return v / (np.sqrt(v @ v) or 1.0)


def small(counts: np.ndarray) -> bytes:
    """Counts in the narrowest whole numbers that hold them all."""
    most = int(counts.max())
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // WIDTH}").astype(np.int64)


class Topics:
    """Centroids, and the mean vector of each language to take off before."""

    def __init__(self, centroids: np.ndarray, means: dict[str, np.ndarray], mean: np.ndarray):
        self.centroids, self.means, self.mean = centroids, means, mean

    def of(self, ids: np.ndarray, lang: str) -> int:
        """The nearest centroid's number, the first of equally near ones; NONE without ids."""
        return self.near(vector(ids), lang) if len(ids) else NONE

    def near(self, v: np.ndarray, lang: str) -> int:
        return int(np.round(self.centroids @ (v - self.means.get(lang, self.mean)), 12).argmax())


def learn(x: np.ndarray, langs: list[str], k: int = TOPICS, steps: int = STEPS) -> Topics:
    """Vectors of different texts, in an order that doesn't depend on how they came, to topics; Vectors.topics() does the same over files."""
    if not len(x):
        return Topics(np.zeros((1, WIDTH)), {}, np.zeros(WIDTH))
    langs, mean = np.array(langs), x.mean(0)
    means = {str(v): x[langs == v].mean(0) for v in np.unique(langs)}
    y = x - np.stack([means[v] for v in langs.tolist()])
    c = [y[(y * y).sum(1).argmax()]]
    while len(c) < min(k, len(y)):  # each further start is the vector least like those before
        c.append(y[np.max(y @ np.stack(c).T, 1).argmin()])
    c = np.stack(c)
    for _ in range(steps):
        c = c / (np.sqrt((c * c).sum(1, keepdims=True)) + 1e-12)
        near = (y @ c.T).argmax(1)
        c = np.stack([y[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
    return Topics(c / (np.sqrt((c * c).sum(1, keepdims=True)) + 1e-12), means, mean)


def keys_of(docs: DataFrame) -> list[F.Column]:
    """Source and language, null counting as ''."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")]


class Vectors:
    """The vectors of all different texts, in files of the shared folder. A file is a row of blocks, each of hashes, languages, places in these and vectors."""

    def __init__(self, counted: DataFrame):
        """counted: as counted() returns. Of equal texts one is taken, in the first of their languages."""
        once = counted.filter("tokens > 0").groupBy("h").agg(F.min("lang").alias("lang"), F.first("counts").alias("counts"))
        spark, folder = counted.sparkSession, scratch_path(counted.sparkSession, "vectors")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, path = pafs.FileSystem.from_uri(uri := f"{folder}/{uuid.uuid4().hex}")
            n, out, waiting = 0, None, []

            def flush() -> None:
                langs, code = np.unique(np.concatenate([v for _, v, _ in waiting]), return_inverse=True)
                buffer = io.BytesIO()
                for part in (np.concatenate([h for h, _, _ in waiting]), langs, code.astype(np.int32), np.concatenate([x for _, _, x in waiting])):
                    np.save(buffer, part)
                out.write(buffer.getvalue())
                waiting.clear()

            for batch in batches:
                if len(batch):
                    out = out or fs.open_output_stream(path)
                    x = np.stack([scaled(large(c)) for c in batch.column(2).to_pylist()])
                    waiting.append((batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=np.str_), np.round(x * GRID).astype("<u2")))
                    n += len(batch)
                    if sum(len(h) for h, _, _ in waiting) >= ROWS:
                        flush()
            if waiting:
                flush()
            if out:
                out.close()
                yield pa.RecordBatch.from_pydict({"uri": [uri], "n": pa.array([n], pa.int64())})

        fs, name = pafs.FileSystem.from_uri(folder)
        fs.create_dir(name)
        # only files of tasks that ended well are among the rows; those of others are never read
        files = once.mapInArrow(write, "uri string, n long").collect()
        self.sc, self.files, self.n = spark.sparkContext, sorted(f["uri"] for f in files), sum(f["n"] for f in files)

    def each(self, f: Callable[[Iterator[tuple]], Iterator]) -> RDD:
        """What f yields in each task for its files' blocks (hashes, languages, places in these, vectors as whole numbers). A few tasks a core, so that what comes to the driver doesn't grow with the table."""
        tasks = min(len(self.files), 4 * self.sc.defaultParallelism)
        return self.sc.parallelize(self.files, tasks).mapPartitions(lambda uris: f(b for uri in uris for b in blocks(uri)))

    def topics(self, k: int = TOPICS, steps: int = STEPS) -> Topics:
        """learn() in passes over the files. A step that moves nothing is the last, as all further ones would be the same."""
        if not self.n:
            return learn(np.zeros((0, WIDTH)), [])

        def summed(found: Iterator[tuple]) -> Iterator[tuple]:
            out: dict = {}
            for _, langs, code, x in found:
                for i, v in enumerate(langs.tolist()):
                    n, total = out.get(v, (0, 0))
                    out[v] = n + int((code == i).sum()), total + x[code == i].sum(0, dtype=np.int64)
            yield from out.items()

        sums = dict(self.each(summed).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect())
        means = {v: total / (n * GRID) for v, (n, total) in sorted(sums.items())}
        mean = sum(total for _, total in sums.values()) / (self.n * GRID)

        def outlying(c: np.ndarray | None) -> np.ndarray:
            """The vector least like all of c, or else the longest; of equal ones that of the least hash."""

            def best(found: Iterator[tuple]) -> Iterator[tuple]:
                least = None
                for h, langs, code, x in found:
                    m = np.stack([means[v] for v in langs.tolist()])
                    if c is None:
                        far = -np.square(x / GRID - m[code]).sum(1)
                    else:
                        far = (x.astype(float) @ c.T / GRID - (m @ c.T)[code]).max(1)
                    far = np.round(far, 12)
                    i = np.lexsort((h, far))[0]
                    if least is None or (far[i], h[i]) < least[:2]:
                        least = float(far[i]), int(h[i]), x[i] / GRID - m[code[i]]
                yield least

            return min(self.each(best).collect(), key=lambda found: found[:2])[2]

        c = np.stack([outlying(None)])
        while len(c) < min(k, self.n):
            c = np.concatenate([c, outlying(c)[None]])

        def assigned(c: np.ndarray) -> Callable:
            def add(found: Iterator[tuple]) -> Iterator[tuple]:
                total, members = np.zeros((len(c), WIDTH)), {}
                for _, langs, code, x in found:
                    m, x = np.stack([means[v] for v in langs.tolist()]), x.astype(float)
                    near = np.round(x @ c.T / GRID - (m @ c.T)[code], 12).argmax(1)
                    total += (near == np.arange(len(c))[:, None]).astype(float) @ x
                    for i, v in enumerate(langs.tolist()):
                        members[v] = members.get(v, 0) + np.bincount(near[code == i], minlength=len(c))
                yield total.astype(np.int64), members

            return add

        before = None
        for _ in range(steps):
            c = c / (np.sqrt((c * c).sum(1, keepdims=True)) + 1e-12)
            total, members = np.zeros((len(c), WIDTH), np.int64), {v: np.zeros(len(c), np.int64) for v in means}
            for own, of in self.each(assigned(c)).collect():
                total += own
                for v, n in of.items():
                    members[v] += n
            now = total.tobytes(), [n.tobytes() for n in members.values()]
            if now == before:
                break
            before, size = now, sum(members.values())
            moved = total / GRID - sum(n[:, None] * means[v] for v, n in members.items())
            c = np.where(size[:, None] > 0, moved, c)
        return Topics(c / (np.sqrt((c * c).sum(1, keepdims=True)) + 1e-12), means, mean)


def blocks(uri: str) -> Iterator[tuple]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        end = file.size()
        while file.tell() < end:
            yield tuple(np.load(file) for _ in range(4))


def fit_topics(docs: DataFrame, k: int = TOPICS, vocabulary: str | None = None) -> Topics:
    """Topics from the vectors of all different texts with tokens. WIDTH numbers a language and a topic come to the driver, and no text."""
    return Vectors(stored(counted(docs, vocabulary), "counted")).topics(k)


def uniform() -> F.Column:
    """A number from 0 to 1 of each doc_id, by a hash."""
    return F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long")), F.lit(1 << 52)) / float(1 << 52)


def profiled(docs: DataFrame, topics: Topics, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, u) for each row: null source and lang count as '', tokens are ids of the vocabulary; u is the row's uniform number from a hash of its id."""
    path = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> dict:
        ids, found, tokens = word_ids(path), [], []
        for text, lang in zip(raw(batch.column(3)), batch.column(2).to_pylist(), strict=True):
            own = ids.ids(text)
            found.append(topics.of(own, lang))
            tokens.append(len(own))
        return {"doc_id": batch.column(0), "source": batch.column(1), "lang": batch.column(2), "topic": found, "tokens": tokens, "u": batch.column(4)}

    tune(docs.sparkSession)
    source, lang = keys_of(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), lang.alias("lang"), F.col("text").cast("string").alias("text"), uniform().alias("u"))
    return per_batch(slim, run, "doc_id long, source string, lang string, topic int, tokens long, u double")


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, u, h, counts) for each row: as profiled(), with the text's hash and what its vector is made of instead of a topic."""
    path = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> dict:
        ids, counts, tokens = word_ids(path), [], []
        for text in raw(batch.column(3)):
            own = ids.ids(text)
            counts.append(small(np.bincount(own % WIDTH, minlength=WIDTH)))
            tokens.append(len(own))
        return {"doc_id": batch.column(0), "source": batch.column(1), "lang": batch.column(2), "tokens": tokens, "u": batch.column(4), "h": batch.column(5), "counts": counts}

    tune(docs.sparkSession)
    source, lang = keys_of(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), lang.alias("lang"), F.col("text").cast("string").alias("text"), uniform().alias("u"), F.xxhash64("text").alias("h"))
    return per_batch(slim, run, "doc_id long, source string, lang string, tokens long, u double, h long, counts binary")


def placed(found: DataFrame, topics: Topics) -> DataFrame:
    """What profiled() returns, from counted()."""

    def run(batch: pa.RecordBatch) -> dict | None:
        if not len(batch):
            return None
        v = np.log1p(np.stack([large(c) for c in batch.column(5).to_pylist()]))
        v /= np.sqrt((v * v).sum(1, keepdims=True)) + (v == 0).all(1, keepdims=True)
        means = np.stack([topics.means.get(lang, topics.mean) for lang in batch.column(2).to_pylist()])
        near = np.round((v - means) @ topics.centroids.T, 12).argmax(1)
        own = np.where(batch.column(3).to_numpy() > 0, near, NONE).astype(np.int32)
        return {"doc_id": batch.column(0), "source": batch.column(1), "lang": batch.column(2), "topic": own, "tokens": batch.column(3), "u": batch.column(4)}

    return per_batch(found.select("doc_id", "source", "lang", "tokens", "u", "counts"), run, "doc_id long, source string, lang string, topic int, tokens long, u double")


def learned(docs: DataFrame, topics: Topics | None = None) -> tuple[DataFrame, Topics]:
    """profiled(), stored, and its topics, learned here unless given; either way texts are tokenized once."""
    if topics:
        return stored(profiled(docs, topics), "profiled"), topics
    found = stored(counted(docs), "counted")
    topics = Vectors(found).topics()
    return stored(placed(found, topics), "profiled"), topics


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def tempered(shares: pd.Series, power: float = TEMPER) -> pd.Series:
    t = (shares / shares.sum()) ** power
    return t / t.sum()


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> np.ndarray:
    """Factors w of the cells so that the shares of w * tokens meet each axis's targets (which sum to 1) as nearly as the cells allow. A value without a target has the target 0."""
    w, tokens = np.ones(len(cells)), cells["tokens"].to_numpy(float)
    codes = {a: pd.factorize(cells[a]) for a in targets}
    for _ in range(rounds):
        moved = 0.0
        for a, (code, names) in codes.items():
            goal = targets[a].reindex(names).fillna(0).to_numpy()
            have = np.bincount(code, w * tokens, len(names))
            by = np.divide(goal * have.sum(), have, out=np.ones(len(names)), where=have > 0)
            w *= by[code]
            moved = max(moved, float(np.abs(by - 1).max(initial=0)))
        if moved < tolerance:
            break
    return w


def rake_table(cells: DataFrame, power: float, targets: dict[str, dict], tolerance: float, rounds: int) -> DataFrame:
    """rake() over any number of cells. A cell's weight is the product of its axes' factors, so only tables of factors, a row for each value of an axis, are written in a step; the cells stay as they are."""
    spark, kinds = cells.sparkSession, dict(cells.dtypes)
    goals, factors = {}, {}
    for a in AXES:
        if a in targets:
            whole = sum(targets[a].values())
            goal = spark.createDataFrame([(k, v / whole) for k, v in targets[a].items()], f"{a} {kinds[a]}, goal double")
        else:
            share = cells.groupBy(a).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow("t", power))
            goal = share.crossJoin(F.broadcast(share.agg(F.sum("p").alias("all")))).select(a, (F.col("p") / F.col("all")).alias("goal"))  # a row with one sum
        goals[a] = stored(goal, "goal")
        factors[a] = stored(cells.select(a).distinct().withColumn(f"f_{a}", F.lit(1.0)), "factors")

    def now() -> DataFrame:
        met = cells
        for a in AXES:
            met = met.join(factors[a], a)
        return met.withColumn("w", F.col("f_source") * F.col("f_lang") * F.col("f_topic"))

    for _ in range(rounds):
        moved = 0.0
        for a in AXES:
            have = stored(now().groupBy(a).agg(F.sum(F.col("w") * F.col("tokens")).alias("have")), "have")
            whole = F.broadcast(have.agg(F.sum("have").alias("all")))  # one row
            by = F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) * F.col("all") / F.col("have")).otherwise(1.0)
            step = stored(factors[a].join(have, a).join(goals[a], a, "left").crossJoin(whole).select(a, f"f_{a}", by.alias("by")), "step")
            moved = max(moved, step.agg(F.max(F.abs(F.col("by") - 1)).alias("m")).first()["m"] or 0.0)
            factors[a] = step.select(a, (F.col(f"f_{a}") * F.col("by")).alias(f"f_{a}"))
        if moved < tolerance:
            break
    return now().select(*cells.columns, "w")


def weighted(rows: DataFrame, power: float = TEMPER, targets: dict[str, dict] | None = None, driver_cells: int = DRIVER_CELLS, bound: float | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, docs, w, probability, expected_share) per cell.

    targets by axis and value override the tempered shares of that axis. bound cuts weights off at so many times their
    mean over all tokens. expected_share, the same for all cells, is the share of all tokens that the sample keeps.
    """
    cells = stored(cells_of(rows), "cells")
    if cells.count() <= driver_cells:
        known = cells.toPandas().sort_values(list(AXES), ignore_index=True)
        goals = {a: tempered(known.groupby(a)["tokens"].sum(), power) if known["tokens"].sum() else known.groupby(a)["tokens"].sum() for a in AXES}
        for a, given in (targets or {}).items():
            goals[a] = pd.Series(given, dtype=float) / sum(given.values())
        known["w"] = rake(known, goals, tolerance, rounds)
        out = rows.sparkSession.createDataFrame(known, "source string, lang string, topic int, tokens double, docs long, w double")
    else:
        out = stored(rake_table(cells, power, targets or {}, tolerance, rounds), "raked")
    full = out.filter("tokens > 0")
    if bound:
        mean = F.broadcast(full.agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("mean")))  # one row
        out = out.crossJoin(mean).withColumn("w", F.least("w", bound * F.coalesce("mean", F.lit(0.0)))).drop("mean")
        full = out.filter("tokens > 0")
    facts = F.broadcast(full.agg(F.max("w").alias("most"), (F.sum(F.col("w") * F.col("tokens")) / F.max("w") / F.sum("tokens")).alias("expected_share")))  # one row
    return out.crossJoin(facts).withColumn("probability", F.when((F.col("tokens") > 0) & (F.col("most") > 0), F.col("w") / F.col("most")).otherwise(1.0)).drop("most")


def mixed(docs: DataFrame, power: float = TEMPER, targets: dict[str, dict] | None = None, driver_cells: int = DRIVER_CELLS, bound: float | None = None, topics: Topics | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, expected_share, kept) for each row of docs (doc_id, text, source, lang).

    Null sources and languages are values of their own (''); a null or empty text, and any other without tokens, has the topic -1, no tokens, weighs
    nothing and is kept; rows of one doc_id are kept or dropped together within a cell, and so are those without one; an
    empty table gives no rows.
    """
    rows, _ = learned(docs, topics)
    w = stored(weighted(rows, power, targets, driver_cells, bound), "weights").select(*AXES, F.col("w").alias("weight"), "probability", "expected_share")
    out = rows.join(w, list(AXES), "left")
    return out.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "expected_share", (F.col("u") < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, power: float = TEMPER, targets: dict[str, dict] | None = None, bound: float | None = None) -> DataFrame:
    """The rows of docs that mixed() keeps, all columns kept. The verdict is taken per cell and id, so the rows pass through one more scan and no join by document."""
    names, (found, topics) = docs.columns, learned(docs)
    u, topic, s, l, t, p = made = [fresh(names, f"mix_{k}") for k in ("u", "topic", "source", "lang", "of", "probability")]
    w = stored(weighted(found, power, targets, bound=bound), "weights")
    w = w.select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("probability").alias(p))
    rows, keys = _with_topics(docs.withColumn(u, uniform()), topic, topics), keys_of(docs)
    joint = rows.join(w, (keys[0] == F.col(s)) & (keys[1] == F.col(l)) & (F.col(topic) == F.col(t)), "left")
    return joint.filter(F.col(u) < F.col(p)).drop(*made)


def _with_topics(docs: DataFrame, topic: str, topics: Topics, vocabulary: str | None = None) -> DataFrame:
    """docs with a column of this name behind."""
    path = vocabulary or default_vocabulary()
    from pyspark.sql.types import IntegerType, StructType

    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            found = [topics.of(word_ids(path).ids(t), "" if v is None else str(v)) for t, v in zip(raw(batch.column(at)), batch.column(lang).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, topic])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(topic, IntegerType()))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
