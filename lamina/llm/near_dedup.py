"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets decide.

1. One pass makes each document's set of hashed 5-word shingles and from it a 128-bit hash of the set, BANDS keys of ROWS
   MinHash samples each, and the odd sketch: a bitmap in which every sample flips one bit, so that the XOR of two
   sketches has about as many ones as the samples in which the sets differ.
2. Equal sets collapse into a class with the smallest doc_id as representative.
3. Representatives that share a band key are joined to the smallest of them: an edge per member, never all pairs. The
   components of these edges hold every pair that any band proposes.
4. Each component is searched for links in one task. In a large one, all members are first compared with its smallest;
   those that don't link with it are then searched against all, in tasks for pairs of blocks. A search goes breadth first
   from a document to the unvisited ones whose size and sketch allow the similarity, and confirms on full sets; it
   returns a spanning forest, so its output grows with the members and not with their pairs.
5. The components of the forests' edges are the result.

A pair at the threshold t shares no band with a chance of (1 - t ** rows) ** bands, 2e-7 for each of the PLANS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import int64, joined, lists, lowered, per_batch, raw, stored, table, tune, windows, word_hashes
from .components import connected_components

SHINGLE, BANDS, ROWS, SKETCH_BITS = 5, 40, 7, 1024
#: Percent. The sketch's estimate errs with a deviation of about 0.03 near the threshold; pairs far below are not confirmed.
THRESHOLD, SCREEN = 85, 0.68
#: The threshold of the pipeline's stage.
STAGE_THRESHOLD = 80
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 18


@dataclass(frozen=True)
class Plan:
    """A threshold in percent, and the bands, samples of a band and screen that go with it."""

    percent: int
    bands: int
    rows: int
    screen: float

    @property
    def samples(self) -> int:
        return self.bands * self.rows


PLAN = Plan(THRESHOLD, BANDS, ROWS, SCREEN)
PLANS = {p.percent: p for p in (PLAN, Plan(STAGE_THRESHOLD, 51, 6, 0.62))}


@cache
def _family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of as many hash functions."""
    rng = np.random.default_rng(20_240_501)
    mul = (rng.integers(0, 1 << 31, samples, np.uint32) << np.uint32(1)) | np.uint32(1)
    return mul, rng.integers(0, 1 << 32, samples, np.uint32)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of A-Z lower-cased text; of the whole sequence, if it is shorter."""
    a = word_hashes(lowered(text).split())
    if not len(a):
        return a
    return np.unique(windows(a, k)) if len(a) >= k else joined(windows(a, len(a)), np.full(1, len(a), np.uint64))


def minhash(s: np.ndarray, samples: int = PLAN.samples) -> np.ndarray:
    mul, add = _family(samples)
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(samples, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * mul + add).min(0), out)
    return out


def band_keys(m: np.ndarray, plan: Plan = PLAN) -> np.ndarray:
    """(documents, bands) keys of (documents, samples) MinHashes."""
    rows = m.astype(np.uint64).reshape(len(m), plan.bands, plan.rows)
    key = np.broadcast_to(np.arange(plan.bands, dtype=np.uint64), rows.shape[:2])
    for r in range(plan.rows):
        key = joined(key.copy(), rows[:, :, r])
    return key


def odd_sketches(m: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(documents, bits / 8) bytes: the parity of the samples that fall on each bit."""
    n, k = m.shape
    place = joined(np.broadcast_to(np.arange(k, dtype=np.uint64), m.shape).copy(), m.astype(np.uint64)) % np.uint64(bits)
    hits = np.bincount((place.astype(np.int64) + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits)
    return np.packbits((hits & 1).astype(np.uint8).reshape(n, bits), axis=1)


def sketch_similarity(a: np.ndarray, b: np.ndarray, samples: int = PLAN.samples) -> np.ndarray:
    """Estimates of the Jaccard similarity from the XOR's ones."""
    bits = a.shape[-1] * 8
    odd = np.minimum(np.bitwise_count(a ^ b).sum(-1) / bits, 0.4999)
    return 1 + bits / (4 * samples) * np.log(1 - 2 * odd)


def signatures(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    def sign(batch: pa.RecordBatch) -> dict:
        sizes, a, b, hashes = [], [], [], np.zeros((len(batch), plan.samples), np.uint32)
        for i, text in enumerate(raw(batch.column(1))):
            s = shingle_set(text)
            sizes.append(len(s))
            if len(s):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
                hashes[i] = minhash(s, plan.samples)
            else:
                a.append(None)
                b.append(None)
        sketch = odd_sketches(hashes)
        return {"doc_id": batch.column(0), "n_shingles": sizes, "a": a, "b": b, "bands": lists(int64(band_keys(hashes, plan).ravel()), np.full(len(batch), plan.bands), pa.int64()), "sketch": [x.tobytes() for x in sketch]}

    return per_batch(docs, sign, "doc_id long, n_shingles long, a long, b long, bands array<long>, sketch binary")


def search(ids: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, tied: np.ndarray | None = None, plan: Plan = PLAN) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents: (id, id of its tree's root). Those tied are known to be in one tree."""
    sizes = np.array([len(s) for s in sets])
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark, open_, edges = ends - sizes, np.zeros(len(every), bool), np.ones(len(ids), bool), []
    known = [] if tied is None else np.flatnonzero(tied).tolist()
    open_[known] = False
    for root in [*known[:1], *np.argsort(ids, kind="stable").tolist()]:
        if not open_[root] and not known:
            continue
        open_[root] = False
        queue, known = known or [root], []
        while queue and open_.any():
            i = queue.pop()
            n = sizes[i]
            may = np.flatnonzero(open_ & (100 * np.minimum(sizes, n) >= plan.percent * np.maximum(sizes, n)))
            if len(may):
                may = may[sketch_similarity(sketches[may], sketches[i], plan.samples) >= plan.screen]
            if not len(may):
                continue
            own = inverse[starts[i] : ends[i]]
            mark[own] = True
            if 4 * sizes[may].sum() < len(inverse) and len(may) < 64:
                both = np.array([np.count_nonzero(mark[inverse[starts[j] : ends[j]]]) for j in may.tolist()])
            else:
                both = np.add.reduceat(mark[inverse].astype(np.int64), starts)[may]
            mark[own] = False
            for j in may[100 * both >= plan.percent * (n + sizes[may] - both)].tolist():
                open_[j] = False
                queue.append(j)
                edges.append((int(ids[j]), int(ids[root])))
        if not open_.any():
            break
    return edges


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that agree in the first columns; they come together, over as many batches as it takes."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a].tolist())
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def linked_to_lead(docs: DataFrame, large: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """large: (doc_id, component, sketch, lead). Adds linked: whether the full set links with that of the lead, which counts as linked."""
    own = docs.join(large.hint("shuffle_hash"), "doc_id")
    leads = docs.join(large.select(F.col("lead").alias("doc_id"), F.col("component").alias("led")).distinct().hint("shuffle_hash"), "doc_id")
    leads = stored(leads.dropDuplicates(["led"]).select("led", F.col("text").alias("lead_text")), "leads")

    def compare(batch: pa.RecordBatch) -> dict:
        out, last, lead = [], None, np.zeros(0, np.uint64)
        for text, other in zip(raw(batch.column(1)), raw(batch.column(5)), strict=True):
            if other != last:
                last, lead = other, shingle_set(other)
            s = shingle_set(text)
            both = len(np.intersect1d(s, lead, assume_unique=True))
            out.append(bool(len(s)) and 100 * both >= plan.percent * (len(s) + len(lead) - both))
        return {name: batch.column(i) for i, name in ((0, "doc_id"), (2, "component"), (3, "sketch"), (4, "lead"))} | {"linked": out}

    pairs = own.join(leads, own["component"] == leads["led"]).select("doc_id", "text", "component", "sketch", "lead", "lead_text")
    return per_batch(pairs, compare, "doc_id long, component long, sketch binary, lead long, linked boolean")


def links(docs: DataFrame, members: DataFrame, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, *, plan: Plan = PLAN) -> DataFrame:
    """(a, b) edges of spanning forests. docs: texts_of() members (doc_id, component, n_shingles, sketch), a row per class."""
    blocks = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int")
    sizes = stored(members.groupBy("component").agg(blocks().alias("k"), F.min("doc_id").alias("lead")), "sizes")
    small = members.join(sizes.filter("k = 1"), "component").select("doc_id", "component", "sketch", F.lit(False).alias("tied"), F.lit(1).alias("free"), F.lit(0).alias("held"))
    if sizes.filter("k > 1").isEmpty():
        placed, edges = small, None
    else:
        large = members.join(sizes.filter("k > 1"), "component")
        checked = stored(linked_to_lead(docs, large.select("doc_id", "component", "sketch", "lead"), plan), "checked")
        edges = checked.filter("linked and doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
        # only those that the lead leaves out are still to be compared: with all, in tasks for pairs of blocks of which one holds them
        sums = checked.join(members.select("doc_id", "n_shingles"), "doc_id").groupBy("component", "linked").agg(blocks().alias("k"))
        sums = sums.groupBy("component").agg(F.max(F.when(~F.col("linked"), F.col("k"))).alias("free"), F.max(F.when(F.col("linked"), F.col("k"))).alias("held")).filter("free is not null")
        rest = checked.join(stored(sums, "blocks"), "component").select("doc_id", "component", "sketch", F.col("linked").alias("tied"), "free", "held")
        placed = small.unionByName(rest)
    salt = F.xxhash64("doc_id")
    placed = placed.withColumn("block", F.when(F.col("tied"), F.col("free") + F.pmod(salt, "held")).otherwise(F.pmod(salt, "free")).cast("int"))
    joint = docs.join(placed.hint("shuffle_hash"), "doc_id")

    def spread(batch: pa.RecordBatch) -> dict:
        sets = [int64(shingle_set(t)) for t in raw(batch.column(1))]
        keep = {name: batch.column(i) for i, name in ((0, "doc_id"), (2, "component"), (3, "tied"), (4, "free"), (5, "held"), (6, "block"), (7, "sketch"))}
        return keep | {"shingles": lists(np.concatenate(sets) if sets else np.zeros(0, np.int64), [len(s) for s in sets], pa.int64())}

    sets = per_batch(joint.select("doc_id", "text", "component", "tied", "free", "held", "block", "sketch"), spread, "doc_id long, component long, tied boolean, free int, held int, block int, sketch binary, shingles array<long>")
    # a component of one block is one task; of more, each pair of blocks is one, which also sees the links within both
    whole = F.col("free") + F.col("held")
    others = F.when(whole == 1, F.array("block")).when(F.col("tied"), F.sequence(F.lit(0), F.col("free") - 1)).otherwise(F.filter(F.sequence(F.lit(0), whole - 1), lambda x: x != F.col("block")))
    dealt = sets.withColumn("other", F.explode(others)).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "tied", "sketch", "shingles")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for group in _groups(batches, 3):
            if sum(map(len, group)) > 1:
                ids = np.concatenate([g.column(3).to_numpy() for g in group])
                tied = np.concatenate([g.column(4).to_numpy(zero_copy_only=False) for g in group])
                sketches = np.frombuffer(b"".join(x for g in group for x in g.column(5).to_pylist()), np.uint8).reshape(len(ids), -1)
                sets = [v.values.to_numpy(zero_copy_only=False) for g in group for v in g.column(6)]
                for x, y in search(ids, sets, sketches, tied, plan):
                    a.append(x)
                    b.append(y)
            if len(a) > 5000:
                yield out()
                a, b = [], []
        yield out()

    found = dealt.mapInArrow(find, "a long, b long")
    return found.unionByName(edges) if edges is not None else found


def texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, text): each class's text once, under the class's key; the corpus is shuffled once. members: (doc_id, rep, a, b).

    Where one rep has several classes, as its doc_id repeats with different texts, a class takes the text whose set it is.
    """
    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for text, key, rep, a in zip(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep.append(key == rep or (s := shingle_set(text)).size > 0 and int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) == a)
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)], ["doc_id", "text", "key"]).filter(pa.array(keep, pa.bool_()))

    met = docs.join(members.select(F.col("rep").alias("doc_id"), F.col("doc_id").alias("key"), "a").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "key", "a")
    several = F.col("doc_id") != F.col("key")
    once = lambda df: df.groupBy("doc_id", "key").agg(F.first("text").alias("text")).select(F.col("key").alias("doc_id"), "text")
    if members.filter("doc_id <> rep").isEmpty():
        return stored(once(met), "texts")
    sure = met.filter(~several).select("doc_id", "text", "key")
    told = per_batch(met.filter(several), own, "doc_id long, text string, key long")
    return stored(once(sure).unionByName(once(told)), "texts")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs, columns doc_id and text being used. percent: one of PLANS.

    Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id share a component if their
    texts are equal; with other texts each goes with what it is near to, and proposes links of its own. A null doc_id names no component: such a row goes with the documents it equals, or, if there are
    none, has a null component_id and is kept. An empty table gives no rows.
    """
    plan = PLANS[percent]
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(docs, plan), "signatures")
    # results of groups are written before they are joined: the joins then stand on plain exchanges, which can be split at a hot key
    classes = stored(signed.filter("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "sets")
    # a class goes by its smallest doc_id, or, where that has several texts and so several classes, by a negative hash of its set
    shared = stored(classes.filter("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep"), "shared")
    key = F.when(F.col("own").isNotNull(), -1 - F.pmod("a", F.lit((1 << 62) - 1))).otherwise(F.col("rep"))
    classes = stored(classes.join(shared.select("rep", F.lit(True).alias("own")), "rep", "left").select("a", "b", "rep", key.alias("key")), "keyed")
    slim = stored(signed.select("doc_id", "n_shingles", "a", "b").join(classes, ["a", "b"], "left").select("doc_id", "n_shingles", "key", F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("rep")).alias("rep")), "classes")
    first = signed.filter("n_shingles > 0").withColumnRenamed("doc_id", "rep").join(classes.filter("rep is not null"), ["rep", "a", "b"]).dropDuplicates(["key"])
    first = stored(first.select(F.col("key").alias("doc_id"), "rep", "a", "n_shingles", "bands", "sketch"), "representatives")

    banded = first.select("doc_id", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other")).filter("lead <> other").select("band", "lead")
    leads = stored(leads, "leads")
    proposed = banded.join(leads, "band").filter("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    near = connected_components(proposed).select(F.col("id").alias("doc_id"), F.col("root").alias("component"))
    members = stored(first.select("doc_id", "rep", "a", "n_shingles", "sketch").join(near, "doc_id"), "members")
    found = links(texts_of(docs, members), members.drop("rep", "a"), plan=plan)
    roots = connected_components(found).select(F.col("id").alias("key"), F.col("root"))
    # a component's least doc_id is that of its least key's class, unless a key is a hash
    least = roots.join(first.select(F.col("doc_id").alias("key"), "rep"), "key").groupBy("root").agg(F.min("rep").alias("least"))
    roots = roots.join(stored(least, "least"), "root").select("key", "least")

    out = slim.join(roots, "key", "left").withColumn("component_id", F.coalesce("least", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, for tables of unrepeated doc_ids and moderate groups: it forms all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {SHINGLE - 1}, 1))) AS i FROM w WHERE len(ws) > 0))
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s AS x JOIN s AS y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)
, l AS (SELECT a, b FROM b JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * m >= {THRESHOLD} * (x.n + y.n - m))
, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
, r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) AS c ON c.doc_id = w.doc_id
"""
