"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text, each a rate or a share so that length alone decides nothing: densities of the seed lexicon, of words
learned from training rows and of learned word beginnings; the largest share of lexicon words near a second-person word;
capitals, punctuation, repeated letters and letters swapped for digits or marks. Labels are learned from a bounded sample
(MAX_TRAIN ids, the least by a hash, a text of at most MAX_TRAIN_BYTES for each, MAX_TRAIN_TOTAL bytes together) of the
rows that are not held out; copies and near copies of a text count once. The trees are grown on histograms of the features' quantiles on the driver, over that sample alone; scoring is one pass over
all texts without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_LIMIT, per_batch, raw, stored, table, tune, windows, word_hashes

#: Labelled ids that may be used for fitting, the bytes of a text beyond which it isn't used for that, the bytes of all such texts, and the words and beginnings that may be learned.
MAX_TRAIN, MAX_TRAIN_BYTES, MAX_TRAIN_TOTAL, MAX_LEARNED = 8_000, 200_000, 64 << 20, 600
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
#: Least rows of a leaf, for small and for large samples.
LEAVES = (5, 20)
CUT = 0.7
SEED = frozenset(b"idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns garbage filth jerk fool fools hate ugly shut kill".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".encode().split())
_SWAPS = bytes.maketrans(b"01345$@!7", b"oieassait")
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = b".,!?;:\"'()[]{}<>*_-"
_NEAR = 5
#: Bits of a word.
IN_SEED, LEARNED, BEGINNING, YOU, CAPS, SWAPPED, STRETCHED, MARKED = (1 << i for i in range(8))
FEATURES = ("seed", "learned", "beginning", "any_per_word", "any_log", "learned_log", "near_you", "you", "caps", "swapped", "stretched", "marked", "letters_upper", "exclaims", "punctuation", "log_words")


def plain(word: bytes) -> str:
    """A word without its outer marks, lower-cased."""
    return word.strip(_EDGES).decode("utf-8", "replace").lower()


def beginnings(word: str) -> tuple[str, ...]:
    return tuple(word[:k] for k in (4, 5, 6) if len(word) > k)


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    starts: frozenset[str] = frozenset()
    bits: dict[bytes, int] = field(default_factory=dict)

    def of(self, word: bytes) -> int:
        if (b := self.bits.get(word)) is not None:
            return b
        if len(self.bits) >= CACHE_LIMIT:
            self.bits.clear()
        p = plain(word)
        e = p.encode()
        turned = e.translate(_SWAPS) if any(c in b"01345$@!7" for c in e) else e
        b = IN_SEED * (e in SEED) | LEARNED * (p in self.words) | BEGINNING * any(s in self.starts for s in beginnings(p)) | YOU * (e in SECOND)
        b |= CAPS * (len(e) > 1 and word.isupper()) | SWAPPED * (turned != e and e.isascii() and any(97 <= c <= 122 for c in e) and (turned in SEED or turned.decode() in self.words))
        b |= STRETCHED * any(e[i] == e[i + 1] == e[i + 2] for i in range(len(e) - 2)) | MARKED * (b"*" in e or b"." in e)
        self.bits[word] = b
        return b

    def __getstate__(self):
        return self.words, self.starts

    def __setstate__(self, state):
        self.words, self.starts, self.bits = *state, {}


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        b = np.fromiter(map(lexicon.of, words), np.int64, n)
        count = lambda m: np.count_nonzero(b & m)  # noqa: B023, E731
        bad = (b & (IN_SEED | LEARNED | BEGINNING | SWAPPED)) > 0
        hits, near = int(bad.sum()), 0
        if hits and (at := np.flatnonzero(b & YOU)).size:
            where = np.flatnonzero(bad)
            j = np.searchsorted(at, where)
            gap = np.minimum(np.abs(at[np.minimum(j, len(at) - 1)] - where), np.abs(at[np.maximum(j - 1, 0)] - where))
            near = int((gap <= _NEAR).sum())
        chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        upper, lower = chars[65:91].sum(), chars[97:123].sum()
        marks = chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()
        out[i] = (
            count(IN_SEED) / n, count(LEARNED) / n, count(BEGINNING) / n, hits / n, math.log1p(hits), math.log1p(count(LEARNED | IN_SEED | SWAPPED)), near / n, count(YOU) / n, count(CAPS) / n,
            count(SWAPPED) / n, count(STRETCHED) / n, count(MARKED) / n, upper / max(1, upper + lower), chars[33] / n, marks / max(1, len(text)), math.log1p(n),
        )
    return out


def learn_lexicon(texts: list[bytes], y: np.ndarray) -> Lexicon:
    """Words and beginnings of at least 4 toxic texts and hardly any other: log-odds of 3 or more on smoothed shares."""
    sides = (Counter(), Counter()), (Counter(), Counter())
    for text, t in zip(texts, y.tolist(), strict=True):
        words = {plain(w) for w in text.split()}
        sides[0][t].update(words)
        sides[1][t].update({s for w in words for s in beginnings(w)})
    n1, n0 = int(y.sum()), int(len(y) - y.sum())

    def best(clean: Counter, toxic: Counter, least: int) -> frozenset[str]:
        odds = [(math.log((a + 0.1) / (n1 + 1)) - math.log((clean[w] + 0.5) / (n0 + 1)), a, w) for w, a in toxic.items() if a >= least and len(w) > 2]
        return frozenset(w for _, _, w in sorted((x for x in odds if x[0] >= 3), reverse=True, key=lambda x: (x[1] * x[0], x[2]))[:MAX_LEARNED])

    return Lexicon(best(*sides[0], 6), best(*sides[1], 10))


def halves(y: np.ndarray) -> np.ndarray:
    return np.arange(len(y)) % 2


class Trees:
    """Binary classification by boosting on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        leaf = min(max(len(y) // 50, LEAVES[0]), LEAVES[1])
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.edges = [np.unique(np.concatenate([e, [0.0]])) for e in self.edges]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        width = bins.max(initial=0) + 1
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base, self.trees = math.log(share / (1 - share)), []
        f = np.full(len(y), self.base)
        flat = bins + np.arange(bins.shape[1]) * width
        for _ in range(TREES if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree, node = [], np.zeros(len(y), np.int64)  # rows of a tree: feature, last bin of the left, value
            for level in range(DEPTH):
                for k in range(2**level):
                    own = np.flatnonzero(node == k)
                    feature, cut = 0, width
                    if len(own) >= 2 * leaf:
                        sums = [np.bincount(flat[own].ravel(), np.repeat(v[own], bins.shape[1]), width * bins.shape[1]).reshape(-1, width).cumsum(1) for v in (g, h, np.ones(len(y)))]
                        (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                        gain = np.where((nl >= leaf) & (nt - nl >= leaf), gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0)
                        if gain.max() > 1e-6:
                            feature, cut = (int(v) for v in np.unravel_index(gain.argmax(), gain.shape))
                    tree.append((feature, cut))
                order = tree[2**level - 1 :]
                fs, cs = np.array([a for a, _ in order]), np.array([c for _, c in order])
                node = 2 * node + (bins[np.arange(len(y)), fs[node]] > cs[node])
            values = np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1) * RATE
            self.trees.append((np.array(tree), values))
            f += values[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        rows, f = np.arange(len(x)), np.full(len(x), self.base)
        for tree, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                feature, cut = tree[2**level - 1 + node].T
                node = 2 * node + (bins[rows, feature] > cut)
            f += values[node]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to f (pool adjacent violators), a little smoothed so that no score is 0 or 1."""
    blocks: list[list[float]] = []  # from, to, positives, rows
    for v in np.unique(f):
        own = y[f == v]
        blocks.append([v, v, float(own.sum()), float(len(own))])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    x = [v for b in blocks for v in (b[0], b[1])]
    return np.array(x), np.array([(b[2] + 0.02) / (b[3] + 0.04) for b in blocks for _ in range(2)])


class Model:
    """Lexicon, trees and calibration. Lexicon and calibration never see the same rows: each half of the sample has its own lexicon and gives the other half its training features."""

    def fit(self, texts: list[bytes], y: np.ndarray) -> Model:
        half = halves(y)
        x = np.zeros((len(y), len(FEATURES)))
        for k in (0, 1):
            own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
            lexicon = learn_lexicon([texts[i] for i in other.tolist()], y[other])
            x[own] = features([texts[i] for i in own.tolist()], lexicon)
        out = np.zeros(len(y))
        for k in (0, 1):  # scores of rows that the trees have not seen, for the calibration
            out[half == k] = Trees().fit(x[half != k], y[half != k]).raw(x[half == k]) if len(y) > 1 else 0
        self.lexicon, self.trees = learn_lexicon(texts, y), Trees().fit(x, y)
        self.knots = isotonic(out, y) if len(y) else (np.zeros(1), np.full(1, 0.5))
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        f = self.trees.raw(features(texts, self.lexicon))
        # between the knots' steps the raw score still orders rows
        return np.clip(np.interp(f, *self.knots) * 0.999 + 0.0005 / (1 + np.exp(-f)), 0, 1)


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, total: int = MAX_TRAIN_TOTAL) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most so many labelled ids that are not held out, and of at most so many bytes together.

    An id counts once: of several labels the greatest holds, of several texts the one of the least hash. The ids chosen
    are few enough to broadcast; bytes are counted before any text comes to the driver.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    once = stored(met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "training")
    sizes = once.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # most rows of two numbers
    fit = np.cumsum([r["n"] for r in sizes]) <= total
    ids = [r["doc_id"] for r, ok in zip(sizes, fit.tolist(), strict=True) if ok]
    rows = (once if len(ids) == len(sizes) else once.filter(F.col("doc_id").isin(ids))).select("text", "toxic").collect()
    seen: dict[bytes, int] = {}
    for r in rows:
        text = r["text"].encode()
        seen[text] = max(seen.get(text, 0), int(r["toxic"]))
    order = without_near_copies(sorted(seen, key=lambda t: (zlib.crc32(t), t)))  # the same whatever order the rows came in
    return order, np.array([seen[t] for t in order], np.int64)


def without_near_copies(texts: list[bytes]) -> list[bytes]:
    """Texts that share none of four MinHashes of 5-word shingles with one before: else the words of one that is much copied look toxic, or clean, by themselves."""
    met: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        a = word_hashes(text.split())
        s = windows(a, min(5, len(a))) if len(a) else a
        own = {(k, int((s * m).min())) for k, m in enumerate(_MULTIPLIERS)} if len(s) else set()
        if not own & met:
            out.append(text)
        met |= own
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    return Model().fit(*training_rows(docs, labels, most))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Null and empty texts get the score of no words; a null doc_id is not held out; repeated rows are scored each.
    """
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        s = model.score(list(raw(batch.column(2))))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= CUT).astype(np.int32)}

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return per_batch(slim, run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text the model does not predict to be toxic, all columns kept."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(model.score(list(raw(batch.column(at)))) < CUT))

    return docs.mapInArrow(run, docs.schema)
