"""Exact removal of passages that repeat across documents, by level-wise doubling.

Each level doubles the length of the one before and looks only at windows of which both halves repeated there, until no
candidate survives:

* Half the length. Every window is stood for by the half window of the least hash in it; equal windows have equal
  stands, so nothing is lost and one row stands for a run of about a quarter of the length. A stand that only one
  document has ends here.
* The length itself. Where all runs under a stand agree as a whole they are decided run by run; only the runs that
  disagree are spelled out window by window, keyed by the hashes of both halves (128 bits). These windows are what is
  removed.
* Twice the length, four times, and so on: the same two steps, over the documents that hold a window of which both
  halves repeat, and all windows between them, as those of a repeat do. They tell how long a document's repeats are
  (levels(), and remove_repeats() where asked for); they remove nothing more, as a longer repeat is a run of repeated
  windows of the length. The query goes through all of them; the pipeline's stage ends at the length.

All groups are reduced by partial aggregates of fixed size, and rows find their group's result by a join that adaptive
execution splits where a key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, recorded, scope
from .common import fresh, int64, joined, lists, per_batch, raw, scratch_path, stored, table, tune, windows, word_hashes

WINDOW = 50
#: Bits of a packed run: the first window's place and the number of windows; above them the text's mark. A text has less than 2 ** 31 bytes and so less than 2 ** 30 words.
PLACE, COUNT = 30, 6
#: Windows of a run at the longer levels, at most. Nearly all repeat there, so short runs that end alike leave less to spell out than whole stands would.
STEP = 8


class Passage:
    """A text's windows: the halves' hashes g, and each full window's stand, the least of the halves within it."""

    def __init__(self, text: bytes, window: int, step: int = 0):
        """step: if given, the stand also tells where it is within the window, to so many words; so runs end at the same places wherever a passage stands."""
        self.words, self.half = text.split(), window // 2
        self.n = len(self.words) - window + 1
        if self.n > 0:
            self.g = windows(word_hashes(self.words), self.half)
            m, have, need = self.g, 1, window - self.half + 1
            while 2 * have <= need:
                m = np.minimum(m[: len(m) - have], m[have:])
                have *= 2
            self.stand = m if have == need else np.minimum(m[: len(m) - (need - have)], m[need - have :])
            self.stand = self.stand[: self.n]
            if step:
                self.stand = joined(self.stand, (self.places(need) // step).astype(np.uint64))

    def places(self, need: int) -> np.ndarray:
        """How far within each window its least half window begins, the first of equal ones."""
        m, at, have = self.g, np.arange(len(self.g)), 1
        while have < need:
            by = min(have, need - have)
            left = m[: len(m) - by] <= m[by:]
            m, at = np.where(left, m[: len(m) - by], m[by:]), np.where(left, at[: len(at) - by], at[by:])
            have += by
        return at[: self.n] - np.arange(self.n)

    def runs(self, most: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run of one stand, among the windows within if given; at most so many to a run, so that its first and last window overlap and tell it whole."""
        cut = np.concatenate([[True], self.stand[1:] != self.stand[:-1]])
        if within is not None:
            cut[1:] |= within[1:] != within[:-1]
        cuts = np.flatnonzero(cut)
        counts = np.diff(np.concatenate([cuts, [self.n]]))
        if within is not None:
            cuts, counts = cuts[within[cuts]], counts[within[cuts]]
        return split_runs(cuts, counts, most)


def split_runs(first: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same runs in pieces of at most so many."""
    if not len(count) or count.max() <= most:
        return first, count
    pieces = -(-count // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(first, pieces) + nth * most, np.minimum(most, np.repeat(count, pieces) - nth * most)


def _mark(text: bytes) -> int:
    """27 bits of a text: tells texts under a repeated doc_id apart."""
    return xxhash.xxh3_64_intdigest(text) >> 37


def packed(mark: int | np.ndarray, first: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    return ((mark << PLACE | first) << COUNT | count).astype(np.int64)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> COUNT & (1 << PLACE) - 1, at & (1 << COUNT) - 1


def _own(runs: pa.Scalar, text: bytes) -> np.ndarray:
    """The packed runs that belong to this text."""
    if not runs.is_valid:
        return np.zeros(0, np.int64)
    at = runs.values.to_numpy(zero_copy_only=False)
    return at[at >> PLACE + COUNT == _mark(text)]


def _places(at: np.ndarray) -> np.ndarray:
    """The windows of packed runs, in order."""
    first, count = unpacked(at)
    return np.unique(np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum()))


def runs_of(docs: DataFrame, window: int) -> DataFrame:
    """(stand, doc_id, at, whole) for every run of windows. docs: (doc_id, text), or (doc_id, text, at) with at telling the windows that count."""
    most = min((1 << COUNT) - 1, window // 2 + 1)

    def emit(batch: pa.RecordBatch) -> dict:
        stand, ids, at, whole = [], [], [], []
        given = batch.column(2) if batch.num_columns > 2 else [None] * len(batch)
        for doc_id, text, only in zip(batch.column(0).to_pylist(), raw(batch.column(1)), given, strict=True):
            if only is not None and not len(only := _own(only, text)):
                continue
            p = Passage(text, window, STEP if only is not None else 0)
            if p.n <= 0:
                continue
            within = None
            if only is not None:
                within = np.zeros(p.n, bool)
                within[_places(only)] = True
            first, count = p.runs(most, within)
            full = joined(p.g[: p.n], p.g[window - p.half : window - p.half + p.n])
            last = first + count - 1
            whole.append(joined(full[first], full[last] + count.astype(np.uint64)))
            stand.append(p.stand[first])
            at.append(packed(_mark(text), first, count))
            ids.append(np.full(len(first), doc_id, np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return {"stand": int64(join(stand)), "doc_id": join(ids), "at": join(at).astype(np.int64), "whole": int64(join(whole))}

    known = docs.filter("doc_id is not null and text is not null")
    return per_batch(known, emit, "stand long, doc_id long, at long, whole long")


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, later, first): packed runs of the windows whose words start in documents of different ids: those that also start in a smaller one, and those of which the document is the first.

    docs: as in runs_of(), doc_id long. window is even and at least 4.
    """
    runs = stored(runs_of(docs, window), "runs")
    groups = runs.groupBy("stand").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    # groups are written before they are joined: the join then stands on plain exchanges, which can be split at a hot key
    groups = stored(groups.filter("owner <> other").select("stand", "owner", (F.col("low") == F.col("high")).alias("alike")), "groups")
    of = lambda when, name: F.collect_list(F.when(F.expr(when), F.col("at"))).alias(name)
    found = runs.join(groups, "stand")
    marks = stored(found.groupBy("doc_id").agg(of("alike and doc_id > owner", "later"), of("alike and doc_id = owner", "first"), of("not alike", "open")), "marks")

    def spell(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[], [], [], []]
        for doc_id, text, runs in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2), strict=True):
            at = _own(runs, text)
            if not len(at):
                continue
            p, pos = Passage(text, window), _places(at)
            for o, v in zip(out, (p.g[pos], p.g[pos + window - p.half], np.full(len(pos), doc_id, np.int64), packed(_mark(text), pos, 1)), strict=True):
                o.append(v)
        a, b, c, d = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        return {"a": int64(a), "b": int64(b), "doc_id": c, "at": d.astype(np.int64)}

    spelled = docs.select("doc_id", "text").join(marks.filter(F.size("open") > 0).select("doc_id", "open").hint("shuffle_hash"), "doc_id")
    spelled = stored(per_batch(spelled.select("doc_id", "text", "open"), spell, "a long, b long, doc_id long, at long"), "windows")
    owners = stored(spelled.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).filter("owner <> other").select("a", "b", "owner"), "owners")
    late = spelled.join(owners, ["a", "b"]).groupBy("doc_id").agg(of("doc_id > owner", "later"), of("doc_id = owner", "first"))
    both = marks.filter(F.size("later") + F.size("first") > 0).select("doc_id", "later", "first").unionByName(late)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return both.groupBy("doc_id").agg(flat("later"), flat("first"))


def extensible(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, at): windows of twice the length of which both halves, and every window between, are among those found; documents with none don't appear. Texts aren't needed."""

    def pair(batch: pa.RecordBatch) -> dict:
        ids, out = [], []
        for doc_id, later, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            at = np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in (later, first)])
            kept = []
            for mark in np.unique(at >> PLACE + COUNT).tolist():
                have = _places(at[at >> PLACE + COUNT == mark])
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(have) != 1]))
                count = np.diff(np.concatenate([cuts, [len(have)]])) - window
                if (count > 0).any():
                    first_, count = split_runs(have[cuts[count > 0]], count[count > 0], (1 << COUNT) - 1)
                    kept.append(packed(mark, first_, count))
            if kept:
                ids.append(doc_id)
                out.append(np.concatenate(kept))
        return {"doc_id": ids, "at": lists(np.concatenate(out) if out else np.zeros(0, np.int64), [len(o) for o in out], pa.int64())}

    return per_batch(found.select("doc_id", "later", "first"), pair, "doc_id long, at array<long>")


def levels(docs: DataFrame, window: int = WINDOW) -> Iterator[tuple[int, DataFrame]]:
    """(length, repeated() as a stored table) for the window and its doublings, until no candidate survives. docs: (doc_id long, text)."""
    found, texts, made = settled(lambda: repeated(docs, window), docs, f"level-{window}"), docs, []
    yield window, found
    try:
        while True:
            with recorded(now := []):
                further = stored(extensible(found, window), "further")
                if further.isEmpty():
                    made += now
                    return
                window *= 2
                # only texts that still take part go on to the next level; those of the one before go
                texts = stored(texts.join(further.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "at"), "texts")
            drop(docs.sparkSession, made)
            made = now
            found = settled(lambda: repeated(texts, window), docs, f"level-{window}")  # noqa: B023
            texts = texts.select("doc_id", "text")
            yield window, found
    finally:
        drop(docs.sparkSession, made)


def settled(make: Callable[[], DataFrame], docs: DataFrame, name: str) -> DataFrame:
    """What make() returns, written; the tables that it stands on go at once."""
    path = scratch_path(docs.sparkSession, name)
    with scope(docs.sparkSession):
        df = make()
        df.write.parquet(path)
    return docs.sparkSession.read.schema(df.schema).parquet(path)


def covered(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in the windows of packed runs."""
    first, count = unpacked(at)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + count + window - 1, -1)
    return np.cumsum(steps[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, deep: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, longest_repeat][, text]) for each row of docs, columns doc_id and text being used.

    Words stand between ASCII white space. A word goes if a window of so many words that covers it also starts in a
    document of a smaller doc_id, as the input has it. A null or empty text has no words; a null doc_id is neither
    smaller nor larger than another, so its row stays whole; rows of one doc_id never take words from one another. text
    is the row's own where nothing goes, else the kept words with what stood before each. longest_repeat, if deep, is the greatest of
    window, twice it, four times, ... so that a window of so many words also starts in a document of a smaller doc_id, or 0.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_sha256": []} | ({"longest_repeat": []} if deep else {}) | ({"text": []} if with_text else {})
        for i, (text, runs) in enumerate(zip(raw(batch.column(1)), batch.column(2), strict=True)):
            words, gone = text.split(), 0
            if len(at := _own(runs, text)):
                drop = covered(at, len(words), window)
                gone, kept = int(drop.sum()), [w for w, x in zip(words, drop.tolist(), strict=True) if not x]
                if with_text:
                    out["text"].append(_without(text, words, drop))
            else:
                kept = words
                if with_text:
                    out["text"].append(batch.column(1)[i].as_py())
            out["n_words"].append(len(words))
            out["n_removed"].append(gone)
            if deep:
                out["longest_repeat"].append(window << int(unpacked(own)[1].max()) - 1 if len(own := _own(batch.column(3)[i], text)) else 0)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", longest_repeat long" * deep + ", text string" * with_text
    if not deep:
        marked = settled(lambda: _later(repeated(docs, window)), docs, "marked")
        return per_batch(docs.join(marked.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "at"), finish, schema)
    marked, depths = None, None
    for n, (_, found) in enumerate(levels(docs, window), 1):
        marked = marked if marked is not None else _later(found)
        # which level, under the text's mark, in the place of a count
        own = found.filter(F.size("later") > 0).select("doc_id", F.array_distinct(F.transform("later", lambda x: F.shiftleft(F.shiftright(x, PLACE + COUNT), PLACE + COUNT) + n)).alias("depth"))  # noqa: B023
        depths = own if depths is None else depths.unionByName(own)
    depths = depths.groupBy("doc_id").agg(F.flatten(F.collect_list("depth")).alias("depth"))
    marked = stored(marked.join(depths, "doc_id"), "marked")
    return per_batch(docs.join(marked.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "at", "depth"), finish, schema)


def _later(found: DataFrame) -> DataFrame:
    return found.filter(F.size("later") > 0).select("doc_id", F.col("later").alias("at"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words cut out of text, as remove_repeats() does, and n_chars set to what is left; rows that lose every word go, all others stay as they are. Needs columns doc_id (long), text and n_chars."""
    tune(docs.sparkSession)
    found = settled(lambda: _later(repeated(docs.select("doc_id", "text"), window)), docs, "marked").withColumnRenamed("at", at_name := fresh(docs.columns, "at"))
    joint = docs.join(found.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, at_name)
    ids, at_text = docs.columns, docs.columns.index("text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, stay = [], []
        for i, (text, runs) in enumerate(zip(raw(batch.column(at_text)), batch.column(len(ids)), strict=True)):
            own = _own(runs, text)
            if len(own):
                drop = covered(own, len(words := text.split()), window)
                texts.append(_without(text, words, drop))
                stay.append(not drop.all())
            else:
                texts.append(batch.column(at_text)[i].as_py())
                stay.append(True)
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)}
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(ids)], ids).filter(pa.array(stay))

    from pyspark.sql.types import StructType

    return joint.mapInArrow(lambda batches: (cut(b) for b in batches if len(b)), StructType(docs.schema.fields))


def _without(text: bytes, words: list[bytes], drop: np.ndarray) -> str:
    parts, end = [], 0
    for word, gone in zip(words, drop.tolist(), strict=True):
        at = text.index(word, end)
        if not gone:
            parts.append(text[end : at + len(word)])
        end = at + len(word)
    return b"".join(parts).decode("utf-8", "replace").strip(" \t\n\x0b\x0c\r")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns. The longer levels are gone through until no candidate survives; they change nothing in these."""
    return remove_repeats(table(spark, sf_dir, "documents"), deep=True).drop("longest_repeat")


def oracle_sql(window: int = WINDOW) -> str:
    """The same in DuckDB's SQL, for tables of unrepeated doc_ids."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, p AS (SELECT doc_id, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS k, i FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {window - 1})) AS i FROM w WHERE len(ws) >= {window}))
, o AS (SELECT k, min(doc_id) AS owner FROM p GROUP BY k)
, g AS (SELECT DISTINCT doc_id, i + s.n AS i FROM p JOIN o USING (k), range({window}) AS s(n) WHERE doc_id > owner)
, e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
, l AS (SELECT doc_id, count(*) AS n, array_to_string(array_agg(word ORDER BY i), ' ') AS kept FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(l.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""
