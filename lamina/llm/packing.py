"""Best-fit packing of documents into sequences, after dominance reduction.

Pieces of one length are alike, so the instance is its histogram of lengths, which has at most ``capacity`` rows however
many documents there are. The reduction of Martello and Toth runs on the histogram: a set of pieces is fixed as a
sequence for good where it dominates every other set with its largest piece. What is left goes by best fit, longest first,
whole runs of equal pieces at a time. The plan is a short table of runs; documents then find their places by the rank
that they have among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, raw, stored, table, tune
from .tokens import default_vocabulary, word_ids

#: Pieces of one length that one task ranks, about.
RANKED = 2_000


@dataclass
class Run:
    """Pieces of a length from the rank ``first`` on: ``n`` of them, ``each`` side by side in one sequence after another."""

    length: int
    first: int
    n: int
    each: int
    sequence: int
    offset: int


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixed sets of lengths and their numbers; counts keeps the rest.

    With j the largest piece and r the room beside it: if nothing fits, {j} is fixed; if a piece of exactly r is there, {j, r}
    is; if no two pieces fit beside j, {j, k} is, k being the largest that fits. In each case whatever a sequence holds
    beside j in an optimal packing can change places with the fixed set, so no optimum is lost.
    """
    sizes = sorted(k for k, n in counts.items() if n)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            sizes.pop(bisect_left(sizes, size))

    for j in sorted(counts, reverse=True):
        while n := counts.get(j, 0):
            room = capacity - j
            others = lambda s: counts[s] - (s == j)  # noqa: B023, E731
            smallest = [s for s in sizes[:3] for _ in range(min(2, others(s)))][:2]
            if not smallest or smallest[0] > room:
                fixed.append(((j,), n))
                take(j, n)
                continue
            at = bisect_left(sizes, room + 1) - 1
            if sizes[at] == j and not others(j):
                at -= 1
            k = sizes[at]
            if k == room or len(smallest) < 2 or sum(smallest) > room:
                m = n // 2 if k == j else min(n, counts[k])
                fixed.append(((j, k), m))
                take(j, 2 * m) if k == j else (take(k, m), take(j, m))
                continue
            break
    return fixed


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of each length go, by their ranks within it."""
    left, ranks, runs, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0

    def put(length: int, n: int, each: int, first_sequence: int, offset: int) -> None:
        runs.append(Run(length, ranks[length], n, each, first_sequence, offset))
        ranks[length] += n

    for held, n in reduce_by_dominance(left, capacity):
        offset = 0
        for length in held:
            put(length, n, 1, sequence, offset)
            offset += length
        sequence += n

    rooms: list[int] = []  # in ascending order
    bins: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number

    def opened(room: int, first: int, n: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append((first, n))

    for length in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            if (at := bisect_left(rooms, length)) == len(rooms):
                each = min(n, capacity // length)
                room, first, have = capacity, sequence, max(1, n // each)
                sequence += have
            else:
                room = rooms[at]
                first, have = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
                each = min(n, room // length)
                if n < each * have:
                    used = max(1, n // each)
                    if used < have:
                        opened(room, first + used, have - used)
                    have = used
            put(length, each * have, each, first, capacity - room)
            n -= each * have
            if room > each * length:
                opened(room - each * length, first, have)
    return runs


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of more than capacity ids are cut, others are one piece."""

    def cut(batch: pa.RecordBatch) -> dict:
        ids_of, out = word_ids(vocabulary), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            ids = ids_of.ids(text, end).astype("<u4")
            for i, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                for k, v in (("doc_id", doc_id), ("piece", i), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                    out[k].append(v)
        return out

    tune(docs.sparkSession)
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to stored pieces; length is from 1 to capacity, rows may repeat, and doc_id may be null.

    Ranks are taken within a length and a hashed bucket, and then moved by the sums of the buckets before. A length has
    as many buckets as its pieces ask for, so that one which a third of them share is still ranked by many tasks.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    shares = cut.sparkSession.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, buckets long")
    salted = cut.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets"))
    sums = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(sums, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    runs = sorted(plan(counts, capacity), key=lambda r: (r.length, r.first))
    keys = np.array([[r.length, r.first, r.each, r.sequence, r.offset] for r in runs], np.int64).reshape(-1, 5)
    starts = keys[:, 0] * (1 << 50) + keys[:, 1]

    def place(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        _, first, each, sequence, offset = keys[np.searchsorted(starts, length * (1 << 50) + rank, "right") - 1].T
        k = rank - first
        return {name: batch.column(i) for i, name in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": sequence + k // each, "offset": offset + k % each * length}

    return per_batch(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Documents (doc_id, text; a null text is empty) to placed pieces. An empty table gives no rows."""
    return pack(stored(pieces(docs, vocabulary or default_vocabulary(), capacity, end), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
