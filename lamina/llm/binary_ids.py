"""Token ids in files of fixed-width packed bits.

A file is: blocks, then a footer, then the footer's length (8 bytes) and the mark ``IDB1``. A block holds BLOCK ids (the
last one fewer), each in the fewest bits that the vocabulary's size needs, padded to a whole byte. The footer is a
compressed numpy archive: bits, ids per block, the byte offset of each block, and each document's id and ids' number in
order. So any range of ids is read by its blocks alone and unpacked without a loop over ids.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, raw, scratch_path, stored, table, tune
from .tokens import default_vocabulary, word_ids

BLOCK = 4096
MARK = b"IDB1"
#: Documents of a file, about; beyond so many files each gets more documents.
DOCS, RANGES = 4096, 10_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell so many ids apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    ones = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (ones.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


class Writer:
    """Documents go in one by one; a block leaves as soon as it is full."""

    def __init__(self, path: str, vocabulary: int):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.part, self.bits = f"{self.path}.{uuid.uuid4().hex}", bits_for(vocabulary)
        self.out = self.fs.open_output_stream(self.part)
        self.rest, self.waiting, self.offsets, self.at, self.docs, self.lengths = [], 0, [], 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self.flush(BLOCK)

    def flush(self, least: int) -> None:
        ids = np.concatenate(self.rest)
        cut = len(ids) // least * least if least > 1 else len(ids)
        for i in range(0, cut, BLOCK):
            self.offsets.append(self.at)
            self.out.write(data := pack(ids[i : min(i + BLOCK, cut)], self.bits))
            self.at += len(data)
        self.rest, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> tuple[int, int]:
        """Documents and ids written; only now the file gets its name, so a failed task leaves none behind."""
        if self.waiting:
            self.flush(1)
        known = np.array([d is not None for d in self.docs], bool)
        np.savez_compressed(
            foot := io.BytesIO(), bits=self.bits, block=BLOCK, offsets=np.array([*self.offsets, self.at], np.int64), known=known,
            docs=np.array([d or 0 for d in self.docs], np.int64), lengths=np.array(self.lengths, np.int64),
        )
        self.out.write(foot.getvalue() + len(foot.getvalue()).to_bytes(8, "little") + MARK)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.docs), sum(self.lengths)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - 12)
        tail = self.file.read(12)
        if tail[8:] != MARK:
            raise ValueError(f"{path} is not a file of packed ids")
        self.file.seek(size - 12 - (n := int.from_bytes(tail[:8], "little")))
        foot = np.load(io.BytesIO(self.file.read(n)))
        self.bits, self.block, self.offsets = int(foot["bits"]), int(foot["block"]), foot["offsets"]
        self.docs = [d if k else None for d, k in zip(foot["docs"].tolist(), foot["known"].tolist(), strict=True)]
        self.lengths = foot["lengths"]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        whole = self.block * self.bits
        if whole % 8 == 0:
            n = min((last + 1) * self.block, int(self.starts[-1])) - first * self.block
            return unpack(data, n, self.bits)[start - first * self.block : stop - first * self.block]
        parts = [unpack(data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], min(self.block, int(self.starts[-1]) - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's ids; so many ids or one document are read at a time."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield self.docs[k], ids[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j


def bounds_of(docs: DataFrame) -> np.ndarray:
    """Greatest ids of all ranges but the last, which hold about DOCS rows each; null ids belong to the first range."""
    rows = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = min(RANGES, -(-rows // DOCS))
    if n < 2:
        return np.zeros(0, np.int64)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts")).first()["cuts"]
    return np.unique(np.array(cuts or [], np.int64))


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end: tuple[int, ...] = (1,)) -> DataFrame:
    """Encode documents (doc_id, text) into files of ascending doc_id, null ones first, one file per range of ids.

    Returns (shard, path, n_docs, n_ids), stored. A null text counts as empty; repeated rows are all written, equal ids
    in any order. Texts are encoded where they are read, once, and only their ids are dealt and sorted: the ranges are
    known from the doc_ids beforehand. Each task writes under a name of its own and renames the file when it is whole, so
    a task that runs again only replaces its file by an equal one.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = bounds_of(docs)

    def encode(batch: pa.RecordBatch) -> dict:
        ids, doc_id = word_ids(vocabulary), batch.column(0)
        part = np.where(doc_id.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(zero_copy_only=False)), 0)
        return {"range": part.astype(np.int32), "doc_id": doc_id, "ids": [ids.ids(text, *end).tobytes() for text in raw(batch.column(1))]}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, to, n = word_ids(vocabulary), None, TaskContext.get().partitionId()
        ids.forget()
        for batch in batches:
            to = to or Writer(path := f"{folder}/shard-{n:06d}.idb", ids.size)
            for doc_id, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                to.add(doc_id, np.frombuffer(own.as_buffer(), ids.kind))
        if to:
            n_docs, n_ids = to.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([n], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name)
    ranged = per_batch(docs, encode, "range int, doc_id long, ids binary").repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("doc_id")
    return stored(ranged.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "shards")


def read_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, start counting over all files."""
    n = max(1, shards.count())
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start")).repartition(n)  # one row a file

    def read(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for doc_id, ids in Reader(path).documents():
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["n_tokens"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                start += len(ids)
        return out

    return per_batch(placed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the files and back."""
    shards = write_ids(table(spark, sf_dir, "documents"), scratch_path(spark, "ids"), default_vocabulary())
    return read_ids(shards)
