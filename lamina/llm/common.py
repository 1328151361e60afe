"""What the operators share: scratch tables in the shared folder, Arrow helpers, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, ship, stored  # noqa: F401

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a worker's word cache; a full one is emptied, so a worker's memory is bounded.
CACHE_LIMIT = 300_000
#: Rows and bytes of an Arrow batch: texts may be long, so both are kept small.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and send them this package, once a session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """name, or with as many underscores behind as make it differ from all that are taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Arrow batches of df through f, which returns columns by name; the columns' types follow the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    with_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None:
                yield out if isinstance(out, pa.RecordBatch) else as_batch(out, with_schema)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[field.name], pa.Array) else pa.array(c, field.type) for field in schema], schema=schema)


def raw(column: pa.Array) -> Iterator[bytes]:
    """Each row's UTF-8 bytes; null counts as empty."""
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    ok = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(data[at[i] : at[i + 1]]) if ok is None or ok[i] else b""


def lowered(text: bytes) -> bytes:
    """A-Z to a-z; nothing else changes."""
    return text.translate(_LOWER)


class HashOf(dict):
    """64-bit hashes of words, kept by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = HashOf()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of two adjoining parts to hashes of the whole."""
    z = (x * _A) ^ (y + _B + (x >> _S))
    z *= _B
    z ^= z >> _S
    z *= _A
    z ^= z >> np.uint64(32)
    return z


def windows(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries, built by doubling."""
    h, have = a, 1
    for bit in bin(k)[3:]:
        h = joined(h[: len(h) - have], h[have:])
        have *= 2
        if bit == "1":
            h = joined(h[: len(h) - 1], a[have:])
            have += 1
    return h


def int64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def lists(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


