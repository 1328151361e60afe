"""Files in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCKS
from ..session import ship


def _stem(suffix: str, prefix: str = "") -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^{prefix}(.*)\.{suffix}$", 1)


def read_notes(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(stem, text), a row per .txt file of a folder, or of one file of it; ValueError if there is none."""
    files = spark.read.option("pathGlobFilter", name or "*.txt").text(folder, wholetext=True)
    notes = files.select(_stem("txt").alias("stem"), F.col("value").alias("text"))
    if notes.isEmpty():
        raise ValueError(f"no {name or '.txt file'} in {folder}")
    return notes


def with_translations(spark: SparkSession, notes: DataFrame, folder: str, prefix: str = "translation") -> DataFrame:
    """(stem, text, given): notes with the text of a folder's <prefix><stem>.txt in place of their own, where there is one."""
    files = spark.read.option("pathGlobFilter", f"{prefix}*.txt").text(folder, wholetext=True)
    given = files.select(_stem("txt", prefix).alias("stem"), F.col("value").alias("_given"))
    return notes.join(given, "stem", "left").select("stem", F.coalesce("_given", "text").alias("text"), F.col("_given").isNotNull().alias("given"))


def read_references(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, reference) of <stem>_rec.txt files."""
    files = spark.read.option("pathGlobFilter", "*_rec.txt").text(folder, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)_rec\.txt$", 1).alias("stem"), F.col("value").alias("reference"))


def write_texts(df: DataFrame, folder: str, name: str, text: str = "output") -> None:
    """Each row's text to a file of its own; name is a column with file names. Written by executors to a path that they share, a file under its own name only once it is whole."""

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        n = 0
        for frame in frames:
            for file, content in frame.itertuples(index=False, name=None):
                with fs.open_output_stream(part := f"{root}/.{file}.{uuid.uuid4().hex}") as out:
                    out.write((content or "").encode())
                fs.move(part, f"{root}/{file}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    ship(df.sparkSession)
    df.select(F.col(name).alias("file"), F.col(text).alias("content")).mapInPandas(save, "n long").agg(F.sum("n")).first()


def write_chunk_dump(chunks: DataFrame, folder: str) -> None:
    """Chunk texts in order, three newlines apart: text files in the order of their names."""
    ranged = chunks.select("doc_id", "chunk_no", "text").repartitionByRange("doc_id", "chunk_no").sortWithinPartitions("doc_id", "chunk_no")
    ranged.select("text").write.mode("overwrite").option("lineSep", "\n\n\n").text(folder)


def save_table(df: DataFrame, path: str) -> None:
    """Index with metadata, vocabulary, or abbreviation table."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    """A saved table; RuntimeError that says what to do if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise RuntimeError(f"{what} not found at {path}: build and save it first") from e


def load_or_learn(spark: SparkSession, path: str, learn: Callable[[], DataFrame] | None) -> DataFrame:
    """A saved table, or a learned one that is then saved; ValueError with neither."""
    try:
        return load_table(spark, path)
    except RuntimeError:
        if learn is None:
            raise ValueError(f"nothing saved at {path} and no texts to learn from") from None
        save_table(learn(), path)
        return load_table(spark, path)


def read_pdf_blocks(spark: SparkSession, folder: str, load: Callable[[], Callable[[bytes], Iterator[tuple]]] | None = None) -> DataFrame:
    """schema.BLOCKS of a folder's PDF files (not of its subfolders), a task per few files.

    load() returns a function from a file's bytes to (page, block_no, x0, y0, x1, y1, page_width, page_height, text); by
    default one that needs the PyMuPDF package on the workers.
    """
    load = load or _pymupdf
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(F.regexp_extract("path", r"([^/]*)\.pdf$", 1).alias("doc_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for frame in frames:
            for doc_id, content in frame.itertuples(index=False, name=None):
                yield pd.DataFrame([(doc_id, *row) for row in read(content)], columns=names)

    return files.mapInPandas(run, BLOCKS)


def _pymupdf() -> Callable[[bytes], Iterator[tuple]]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF, or a reader of your own as load") from e

    def read(content: bytes) -> Iterator[tuple]:
        with fitz.open(stream=content, filetype="pdf") as pdf:
            for n, page in enumerate(pdf, 1):
                for i, block in enumerate(page.get_text("blocks")):
                    yield (n, i, *block[:4], page.rect.width, page.rect.height, block[4])

    return read
