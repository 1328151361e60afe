"""Notes as they arrive: the same row-local expressions over a stream of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.notes import fields


def stream_notes(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(note_id, text) of .txt files as they come into a folder; note_id is a hash of the file's name."""
    files = spark.readStream.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return files.select(F.xxhash64("_metadata.file_name").alias("note_id"), F.col("value").alias("text"))


def stream_fields(notes: DataFrame) -> DataFrame:
    """schema.FIELDS of each note; stateless, so any output mode and trigger will do."""
    return fields(notes)
