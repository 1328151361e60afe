"""The two programs over files: PDF files to a saved index, and note files to output files."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..models import generate, make_generator, translate
from ..operators import prompt, quality, queries, rerank, segment, vectors
from ..session import stored
from ..sources import files
from . import pipelines

log = logging.getLogger(__name__)


def build_index(spark: SparkSession, pdfs: str, out: str, settings: Settings = Settings(), reader=None, embedder=None) -> DataFrame:
    """A folder of PDF files to the tables index, vocabulary, abbreviations and warnings, and the texts of chunks, below out. Returns the index.

    Abbreviations that are saved there already are used again. Documents with many empty pages are listed in warnings.
    """
    blocks = stored(files.read_pdf_blocks(spark, pdfs, reader), "blocks")
    files.save_table(quality.empty_page_share(blocks).filter("warn"), f"{out}/warnings")
    if n := spark.read.parquet(f"{out}/warnings").count():
        log.warning("%d documents have many empty pages, see %s/warnings", n, out)
    units = stored(segment.page_units(quality.good_pages(quality.assemble_pages(quality.filter_blocks(blocks)))), "units")
    learn = lambda: segment.learn_abbreviations(units.select(F.explode_outer("units").alias("unit")))
    known = files.load_or_learn(spark, f"{out}/abbreviations", learn)
    built = pipelines.index_of_units(units, segment.abbreviation_list(known), settings, embedder)
    files.save_table(built.chunks, f"{out}/index")
    files.save_table(built.vocabulary, f"{out}/vocabulary")
    index = load_index(spark, out)
    files.write_chunk_dump(index, f"{out}/chunks")
    return index


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    """A saved index; ValueError if its ids are not 0 to n - 1 or its vectors differ in length."""
    index = files.load_table(spark, f"{folder}/index", "index")
    facts = vectors.sanity(index).first()
    if facts["n"] and not (facts["dense"] and facts["one_dim"]):
        raise ValueError(f"the index at {folder} is damaged: {facts.asDict()}")
    return index


def answer_notes(
    spark: SparkSession, notes: str, index: str, out: str, gazetteer: DataFrame, settings: Settings = Settings(), name: str | None = None, translations: str | None = None, references: str | None = None,
    embedder=None, translator: Callable | None = None, back: Callable | None = None, **options,
) -> DataFrame:
    """Every note file of a folder, or the one of this name, to <stem>_output.txt and <stem>_queries.txt below out. Returns (stem, output).

    translations is a folder of given translations, used if the settings say so; notes without one go through
    translator, and what it says is written there. back translates outputs. options go to the generator of the settings'
    backend, which isn't asked if they want retrieval only. Texts of references stand behind the outputs then too.
    """
    own = vectors.with_dense_ids(files.read_notes(spark, notes, name), "stem").withColumnRenamed("chunk_id", "note_id")
    given = files.with_translations(spark, own.select("stem", "text"), translations) if translations and settings.use_existing_translation else own.select("stem", "text").withColumn("given", F.lit(False))
    told = stored(translate(given.filter("not given"), translator), "translated")
    if translations and translator:
        files.write_texts(told.withColumn("file", F.concat(F.lit("translation"), "stem", F.lit(".txt"))), translations, "file", "text")
    table = stored(own.select("stem", "note_id").join(given.filter("given").unionByName(told), "stem").select("stem", "note_id", "text"), "notes")

    known = load_index(spark, index)
    vocabulary = files.load_table(spark, f"{index}/vocabulary", "vocabulary")
    found = pipelines.retrieve(table.select("note_id", "text"), known, vocabulary, gazetteer, settings, embedder)
    pool, final = (stored(df, "found") for df in (rerank.require_rows(found.pool, "search"), found.final))
    rerank.require_rows(final, "reranking")
    prompts = prompt.build_prompts(table.select("note_id", "text"), found.fields, final, known)
    model = None if settings.retrieval_only else make_generator(settings.backend, **({"temperature": settings.temperature, "max_tokens": settings.max_tokens} | options if settings.backend == "remote" else options))
    said = translate(generate(prompts, model), back, "output").join(table.select("note_id", "stem"), "note_id")
    if references:
        texts = files.read_references(spark, references).join(table.select("stem", "note_id"), "stem").select("note_id", "reference")
        said = prompt.append_reference(said.select("note_id", "output"), texts, settings.retrieval_only).join(table.select("note_id", "stem"), "note_id")
    said = stored(said.select("stem", "output"), "outputs")
    asked = queries.query_file(found.asked).join(table.select("note_id", "stem"), "note_id")
    files.write_texts(said.withColumn("file", F.concat("stem", F.lit("_output.txt"))), f"{out}/output", "file")
    files.write_texts(asked.withColumn("file", F.concat("stem", F.lit("_queries.txt"))), f"{out}/queries", "file", "content")
    return said
