"""Prompts: preamble with cited excerpts, and a template chosen by the prognosis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import ADMISSION_WORDS, BANNER


@dataclass(frozen=True)
class Template:
    """A role, and what follows the excerpts. Own texts can be given in place of the defaults."""

    role: str
    task: str
    rules: str


#: Short neutral defaults; users give their own texts.
_RULE = "Use the note and the excerpts alone, and cite excerpts by their numbers.\n"
DISCHARGE = Template("Clinician of an emergency department.", "TASK:\nAdvise a patient who goes home: treatment, visits, warning signs.\n", _RULE)
ADMISSION = Template("Clinician of an emergency department.", "TASK:\nHand over a patient who stays: ward, plan, what the family was told.\n", _RULE)


def is_admitted(prognosis: Column) -> Column:
    return F.lower(prognosis).rlike("|".join(ADMISSION_WORDS))


def preamble(role: Column, note: Column, excerpts: Column) -> Column:
    return F.concat(F.lit("ROLE:\n"), role, F.lit("\n\nCLINICAL NOTE:\n\n"), note, F.lit("\n\n\nGUIDELINE EXCERPTS:\n\n"), excerpts)


def build_prompts(notes: DataFrame, fields: DataFrame, final: DataFrame, chunks: DataFrame, discharge: Template = DISCHARGE, admission: Template = ADMISSION) -> DataFrame:
    """(note_id, template, prompt). notes (note_id, text), fields with prognosis, final (note_id, rank, chunk_id), chunks (chunk_id, doc_id, page_start, page_end, text)."""
    cited = final.select("note_id", "rank", "chunk_id").join(chunks.select("chunk_id", "doc_id", "page_start", "page_end", F.col("text").alias("_t")), "chunk_id")
    said = F.concat(F.lit("[E"), F.col("rank").cast("string"), F.lit("] ("), "doc_id", F.lit(", p."), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(")\n\n"), "_t", F.lit("\n\n\n"))
    listed = cited.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))), lambda x: x["said"]), "").alias("_excerpts"))
    met = notes.select("note_id", "text").join(fields.select("note_id", "prognosis"), "note_id").join(listed, "note_id", "left")
    admitted = is_admitted(F.col("prognosis"))
    of = lambda part: F.when(admitted, F.lit(getattr(admission, part))).otherwise(F.lit(getattr(discharge, part)))
    prompt = F.concat(preamble(of("role"), F.col("text"), F.coalesce("_excerpts", F.lit(""))), of("task"), F.lit("\n"), of("rules"))
    return met.select("note_id", F.when(admitted, "admission").otherwise("discharge").alias("template"), prompt.alias("prompt"))


def append_reference(outputs: DataFrame, references: DataFrame, retrieval_only: bool = False) -> DataFrame:
    """(note_id, output): outputs with the physician's own text behind a banner, where references (note_id, reference) has one and the run is not for retrieval only."""
    met = outputs.join(references, "note_id", "left")
    add = F.col("reference").isNotNull() & F.lit(not retrieval_only)
    return met.select("note_id", F.when(add, F.concat("output", F.lit(BANNER), "reference")).otherwise(F.col("output")).alias("output"))
