"""Retrieval and reranking queries of a note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ANCHORS
from ..functions.text import let
from .entities import condense
from .notes import age_bracket


def words_by_type(mentions: DataFrame, ranking: DataFrame) -> DataFrame:
    """(note_id, etype, words, all_words): ranked words and every word of a type, as arrays in order; a row for each type that a note affirms."""
    listed = lambda df, by, name: df.groupBy("note_id", "etype").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "word"))), lambda x: x["word"]).alias(name))
    both = listed(mentions, "ord", "all_words").join(listed(ranking, "rank", "words"), ["note_id", "etype"], "left")
    return both.select("note_id", "etype", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "all_words")


def build_queries(fields: DataFrame, words: DataFrame, diary_terms: int = 2) -> DataFrame:
    """schema.QUERIES: one per anchored type with words, then a broad one, numbered from 1 per note.

    Types without a ranked word fall back to all their words. The diary's query is for reranking alone, and is left out
    where nothing of the diary is condensed.
    """
    of = lambda etype: F.first(F.when(F.col("etype") == etype, F.struct("words", "all_words")), ignorenulls=True).alias(etype)
    met = fields.select("note_id", "diagnosis", "clinical_diary", F.lower("gender").alias("gender"), age_bracket(F.col("age"), F.col("neonatal")).alias("bracket"))
    met = met.join(words.groupBy("note_id").agg(*[of(etype) for etype, _ in ANCHORS]), "note_id", "left")
    query = lambda kind, text, retrieval: F.struct(F.lit(kind).alias("kind"), text.alias("query"), F.lit(retrieval).alias("for_retrieval"))
    made = []
    for etype, anchor in ANCHORS:
        own = F.col(etype)
        if etype == "DIAGNOSTIC_PROCEDURE":
            short = condense(F.col("clinical_diary"), own["words"], diary_terms)
            # let: a lambda's value is computed once, and the note is gone through once
            told = lambda c: F.when(c != "", query("DIAGNOSTIC_PROCEDURE", F.concat(c, F.lit(" "), "diagnosis", F.lit(". " + dict(ANCHORS)["DIAGNOSTIC_PROCEDURE"])), False))
            made.append(let(F.when(own.isNotNull(), short), told))
        else:
            chosen = F.array_join(F.when(F.size(own["words"]) > 0, own["words"]).otherwise(own["all_words"]), " ")
            made.append(F.when(own.isNotNull(), query(etype, F.concat_ws(". ", F.nullif(chosen, F.lit("")), F.nullif(F.col("diagnosis"), F.lit("")), F.lit(anchor)), True)))
    broad = F.concat(F.col("diagnosis"), F.lit(" recommendations discharge management "), F.coalesce(F.concat("bracket", F.lit(" ")), F.lit("")), F.col("gender"))
    made.append(query("BROAD", broad, True))
    every = met.select("note_id", F.posexplode_outer(F.filter(F.array(*made), lambda q: q.isNotNull())).alias("_i", "_q"))
    return every.select("note_id", (F.col("_i") + 1).alias("q_no"), "_q.kind", "_q.query", "_q.for_retrieval", F.lit(True).alias("for_rerank"))


def single_query(fields: DataFrame) -> DataFrame:
    """(note_id, query): the older form, one query a note."""
    twice = F.concat(F.lit("Diagnosis: "), F.col("diagnosis"), F.lit(". "))
    history = F.concat(F.lit("Past medical history: "), F.col("remote_medical_history"), F.lit(". "))
    return fields.select("note_id", F.concat(twice, twice, history, F.lit("therapy recommendations hospitalization discharge")).alias("query"))


def query_file(queries: DataFrame) -> DataFrame:
    """(note_id, content): a note's reranking queries as one text."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("q_no", "query"))), lambda x: F.concat(F.lit("--- Query "), x["q_no"].cast("string"), F.lit(" ---\n"), x["query"], F.lit("\n\n")))
    return queries.filter("for_rerank").groupBy("note_id").agg(F.array_join(blocks, "").alias("content"))
