"""The generic tables in the roles that the operators expect, in Spark and, word for word, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import TERM
from ..operators import stats
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words that the pages carry as abbreviations, with a full stop behind.
SHORT = "( (?:for|und|les|por)) "


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of their source, numbered by their ids; a few of their words are abbreviated."""
    return spread(table(spark, d, "documents")).select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page"), F.regexp_replace("text", SHORT, "$1. ").alias("text"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages as blocks, with places made from their numbers."""
    n = F.col("block_no")
    lines = pages(spark, d).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("block_no", "text"))
    whole = lambda c: c.cast("double")
    top, left = (n * 37 + F.col("page") * 13) % 800, (n * 53) % 620
    return lines.select("doc_id", "page", "block_no", whole(left).alias("x0"), whole(top).alias("y0"), whole(left + 20).alias("x1"), whole(top + 15).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as an index of chunks; a chunk's text is that of the document of its id, or empty."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("guide"), F.col("label").cast("string")).alias("doc_id"), "embedding")
    page = (F.col("chunk_id") % 40 + 1).cast("int")
    return own.join(docs, "chunk_id", "left").select("chunk_id", "doc_id", page.alias("page_start"), (page + (F.col("chunk_id") % 2).cast("int")).alias("page_end"), F.coalesce("text", F.lit("")).alias("text"), "embedding")


def searching(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose id is divisible by 100 as queries, three to a note."""
    asked = chunks(spark, d).filter("chunk_id % 100 = 0")
    n = F.expr("chunk_id div 100")
    return asked.select(F.expr("chunk_id div 300").alias("note_id"), (n % 3 + 1).cast("int").alias("q_no"), F.col("text").alias("query"), "embedding")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary(spread(table(spark, d, "documents").select("text")))


def gazetteer(vocabulary: DataFrame) -> DataFrame:
    """Terms of the vocabulary under the type that their MD5 picks; a quarter has none."""
    pick = F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("bigint") % 4
    types = F.when(pick == 0, "DISEASE_DISORDER").when(pick == 1, "MEDICATION").when(pick == 2, "DIAGNOSTIC_PROCEDURE")
    return vocabulary.select("term", types.alias("etype")).filter("etype is not null")


HEADS = ("Medical history:\n- Pathological proximate: ", "\n- Remote pathology: ", "\n\nObjective examination:\n", "\n\nClinical diary:\n- ", "\n\nDiagnosis: ", "\nPrognosis: ")
LATE = "\n- "


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notes: each turn of the first six is a section, all later ones are entries of the diary."""
    turn = lambda k: F.coalesce(F.max(F.when(F.col("turn") == k, F.col("text"))), F.lit(""))
    c = F.col("conv_id")
    gender = F.when(c % 3 == 0, "MALE").when(c % 3 == 1, "FEMALE").otherwise("OTHER")
    age = F.when(c % 7 == 6, "8 MONTHS").when(c % 11 == 10, "").otherwise(F.concat((c % 90).cast("string"), F.lit(" AA")))
    end = F.when(c % 2 == 0, "Admission to the ward. ").otherwise("30 days. ")
    t = [turn(k).alias(f"t{k}") for k in range(6)]
    late = F.array_sort(F.collect_list(F.when(F.col("turn") > 5, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))))
    t.append(F.array_join(F.transform(late, lambda x: F.concat(F.lit(LATE), x["text"])), "").alias("t6"))
    wide = table(spark, d, "conversations").groupBy("conv_id").agg(*t)
    text = F.concat(gender, F.lit(", "), age, F.lit("\n"), F.lit(HEADS[0]), "t0", F.lit(HEADS[1]), "t1", F.lit(HEADS[2] + "No "), "t0", F.lit(HEADS[3]), "t2", F.lit("\n- CHA₂: "), "t3", "t6", F.lit(HEADS[4]), "t4", F.lit(HEADS[5]), end, "t5")
    return wide.select(F.col("conv_id").alias("note_id"), text.alias("text"))


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TERM_SQL = f"'{TERM}'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {_SPACES})"


_stop = ", ".join(f"'{w}'" for w in stats.STOP_WORDS)
#: Common table expressions by name, each with the names it stands on.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "page_v": ((), f"SELECT source AS doc_id, doc_id + 1 AS page, regexp_replace(text, '{SHORT}', '\\1. ', 'g') AS text FROM documents"),
    "line_v": (("page_v",), "SELECT doc_id, page, text, string_split(text, chr(10)) AS raw, list_filter(list_transform(string_split(text, chr(10)), lambda x: " + strip_sql("x") + "), lambda x: x <> '') AS ls FROM page_v"),
    "block_v": (
        ("page_v",),
        "SELECT doc_id, page, (i - 1)::INT AS block_no, (((i - 1) * 53) % 620)::DOUBLE AS x0, (((i - 1) * 37 + page * 13) % 800)::DOUBLE AS y0, (((i - 1) * 53) % 620 + 20)::DOUBLE AS x1, "
        "(((i - 1) * 37 + page * 13) % 800 + 15)::DOUBLE AS y1, 600::DOUBLE AS page_width, 800::DOUBLE AS page_height, ls[i] AS text FROM (SELECT doc_id, page, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, page, string_split(text, chr(10)) AS ls FROM page_v))",
    ),
    "useful_v": (("block_v",), "SELECT *, " + strip_sql("text") + " AS bare, (length(" + strip_sql("text") + ") >= 10 AND y1 >= page_height * 0.05::DOUBLE AND y0 <= page_height * (1.0::DOUBLE - 0.05::DOUBLE) AND x1 >= page_width * 0.05::DOUBLE AND x0 <= page_width * (1.0::DOUBLE - 0.05::DOUBLE)) AS useful FROM block_v"),
    "chunk_v": ((), "SELECT vec_id AS chunk_id, 'guide' || label AS doc_id, (vec_id % 40 + 1)::INT AS page_start, (vec_id % 40 + 1 + vec_id % 2)::INT AS page_end, coalesce(text, '') AS text, embedding FROM embeddings LEFT JOIN documents ON vec_id = documents.doc_id"),
    "query_v": (("chunk_v",), "SELECT chunk_id // 300 AS note_id, ((chunk_id // 100) % 3 + 1)::INT AS q_no, text AS query, embedding FROM chunk_v WHERE chunk_id % 100 = 0"),
    "df_v": ((), f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {TERM_SQL}))) AS term FROM documents) GROUP BY term"),
    "vocab_v": (("df_v",), f"SELECT term, df, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM df_v, (SELECT count(*) AS n FROM documents) WHERE term NOT IN ({_stop}) AND df >= 2 AND df <= 0.85::DOUBLE * n"),
    "gaz_v": (("vocab_v",), "SELECT term, CASE ('0x' || substr(md5(term), 1, 4))::BIGINT % 4 WHEN 0 THEN 'DISEASE_DISORDER' WHEN 1 THEN 'MEDICATION' WHEN 2 THEN 'DIAGNOSTIC_PROCEDURE' END AS etype FROM vocab_v WHERE ('0x' || substr(md5(term), 1, 4))::BIGINT % 4 < 3"),
    "note_v": (
        (),
        "SELECT conv_id AS note_id, CASE conv_id % 3 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' ELSE 'OTHER' END || ', ' || CASE WHEN conv_id % 7 = 6 THEN '8 MONTHS' WHEN conv_id % 11 = 10 THEN '' ELSE (conv_id % 90) || ' AA' END || chr(10) || "
        + f"{sql_quote(HEADS[0])} || t0 || {sql_quote(HEADS[1])} || t1 || {sql_quote(HEADS[2] + 'No ')} || t0 || {sql_quote(HEADS[3])} || t2 || {sql_quote(chr(10) + '- CHA₂: ')} || t3 || t6 || {sql_quote(HEADS[4])} || t4 || {sql_quote(HEADS[5])} || CASE WHEN conv_id % 2 = 0 THEN 'Admission to the ward. ' ELSE '30 days. ' END || t5 AS text FROM (SELECT conv_id, "
        + ", ".join(f"coalesce(max(text) FILTER (WHERE turn = {k}), '') AS t{k}" for k in range(6))
        + f", coalesce(string_agg({sql_quote(LATE)} || coalesce(text, ''), '' ORDER BY turn, text) FILTER (WHERE turn > 5), '') AS t6"
        + " FROM conversations GROUP BY conv_id)",
    ),
}


def with_views(sql: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """sql behind WITH and the views that it names, in order."""
    views, done = VIEWS | (extra or {}), []

    def need(name: str) -> None:
        for below in views[name][0]:
            need(below)
        if name not in done:
            done.append(name)

    import re

    for name in views:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({views[n][1]})" for n in done) + " " if done else "") + sql
