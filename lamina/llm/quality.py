"""Quality rules with thresholds learned per language and source from mergeable sketches.

A sketch is a histogram over a fixed grid of whole numbers of PRECISION leading bits, so it has at most a few thousand
cells however many rows it counts, sketches of parts merge by adding counts, the result doesn't depend on how rows were
dealt, and a quantile is off by less than one part in 2 ** (PRECISION - 1). A document fails where a metric lies
beyond its group's fence: the upper quartile and FENCE times the wider of the quartiles' distances from the median. Most
rates are zero in most texts, and their quartiles with them; their fences lie STEPS counts of the group's median text
beyond the quartile at least, so they follow the sizes of the group's texts, which the sketch holds too. No threshold is
given: a metric without a spread and without counts takes the fence of its language, then the one over all rows, and so
do groups of fewer than LEAST rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, raw, stored, table, tune, windows, word_hashes

REPEAT = 8
FENCE, STEPS, LEAST, PRECISION = 6, 3, 50, 7
#: Each metric, per million or (letters) per hundred; what it is a share of, and how much of that one count takes.
METRICS = {
    "chars_per_word": ("(word_chars * 100) div greatest(n_words, 1)", None, 0),
    "symbols": ("(n_symbols * 1000000) div greatest(word_chars, 1)", "word_chars", 1),
    "dup_lines": ("(n_dup_lines * 1000000) div greatest(n_lines, 1)", "n_lines", 1),
    "repeats": ("(n_repeat_words * 1000000) div greatest(n_words, 1)", "n_words", 2 * REPEAT),
}
SIZES = ("n_words", "word_chars", "n_lines")
#: All that is sketched, by name.
SKETCHED = {m: e for m, (e, *_) in METRICS.items()} | {s: s for s in SIZES}
_symbols = bytes(set(range(256)) - set(b"#*$%&|<>"))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) for each row, over its whole text."""

    def count(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
        for text in raw(batch.column(3)):
            words = text.split()
            n = len(words)
            solid = b"".join(words)
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            repeat = 0
            if n > REPEAT:
                g = windows(word_hashes(words), REPEAT)
                order = np.argsort(g, kind="stable")
                same = g[order[1:]] == g[order[:-1]]
                if same.any():
                    hit = np.zeros(len(g), bool)
                    hit[order[1:][same]] = True
                    hit[order[:-1][same]] = True
                    at = np.flatnonzero(hit)
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + REPEAT, -1)
                    repeat = int((np.cumsum(steps[:n]) > 0).sum())
            for k, v in zip(out, (n, len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace")), len(solid.translate(None, _symbols)), len(lines), len(lines) - len(set(lines)), repeat), strict=True):
                out[k].append(v)
        return {"doc_id": batch.column(0), "lang": batch.column(1), "source": batch.column(2)} | out

    tune(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return per_batch(slim, count, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def cell_of(value: str, shift: str = "shiftleft(1L, {})") -> str:
    """SQL of a whole number's cell: its leading bits, the others being zero."""
    return f"({value} - {value} % {shift.format(f'greatest(length(bin({value})) - {PRECISION}, 0)')})"


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, cell, n): the histograms of each group; sketches of parts merge by summing n."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(cell_of(f"({e})")).alias("cell")) for m, e in SKETCHED.items()])).alias("x")
    return measured.filter("n_words > 0").select(*by, cells).select(*by, "x.metric", "x.cell").groupBy(*by, "metric", "cell").agg(F.count(F.lit(1)).alias("n"))


def fences(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, one upper fence per metric) from sketches: the window runs over a group's cells, not over its rows. Null where a metric has neither spread nor counts."""
    keys = [*by, "metric"]
    run = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.withColumn("upto", F.sum("n").over(run)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("cell")))
    quartiles = ranked.groupBy(*keys).agg(at(25).alias("low"), at(50).alias("mid"), at(75).alias("high"), F.max("rows").alias("rows"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    wide = quartiles.groupBy(*by).agg(F.max("rows").alias("rows"), *[of(m, c) for m in METRICS for c in ("low", "mid", "high")], *[of(s, "mid") for s in SIZES])
    return wide.select(*by, "rows", *[F.expr(_fence(m, "div")).alias(f"max_{m}") for m in METRICS])


def _fence(m: str, div: str) -> str:
    """SQL of a metric's fence over a group's quartiles."""
    _, size, unit = METRICS[m]
    spread = f"greatest(high_{m} - mid_{m}, mid_{m} - low_{m})"
    if size is None:
        return f"CASE WHEN {spread} > 0 THEN high_{m} + {FENCE} * {spread} END"
    return f"high_{m} + greatest({FENCE} * {spread}, {STEPS * unit * 1_000_000} {div} mid_{size})"


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed, kept and the fences that were applied to stored measurements."""
    fine = stored(sketch(measured, ["lang", "source"]), "sketches")
    own = fences(fine, ["lang", "source"])
    merged = lambda *by: fine.groupBy(*by, "metric", "cell").agg(F.sum("n").alias("n"))
    by_lang, of_all = fences(merged("lang"), ["lang"]), fences(merged(), [])
    lang = by_lang.select(F.col("lang").alias("l"), F.col("rows").alias("rows_l"), *[F.col(f"max_{m}").alias(f"l_{m}") for m in METRICS])
    every = of_all.select(*[F.col(f"max_{m}").alias(f"a_{m}") for m in METRICS])
    wide = own.join(lang, own["lang"].eqNullSafe(lang["l"]), "left").join(F.broadcast(every))  # one row
    limit = lambda m: F.coalesce(F.when(F.col("rows") >= LEAST, F.col(f"max_{m}")), F.when(F.col("rows_l") >= LEAST, F.col(f"l_{m}")), F.col(f"a_{m}"))
    wide = wide.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[limit(m).alias(f"max_{m}") for m in METRICS])
    wide = stored(wide, "fences")
    joint = measured.join(wide, measured["lang"].eqNullSafe(wide["g_lang"]) & measured["source"].eqNullSafe(wide["g_source"]), "left")
    base = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
    beyond = reduce(lambda a, b: a | b, [F.coalesce(F.expr(e) > F.col(f"max_{m}"), F.lit(False)) for m, (e, *_) in METRICS.items()])
    out = joint.withColumn("base_failed", F.expr(base)).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~beyond))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"max_{m}" for m in METRICS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """A verdict for each row of docs (doc_id, text, lang, source).

    A null or empty text has no words, fails, and counts for no fence; a metric of a group whose fence no row tells rejects nothing; null languages and sources form groups of their own; repeated rows are
    judged, and count for the fences, once each; an empty table gives no rows.
    """
    return judge(stored(measure(docs), "measured"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    cell = {m: e.replace(" div ", " // ") for m, e in SKETCHED.items()}
    cells = "\nUNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {cell_of(f'({e})', '(1::BIGINT << ({}))')} AS cell FROM m WHERE n_words > 0" for m, e in cell.items())

    def fence(name: str, by: str) -> str:
        group = f"{by}, " if by else ""
        of = lambda m, c: f"max({c}) FILTER (WHERE metric = '{m}')::BIGINT AS {c}_{m}"
        wide = ", ".join([of(m, c) for m in METRICS for c in ("low", "mid", "high")] + [of(s, "mid") for s in SIZES])
        return f""", {name}_r AS (SELECT {group}metric, cell, sum(n) OVER (PARTITION BY {group}metric ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {group}metric) AS total
  FROM (SELECT {group}metric, cell, count(*) AS n FROM cells GROUP BY {group}metric, cell))
, {name}_q AS (SELECT {group}metric, {", ".join(f"min(cell) FILTER (WHERE upto * 100 >= total * {q}) AS {c}" for c, q in (("low", 25), ("mid", 50), ("high", 75)))}, max(total) AS total FROM {name}_r GROUP BY {group}metric)
, {name}_w AS (SELECT {group}max(total) AS total, {wide} FROM {name}_q {"GROUP BY " + by if by else ""})
, {name} AS (SELECT {group}total, {", ".join(f"{_fence(m, '//')} AS max_{m}" for m in METRICS)} FROM {name}_w)"""

    limit = lambda m: f"CAST(coalesce(CASE WHEN f.total >= {LEAST} THEN f.max_{m} END, CASE WHEN f.total > 0 AND l.total >= {LEAST} THEN l.max_{m} END, CASE WHEN f.total > 0 THEN a.max_{m} END) AS BIGINT)"
    base = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    beyond = " OR ".join(f"coalesce({cell[m]} > {limit(m)}, false)" for m in METRICS)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, g AS (SELECT rid, p, array_to_string(ws[p:p + {REPEAT - 1}], ' ') AS k FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {REPEAT - 1})) AS p FROM w WHERE len(ws) > {REPEAT}))
, r AS (SELECT rid, p FROM g QUALIFY count(*) OVER (PARTITION BY rid, k) >= 2)
, c AS (SELECT rid, count(DISTINCT p + o) AS n FROM r, range({REPEAT}) AS s(o) GROUP BY rid)
, y AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
, m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM y LEFT JOIN c USING (rid))
, cells AS ({cells})
{fence("fine", "lang, source")}{fence("by_lang", "lang")}{fence("of_all", "")}
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND NOT (n_words > 0 AND ({beyond})) AS kept, {", ".join(f"{limit(m)} AS max_{m}" for m in METRICS)}
FROM m LEFT JOIN fine AS f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source LEFT JOIN by_lang AS l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN of_all AS a
"""
