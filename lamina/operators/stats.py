"""Term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms

#: Common English words, the default; a list of another library can be given in its place.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her "
    "here hers him his how i if in into is it its itself just may me might more most must my no nor not now of off on once only or other our out over own per same she should so some such than that the their them then "
    "there these they this those through to too under until up upon us very was we were what when where which while who whom why will with within without would you your".split()
)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df) over the distinct terms of each row of texts (text); partial counts before the shuffle."""
    return texts.select(F.explode_outer(F.array_distinct(terms(F.col("text")))).alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(texts: DataFrame, min_df: int = 2, max_df: float = 0.85, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1 over n texts, for terms that are no stop words and are in min_df texts or more and in a share of at most max_df."""
    n = F.broadcast(texts.agg(F.count(F.lit(1)).alias("n")))  # one row
    counted = document_frequencies(texts).filter(~F.col("term").isin(*stop_words) & (F.col("df") >= min_df)).crossJoin(n)
    return counted.filter(F.col("df") <= max_df * F.col("n")).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
