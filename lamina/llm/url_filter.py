"""URL rules of hosts and path prefixes, by hashed expressions; DataFrame functions only.

A URL is expanded into expressions: each suffix of its host's labels with each prefix of its path that ends in a slash
(and the empty one). A rule stands under its host with its path up to the last slash. Both sides meet by an equi-join on
the first 8 hex digits of SHA-256, as a list of short prefixes is all that a large rule list needs to ship; the full
digests, the host and the rest of the rule's path then confirm. The longest rule wins, then the longer host, then the
lesser text. Only as many labels and slashes are expanded as some rule has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Rules up to this many are broadcast (a few hundred bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(rule, verdict) rows; a rule is a lower-case host followed by a path."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path; both empty for null and where there is no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1))), r"^[^?#]*", 0)


def _keyed(df: DataFrame, host: str, stem: str) -> DataFrame:
    return df.withColumn("digest", F.sha2(F.concat_ws("\n", host, stem), 256)).withColumn("short", F.substring("digest", 1, 8))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    A url with no ``://`` or null has an empty host and path, fits no rule, and gets the default, as does every url that
    fits none. Repeated rows give a row each; each pair of host and path is judged once. Null rules are skipped.
    """
    listed = rules.filter("rule is not null and verdict is not null").select("rule", "verdict", F.regexp_extract("rule", "^[^/]*", 0).alias("rule_host"))
    listed = listed.withColumn("rule_path", F.expr("substring(rule, length(rule_host) + 1)")).withColumn("rule_stem", F.regexp_extract("rule_path", "^(?s)(.*/)?", 0))
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes")).first()
    keyed = _keyed(listed, "rule_host", "rule_stem")
    if facts["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    once = parts.filter("host <> ''").select("host", "path").distinct()
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(facts["labels"] or 1))), lambda k: F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)))
    stems = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(facts["slashes"] or 0))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(steps, F.lit(1), k)), F.lit("/"))))
    expressions = once.withColumn("suffix", F.explode(hosts)).withColumn("stem", F.explode(stems))
    met = _keyed(expressions, "suffix", "stem").withColumnRenamed("digest", "own").join(keyed, "short")
    sure = met.filter((F.col("own") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), F.col("rule"), F.col("verdict"))
    # written first, so that the join below stands on plain exchanges, which adaptive execution can split at a hot url
    best = stored(sure.groupBy("host", "path").agg(F.min(rank).alias("best")).select("host", "path", "best.rule", "best.verdict"), "verdicts")
    return parts.join(best.hint("shuffle_hash"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def oracle_sql() -> str:
    rows = ", ".join(f"('{r}', '{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
    return rf"""
WITH r(rule, verdict, rh, rp) AS (VALUES {rows})
, p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
, q AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p)
, b AS (SELECT rid, rule, verdict FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(rh) DESC, rule) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM q LEFT JOIN b USING (rid)
"""
