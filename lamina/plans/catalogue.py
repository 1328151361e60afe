"""Every operator as a query over the generic tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, models
from ..functions import text as fx
from ..operators import entities, notes, prompt, quality, queries, rerank, segment, stats, vectors
from ..session import spread, stored
from . import pipelines
from . import standins as v
from .standins import strip_sql, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_more: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, _more)
        return f

    return add


def view(name: str, sql: str, *below: str) -> None:
    _more[name] = (below, sql)


# Blocks, pages, lines


@query("block_filter", "SELECT doc_id, page, block_no, bare AS text FROM useful_v WHERE useful")
def block_filter(s, d):
    return quality.filter_blocks(v.blocks(s, d)).select("doc_id", "page", "block_no", "text")


@query("page_assembly", "SELECT doc_id, page, string_agg(bare, chr(10) ORDER BY block_no) AS text FROM useful_v WHERE useful GROUP BY doc_id, page")
def page_assembly(s, d):
    return quality.assemble_pages(quality.filter_blocks(v.blocks(s, d)))


@query("empty_page_ratio", "SELECT doc_id, count(*) AS pages, avg(CASE WHEN full_ THEN 0.0 ELSE 1.0 END)::DOUBLE AS empty_share, avg(CASE WHEN full_ THEN 0.0 ELSE 1.0 END) > 0.3 AS warn FROM (SELECT doc_id, page, bool_or(useful) AS full_ FROM useful_v GROUP BY doc_id, page) GROUP BY doc_id")
def empty_page_ratio(s, d):
    return quality.empty_page_share(v.blocks(s, d))


_biblio = rf"(len(ls) > 0 AND coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '{fixed.CITATION}') OR regexp_matches(lower(x), '{fixed.LINK}')))::DOUBLE / nullif(len(ls), 0), 0) >= 0.1::DOUBLE)"
_abbr = r"(len(list_filter(list_transform(raw, lambda x: " + strip_sql("x") + r"), lambda x: regexp_matches(x, '" + fixed.SHORT_NAME + "'))) >= 12)"
_share = lambda pattern: f"coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}')))::DOUBLE / nullif(len(ls), 0), 0)"
_score = (
    r"(CASE WHEN len(list_filter(ls[1:20], lambda x: regexp_matches(x, '[\pL\pN_]'))) > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + 0.4::DOUBLE * least("
    + _share(fixed.NUMBERED) + " / 0.5::DOUBLE, 1.0::DOUBLE) + 0.2::DOUBLE * least(" + _share(fixed.LEADER) + " / 0.3::DOUBLE, 1.0::DOUBLE))"
)
_index = f"(length({strip_sql('text')}) >= 20 AND {_score} >= 0.4::DOUBLE)"


@query("detect_biblio", f"SELECT doc_id, page, {_biblio} AS is_biblio FROM line_v")
def detect_biblio(s, d):
    return v.pages(s, d).select("doc_id", "page", quality.is_bibliography(F.col("text")).alias("is_biblio"))


@query("detect_index", f"SELECT doc_id, page, round({_score}, 6) AS score, {_index} AS is_index FROM line_v")
def detect_index(s, d):
    return v.pages(s, d).select("doc_id", "page", F.round(quality.index_score(F.col("text")), 6).alias("score"), quality.is_index(F.col("text")).alias("is_index"))


@query("detect_abbreviations", f"SELECT doc_id, page, {_abbr} AS is_abbreviations FROM line_v")
def detect_abbreviations(s, d):
    return v.pages(s, d).select("doc_id", "page", quality.is_abbreviation_list(F.col("text")).alias("is_abbreviations"))


view("bad_v", f"SELECT doc_id, page, {_biblio} OR {_abbr} OR {_index} AS bad, text, ls, raw FROM line_v", "line_v")


@query("bad_pages", "SELECT doc_id, page FROM bad_v WHERE NOT bad")
def bad_pages(s, d):
    return quality.good_pages(v.pages(s, d)).select("doc_id", "page")


_bare = r"list_filter(list_transform(raw, lambda x: " + strip_sql(r"regexp_replace(x, '([a-zA-Z\)\.,])\d+(?:[,\-–]\d+)*', '\1', 'g')") + "), lambda x: x <> '')"
_garbled = lambda xs: f"list_filter({xs}, lambda x: length(regexp_replace(x, '[ -~]', '', 'g'))::DOUBLE / greatest(length(x), 1) <= 0.8::DOUBLE AND {strip_sql('x')} <> '')"


@query("strip_reference_numbers", f"SELECT doc_id, page, array_to_string({_bare}, chr(10)) AS text FROM line_v")
def strip_reference_numbers(s, d):
    return v.pages(s, d).select("doc_id", "page", F.array_join(quality.without_reference_numbers(fx.split(F.col("text"))), "\n").alias("text"))


@query("drop_garbled", f"SELECT doc_id, page, array_to_string({_garbled('raw')}, chr(10)) AS text FROM line_v")
def drop_garbled(s, d):
    return v.pages(s, d).select("doc_id", "page", F.array_join(quality.without_garbled(fx.split(F.col("text"))), "\n").alias("text"))


@query("clean_lines", f"SELECT doc_id, page, array_to_string({_garbled(_bare)}, chr(10)) AS text FROM line_v")
def clean_lines(s, d):
    return v.pages(s, d).select("doc_id", "page", F.array_join(quality.clean_lines(fx.split(F.col("text"))), "\n").alias("text"))


_summaries = lambda xs: f"list_filter(list_transform({xs}, lambda x: {strip_sql('x')}), lambda x: NOT contains(x, '©') AND len(string_split(x, ';')) < 4)"
_captions = lambda xs: rf"list_filter({xs}, lambda x: NOT regexp_matches(x, '{fixed.CAPTION.replace('*+', '*')}'))"


@query("drop_summaries", f"SELECT doc_id, page, array_to_string({_summaries('raw')}, chr(10)) AS text FROM line_v")
def drop_summaries(s, d):
    return v.pages(s, d).select("doc_id", "page", F.array_join(quality.without_summaries(fx.split(F.col("text"))), "\n").alias("text"))


@query("drop_captions", f"SELECT doc_id, page, array_to_string({_captions('raw')}, chr(10)) AS text FROM line_v")
def drop_captions(s, d):
    return v.pages(s, d).select("doc_id", "page", F.array_join(quality.without_captions(fx.split(F.col("text"))), "\n").alias("text"))


# Units, sentences, chunks

view("clean_v", f"SELECT doc_id, page, list_filter(list_transform({_garbled(_bare)}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM bad_v WHERE NOT bad", "bad_v")
_hy = "right(x, 1) IN ('-', '–', chr(173))"
_kept = f"(CASE WHEN {_hy} THEN left(x, length(x) - 1) ELSE x END)"
view(
    "unit_v",
    f"SELECT doc_id, page, list_filter(string_split(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = len(ls) THEN x ELSE {_kept} || CASE WHEN {_kept} <> '' AND contains('.:;?!,', right({_kept}, 1)) THEN chr(1) WHEN {_hy} THEN '' ELSE ' ' END END), ''), chr(1)), lambda x: x <> '') AS units FROM clean_v",
    "clean_v",
)
view("short_v", r"SELECT rtrim(w, '.') AS token, sum(CASE WHEN ends_with(w, '.') THEN 1 ELSE 0 END)::BIGINT AS with_stop, sum(CASE WHEN ends_with(w, '.') THEN 0 ELSE 1 END)::BIGINT AS without_stop FROM (SELECT unnest(regexp_split_to_array(lower(u), '\s+')) AS w FROM (SELECT unnest(units) AS u FROM unit_v)) WHERE regexp_matches(w, '^[a-z]{1,5}\.?$') GROUP BY 1", "unit_v")
view("known_v", "SELECT coalesce(list(token), []) AS known FROM (SELECT token FROM short_v WHERE with_stop >= 5 AND with_stop >= 0.8::DOUBLE * (with_stop + without_stop))", "short_v")
view(
    "split_v",
    r"SELECT doc_id, page, flatten(list_transform(units, lambda u: list_transform([string_split(regexp_replace(u, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda ps: list_filter(string_split(array_to_string(list_transform(ps, lambda p, i: p || CASE WHEN i = len(ps) THEN '' "
    r"WHEN list_contains(known, lower(regexp_extract(p, '(?:^|[\s(])([A-Za-z]{1,5})\.$', 1))) THEN ' ' ELSE chr(1) END), ''), chr(1)), lambda x: x <> ''))[1])) AS ss FROM unit_v, known_v",
    "unit_v", "known_v",
)
_over = lambda xs: rf"flatten(list_transform({xs}, lambda s: CASE WHEN length(s) > 1200 THEN string_split(regexp_replace(s, '([;:!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [s] END))"
view("sent_v", f"SELECT doc_id, page, {_over(_captions(_summaries('ss')))} AS ss FROM split_v", "split_v")


def good(s, d):
    return quality.good_pages(v.pages(s, d))


def units(s, d):
    """Units of good pages, stored: the abbreviations are learned from them before they are cut."""
    return stored(segment.page_units(good(s, d)), "units")


def known(made):
    return segment.abbreviation_list(segment.learn_abbreviations(made.select(F.array_join("units", "\n").alias("unit"))))


def sentences(s, d):
    made = units(s, d)
    return segment.sentences_of_units(made, known(made))


def sentence_lists(s, d):
    made = units(s, d)
    return segment.lists_of_units(made, known(made))


@query("merge_lines", "SELECT doc_id, page, array_to_string(units, chr(10)) AS units FROM unit_v")
def merge_lines(s, d):
    return segment.page_units(good(s, d)).select("doc_id", "page", F.array_join("units", "\n").alias("units"))


@query("abbrev_table", "SELECT token, with_stop, without_stop FROM short_v WHERE with_stop >= 5 AND with_stop >= 0.8::DOUBLE * (with_stop + without_stop)")
def abbrev_table(s, d):
    return segment.learn_abbreviations(segment.page_units(good(s, d)).select(F.explode("units").alias("unit")))


@query("sentence_split", "SELECT doc_id, page, array_to_string(ss, chr(10)) AS sentences FROM split_v")
def sentence_split(s, d):
    made = units(s, d)
    return made.select("doc_id", "page", F.array_join(segment.split_sentences(F.col("units"), known(made)), "\n").alias("sentences"))


@query("split_oversized", f"SELECT doc_id, page, array_to_string({_over('raw')}, chr(10)) AS parts FROM line_v")
def split_oversized(s, d):
    return v.pages(s, d).select("doc_id", "page", F.array_join(segment.split_oversized(fx.split(F.col("text"))), "\n").alias("parts"))


@query("clean_sentences", "SELECT doc_id, page, (i - 1)::INT AS sent_no, ss[i] AS sentence FROM (SELECT doc_id, page, ss, unnest(generate_series(1, len(ss))) AS i FROM sent_v)")
def clean_sentences(s, d):
    return sentences(s, d)


view("seq_v", "SELECT doc_id, list(page ORDER BY page, i) AS ps, list(s ORDER BY page, i) AS ss, list(length(s) ORDER BY page, i) AS ns FROM (SELECT doc_id, page, i, ss[i] AS s FROM (SELECT doc_id, page, ss, unnest(generate_series(1, len(ss))) AS i FROM sent_v)) GROUP BY doc_id", "sent_v")
view(
    "fold_v",
    "SELECT doc_id, ps, ss, list_reduce(generate_series(1, len(ss)), lambda a, i: CASE WHEN i > a.s AND a.n + ns[i] > 1200 THEN {'s': greatest(a.s, i - 2), 'n': list_sum(ns[greatest(a.s, i - 2):i])::BIGINT, 'p': ps[i], 'out': list_append(a.out, {'s': a.s, 'e': i - 1, 'p': a.p})} ELSE {'s': a.s, 'n': a.n + ns[i], 'p': a.p, 'out': a.out} END, "
    "{'s': 1::BIGINT, 'n': 0::BIGINT, 'p': ps[1], 'out': [{'s': 0::BIGINT, 'e': 0::BIGINT, 'p': ps[1]}]}) AS f FROM seq_v",
    "seq_v",
)
view("cut_v", "SELECT doc_id, (k - 1)::INT AS chunk_no, o[k].p AS page_start, ps[o[k].e] AS page_end, array_to_string(ss[o[k].s:o[k].e], ' ') AS text FROM (SELECT doc_id, ps, ss, o, unnest(generate_series(1, len(o))) AS k FROM (SELECT doc_id, ps, ss, list_append(f.out[2:], {'s': f.s, 'e': len(ss)::BIGINT, 'p': f.p}) AS o FROM fold_v))", "fold_v")


@query("chunk_documents", "SELECT doc_id, chunk_no, page_start, page_end, text FROM cut_v")
def chunk_documents(s, d):
    return segment.chunk_lists(sentence_lists(s, d))


view(
    "stream_v",
    "SELECT ds, ps, ss, list_reduce(generate_series(1, len(ss)), lambda a, i: CASE WHEN i > a.s AND a.n + ns[i] > 1200 THEN {'s': greatest(a.s, i - 2), 'n': list_sum(ns[greatest(a.s, i - 2):i])::BIGINT, 'f': i, 'out': list_append(a.out, {'s': a.s, 'e': i - 1, 'f': a.f})} ELSE {'s': a.s, 'n': a.n + ns[i], 'f': a.f, 'out': a.out} END, "
    "{'s': 1::BIGINT, 'n': 0::BIGINT, 'f': 1::BIGINT, 'out': [{'s': 0::BIGINT, 'e': 0::BIGINT, 'f': 0::BIGINT}]}) AS f FROM "
    "(SELECT list(doc_id ORDER BY doc_id, page, i) AS ds, list(page ORDER BY doc_id, page, i) AS ps, list(s ORDER BY doc_id, page, i) AS ss, list(length(s) ORDER BY doc_id, page, i) AS ns FROM (SELECT doc_id, page, i, ss[i] AS s FROM (SELECT doc_id, page, ss, unnest(generate_series(1, len(ss))) AS i FROM sent_v)))",
    "sent_v",
)


@query("chunk_across_documents", "SELECT ds[o[k].f] AS doc_id, (k - 1)::INT AS chunk_no, ps[o[k].f] AS page_start, ps[o[k].e] AS page_end, array_to_string(ss[o[k].s:o[k].e], ' ') AS text FROM (SELECT ds, ps, ss, o, unnest(generate_series(1, len(o))) AS k FROM (SELECT ds, ps, ss, list_append(f.out[2:], {'s': f.s, 'e': len(ss)::BIGINT, 'f': f.f}) AS o FROM stream_v))")
def chunk_across_documents(s, d):
    return segment.chunk_lists(sentence_lists(s, d), carry_across_docs=True)


# Vectors and statistics

view(
    "hash_v",
    f"SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {v.TERM_SQL})) AS t FROM documents)) GROUP BY doc_id, b",
)


@query("hash_embed", "SELECT doc_id, b::INT AS bucket, round((c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM hash_v")
def hash_embed(s, d):
    made = models.embed(spread(v.table(s, d, "documents").select("doc_id", "text"))).select("doc_id", F.posexplode_outer("embedding").alias("bucket", "value"))
    return made.filter("value > 0").select("doc_id", "bucket", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("metadata_and_sanity", "SELECT count(*) AS n, min(chunk_id) = 0 AND max(chunk_id) = count(*) - 1 AND count(DISTINCT chunk_id) = count(*) AS dense, min(len(embedding)) = max(len(embedding)) AS one_dim FROM chunk_v")
def metadata_and_sanity(s, d):
    return vectors.sanity(vectors.build_index(v.chunks(s, d)))


@query("index_metadata", "SELECT chunk_id, doc_id, page_start, page_end, text FROM chunk_v")
def index_metadata(s, d):
    return vectors.metadata(v.chunks(s, d))


@query("idf_vocabulary", "SELECT term, df, round(idf, 9) AS idf FROM vocab_v")
def idf_vocabulary(s, d):
    return v.vocabulary(s, d).withColumn("idf", F.round("idf", 9))


# Search and rerank

view("met_v", "SELECT note_id, q_no, chunk_id, list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM chunk_v AS c, query_v AS q", "chunk_v", "query_v")
view("top_v", "SELECT note_id, q_no, row_number() OVER (PARTITION BY note_id, q_no ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score FROM met_v QUALIFY rank <= 10", "met_v")
view("pool_v", "SELECT note_id, chunk_id, row_number() OVER (PARTITION BY note_id ORDER BY q_no, rank)::INT AS pool_pos, q_no, rank, score, doc_id, text, embedding FROM (SELECT * FROM top_v QUALIFY row_number() OVER (PARTITION BY note_id, chunk_id ORDER BY q_no, rank) = 1) JOIN chunk_v USING (chunk_id)", "top_v", "chunk_v")
_words = rf"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"  # noqa: F541
_terms = lambda c: f"list_distinct(regexp_extract_all(lower({c}), {v.TERM_SQL}))"
view(
    "pair_v",
    f"SELECT a.note_id, a.q_no, p.chunk_id, round(coalesce(hit / total, 0), 9) AS pair_score FROM query_v AS a JOIN pool_v AS p ON a.note_id = p.note_id LEFT JOIN (SELECT note_id, q_no, chunk_id, sum(idf) AS hit FROM (SELECT note_id, q_no, unnest({_terms('query')}) AS term FROM query_v) JOIN vocab_v USING (term) JOIN (SELECT note_id, chunk_id, unnest({_terms('text')}) AS term FROM pool_v) USING (note_id, term) GROUP BY ALL) AS h ON a.note_id = h.note_id AND a.q_no = h.q_no AND p.chunk_id = h.chunk_id "
    f"LEFT JOIN (SELECT note_id, q_no, sum(idf) AS total FROM (SELECT note_id, q_no, unnest({_terms('query')}) AS term FROM query_v) JOIN vocab_v USING (term) GROUP BY ALL) AS w ON a.note_id = w.note_id AND a.q_no = w.q_no",
    "query_v", "pool_v", "vocab_v",
)
view("max_v", "SELECT note_id, chunk_id, max(pair_score) AS max_score FROM pair_v GROUP BY ALL", "pair_v")
view("lead_v", "SELECT note_id, pair_v.q_no, chunk_id FROM pair_v JOIN (SELECT note_id, chunk_id, pool_pos FROM pool_v) USING (note_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY note_id, pair_v.q_no ORDER BY pair_score DESC, pool_pos) = 1", "pair_v", "pool_v")


def _primary(ratio: float) -> str:
    return f"SELECT note_id, doc_id, n, big OR NOT bool_or(big) OVER (PARTITION BY note_id) AS is_primary FROM (SELECT note_id, doc_id, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY note_id) >= {ratio}::DOUBLE AS big FROM pool_v GROUP BY note_id, doc_id)"


view("main_v", _primary(0.35), "pool_v")
view("done_v", "SELECT note_id, chunk_id, pool_pos, doc_id, text, max_score, l.chunk_id IS NOT NULL AS is_leader, is_primary, max_score * CASE WHEN l.chunk_id IS NOT NULL THEN (1.0::DOUBLE + 0.1::DOUBLE) ELSE 1.0::DOUBLE END * CASE WHEN is_primary THEN 1.0::DOUBLE ELSE (1.0::DOUBLE - 0.15::DOUBLE) END AS final_score FROM pool_v JOIN max_v USING (note_id, chunk_id) LEFT JOIN (SELECT DISTINCT note_id, chunk_id FROM lead_v) AS l USING (note_id, chunk_id) JOIN main_v USING (note_id, doc_id)".replace("l.chunk_id IS NOT NULL", "l.is_lead IS NOT NULL").replace("SELECT DISTINCT note_id, chunk_id FROM lead_v", "SELECT DISTINCT note_id, chunk_id, true AS is_lead FROM lead_v"), "pool_v", "max_v", "lead_v", "main_v")
_far = "len(list_intersect(x.words, y.words))::DOUBLE / nullif(least(len(x.words), len(y.words)), 0) >= 0.8::DOUBLE"
view("kept_v", f"SELECT note_id, list_reduce(rs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: coalesce({_far}, false))) > 0 THEN acc ELSE list_append(acc, x) END, rs[1:0]) AS ks FROM (SELECT note_id, list({{'chunk_id': chunk_id, 'final_score': final_score, 'words': {_words}}} ORDER BY final_score DESC, pool_pos) AS rs FROM done_v GROUP BY note_id)", "done_v")


def pool(s, d):
    found = rerank.merge_first_seen(vectors.top_k(v.searching(s, d), v.chunks(s, d), 10))
    return stored(found.join(v.chunks(s, d), "chunk_id"), "pool")


def pairs(s, d, candidates=None):
    return rerank.lexical_scores(v.searching(s, d), candidates or pool(s, d), v.vocabulary(s, d))


@query("topk_inner_product", "SELECT note_id, q_no, rank, chunk_id, round(score, 6) AS score FROM top_v")
def topk_inner_product(s, d):
    return vectors.top_k(v.searching(s, d), v.chunks(s, d), 10).withColumn("score", F.round("score", 6))


@query("topk_merge_first_seen", "SELECT note_id, chunk_id, pool_pos, q_no, rank, round(score, 6) AS score FROM pool_v")
def topk_merge_first_seen(s, d):
    return rerank.merge_first_seen(vectors.top_k(v.searching(s, d), v.chunks(s, d), 10)).withColumn("score", F.round("score", 6))


@query("primary_source", _primary(0.4))
def primary_source(s, d):
    return rerank.primary_sources(pool(s, d))


@query("pair_score_lexical", "SELECT note_id, q_no, chunk_id, pair_score FROM pair_v")
def pair_score_lexical(s, d):
    return pairs(s, d)


@query("max_over_queries", "SELECT note_id, chunk_id, max_score FROM max_v")
def max_over_queries(s, d):
    return rerank.max_over_queries(pairs(s, d))


@query("category_leaders", "SELECT note_id, q_no, chunk_id FROM lead_v")
def category_leaders(s, d):
    return rerank.category_leaders(pairs(s, d, p := pool(s, d)), p)


@query("boost_and_penalty", "SELECT note_id, chunk_id, is_leader, is_primary, round(final_score, 9) AS final_score FROM done_v")
def boost_and_penalty(s, d):
    return rerank.final_scores(pairs(s, d, p := pool(s, d)), p).select("note_id", "chunk_id", "is_leader", "is_primary", F.round("final_score", 9).alias("final_score"))


@query("text_overlap_pairs", f"SELECT note_id, x.chunk_id AS a, y.chunk_id AS b, round(coalesce(len(list_intersect(x.words, y.words))::DOUBLE / nullif(least(len(x.words), len(y.words)), 0), 0), 6) AS overlap FROM (SELECT note_id, chunk_id, pool_pos, {_words} AS words FROM pool_v) AS x JOIN (SELECT note_id, chunk_id, pool_pos, {_words} AS words FROM pool_v) AS y USING (note_id) WHERE x.pool_pos < y.pool_pos")
def text_overlap_pairs(s, d):
    """Pairs within a note's pool, whose size the retrieval depth bounds."""
    w = pool(s, d).select("note_id", "chunk_id", "pool_pos", fx.word_set(F.col("text")).alias("words"))
    x, y = w.alias("x"), w.select("note_id", *[F.col(c).alias(f"{c}_y") for c in ("chunk_id", "pool_pos", "words")])
    return x.join(y, "note_id").filter("pool_pos < pool_pos_y").select("note_id", F.col("chunk_id").alias("a"), F.col("chunk_id_y").alias("b"), F.round(fx.overlap(F.col("words"), F.col("words_y")), 6).alias("overlap"))


_final = "SELECT note_id, {n} AS rank, k.chunk_id AS chunk_id, round(k.final_score, 9) AS final_score FROM (SELECT note_id, unnest(generate_series(1, len(ks))) AS i, ks[i] AS k FROM kept_v) {w}"


@query("near_dup_removal", _final.format(n="i::INT", w=""))
def near_dup_removal(s, d):
    return rerank.select_final(rerank.final_scores(pairs(s, d, p := pool(s, d)), p), 1_000_000).withColumn("final_score", F.round("final_score", 9))


@query("multi_query_rerank", _final.format(n="i::INT", w="WHERE i <= 10"))
def multi_query_rerank(s, d):
    candidates = pool(s, d)
    return rerank.rerank(v.searching(s, d), candidates, pairs(s, d, candidates), 10).withColumn("final_score", F.round("final_score", 9))


@query("single_query_rerank", "SELECT note_id, pair_v.q_no, row_number() OVER (PARTITION BY note_id, pair_v.q_no ORDER BY pair_score DESC, pool_pos)::INT AS rank, chunk_id, pair_score AS rerank_score FROM pair_v JOIN (SELECT note_id, chunk_id, pool_pos FROM pool_v) USING (note_id, chunk_id) QUALIFY rank <= 6")
def single_query_rerank(s, d):
    return rerank.single_query_rerank(pairs(s, d, p := pool(s, d)), p)


_gain = "list_transform(generate_series(1, len(cs)), lambda i: CASE WHEN list_contains(acc, i) THEN -1e300::DOUBLE ELSE 0.5::DOUBLE * cs[i].sim - 0.5::DOUBLE * CASE WHEN len(acc) = 0 THEN 0::DOUBLE ELSE list_max(list_transform(acc, lambda j: list_inner_product(cs[i].e, cs[j].e))) END END)"
view("wide_v", "SELECT note_id, q_no, list({'id': chunk_id, 'sim': score, 'e': embedding::DOUBLE[]} ORDER BY score DESC, chunk_id) AS cs FROM (SELECT * FROM met_v QUALIFY row_number() OVER (PARTITION BY note_id, q_no ORDER BY score DESC, chunk_id) <= 30) JOIN chunk_v USING (chunk_id) GROUP BY note_id, q_no", "met_v", "chunk_v")
view("picked_v", f"SELECT note_id, q_no, cs, list_reduce(generate_series(1, 15), lambda acc, step: CASE WHEN len(acc) >= len(cs) THEN acc ELSE list_append(acc, list_position({_gain}, list_max({_gain}))::BIGINT) END, [0::BIGINT][1:0]) AS chosen FROM wide_v", "wide_v")


@query("mmr_select", "SELECT note_id, q_no, k::INT AS mmr_rank, cs[chosen[k]].id AS chunk_id FROM (SELECT note_id, q_no, cs, chosen, unnest(generate_series(1, len(chosen))) AS k FROM picked_v)")
def mmr_select(s, d):
    asked = v.searching(s, d).select("note_id", "q_no", F.col("embedding").alias("q_embedding"))
    found = vectors.top_k(v.searching(s, d), v.chunks(s, d), 30).join(v.chunks(s, d).select("chunk_id", "embedding"), "chunk_id").join(asked, ["note_id", "q_no"])
    return rerank.mmr(found)


# Notes

_gender = f"CASE WHEN lower({strip_sql('split_part(text, chr(44), 1)')}) = 'other' THEN '' ELSE {strip_sql('split_part(text, chr(44), 1)')} END"
_years = f"try_cast(nullif(regexp_extract(text, '{fixed.DEMOGRAPHICS}', 1), '') AS INT)"
_months = f"try_cast(nullif(regexp_extract(text, '{fixed.DEMOGRAPHICS}', 2), '') AS INT)"
view(
    "field_v",
    f"SELECT note_id, text, {_gender} AS gender, coalesce({_years}, CASE WHEN {_months} IS NOT NULL THEN 0 END)::INT AS age, {_years} IS NULL AND {_months} IS NOT NULL AS neonatal, "
    + ", ".join(strip_sql(rf"regexp_extract(text, '(?is){a}[:\s]+(.*?){b}\s*:', 1)") + f" AS {n}" for n, (a, b) in fixed.SECTIONS.items())
    + ", " + strip_sql(r"regexp_extract(text, '(?is)Prognosis[:\s]+(.+)$', 1)") + " AS prognosis FROM note_v",
    "note_v",
)
_bracket = "CASE WHEN age IS NULL THEN NULL WHEN age <= 1 OR neonatal THEN 'neonatal' WHEN age <= 14 THEN 'pediatric' WHEN age >= 65 THEN 'elderly' END"


@query("note_fields", "SELECT note_id, gender, age, neonatal, medical_history, remote_medical_history, exams, clinical_diary, diagnosis, prognosis FROM field_v")
def note_fields(s, d):
    return notes.fields(v.notes(s, d))


@query("age_bracket", f"SELECT note_id, age, {_bracket} AS bracket FROM field_v")
def age_bracket(s, d):
    return notes.fields(v.notes(s, d)).select("note_id", "age", notes.age_bracket(F.col("age"), F.col("neonatal")).alias("bracket"))


@query("note_builder", "SELECT note_id, CASE lower(g) WHEN 'f' THEN 'Femmina' WHEN 'a' THEN 'Altro' ELSE 'Maschio' END || ', ' || a || chr(10) || chr(10) || 'Anamnesi: ' || chr(10) || '- Patologia Prossima:' || chr(10) || " + strip_sql("medical_history") + " || CASE WHEN r <> '' THEN chr(10) || '- Patologia Remota:' || chr(10) || r ELSE '' END || chr(10) || chr(10) || 'Esame Obiettivo:' || chr(10) || exams || chr(10) || chr(10) || 'Diario Clinico: ' || chr(10) || clinical_diary || chr(10) || chr(10) || 'Diagnosi: ' || diagnosis || chr(10) || chr(10) || 'Prognosi: ' || prognosis AS note FROM (SELECT *, CASE note_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'A' END AS g, coalesce(age, 0)::VARCHAR AS a, CASE WHEN note_id % 5 = 0 THEN '' ELSE remote_medical_history END AS r FROM field_v)")
def note_builder(s, d):
    f = notes.fields(v.notes(s, d))
    gender = F.when(F.col("note_id") % 3 == 0, "m").when(F.col("note_id") % 3 == 1, "f").otherwise("A")
    remote = F.when(F.col("note_id") % 5 == 0, "").otherwise(F.col("remote_medical_history"))
    return f.select("note_id", notes.build_note(gender, F.coalesce("age", F.lit(0)).cast("string"), F.col("medical_history"), remote, F.col("exams"), F.col("clinical_diary"), F.col("diagnosis"), F.col("prognosis")).alias("note"))


view("piece_v", f"SELECT note_id, w AS word, i, sum(length(w)) OVER (PARTITION BY note_id ORDER BY i)::INT AS stop FROM (SELECT note_id, ws[i] AS w, i FROM (SELECT note_id, ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT note_id, regexp_extract_all(text, '{fixed.TERM}|[^a-zA-Z0-9µ²³]+') AS ws FROM note_v)))", "note_v")
view("ent_v", "SELECT note_id, etype, word, (stop - length(word))::INT AS start, stop FROM piece_v JOIN gaz_v ON lower(word) = term", "piece_v", "gaz_v")
_cue = rf"(^|[^\pL\pN_])({fixed.NEGATIONS})([^\pL\pN_]|$)"
view(
    "neg_v",
    rf"SELECT e.note_id, etype, word, start, stop, regexp_matches(regexp_replace(substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)), '(?s)^.*[.,:;]', ''), '(?i){_cue}') OR regexp_matches(regexp_replace(substr(text, stop + 1, 15), '(?s)[.,:;].*$', ''), '(?i)(^|[^\pL\pN_]){fixed.NEGATED_AFTER}([^\pL\pN_]|$)') AS negated FROM ent_v AS e JOIN note_v USING (note_id)",
    "ent_v", "note_v",
)
view("first_v", "SELECT note_id, etype, row_number() OVER (PARTITION BY note_id, etype ORDER BY start, stop)::INT AS ord, word FROM (SELECT * FROM neg_v WHERE NOT negated QUALIFY row_number() OVER (PARTITION BY note_id, etype, lower(word) ORDER BY start, stop) = 1)", "neg_v")
view("rank_v", "SELECT note_id, etype, row_number() OVER (PARTITION BY note_id, etype ORDER BY score DESC, ord)::INT AS rank, word, score FROM (SELECT note_id, etype, ord, word, max(coalesce(idf, 0)) AS score FROM first_v LEFT JOIN vocab_v ON lower(word) = term GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 10", "first_v", "vocab_v")


def first(s, d, vocabulary=None):
    return entities.first_mentions(entities.find_affirmed(v.notes(s, d), v.gazetteer(vocabulary or v.vocabulary(s, d)), first=True))


def mentions(s, d):
    """First mentions and their ranking, over one vocabulary."""
    vocabulary = stored(v.vocabulary(s, d), "vocabulary")
    once = stored(first(s, d, vocabulary), "mentions")
    return once, entities.ranked(entities.scored(once, vocabulary))


@query("gazetteer_ner", "SELECT note_id, etype, word, start, stop FROM ent_v")
def gazetteer_ner(s, d):
    return entities.find_terms(v.notes(s, d), v.gazetteer(v.vocabulary(s, d)))


@query("negation_filter", "SELECT note_id, etype, word, start, stop, negated FROM neg_v")
def negation_filter(s, d):
    return entities.find_affirmed(v.notes(s, d), v.gazetteer(v.vocabulary(s, d)))


@query("entity_dedup", "SELECT note_id, etype, ord, word FROM first_v")
def entity_dedup(s, d):
    return first(s, d)


@query("entity_rank", "SELECT note_id, etype, rank, word, round(score, 9) AS score FROM rank_v")
def entity_rank(s, d):
    return mentions(s, d)[1].withColumn("score", F.round("score", 9))


@query("digit_normalise", "SELECT note_id, translate(text, '₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹', '01234567890123456789') AS text FROM note_v")
def digit_normalise(s, d):
    return v.notes(s, d).select("note_id", fx.plain_digits(F.col("text")).alias("text"))


view("words_v", "SELECT note_id, etype, coalesce(ws, []) AS words, aws AS all_words FROM (SELECT note_id, etype, list(word ORDER BY ord) AS aws FROM first_v GROUP BY ALL) LEFT JOIN (SELECT note_id, etype, list(word ORDER BY rank) AS ws FROM rank_v GROUP BY ALL) USING (note_id, etype)", "first_v", "rank_v")
_digits = lambda x: f"lower(translate({x}, '₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹', '01234567890123456789'))"
_at = lambda k: f"coalesce(regexp_matches({_digits('x')}, '(^|[^0-9a-z])' || {_digits(f'words[{k}]')} || '([^0-9a-z]|$)'), false)"
view(
    "short_diary_v",
    "SELECT note_id, array_to_string(list_filter(ss, lambda x: " + _at(1) + ") || list_filter(ss, lambda x: " + _at(2) + " AND NOT " + _at(1) + "), ' ') AS condensed FROM (SELECT note_id, words, list_filter(list_transform(us, lambda x, i: CASE WHEN list_position(us, x) = i THEN x END), lambda x: x IS NOT NULL) AS ss FROM (SELECT note_id, words, list_transform(list_filter(string_split(regexp_replace(regexp_replace(clinical_diary, '([.])\\s+', '\\1' || chr(1), 'g'), '(\\n\\s*-)', chr(1) || '\\1', 'g'), chr(1)), lambda x: "
    + strip_sql("x") + " <> ''), lambda x: ltrim(" + strip_sql("x") + ", '- ')) AS us FROM field_v JOIN words_v USING (note_id) WHERE etype = 'DIAGNOSTIC_PROCEDURE'))",
    "field_v", "words_v",
)


@query("condense_diary", "SELECT note_id, condensed FROM short_diary_v")
def condense_diary(s, d):
    words = queries.words_by_type(*mentions(s, d)).filter("etype = 'DIAGNOSTIC_PROCEDURE'")
    return notes.fields(v.notes(s, d)).join(words, "note_id").select("note_id", entities.condense(F.col("clinical_diary"), F.col("words")).alias("condensed"))


_named = lambda k, kind, anchor: f"SELECT note_id, {k} AS o, '{kind}' AS kind, concat_ws('. ', nullif(array_to_string(CASE WHEN len(words) > 0 THEN words ELSE all_words END, ' '), ''), nullif(diagnosis, ''), '{anchor}') AS query, true AS for_retrieval FROM field_v JOIN words_v USING (note_id) WHERE etype = '{kind}'"
_anchors = dict(fixed.ANCHORS)
view(
    "asked_v",
    "SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY o)::INT AS q_no, kind, query, for_retrieval, true AS for_rerank FROM ("
    + " UNION ALL ".join([
        _named(0, "DISEASE_DISORDER", _anchors["DISEASE_DISORDER"]), _named(1, "MEDICATION", _anchors["MEDICATION"]),
        f"SELECT note_id, 2, 'DIAGNOSTIC_PROCEDURE', condensed || ' ' || diagnosis || '. {_anchors['DIAGNOSTIC_PROCEDURE']}', false FROM short_diary_v JOIN field_v USING (note_id) WHERE condensed <> ''",
        f"SELECT note_id, 3, 'BROAD', diagnosis || ' recommendations discharge management ' || coalesce({_bracket} || ' ', '') || lower(gender), true FROM field_v",
    ]) + ")",
    "field_v", "words_v", "short_diary_v",
)


def asked(s, d):
    return queries.build_queries(notes.fields(v.notes(s, d)), queries.words_by_type(*mentions(s, d)))


@query("build_queries", "SELECT note_id, q_no, kind, query, for_retrieval, for_rerank FROM asked_v")
def build_queries(s, d):
    return asked(s, d)


@query("legacy_query", "SELECT note_id, 'Diagnosis: ' || diagnosis || '. ' || 'Diagnosis: ' || diagnosis || '. ' || 'Past medical history: ' || remote_medical_history || '. therapy recommendations hospitalization discharge' AS query FROM field_v")
def legacy_query(s, d):
    return queries.single_query(notes.fields(v.notes(s, d)))


@query("query_file_text", "SELECT note_id, string_agg('--- Query ' || q_no || ' ---' || chr(10) || query || chr(10) || chr(10), '' ORDER BY q_no) AS content FROM asked_v GROUP BY note_id")
def query_file_text(s, d):
    return queries.query_file(asked(s, d))


# Prompts

_admitted = f"regexp_matches(lower(prognosis), '{'|'.join(fixed.ADMISSION_WORDS)}')"


@query("prompt_route", f"SELECT note_id, CASE WHEN {_admitted} THEN 'admission' ELSE 'discharge' END AS template FROM field_v")
def prompt_route(s, d):
    return notes.fields(v.notes(s, d)).select("note_id", F.when(prompt.is_admitted(F.col("prognosis")), "admission").otherwise("discharge").alias("template"))


def _prompt_sql(final: str) -> str:
    part = lambda name: f"CASE WHEN {_admitted} THEN {v.sql_quote(getattr(prompt.ADMISSION, name))} ELSE {v.sql_quote(getattr(prompt.DISCHARGE, name))} END"
    nl = lambda k: " || ".join(["chr(10)"] * k)
    said = f"'[E' || rank || '] (' || c.doc_id || ', p.' || c.page_start || '-' || c.page_end || ')' || {nl(2)} || c.text || {nl(3)}"
    return (
        f"SELECT f.note_id, CASE WHEN {_admitted} THEN 'admission' ELSE 'discharge' END AS template, 'ROLE:' || chr(10) || {part('role')} || {nl(2)} || 'CLINICAL NOTE:' || {nl(2)} || f.text || {nl(3)} || 'GUIDELINE EXCERPTS:' || {nl(2)} || coalesce(e.x, '') || {part('task')} || chr(10) || {part('rules')} AS prompt "
        f"FROM field_v AS f LEFT JOIN (SELECT note_id, string_agg({said}, '' ORDER BY rank) AS x FROM ({final}) AS k JOIN chunk_v AS c USING (chunk_id) GROUP BY note_id) AS e ON f.note_id = e.note_id"
    )


_final10 = _final.format(n="i::INT", w="WHERE i <= 10")


def prompts(s, d):
    candidates = pool(s, d)
    final = rerank.rerank(v.searching(s, d), candidates, pairs(s, d, candidates), 10)
    return prompt.build_prompts(v.notes(s, d), notes.fields(v.notes(s, d)), final, v.chunks(s, d))


@query("prompt_text", _prompt_sql(_final10))
def prompt_text(s, d):
    return prompts(s, d)


view("out_v", f"SELECT note_id, prompt AS output FROM ({_prompt_sql(_final10)})", "field_v", "kept_v", "chunk_v")


@query("append_reference", f"SELECT note_id, output || CASE WHEN b.text IS NOT NULL THEN {v.sql_quote(fixed.BANNER)} || b.text ELSE '' END AS output FROM out_v LEFT JOIN benchmark AS b ON note_id = item_id")
def append_reference(s, d):
    references = v.table(s, d, "benchmark").select(F.col("item_id").alias("note_id"), F.col("text").alias("reference"))
    return prompt.append_reference(models.generate(prompts(s, d)).select("note_id", "output"), references)


@query("pipeline_end_to_end")
def pipeline_end_to_end(s, d):
    """Both programs: documents to chunks and their index, conversations to prompts over it."""
    built = pipelines.build_index(v.pages(s, d))
    return pipelines.answer(v.notes(s, d), built.chunks, built.vocabulary, v.gazetteer(v.vocabulary(s, d)))
