"""The stages on a small table, each against what brute force says of its own input."""

import os

import corpus_pipeline
import pytest
from lamina.llm import near_dedup, toxicity
from lamina.llm.common import table
from lamina.llm.registry import QUERIES
from lamina.session import scope, shared_dir
from pyspark.sql import functions as F

from .conftest import DATA, edge_rows
from .test_dedup import brute_components, brute_repeats, brute_sets
from .test_tokens import check_places, library_ids

#: Where the labels are enough to learn from.
LARGER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, LARGER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*columns).collect()]
        stage(spark, docs, LARGER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            model = toxicity.fit(table(spark, LARGER, "documents"), table(spark, LARGER, "labels"))
            assert ids == {r[0] for r, s in zip(before, model.score([r[1].encode() for r in before]), strict=True) if s < toxicity.CUT}
            assert len(ids) < len(before)
        if name == "near_dedup":
            assert ids == {r[0] for r, c in zip(before, brute_components([r[0] for r in before], brute_sets(before), near_dedup.STAGE_THRESHOLD), strict=True) if r[0] == c}
            assert len(ids) < len(before)
        if name == "substring_dedup":
            want = {d: n - gone for d, n, gone, _ in brute_repeats(before) if not gone or n - gone}
            assert {r["doc_id"]: len((r["text"] or "").encode().split()) for r in after} == want
        if name == "mixing":
            assert ids <= {r[0] for r in before} and len(ids) > len(before) / 2
            assert {tuple(r) for r in after} <= set(before)
        if name == "packing":
            assert ids == {r[0] for r in before}
            assert sum(r["length"] for r in after) == sum(len(library_ids(r[1], 0)) for r in before)
            check_places(after, 2048)


@pytest.mark.parametrize("which", ["edges", "clashing", "nothing"])
def test_odd_rows_pass(spark, edges, clashing, nothing, which):
    """Every stage on odd rows, with the labels of a folder; columns that clash with the operators' own stay outside."""
    docs = {"edges": edges, "clashing": clashing, "nothing": nothing}[which]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        rows = out.collect()
        assert bool(rows) == (which != "nothing") and len(rows) <= docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(packed) >= docs.count() and sum(r["length"] for r in packed) == sum(len(library_ids(r["text"], 0)) for r in docs.select("text").collect())
    check_places(packed, 2048)
    if which == "edges":
        kept = corpus_pipeline.drop_near_copies(spark, edges, DATA)
        assert kept.filter(F.col("doc_id").isNull()).count() == sum(r[0] is None for r in edge_rows())


def test_query_and_its_tables(spark):
    """A result that is still to be fetched outlives a pipeline run beside it, and nothing is left in the shared folder."""
    folder = shared_dir(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    with scope(spark):
        held = QUERIES["op8_url_filter"](spark, DATA)
        assert corpus_pipeline.run(spark, DATA).count() > 0
        assert held.count() == table(spark, DATA, "pages").count()
    assert set(os.listdir(folder)) == before


def test_near_copies_from_four_fifths_on(spark):
    docs = table(spark, LARGER, "documents").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    ids, sets = [r[0] for r in rows], brute_sets(rows)
    want, strict = ({d for d, c in zip(ids, brute_components(ids, sets, percent), strict=True) if d == c} for percent in (80, 85))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, LARGER).collect()} == want
    assert want < strict


def test_mixing_stage_learns_from_every_text(spark, monkeypatch):
    from lamina.llm import mixing

    made = []

    class Noted(mixing.Vectors):
        def __init__(self, counted):
            super().__init__(counted)
            made.append(self.n)

    monkeypatch.setattr(mixing, "Vectors", Noted)
    docs = spark.createDataFrame([(i, f"text {i % 4500} of {i % 7} and {i % 11}", "en", "s", 9) for i in range(4500)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.mix(spark, docs, "").count() > 0 and made == [4500]
