"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lamina.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted((tuple(plain(x[names.index(c)]) for c in order) for x in r.fetchall()), key=repr)
        assert sorted((tuple(plain(x[c]) for c in order) for x in rows), key=repr) == want


def test_end_to_end_answers_every_note(spark):
    rows = QUERIES["pipeline_end_to_end"](spark, DATA).collect()
    assert sorted(r["note_id"] for r in rows) == sorted(r["conv_id"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().collect())
    assert all(r["output"] == r["prompt"] for r in rows) and any("[E1] (" in r["prompt"] for r in rows)


def test_index_lines_end_as_in_sql(spark, tmp_path):
    """Carriage returns, separators and vertical tabs within lines, as the query and its SQL read them."""
    line = lambda c: f"Chapter{c}one ..  12"
    texts = ["\n".join([line(c)] * 3 + [f"plain{c}text......", f"last{c}", "Part 1\x0b\x0b7"]) for c in (" ", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028", "\u2029")] + ["", "12", "Contents\r\n" * 9 + "A  1\r\n" * 9]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("detect_index", "bad_pages"):
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)
