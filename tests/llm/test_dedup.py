"""Repeated passages and near duplicates against brute force."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lamina.llm import components, near_dedup, substring_dedup
from lamina.llm.common import stored

from .conftest import DATA, SCHEMA, edge_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_repeats(rows, window=50):
    starts = {}
    docs = [(r[0], WORDS(r[1] or "")) for r in rows]
    for d, w in docs:
        if d is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                starts[k] = min(starts.get(k, d), d)
    out = []
    for d, w in docs:
        gone = set()
        if d is not None:
            for p in range(len(w) - window + 1):
                if starts[tuple(w[p : p + window])] < d:
                    gone.update(range(p, p + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def brute_sets(rows):
    sets = []
    for r in rows:
        w = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def brute_components(ids, sets, percent=85):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            by[k].append(i)
    common = Counter()
    for own in by.values():
        for x in range(len(own)):
            for y in range(x):
                common[own[x], own[y]] += 1
    for (i, j), both in common.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    return rows


@pytest.mark.parametrize("which", ["edges", "clashing", "table"])
def test_repeats(spark, edges, clashing, which):
    rows, df = (edge_rows(), {"edges": edges, "clashing": clashing}[which]) if which != "table" else (tables(spark), spark.read.parquet(f"{DATA}/documents.parquet"))
    found = got(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(brute_repeats(rows), key=repr)
    assert sum(r[2] for r in found) > 0


@pytest.mark.parametrize("window", [4, 10, 50])
def test_repeats_with_many_partial_overlaps(spark, window):
    """Few different words: runs under one stand often disagree."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(str(x) for x in r.integers(0, 2, int(r.integers(0, 160)))), None, None, 0) for i in range(40)]
    rows += [(100 + i, " ".join(rows[i][1].split()[7:90]) + " tail", None, None, 0) for i in range(10)]
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    assert got(substring_dedup.remove_repeats(df, window), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_repeats(rows, window), key=repr)


def brute_longest(rows, window):
    """The greatest doubling of window that has a window which also starts in a smaller doc_id."""
    docs, out = [(r[0], WORDS(r[1] or "")) for r in rows], [0] * len(rows)
    while any(len(w) >= window for _, w in docs):
        starts = {}
        for d, w in docs:
            if d is not None:
                for p in range(len(w) - window + 1):
                    starts[k] = min(starts.get(k := tuple(w[p : p + window]), d), d)
        for i, (d, w) in enumerate(docs):
            if d is not None and any(starts[tuple(w[p : p + window])] < d for p in range(len(w) - window + 1)):
                out[i] = window
        window *= 2
    return out


@pytest.mark.parametrize("window", [4, 10])
def test_repeats_double_until_none_is_left(spark, window):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(str(x) for x in r.integers(0, 2, int(r.integers(0, 160)))), None, None, 0) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " tail", None, None, 0) for i in range(8)] + [(3, rows[4][1] + " other text", None, None, 0)]
    out = substring_dedup.remove_repeats(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), window, deep=True)
    want = sorted(((d, n, gone, deep) for (d, n, gone, _), deep in zip(brute_repeats(rows, window), brute_longest(rows, window), strict=True)), key=repr)
    assert got(out, "doc_id", "n_words", "n_removed", "longest_repeat") == want
    assert max(w[3] for w in want) >= 4 * window


def test_candidates_of_each_level(spark):
    """Documents with a passage of 60, 130, 230 and 450 words: each goes on as long as both halves repeat, and the texts of the others are left behind."""
    rows = []
    for i, n in enumerate((60, 130, 230, 450)):
        rows += [(2 * i, " ".join(prose(50 + i, n) + prose(60 + i, 500))), (2 * i + 1, " ".join(prose(70 + i, 500) + prose(50 + i, n)))]
    rows += [(20, " ".join(prose(90, 900)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {n: [sorted(r["doc_id"] for r in t.filter(f"size({c}) > 0").collect()) for c in ("later", "first")] for n, t in substring_dedup.levels(docs)}
    assert seen == {50: [[1, 3, 5, 7], [0, 2, 4, 6]], 100: [[3, 5, 7], [2, 4, 6]], 200: [[5, 7], [4, 6]], 400: [[7], [6]]}
    assert {r["doc_id"]: r["longest_repeat"] for r in substring_dedup.remove_repeats(docs, deep=True).collect()} == {0: 0, 1: 50, 2: 0, 3: 100, 4: 0, 5: 200, 6: 0, 7: 400, 20: 0}


def test_query_goes_through_all_levels(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(prose(100 + i, 30) + prose(50, 430) + prose(200 + i, 30)), "en", "src0", 0) for i in range(3)] + [(9, " ".join(prose(90, 900)), "en", "src0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    seen, levels = [], substring_dedup.levels

    def noted(*args):
        for n, found in levels(*args):
            seen.append((n, found.filter("size(later) > 0").count()))
            yield n, found

    monkeypatch.setattr(substring_dedup, "levels", noted)
    out = substring_dedup.op1_substring_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert got(out, *out.columns) == sorted(brute_repeats(rows), key=repr) and seen == [(50, 2), (100, 2), (200, 2), (400, 2)]


def test_runs_of_very_long_texts_are_told_apart():
    """Places up to those of the longest text that a string can hold, without a cap."""
    first, count = np.array([0, (1 << 26) + 5, (1 << 30) - 1]), np.array([1, 63, 7])
    for mark in (0, (1 << 27) - 1):
        at = substring_dedup.packed(mark, first, count)
        assert (at >= 0).all() and (at >> 36 == mark).all()
        assert [x.tolist() for x in substring_dedup.unpacked(at)] == [first.tolist(), count.tolist()]


def test_repeats_cut_from_texts(clashing, nothing):
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(clashing).collect()}
    want = {d: (n, gone) for d, n, gone, _ in brute_repeats(edge_rows())}
    assert out[0]["at"] == "own at" and out[0]["text"] == edge_rows()[0][1]
    assert 20 not in out and 1 in out and 3 in out  # every word of 20 goes; what had none stays
    for d, r in out.items():
        if d is not None:
            assert len(WORDS(r["text"] or "")) == want[d][0] - want[d][1]
            assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert substring_dedup.without_repeats(nothing).count() == 0 and substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("which", ["edges", "table"])
def test_near_duplicates(spark, edges, which):
    rows, df = (edge_rows(), edges) if which == "edges" else (tables(spark), spark.read.parquet(f"{DATA}/documents.parquet"))
    sets = brute_sets(rows)
    want = [(r[0], len(s), c, c is None or r[0] == c) for r, s, c in zip(rows, sets, brute_components([r[0] for r in rows], sets), strict=True)]
    assert got(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(want)


def test_near_duplicates_with_odd_columns_and_none(clashing, nothing):
    assert near_dedup.near_duplicates(clashing).count() == len(edge_rows())
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_where_ids_repeat_with_other_texts(spark):
    """Each text of a repeated doc_id keeps its own links; repeated rows count once."""
    x, y, z = prose(21, 120), prose(22, 120), prose(23, 120)
    near = lambda w, i: " ".join(v if j != i else "changed" for j, v in enumerate(w))
    rows = [(5, " ".join(x)), (5, " ".join(y)), (5, " ".join(x)), (7, near(x, 60)), (8, near(y, 70)), (9, " ".join(y)), (3, near(z, 50)), (5, " ".join(z)), (11, near(z, 5)), (5, ""), (12, "alone here is one text")] + [(5, " ".join(x))] * 40
    sets = brute_sets(rows)
    want = [(r[0], len(s), c) for r, s, c in zip(rows, sets, brute_components([r[0] for r in rows], sets), strict=True)]
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def chain(n):
    """Each text differs from the next in a few words, so the first and the last don't link."""
    w, out = prose(9, 150), []
    r = np.random.default_rng(3)
    for i in range(n):
        out.append((i, " ".join(w)))
        w = w.copy()
        w[int(r.integers(0, 150))] = f"new{i}"
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_links_of_large_components(spark, monkeypatch, block):
    """The same components whether one task searches them or pairs of blocks do."""
    rows = chain(40) + [(100 + i, " ".join(w if j != i else "y" for j, w in enumerate(prose(10, 200)))) for i in range(60)]
    rows += [(300 + i, " ".join(prose(10, 200)[i:] + prose(11 + i, i))) for i in range(0, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup.links, "__defaults__", (block, 1 << 20))
    sets = brute_sets(rows)
    want = sorted(((d, c) for (d, _), c in zip(rows, brute_components([r[0] for r in rows], sets), strict=True)), key=repr)
    assert got(near_dedup.near_duplicates(docs), "doc_id", "component_id") == want
    assert len({c for _, c in want}) < 40


def test_odd_sketch_estimates():
    r = np.random.default_rng(0)
    for share in (0.7, 0.85, 0.95):
        errors = []
        for _ in range(30):
            both, n = r.integers(0, 1 << 63, 2000, np.uint64), int(2000 * share)
            a, b = both, np.concatenate([both[:n], r.integers(0, 1 << 63, 2000 - n, np.uint64)])
            s = near_dedup.odd_sketches(np.stack([near_dedup.minhash(a), near_dedup.minhash(b)]))
            errors.append(near_dedup.sketch_similarity(s[0], s[1]) - n / (4000 - n))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_connected_components(spark):
    r = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(80)] + [tuple(map(int, x)) for x in r.integers(200, 300, (70, 2))]
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {x: i for i, x in enumerate(ids)}
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            root[max(find(place[a]), find(place[b]))] = min(find(place[a]), find(place[b]))
    out = components.connected_components(stored(spark.createDataFrame(edges, "a long, b long"), "test"))
    assert got(out, "id", "root") == sorted(((x, ids[find(place[x])]) for x in ids), key=repr)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_quality_rules", "op8_url_filter", "op10_near_dedup"])
def test_queries_and_their_sql(spark, name):
    import duckdb
    from lamina.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    r = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got(df, *names) == sorted(r.fetchall(), key=repr)
