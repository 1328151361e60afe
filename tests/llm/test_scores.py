"""Quality rules, toxicity, neighbours, mixing and URL rules against brute force and held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from lamina.llm import mixing, neighbours, quality, toxicity, url_filter
from lamina.llm.common import stored
from lamina.llm.tokens import default_vocabulary, word_ids
from pyspark.sql import functions as F

from .conftest import DATA, edge_rows
from .test_tokens import library_ids

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_metrics(text):
    text = text or ""
    w = WORDS(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def brute_quality(rows):
    measured = [(r[0], r[2], r[3], *brute_metrics(r[1])) for r in rows]

    def cells(m):
        n, chars, symbols, lines, dup, repeat = m[3:]
        shares = {"symbols": symbols * 10**6 // max(chars, 1), "dup_lines": dup * 10**6 // max(lines, 1), "repeats": repeat * 10**6 // max(n, 1)}
        return shares | {"chars_per_word": chars * 100 // max(n, 1), "n_words": n, "word_chars": chars, "n_lines": lines}

    def fence(group, metric):
        def at(name, q):
            v = sorted(x >> (k := max(x.bit_length() - quality.PRECISION, 0)) << k for x in (cells(m)[name] for m in group))
            return v[math.ceil(len(v) * q / 100) - 1]

        low, mid, high = (at(metric, q) for q in (25, 50, 75))
        spread = max(high - mid, mid - low)
        if metric == "chars_per_word":
            return high + 6 * spread if spread else None
        size, unit = {"symbols": ("word_chars", 1), "dup_lines": ("n_lines", 1), "repeats": ("n_words", 16)}[metric]
        return high + max(6 * spread, 3 * unit * 10**6 // at(size, 50))

    out = []
    for m in measured:
        base = m[3] < 20 or 100 * m[8] > 30 * m[3]
        groups = ([x for x in measured if x[1:3] == m[1:3] and x[3]], [x for x in measured if x[1] == m[1] and x[3]])
        large = [g for g in groups if len(g) >= quality.LEAST]
        kept = not base
        for k in quality.METRICS if kept else ():
            found = [f for g in large if (f := fence(g, k)) is not None] or [fence([x for x in measured if x[3]], k)]
            kept = kept and (found[0] is None or cells(m)[k] <= found[0])
        out.append((m[0], m[3], m[4], m[5], m[7], m[8], base, kept))
    return out


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@pytest.mark.parametrize("which", ["edges", "clashing", "table"])
def test_quality(spark, edges, clashing, which):
    df = {"edges": edges, "clashing": clashing}.get(which) if which != "table" else spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r)[:5] for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = sorted((tuple(r[n] for n in NAMES) for r in quality.quality_rules(df).collect()), key=repr)
    assert found == sorted(brute_quality(rows), key=repr)


def test_fences_follow_the_groups(spark):
    """A rate that is usual in one source fails in another; no group's fence is a constant."""
    r = np.random.default_rng(1)
    said = lambda n, marks: " ".join([f"w{x}" for x in r.integers(0, 10**6, n)] + ["%"] * marks)
    rows = [(i, said(100 + i % 40, 0), "en", "plain") for i in range(80)] + [(100 + i, said(100 + i % 40, 8 + i % 5), "en", "prices") for i in range(80)]
    rows += [(300, said(120, 10), "en", "plain"), (301, said(120, 10), "en", "prices"), (302, said(60, 120), "en", "prices"), (303, said(120, 1), "en", "plain")]
    out = {x["doc_id"]: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [out[k]["kept"] for k in (300, 301, 302, 303)] == [False, True, False, True]
    assert all(out[i]["kept"] for i in [*range(80), *range(100, 180)])
    assert out[0]["max_symbols"] != out[100]["max_symbols"]


def test_fences_of_tables_differ(spark):
    from pyspark.sql import functions as F

    out = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    different = out.select(*[F.countDistinct(f"max_{m}").alias(m) for m in quality.METRICS]).first().asDict()
    assert all(n > 1 for n in different.values()), different


def test_quality_of_nothing_and_merged_sketches(spark, nothing):
    assert quality.quality_rules(nothing).count() == 0
    from pyspark.sql import functions as F

    m = quality.measure(spark.read.parquet(f"{DATA}/documents.parquet"))
    parts = [quality.sketch(m.filter(F.col("doc_id") % 3 == k), ["lang"]) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "metric", "cell").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.sketch(m, ["lang"]).collect()))


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    hit = sum(r["predicted"] and known[r["doc_id"]] for r in held)
    assert hit >= 0.8 * sum(known[r["doc_id"]] for r in held) and hit >= 0.8 * sum(r["predicted"] for r in held)


def test_toxicity_of_odd_tables(spark, edges, clashing, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (edges, clashing):
        for given in (labels, none, labels.selectExpr("doc_id", "1 as toxic")):
            model = toxicity.fit(docs, given)
            out = toxicity.scored(docs, model).collect()
            assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
            assert toxicity.filtered(docs, model).columns == docs.columns
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels)).count() == 0


def brute_features(text, seed, learned, starts):
    """The features by their definitions, word by word."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    bare = [w.strip(b".,!?;:\"'()[]{}<>*_-").decode().lower() for w in words]
    swap = dict(zip("01345$@!7", "oieassait", strict=True))
    turned = ["".join(swap.get(c, c) for c in p) for p in bare]
    is_seed = [p.encode() in seed for p in bare]
    is_learned = [p in learned for p in bare]
    begins = [any(p[:k] in starts for k in (4, 5, 6) if len(p) > k) for p in bare]
    you = [p.encode() in toxicity.SECOND for p in bare]
    caps = [len(p.encode()) > 1 and w.isupper() for p, w in zip(bare, words, strict=True)]
    swapped = [t != p and p.isascii() and any("a" <= c <= "z" for c in p) and (t.encode() in seed or t in learned) for p, t in zip(bare, turned, strict=True)]
    stretched = [any(e[i] == e[i + 1] == e[i + 2] for i in range(len(e) - 2)) for e in (p.encode() for p in bare)]
    marked = ["*" in p or "." in p for p in bare]
    bad = [a or b or c or d for a, b, c, d in zip(is_seed, is_learned, begins, swapped, strict=True)]
    near = sum(bad[i] and any(you[j] for j in range(max(0, i - 5), min(n, i + 6))) for i in range(n))
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    marks = sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text)
    strong = sum(a or b or c for a, b, c in zip(is_seed, is_learned, swapped, strict=True))
    share = lambda x: sum(x) / n
    return [share(is_seed), share(is_learned), share(begins), share(bad), math.log1p(sum(bad)), math.log1p(strong), near / n, share(you), share(caps), share(swapped), share(stretched), share(marked), upper / max(1, upper + lower), text.count("!") / n, marks / max(1, len(text.encode())), math.log1p(n)]


def brute_score(model, x):
    """Trees walked one by one, then the calibration's line between two knots."""
    f = model.trees.base
    for tree, values in model.trees.trees:
        node = 0
        for level in range(toxicity.DEPTH):
            feature, cut = tree[2**level - 1 + node]
            node = 2 * node + (sum(e < x[feature] for e in model.trees.edges[feature]) > cut)
        f += values[node]
    at, value = model.knots
    if f <= at[0]:
        c = value[0]
    elif f >= at[-1]:
        c = value[-1]
    else:
        i = max(k for k in range(len(at)) if at[k] <= f)
        c = value[i] if at[i] == f else value[i] + (value[i + 1] - value[i]) * (f - at[i]) / (at[i + 1] - at[i])
    return min(1, max(0, c * 0.999 + 0.0005 / (1 + math.exp(-f))))


def test_features_and_scores_by_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in docs.filter("doc_id % 5 = 0").collect()] + ["", "YOU 1diot!!! st*pid you", "noooo w.o.r.d YOUR scum, $tupid", "ÄÖ you-are idiot"]
    x = toxicity.features([t.encode() for t in texts], model.lexicon)
    want = [brute_features(t, toxicity.SEED, model.lexicon.words, model.lexicon.starts) for t in texts]
    assert np.allclose(x, want, atol=1e-12)
    some = list(range(0, len(texts), 4)) + list(range(len(texts) - 4, len(texts)))
    assert np.allclose(model.score([texts[i].encode() for i in some]), [brute_score(model, want[i]) for i in some], atol=1e-9)
    assert len(model.trees.trees) == toxicity.TREES


def test_training_rows_are_bounded(spark):
    """Ids count once, however often they repeat and with however many texts; bytes are bounded together."""
    rows = [(k % 30, f"text {k % 7} of id {k % 30} " + "w " * 40) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] * 3, "doc_id long, toxic int")
    one = toxicity.training_rows(docs, labels, most=4)[0]
    assert 1 <= len(one) <= 4 and len({t.split()[4] for t in one}) == len(one)
    size = len(rows[0][1]) + 2
    assert 1 <= len(toxicity.training_rows(docs, labels, total=3 * size)[0]) <= 3


def test_trees_and_isotonic_fit():
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    t = toxicity.Trees().fit(x[:2000], y[:2000])
    assert ((t.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    at, value = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1, 1]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all() and abs(np.interp(1.5, at, value) - 0.5) < 0.01


def brute_nearest(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in rows}, key=lambda s: (sum(len(v) == s for _, v in rows), -s)) if rows else 0
    rows = [(i, neighbours.unit(v[None])[0]) for i, v in rows if len(v) == size]
    out = {}
    for q, x in rows:
        if q % every == 0:
            out[q] = sorted((-round(float(v @ x), 12), i) for i, v in rows if i != q)[:k]
    return out


def test_neighbours_with_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.standard_normal(8)]) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(30)] + [(300, None), (350, [0.0] * 8), (400, [1.0, None] * 4), (450, [float("nan")] * 8), (500, [float("inf")] * 8), (550, [1.0, 2.0]), (None, rows[3][1]), (600, [2.0**900 * x for x in rows[4][1]]), (650, []), (700, [2.0**-900 * x for x in rows[5][1]])]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "vec_id long, embedding array<double>, part int")
    found = {}
    for x in neighbours.nearest(df, every=50).collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = brute_nearest(rows, 50, 5)
    assert found.keys() == want.keys()
    for q, own in found.items():
        assert [x[0] for x in sorted(own)] == [1, 2, 3, 4, 5]
        assert [x[1] for x in sorted(own)] == [i for _, i in want[q]]
        assert np.allclose([x[2] for x in sorted(own)], [-s for s, _ in want[q]], atol=1e-9)


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(few, every=50).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(few.limit(1), every=50).count() == 0 and neighbours.nearest(few.limit(0), every=50).count() == 0


def test_equal_scores_go_by_ids(spark):
    """Rescaled vectors have equal cosines to the last bit, equal ones are one candidate; both come in the order of their ids, in whatever batches."""
    r = np.random.default_rng(9)
    q, b, c = (r.standard_normal(16) for _ in range(3))
    rows = [(0, q)] + [(j, b * 2.0 ** (j % 60 - 30)) for j in range(1, 700)] + [(700 + j, b) for j in range(1, 40)] + [(5000 + j, c) for j in range(40)]
    near = b if b @ q / np.sqrt(b @ b) > c @ q / np.sqrt(c @ c) else c
    rows += [(50, near * 4)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows if i != 50] + [(50, (near * 4).tolist())], "vec_id long, embedding array<double>")
    found = {}
    for x in neighbours.nearest(df, every=50).collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    same = sorted(i for i, v in rows if abs(abs(v @ near) - np.sqrt((v @ v) * (near @ near))) < 1e-6 * np.sqrt((v @ v) * (near @ near)))
    assert [i for _, i in sorted(found[0])] == same[:5]
    assert [i for _, i in sorted(found[50])] == [i for i in same if i != 50][:5]


def made(kind, n):
    r = np.random.default_rng(4)
    if kind == "clusters":
        return r.standard_normal((40, 16))[r.integers(0, 40, n)] + 0.4 * r.standard_normal((n, 16))
    return r.standard_normal((n, 16))


@pytest.mark.parametrize("kind", ["clusters", "none"])
@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_with_fewer_probes_than_parts(spark, monkeypatch, kind, n):
    x = made(kind, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    chosen, fit = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: chosen.append(fit(*a)) or chosen[-1])
    found = {}
    for row in neighbours.nearest(df, every=50).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    _, parts, probes = chosen[0]
    assert 1 <= probes < parts and (kind == "none" or probes <= parts / 4)
    want = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 50, 5)
    assert np.mean([len(found[q] & {i for _, i in own}) / 5 for q, own in want.items()]) >= 0.9


def test_parts_are_balanced_and_grow():
    u = neighbours.unit(made("clusters", 4096))
    part = neighbours.balanced_parts(neighbours.neighbour_graph(u[:2048], 10), 16, np.random.default_rng(0))
    assert set(np.bincount(part)) == {128}
    sizes = [neighbours.fit(u[:n], u[n : 2 * n], 5)[1] for n in (100, 500, 2048)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[2] > sizes[1] > 1


def brute_rake(cells, targets, rounds=3000):
    w = {c: 1.0 for c in cells}
    for _ in range(rounds):
        for axis, goal in enumerate(targets):
            have = {}
            for c, n in cells.items():
                have[c[axis]] = have.get(c[axis], 0) + w[c] * n
            all_of = sum(have.values())
            for c in w:
                w[c] *= goal[c[axis]] * all_of / have[c[axis]]
    return w


def test_raking_meets_targets():
    r = np.random.default_rng(5)
    cells = pd.DataFrame([(f"s{i}", f"l{j}", k, float(r.integers(1, 1000))) for i in range(4) for j in range(3) for k in range(3)], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": pd.Series([0.4, 0.3, 0.2, 0.1], [f"s{i}" for i in range(4)]), "lang": pd.Series([0.5, 0.25, 0.25], [f"l{j}" for j in range(3)]), "topic": pd.Series([0.6, 0.2, 0.2], range(3))}
    w = mixing.rake(cells, targets)
    for a, goal in targets.items():
        share = (cells["tokens"] * w).groupby(cells[a]).sum() / (cells["tokens"] * w).sum()
        assert np.allclose(share[goal.index], goal, atol=1e-6)
    brute = brute_rake({(c.source, c.lang, c.topic): c.tokens for c in cells.itertuples()}, [dict(t) for t in targets.values()], 200)
    ratio = w / np.array(list(brute.values()))
    assert np.allclose(ratio / ratio[0], 1, atol=1e-5)


def test_mixing_of_a_whole_table(spark):
    """Topics by plain arithmetic, tokens by the library, weights by a brute-force rake."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    topics = mixing.fit_topics(docs)
    rows = {r["doc_id"]: r for r in mixing.mixed(docs, topics=topics).collect()}
    known = {r["doc_id"]: r for r in docs.collect()}
    assert rows.keys() == known.keys()
    cells, of = {}, {}
    for d, r in known.items():
        v, ids = np.zeros(mixing.WIDTH), library_ids(r["text"]).tolist()
        for i in ids:
            v[i % mixing.WIDTH] += 1
        v = np.log1p(v) / np.sqrt((np.log1p(v) ** 2).sum())
        near = topics.centroids @ (v - topics.means.get(r["lang"], topics.mean))
        assert near[rows[d]["topic"]] >= near.max() - 1e-9
        assert rows[d]["tokens"] == len(ids)
        of[d] = c = (r["source"], r["lang"], rows[d]["topic"])
        cells[c] = cells.get(c, 0) + rows[d]["tokens"]
    goals = []
    for axis in range(3):
        share = {}
        for c, n in cells.items():
            share[c[axis]] = share.get(c[axis], 0) + n
        goals.append({k: n**mixing.TEMPER / sum(m**mixing.TEMPER for m in share.values()) for k, n in share.items()})
    w = brute_rake(cells, goals, 200)
    most = max(w.values())
    assert all(abs(rows[d]["probability"] - w[c] / most) < 1e-6 for d, c in of.items())
    share = sum(w[c] / most * n for c, n in cells.items()) / sum(cells.values())
    assert all(abs(r["expected_share"] - share) < 1e-6 for r in rows.values()) and len(set(r["topic"] for r in rows.values())) == mixing.TOPICS
    kept = {d for d, r in rows.items() if r["kept"]}
    assert abs(len(kept) - sum(r["probability"] for r in rows.values())) < 5 * math.sqrt(len(rows))
    assert {r["doc_id"] for r in mixing.sampled(docs).collect()} == kept


def test_learned_topics_are_found_again():
    """Texts of two subjects in two languages: the subject is told, not the language."""
    r = np.random.default_rng(7)
    ids = {k: r.integers(0, 40_000, 40) for k in [(s, g) for s in "ab" for g in ("en", "de")] + ["en", "de"]}
    made = [(s, g, np.concatenate([ids[s, g][r.integers(0, 40, 60)], ids[g][r.integers(0, 40, 80)]])) for s in "ab" for g in ("en", "de") for _ in range(50)]
    topics = mixing.learn(np.stack([mixing.vector(w) for *_, w in made]), [g for _, g, _ in made], 4)
    told = {(s, topics.of(w, g)) for s, g, w in made}
    assert len({t for _, t in told}) == len(told) <= 4


def test_topics_are_learned_from_all_texts(spark):
    """What the passes over files learn is what plain arithmetic learns from every different text, beyond any sample's size."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in (r.integers(0, 60, 12) + 60 * (i % 5)).tolist()), ("en", "de", None)[i % 3]) for i in range(4_600)]
    rows += [(5_000 + i, rows[0][1], "de") for i in range(200)] + [(6_000, " \t", "en"), (6_001, None, None), (6_002, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).repartition(7)
    seen = {}
    for h, text, lang in docs.select(F.xxhash64("text"), "text", F.coalesce("lang", F.lit(""))).collect():
        if (text or "").strip():
            seen[h] = min(seen.get(h, (lang, text)), (lang, text))
    ids = word_ids(default_vocabulary())
    x = np.stack([np.round(mixing.vector(ids.ids(seen[h][1].encode())) * mixing.GRID) / mixing.GRID for h in sorted(seen)])
    want, got = mixing.learn(x, [seen[h][0] for h in sorted(seen)]), mixing.fit_topics(docs)
    assert len(x) > 4_500 and want.means.keys() == got.means.keys()
    assert all(np.allclose(want.means[v], got.means[v], atol=1e-12) for v in want.means)
    assert np.allclose(want.mean, got.mean, atol=1e-12) and np.allclose(want.centroids, got.centroids, atol=1e-9)
    again = mixing.fit_topics(docs.repartition(3))
    assert np.array_equal(again.centroids, got.centroids)


def test_mixing_of_odd_tables(spark, edges, clashing, nothing):
    assert mixing.sampled(clashing).columns == clashing.columns and mixing.mixed(edges).count() == len(edge_rows())
    assert all(r["kept"] and r["topic"] == -1 for r in mixing.mixed(edges).collect() if not r["tokens"])
    assert mixing.mixed(nothing).count() == 0 and mixing.sampled(nothing).count() == 0


@pytest.mark.parametrize("targets", [None, {"lang": {"de": 0.5, "en": 0.2, "fr": 0.2, "es": 0.1}, "topic": {k: 1.0 for k in range(8)}}])
def test_mixing_of_many_cells_is_the_same(spark, targets):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = stored(mixing.profiled(docs, mixing.fit_topics(docs)), "rows")
    few = mixing.weighted(rows, targets=targets, tolerance=1e-3, rounds=3).toPandas().sort_values(list(mixing.AXES))
    many = mixing.weighted(rows, targets=targets, driver_cells=0, tolerance=1e-3, rounds=3).toPandas().sort_values(list(mixing.AXES))
    assert np.allclose(few["probability"], many["probability"], rtol=1e-9)


def test_given_targets_and_bounded_weights(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    targets = {"lang": {"de": 0.5, "en": 0.2, "fr": 0.2, "es": 0.1}}
    rows = mixing.mixed(docs, targets=targets).collect()
    t = pd.DataFrame([(r["lang"], r["tokens"] * r["probability"]) for r in rows], columns=["v", "e"]).groupby("v")["e"].sum()
    assert abs(t["de"] / t.sum() - 0.5) < 1e-6
    bounded = mixing.mixed(docs, targets=targets, bound=1.5).collect()
    assert bounded[0]["expected_share"] > rows[0]["expected_share"] and max(r["probability"] for r in bounded) == 1


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.com", "http://example.com/", "HTTP://EXAMPLE.com/en/x", "http://example.com/EN/", "https://www.example.com/en/a?b#c", "http://a.www.example.com/en/", "http://badexample.com/en/", "http://example.com?x=/en/", "http://example.com#/en/",
    "http://x.net/es/", "http://net/fr/1", "http://x.net/fr", "ftp://y.com:80/", "http://com/", "http://.com/", "http://com./", "http://a..com//", "http://u@h.com/x://y", "x://example.com/en//z", "http://ÄÖ.com/é", "http://" + "a." * 200 + "com/" + "p/" * 300,
]


def brute_url(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(-len(r), -len(r.split("/")[0]), r, v) for v, r in rules if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = min(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("rules", [url_filter.RULES, [("block", "a.b/x"), ("allow", "b/x"), ("block", "b/x/y"), ("allow", "com"), ("block", "h.com/x:/"), ("block", "example.com/e")], []])
@pytest.mark.parametrize("most", [0, 200_000])
def test_urls(spark, monkeypatch, rules, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    urls = URLS + ["http://a.b/xyz", "http://c.a.b/x/y/z", "http://b/x/y", "http://b/xx"] + URLS[6:9]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] + [(None, URLS[9], "own")], "page_id long, url string, rule string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert found == {i: brute_url(u, rules, url_filter.DEFAULT) for i, u in [*enumerate(urls), (None, URLS[9])]}
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0
