"""Packing, token counts and token-id files against brute force and exact round trips."""

import random
import zlib
from functools import cache

import numpy as np
import pytest
from lamina.llm import binary_ids, packing, token_counts
from lamina.llm.common import scratch_path, stored
from lamina.llm.tokens import default_vocabulary, word_ids

from .conftest import CLASHES, DATA, edge_rows


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def library_ids(text, *end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, *end], "<u4")


def test_ids_of_words_are_those_of_the_whole_text():
    texts = ["Hello, World's  don't I'LL 'sam x''s", "a<|endoftext|>b <|startoftext|> <| endoftext", "ÀÉ ß ſ İı ﬁ Å e\u0301 漢字カナ 12345 3.14 $%&", "tab\tnew\nline\x0bv\x0cf\rr", "nbsp\u00a0x\u2003y\u0085z\x1cq\x1fw", "x" * 700, "", "µ ² ½ ª 𝔸 👩‍👩‍👧", "\ufeffbom \u200bzero ²³"]
    for text in texts:
        assert word_ids(default_vocabulary()).ids(text.encode()).tolist() == library_ids(text).tolist(), text


@pytest.mark.parametrize("which", ["edges", "clashing", "table"])
def test_id_files(spark, edges, clashing, which):
    df = {"edges": edges, "clashing": clashing}.get(which) if which != "table" else spark.read.parquet(f"{DATA}/documents.parquet")
    shards = binary_ids.write_ids(df, scratch_path(spark, "ids"), default_vocabulary())
    found = [tuple(r) for r in binary_ids.read_ids(shards).collect()]
    want = {}
    for r in df.select("doc_id", "text").collect():
        want.setdefault(r[0], []).append(library_ids(r[1], 1))
    assert sorted((d, n, c) for d, _, n, c in found if d is not None) == sorted((d, len(x), zlib.crc32(x.tobytes())) for d, xs in want.items() if d is not None for x in xs)
    at = 0
    for d, start, n, _ in sorted(found, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [d for d, *_ in sorted(found, key=lambda r: r[1])]
    assert [d for d in order if d is not None] == sorted(d for d in order if d is not None) and None not in order[order.count(None) :]


def test_id_files_are_sorted_without_texts(spark, monkeypatch):
    """Texts are encoded before anything is dealt or sorted, so a file's task holds ids only; files are ranges of about DOCS documents."""
    seen, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    monkeypatch.setattr(binary_ids, "DOCS", 40)
    monkeypatch.setattr(binary_ids, "stored", lambda df, name: seen.append(df) or stored(df, name))
    shards = binary_ids.write_ids(docs, scratch_path(spark, "ids"), default_vocabulary())
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "Repartition" in line)
    assert [i < dealt for i, line in enumerate(plan) if "MapInArrow" in line] == [True, False]
    sizes = [r["n_docs"] for r in shards.orderBy("shard").collect()]
    assert len(sizes) > 1 and sum(sizes) == docs.count() and max(sizes) <= 60
    w = word_ids(default_vocabulary())
    w.ids(b"some words, cached")
    w.forget()
    assert not w and not w.parts and w.ids(b"some words").tolist() == library_ids("some words").tolist()


def test_id_files_of_nothing(spark, nothing):
    assert binary_ids.read_ids(binary_ids.write_ids(nothing, scratch_path(spark, "ids"), default_vocabulary())).count() == 0


@pytest.mark.parametrize("size", [2, 255, 256, 257, 49_408, 65_536, 65_537, 1 << 20])
def test_packed_bits(tmp_path, size):
    r = np.random.default_rng(size)
    lengths = [0, 1, 5, 4095, 4096, 4097, 9000, 3]
    docs = [r.integers(0, size, n).astype("<u4") for n in lengths]
    out = binary_ids.Writer(f"file://{tmp_path}/x.idb", size)
    for i, d in enumerate(docs):
        out.add(i if i != 3 else None, d)
    assert out.close() == (len(docs), sum(lengths))
    file = binary_ids.Reader(f"file://{tmp_path}/x.idb")
    assert file.bits == max(1, (size - 1).bit_length()) and file.docs == [0, 1, 2, None, 4, 5, 6, 7]
    assert all((a == b).all() for a, (_, b) in zip(docs, file.documents(5000), strict=True))
    every = np.concatenate(docs)
    for _ in range(40):
        a, b = sorted(int(x) for x in r.integers(0, len(every) + 1, 2))
        assert (file.ids(a, b) == every[a:b]).all()


def check_places(rows, capacity):
    """Gapless sequences within capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(best := min(fit))
        else:
            best = capacity
        rooms.append(best - n)
    return len(rooms)


def optimum(lengths, capacity):
    best = len(lengths)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        n = rest[0]
        for i in range(len(rooms)):
            if rooms[i] >= n and rooms[i] not in rooms[:i]:
                go(rest[1:], [*rooms[:i], rooms[i] - n, *rooms[i + 1 :]])
        go(rest[1:], [*rooms, capacity - n])

    go(sorted(lengths, reverse=True), [])
    return best


def places(runs):
    out = []
    for r in runs:
        out += [{"sequence_id": r.sequence + k // r.each, "offset": r.offset + k % r.each * r.length, "length": r.length} for k in range(r.n)]
    return out


def counted(lengths):
    out = {}
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return out


def test_plans_hold_every_piece_and_lose_nothing_by_reduction():
    r = random.Random(4)
    for trial in range(300):
        capacity = r.choice([7, 10, 20, 50])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        rows = places(packing.plan(counted(lengths), capacity))
        assert sorted(x["length"] for x in rows) == sorted(lengths), trial
        n = check_places(rows, capacity)
        assert n <= best_fit(lengths, capacity)
        left = counted(lengths)
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = [k for k, m in left.items() for _ in range(m)]
        assert sum(m for _, m in fixed) + (optimum(rest, capacity) if rest else 0) == (optimum(lengths, capacity) if lengths else 0), lengths


def test_large_plans_are_as_good_as_plain_best_fit():
    r = random.Random(8)
    for _ in range(6):
        lengths = [min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)] + [777] * 1000
        n = check_places(places(packing.plan(counted(lengths), 2048)), 2048)
        assert n <= best_fit(lengths, 2048) * 1.002 + 1


@pytest.mark.parametrize("ranked", [3, 20_000])
def test_packed_documents(spark, edges, clashing, nothing, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rows = packing.pack_documents(clashing).collect()
    assert "own rank" not in rows[0]
    check_places(rows, 2048)
    want = []
    for d, text, *_ in edge_rows():
        ids = library_ids(text, 0)
        want += [(d, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(nothing).count() == 0
    assert set(CLASHES) & set(clashing.columns)


def brute_count(scores, text):
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        width = len(text[i - 1].encode())
        options = [(best[i - 1][0] + width * token_counts.BYTE_SCORE, best[i - 1][1] + width)]
        options += [(best[j][0] + scores[text[j:i]], best[j][1] + 1) for j in range(i) if text[j:i] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts(spark, edges, clashing, nothing):
    scores = token_counts.load_scores(token_counts.default_pieces())
    known, want = {}, []
    for d, text, *_ in edge_rows():
        words = (text or "").encode().split()
        for w in words:
            if w not in known:
                known[w] = brute_count(scores, token_counts.MARK + w.decode())
        want.append((d, len(words), sum(known[w] for w in words)))
    for df in (edges, clashing):
        assert sorted((tuple(r) for r in token_counts.count_tokens(df).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing).count() == 0


def test_scores_are_shared_by_prefix():
    t = token_counts.Trie({"▁ab": -1.0, "c": -2.0, "▁a": -1.5, "bc": -1.0})
    assert [t.add(w) for w in ("abc", "ab", "abc", "abd")] == [2, 1, 2, 2]
    assert len(t.best) == 1 + len({"▁", "▁a", "▁ab", "▁abc", "▁abd"})


def test_stored_tables_are_read_again(spark):
    df = stored(spark.range(5), "numbers")
    assert sorted(r[0] for r in df.collect()) == [0, 1, 2, 3, 4]
