import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import models
from lamina.config import Settings
from lamina.plans import pipelines
from lamina.sources import files
from lamina.streaming import notes as streaming


def test_note_files(spark, tmp_path):
    for name, text in (("A.txt", "ita A"), ("B.txt", "ita B"), ("skip.md", "no")):
        (tmp_path / name).write_text(text)
    (tmp_path / "eng").mkdir()
    (tmp_path / "eng" / "translationA.txt").write_text("eng A")
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "A_rec.txt").write_text("rec A")
    all_notes = files.read_notes(spark, str(tmp_path))
    assert sorted(map(tuple, all_notes.collect())) == [("A", "ita A"), ("B", "ita B")]
    assert [tuple(r) for r in files.read_notes(spark, str(tmp_path), "B.txt").collect()] == [("B", "ita B")]
    with pytest.raises(ValueError):
        files.read_notes(spark, str(tmp_path), "C.txt")
    assert sorted(map(tuple, files.with_translations(spark, all_notes, str(tmp_path / "eng")).collect())) == [("A", "eng A", True), ("B", "ita B", False)]
    assert [tuple(r) for r in files.read_references(spark, str(tmp_path / "rec")).collect()] == [("A", "rec A")]
    out = all_notes.select(F.concat("stem", F.lit("_output.txt")).alias("name"), F.col("text").alias("output"))
    files.write_texts(out, f"file://{tmp_path}/out", "name")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"A_output.txt": "ita A", "B_output.txt": "ita B"}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(RuntimeError):
        files.load_table(spark, path)
    with pytest.raises(ValueError):
        files.load_or_learn(spark, path, None)
    assert files.load_or_learn(spark, path, lambda: spark.range(3)).count() == 3
    assert files.load_or_learn(spark, path, None).count() == 3  # what is saved wins
    files.write_chunk_dump(spark.createDataFrame([("d", 1, "b"), ("d", 0, "a")], "doc_id string, chunk_no int, text string"), str(tmp_path / "dump"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*"))) == "a\n\n\nb\n\n\n"


def test_pdf_blocks_by_an_own_reader(spark, tmp_path):
    (tmp_path / "g.pdf").write_bytes(b"one|two")
    (tmp_path / "x.txt").write_bytes(b"no")
    reader = lambda: lambda content: ((1, i, 0.0, 0.0, 1.0, 1.0, 10.0, 10.0, t) for i, t in enumerate(content.decode().split("|")))
    assert [(r["doc_id"], r["block_no"], r["text"]) for r in files.read_pdf_blocks(spark, str(tmp_path), reader).orderBy("block_no").collect()] == [("g", 0, "one"), ("g", 1, "two")]


def test_models(spark):
    texts = ["a b a", "", "zz " * 40 + "CHA2-x, µg", None]
    x = np.array([r["embedding"] for r in models.embed(spark.createDataFrame([(t,) for t in texts], "text string"), dim=8).collect()])
    want = np.zeros((4, 8))
    for row, text in zip(want, (["a", "b", "a"], [], ["zz"] * 40 + ["cha2-x", "µg"], []), strict=True):
        for term in text:
            row[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 8] += 1
        row /= np.sqrt((row * row).sum()) or 1
    assert np.allclose(x, want, atol=1e-6)
    given = models.embed(spark.createDataFrame([("abc",)], "text string"), lambda: lambda texts: np.array([[len(t)] for t in texts]))
    assert given.first()["embedding"] == [3.0]
    pairs = spark.createDataFrame([("a", "a b"), ("q", "")], "query string, text string")
    scored = models.cross_encode(pairs, lambda: lambda q, t: [float(a in b) for a, b in zip(q, t, strict=True)])
    assert [r["pair_score"] for r in scored.collect()] == [1.0, 0.0]
    n = spark.createDataFrame([(0, "cough today")], "note_id long, text string")
    tagged = models.tag_entities(n, lambda: lambda t: [{"entity_group": "SIGN_SYMPTOM", "word": t[:5], "start": 0, "end": 5}])
    assert [tuple(r) for r in tagged.collect()] == [(0, "SIGN_SYMPTOM", "cough", 0, 5)]
    p = spark.createDataFrame([("hi",)], "prompt string")
    assert models.generate(p).first()["output"] == "hi"
    assert models.generate(p, models.make_generator("local", load=lambda: lambda t: t + " there")).first()["output"] == "there"
    assert models.translate(n, lambda: str.upper).first()["text"] == "COUGH TODAY" and models.translate(n) is n
    for backend, options in (("local", {}), ("remote", {"url": "u", "model": "m"}), ("other", {})):
        with pytest.raises(ValueError):
            models.make_generator(backend, **options)


def test_both_programs(spark):
    words = ["asthma", "fever", "cough", "pain", "scan", "drug", "dose", "rest"]
    page = lambda k: ". ".join(f"Patients with {words[(i + k) % 8]} and {words[(i * 3 + k) % 8]} take rest {i}" for i in range(30)) + "."
    pages = spark.createDataFrame([(f"g{k % 3}", k // 3 + 1, page(k)) for k in range(9)], "doc_id string, page int, text string")
    built = pipelines.build_index(pages, Settings(max_chars=300))
    index = built.chunks.cache()
    n = index.count()
    assert sorted(r["chunk_id"] for r in index.select("chunk_id").collect()) == list(range(n)) and n > 9
    notes = spark.createDataFrame([(0, "MALE, 71 AA\nPathological proximate: asthma. Remote pathology: no fever. Objective examination: ok. Clinical diary: scan done. Diagnosis: COUGH\nPrognosis: admission")], "note_id long, text string")
    gazetteer = spark.createDataFrame([("asthma", "DISEASE_DISORDER"), ("fever", "DISEASE_DISORDER"), ("scan", "DIAGNOSTIC_PROCEDURE")], "term string, etype string")
    out = pipelines.answer(notes, index, built.vocabulary, gazetteer).collect()
    assert len(out) == 1 and out[0]["template"] == "admission" and "[E1] (g" in out[0]["output"] and out[0]["output"] == out[0]["prompt"]


NOTE = "{0}\nMedical history:\n- Pathological proximate: {1}. \n- Remote pathology: no fever.\n\nObjective examination:\nok.\n\nClinical diary:\n- Scan done.\n- Rest.\n\nDiagnosis: {2}\nPrognosis: {3}\n"
CASES = {
    "A": ("MALE, 71 AA", "asthma", "COUGH.", "admission to the ward"), "B": ("FEMALE, 2 AA", "pain", "FEVER", "home"), "C": ("WOMAN, 27 years old", "cough", "", "30 days"), "D": ("Other, 8 months", "asthma and pain", "RASH", "URGENT HOSPITALISATION"),
}


def test_programs_over_files(spark, tmp_path):
    """PDF files to an index, note files to output and query files, with every setting in use and the shared folder empty at the end."""
    from lamina.plans import programs
    from lamina.session import scope, shared_dir

    words = ["asthma", "fever", "cough", "pain", "scan", "drug", "dose", "rest"]
    (tmp_path / "pdf").mkdir()
    for k in range(4):
        page = lambda n, k=k: "|".join(". ".join(f"Patients with {words[(i + k + n) % 8]} and {words[(i * 3 + k) % 8]} have plan {i} of guide {k} page {n}" for i in range(j, j + 6)) + "." for j in range(0, 30, 6))
        (tmp_path / "pdf" / f"g{k}.pdf").write_text("\f".join(page(n) for n in range(3)))
    (tmp_path / "pdf" / "bad.pdf").write_text("short\fshort\f" + page(7))

    def reader():
        return lambda content: ((n, i, 100.0, 100.0, 300.0, 120.0, 600.0, 800.0, t) for n, p in enumerate(content.decode().split("\f"), 1) for i, t in enumerate(p.split("|")))

    ita, eng, ref = tmp_path / "ita", tmp_path / "eng", tmp_path / "ref"
    for folder in (ita, eng, ref):
        folder.mkdir()
    for stem, case in CASES.items():
        (ita / f"{stem}.txt").write_text("it:" + NOTE.format(*case))
    (eng / "translationA.txt").write_text(NOTE.format(*CASES["A"]))
    (ref / "A_rec.txt").write_text("said by the physician")
    gazetteer = spark.createDataFrame([("asthma", "DISEASE_DISORDER"), ("fever", "DISEASE_DISORDER"), ("pain", "MEDICATION"), ("scan", "DIAGNOSTIC_PROCEDURE")], "term string, etype string")
    at, out = f"{tmp_path}/index", f"file://{tmp_path}/out"
    with scope(spark):
        index = programs.build_index(spark, str(tmp_path / "pdf"), at, Settings(max_chars=300, embedding_dim=32), reader)
        n = index.count()
        assert n > 20 and len(index.first()["embedding"]) == 32 and len("".join(p.read_text() for p in (tmp_path / "index/chunks").glob("part-*")).split("\n\n\n")) == n + 1
        assert [r["doc_id"] for r in spark.read.parquet(f"{at}/warnings").collect()] == ["bad"]
        with pytest.raises(ValueError):
            (tmp_path / "none").mkdir()
            programs.answer_notes(spark, str(tmp_path / "none"), at, out, gazetteer)
        settings = Settings(embedding_dim=32, final_n=5, retrieval_k=8, retrieval_only=False, backend="local")
        said = programs.answer_notes(spark, str(ita), at, out, gazetteer, settings, translations=f"file://{eng}", references=str(ref), translator=lambda: lambda t: t.removeprefix("it:"), back=lambda: lambda t: t + " (it)", load=lambda: lambda p: p + f"letter of {p.count('[E')}")
        assert {r["stem"] for r in said.collect()} == set(CASES)
    texts = {p.name: p.read_text() for p in (tmp_path / "out/output").iterdir()}
    assert texts == {"A_output.txt": "letter of 5 (it)\n\n" + "=" * 60 + "\nORIGINAL RECOMMENDATIONS (for comparison)\n" + "=" * 60 + "\nsaid by the physician"} | {f"{s}_output.txt": "letter of 5 (it)" for s in "BCD"}
    assert sorted(p.name for p in eng.iterdir() if p.suffix == ".txt" and p.name[0] != ".") == [f"translation{s}.txt" for s in "ABCD"] and (eng / "translationC.txt").read_text() == NOTE.format(*CASES["C"])
    asked = {p.name[0]: p.read_text() for p in (tmp_path / "out/queries").iterdir()}
    assert asked["A"].endswith("COUGH. recommendations discharge management elderly male\n\n") and "asthma. COUGH.. diagnosis" in asked["A"] and "Scan done. COUGH.. findings" in asked["A"]
    assert asked["B"].endswith("FEVER recommendations discharge management pediatric female\n\n") and asked["D"].endswith("RASH recommendations discharge management neonatal \n\n")
    assert asked["C"].count("--- Query") == 2 and "asthma" not in asked["C"]
    with scope(spark):  # retrieval only: the prompt is the output, and the reference text stays away
        one = programs.answer_notes(spark, str(ita), at, out, gazetteer, Settings(embedding_dim=32), name="A.txt", translations=f"file://{eng}", references=str(ref)).collect()
    assert len(one) == 1 and one[0]["output"].startswith("ROLE:") and "ORIGINAL" not in one[0]["output"]
    excerpts = [set(e.split("\n\n", 1)[1].lower().split()) for e in one[0]["output"].split("[E")[1:]]
    assert 1 <= len(excerpts) <= 10 and all(len(a & b) / min(len(a), len(b)) < 0.8 for i, a in enumerate(excerpts) for b in excerpts[:i])
    damaged = spark.read.parquet(f"{at}/index").filter("chunk_id <> 1")
    damaged.write.parquet(f"{tmp_path}/damaged/index")
    with pytest.raises(ValueError):
        programs.load_index(spark, f"{tmp_path}/damaged")
    assert shared_dir(spark)


def test_tables_live_as_long_as_their_scope(spark):
    import os

    from lamina.session import scope, shared_dir, stored

    folder = shared_dir(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    outer = stored(spark.range(3), "outer")
    with scope(spark):
        inner = stored(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3 and len(set(os.listdir(folder)) - before) == 1


def test_remote_generator_against_a_stub():
    import json
    import threading
    import urllib.error
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["Authorization"], body))
            said = {"ask": {"choices": [{"message": {"content": "answer"}}]}, "err": {"error": "no credit"}}.get(body["messages"][0]["content"])
            self.send_response(200 if said else 500)
            self.end_headers()
            self.wfile.write(json.dumps(said or {}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = models.make_generator("remote", url=f"http://127.0.0.1:{server.server_port}", key="k", model="m", temperature=0.1, max_tokens=7, reasoning=True)()
    assert model("ask") == "answer"
    assert got[0] == ("Bearer k", {"model": "m", "messages": [{"role": "user", "content": "ask"}], "temperature": 0.1, "max_tokens": 7, "reasoning": {"enabled": True}})
    with pytest.raises(RuntimeError):
        model("err")
    with pytest.raises(urllib.error.HTTPError):
        model("fail")
    server.shutdown()


def test_gated_packages_by_stand_ins(monkeypatch):
    import sys
    import types
    from contextlib import contextmanager

    fake = lambda name, **kw: monkeypatch.setitem(sys.modules, name, types.SimpleNamespace(**kw))
    fake("llama_cpp", Llama=lambda **kw: types.SimpleNamespace(create_completion=lambda p, **more: {"choices": [{"text": f"{kw['model_path']} {p} {more['max_tokens']}"}]}))
    assert models.local_model("llama_cpp", "f.gguf", 9)()("hi") == "f.gguf hi 9"
    fake("transformers", pipeline=lambda kind, model: lambda p, **kw: [{"generated_text": f"{p} by {model}"}])
    assert models.make_generator("local", load=models.local_model("transformers", "m"))()("hi") == "by m"
    fake("deepl", DeepLClient=lambda key: types.SimpleNamespace(translate_text=lambda text, **kw: types.SimpleNamespace(text=f"{key} {text} {sorted(kw.items())}")))
    assert models.make_translator("k", "IT", "EN-GB", glossary="g", formality="more")()("t") == "k t [('formality', 'more'), ('glossary', 'g'), ('source_lang', 'IT'), ('target_lang', 'EN-GB')]"
    for bad in (lambda: models.local_model("other", "m"), lambda: models.make_translator("", "IT", "EN")):
        with pytest.raises(ValueError):
            bad()

    page = types.SimpleNamespace(get_text=lambda kind: [(1.0, 2.0, 3.0, 4.0, f"{kind} text", 0, 0)], rect=types.SimpleNamespace(width=600.0, height=800.0))

    @contextmanager
    def opened(stream, filetype):
        assert (stream, filetype) == (b"pdf", "pdf")
        yield [page, page]

    fake("fitz", open=opened)
    assert list(files._pymupdf()(b"pdf")) == [(n, 0, 1.0, 2.0, 3.0, 4.0, 600.0, 800.0, "blocks text") for n in (1, 2)]


def test_stream_of_notes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.txt").write_text("MALE, 71 AA\nDiagnosis: X\nPrognosis: y")
    stream = streaming.stream_fields(streaming.stream_notes(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("fields").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r["age"], r["diagnosis"]) for r in spark.sql("select * from fields").collect()] == [(71, "X")]
