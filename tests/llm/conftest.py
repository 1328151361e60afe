import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ("a", "at", "bucket", "component", "kept", "length", "other", "part", "rank", "score", "tokens", "topic", "u", "mix_u", "weight", "words")


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [f"{r.choice('bdfglmnprst')}{r.choice('aeiou')}{r.choice('bdfglmnprst')}{r.randrange(90)}" for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls in every column, texts that are empty, blank, very long, copied, nearly copied and partly shared, and repeated rows."""
    base, passage = prose(1, 120), prose(2, 70)
    near = [w if i != 60 else "changed" for i, w in enumerate(base)]
    far = [w if i % 9 else "x" for i, w in enumerate(base)]
    texts = {
        0: " ".join(prose(3, 40) + passage), 1: None, 2: "", 3: " \n\t ", 4: " ".join(base), 5: " ".join(near), 6: " ".join(base).upper(), 7: " ".join(far), 8: "one two three", 9: "one  two\nthree", 10: " ".join(passage[:55] + prose(4, 30)),
        11: "\n".join(" ".join(prose(5, 30)) for _ in range(8)), 12: " ".join(prose(6, 60_000)), 13: " ".join(prose(6, 60_000)[:40_000] + passage), 14: "ÄÖ é ß 漢字 " * 30, 15: "w" * 5000, 16: " ".join(passage + prose(7, 200) + passage),
    }
    rows = [(k, t, ("en", "de", None)[k % 3], ("src0", "src1", None)[k % 2 if k % 7 else 2], None if t is None else len(t)) for k, t in texts.items()]
    rows += [rows[4], rows[4], rows[2], (20, " ".join(base), "en", "src0", None), (None, "no id here " * 30, "en", "src0", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    from pyspark.sql import functions as F

    return edges.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
