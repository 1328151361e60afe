"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The pieces are those of a public vocabulary file; the piece of rank r has the log-probability -ln(r + 2) less that of the
whole (Zipf's law), the file having ranks only. A pre-token is a word between white space behind the mark of a word's
start. Its segmentation is the one of the highest sum, ties going to the fewest pieces; a character that no piece covers
is its UTF-8 bytes, one token each, at BYTE_SCORE.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_LIMIT, per_batch, raw, table, tune

MARK, BYTE_SCORE = "▁", -25.0


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str) -> dict[str, float]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # single characters stand last in such files, but text can't do without them: they are ranked by place all the same
    total = math.log(sum(1 / (r + 2) for r in range(len(kept))))
    return {piece: -math.log(r + 2) - total for r, piece in enumerate(kept)}


class Trie:
    """Forward scores per prefix. Each new word walks down its known prefix and computes only the nodes below it."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        # children, best score and its number of tokens, by node; node 0 is the empty prefix
        self.children: list[dict[str, int]] = [{}]
        self.best, self.n, self.terminal = [0.0], [0], {}

    def add(self, word: str) -> int:
        """The number of tokens of MARK + word, kept at its terminal."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if len(self.best) >= 4 * CACHE_LIMIT or len(self.terminal) >= CACHE_LIMIT:
            self.clear()
        text, node, path, scores = MARK + word, 0, [0], self.scores
        for i, c in enumerate(text):
            below = self.children[node].get(c)
            if below is None:
                width = len(c.encode())
                score, n = self.best[node] + width * BYTE_SCORE, self.n[node] + width
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    if (s := scores.get(text[j : i + 1])) is not None:
                        total, m = self.best[path[j]] + s, self.n[path[j]] + 1
                        if total > score or total == score and m < n:
                            score, n = total, m
                below = self.children[node][c] = len(self.best)
                self.children.append({})
                self.best.append(score)
                self.n.append(n)
            node = below
            path.append(node)
        self.terminal[word] = self.n[node]
        return self.n[node]


class Counts(dict):
    """Numbers of tokens by word. Words of more than LONG characters are counted in a trie of their own, which is dropped."""

    LONG = 400

    def __init__(self, path: str):
        self.trie = Trie(load_scores(path))

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if len(text) > self.LONG:
            return Trie(self.trie.scores).add(text)
        if len(self) >= CACHE_LIMIT:
            self.clear()
        n = self[word] = self.trie.add(text)
        return n


_of: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) per row, without a shuffle: each worker shares prefixes over all batches it gets.

    Null and empty texts have 0 of both; repeated rows give a row each; a null doc_id stays null.
    """
    path = pieces or default_pieces()

    def count(batch: pa.RecordBatch) -> dict:
        if path not in _of:
            _of[path] = Counts(path)
        n_words, n_tokens = [], []
        for text in raw(batch.column(1)):
            words = text.split()
            n_words.append(len(words))
            n_tokens.append(int(np.fromiter(map(_of[path].__getitem__, words), np.int64, len(words)).sum()))
        return {"doc_id": batch.column(0), "n_words": n_words, "n_tokens": n_tokens}

    tune(docs.sparkSession)
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
