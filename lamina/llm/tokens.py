"""Ids of a public tokenizer's file, kept by word."""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Entries of a worker's caches of words and of their parts; a full one is emptied.
CACHED_WORDS = 600_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Little-endian ids (16 bits each if the vocabulary fits, else 32) of each word between white space.

    The vocabulary drops white space before its merges, so a text's ids are those of its words, one after another. A
    word of Latin-1 letters, where NFC and lower-casing act letter by letter, is cut by the file's own pattern and each
    part goes to the merge model; any other word goes through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        parts = [p["type"] for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        if parts != ["Split", "ByteLevel"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: words can't be encoded one by one under this file's rules")
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = tuple(t["content"].encode() for t in spec["added_tokens"])
        self.letters, self.parts = _byte_letters(), {}

    def of_part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= CACHED_WORDS:
                self.parts.clear()
            found = self.library.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))
            ids = self.parts[part] = np.array([t.id for t in found], self.kind).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        if max(text) <= "\xff" and len(text) < 200 and not (b"<|" in word and any(s in word for s in self.special)):
            ids = b"".join(map(self.of_part, self.find(text.lower())))
        else:
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = ids
        return ids

    def ids(self, text: bytes, *end: int) -> np.ndarray:
        """The text's ids, then those of end."""
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) + np.array(end, self.kind).tobytes(), self.kind)

    def forget(self) -> None:
        """Empty the caches, before tasks that encode nothing and need the room."""
        self.clear()
        self.parts.clear()


_of: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per vocabulary and Python worker."""
    if path not in _of:
        _of[path] = WordIds(path)
    return _of[path]
