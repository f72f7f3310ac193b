"""Token ids of whole texts by the ``tokenizers`` library, word by word.

The vocabulary drops white space, and none of its pre-tokens, compositions or special strings spans a
blank or a line feed, so the ids of a text are those of its words in turn. Each distinct word is
encoded once and kept in a bounded table; a text is then one join of byte strings. Words of ASCII and
Latin letters, digits and marks are lower-cased and cut into pre-tokens here, and each distinct pre-token
goes to the library's BPE model; all other words go through the whole library.

This holds for files whose steps are those of ``STEPS`` and whose special strings hold no blank; with any other
file whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import keep

KEPT_WORDS = 350_000
# The normaliser, the pre-tokeniser and the model's switches of a file that is read word by word.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall

# The letter that stands for each byte: itself where it is printable in Latin-1, else the next from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


def by_word(path: str) -> bool:
    """Whether a tokenizer file's steps are those that this module takes over."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    plain = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return plain and spec["normalizer"] == STEPS["normalizer"] and spec["pre_tokenizer"] == STEPS["pre_tokenizer"] and model == STEPS["model"]


class Words(dict):
    """Ids by word; a word that is asked for first is encoded then."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # 16-bit integers if all ids fit
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.coded(word)
        self[word] = ids
        return ids

    def coded(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable() or PLAIN(word)) or "<|" in word:
            return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low, parts = word.lower(), self.parts
        if low.isalpha():
            return parts.get(low) or self.part(low)
        if low[:-1].isalpha():
            head, tail = low[:-1], low[-1]
            return (parts.get(head) or self.part(head)) + (parts.get(tail) or self.part(tail))
        return b"".join([parts.get(p) or self.part(p) for p in PRETOKENS(low)])

    def part(self, part: str) -> bytes:
        """Ids of a pre-token, by the BPE model over its bytes' letters."""
        letters = part if part.isascii() else "".join(map(BYTE_LETTERS.__getitem__, part.encode()))
        ids = self.parts[part] = array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids


class WordEncoder:
    """``encode(texts)`` gives for each text its ids as little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        self.kept = kept
        self.words = Words(path)
        self.by_word = by_word(path)
        self.dtype = np.dtype("<u2" if self.words.kind == "H" else "<u4")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = self.words
        if not self.by_word:
            found = words.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [array(words.kind, x.ids).tobytes() for x in found]
        if len(words) > self.kept:  # the last generation stays within reach
            words.older = dict(words)
            words.clear()
        if len(words.parts) > self.kept:
            words.parts = {}
        get = words.__getitem__
        out = []
        for t in texts:
            if t and t.isascii() and "<|" not in t:  # the vocabulary is lower-case; here that is one pass
                t = t.lower()
            out.append(b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"")
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept until ``only`` forgets it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
        keep("words", _ENCODERS.clear)
    return _ENCODERS[path]
