"""SentencePiece encoding and decoding, by one forward pass over a trie of distinct marked words.

A text's ids are those of its marked words (a blank becomes the mark before the word that follows), for
no piece holds a mark after another character. The distinct words of a batch are sorted, which lays
their trie out depth first: each word starts from the forward states it shares with the word before.

The forward pass of a Unigram model is Viterbi's: the best score of each prefix and its last piece. A
BPE model has no additive scores; its result is fixed by the merge order. There the state of a prefix
is the last piece of its own encoding, and a piece may follow only if no merge across the seam would
have come before the merges that formed the two: exactly one piece may (tested against the library).
The words such a pass can't decide (runs of blanks, the mark itself) go to the library one by one.

Edge cases: null and empty texts give no ids. Characters that no piece holds become byte pieces. Very long texts count whole,
word by word. Every row gives one row, repeated ones too; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chosen, slices, texts_of

MARK = "▁"
KEPT_WORDS = 300_000
FAR = 1 << 30


class PieceCoder:
    """Encodes and decodes like the library does with the model at ``path``."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.unigram = model.trainer_spec.model_type == 1
        if model.trainer_spec.model_type not in (1, 2) or model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only Unigram and BPE models with identity normalisation and a mark before each text")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = [p.score for p in model.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(p.type == 4 for p in model.pieces):
            raise ValueError("a piece holds a mark after another character")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.single = {p for p in self.ids if len(p) == 1}
        self.unknown = min(self.scores[i] for i in self.ids.values()) - 10.0
        self.halves: dict[int, tuple[int, int]] = {}
        if not self.unigram:
            for piece, i in self.ids.items():
                if len(piece) > 1 and piece.strip(MARK):
                    self.halves[i] = self._halves(piece)
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.kept = kept
        values = [self._value(i) for i in range(len(self.pieces))]
        self.value = values

    def _value(self, i: int) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.library.is_control(i):
            return b""
        return " ⁇ ".encode() if self.library.is_unknown(i) else self.pieces[i].replace(MARK, " ").encode()

    def _halves(self, piece: str) -> tuple[int, int]:
        """The two pieces whose merge is the last on the way to ``piece``; (-1, -1) if merging doesn't lead to it."""
        parts = list(piece)
        while len(parts) > 2:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None and len(parts[k] + parts[k + 1]) < len(piece)), default=None)
            if best is None:
                return -1, -1
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        left, right = (self.ids.get(p, -1) for p in parts)
        return (left, right) if left >= 0 and right >= 0 else (-1, -1)

    def _spine(self, i: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge of piece ``i`` while it forms, whole piece first, each with the score of the merge that ends it."""
        out, ends = [], -np.inf
        while True:
            out.append((i, ends))
            if i not in self.halves:
                return out
            ends, i = self.scores[i], self.halves[i][side]

    def _fit(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart where they meet.

        Some pair at the seam merges if it exists while both its sides are whole, and its merge comes
        before either side's next; of equal scores the leftmost comes first.
        """
        if self.halves.get(left, (0, 0))[0] < 0 or self.halves.get(right, (0, 0))[0] < 0:
            return False
        rights = self._spine(right, 0)
        for a, a_ends in self._spine(left, 1):
            formed_a = self.scores[a] if a in self.halves else np.inf
            for b, b_ends in rights:
                formed_b = self.scores[b] if b in self.halves else np.inf
                both = self.ids.get(self.pieces[a] + self.pieces[b])
                # both sides exist together at some time, and the seam's merge comes before either ends
                if both is not None and min(formed_a, formed_b) >= max(a_ends, b_ends) and self.scores[both] > a_ends and self.scores[both] >= b_ends:
                    return False
        return True

    def _bpe(self, words: list[str]) -> Iterator[list[int]]:
        """Last piece of each prefix's encoding, carried from word to word along shared prefixes."""
        ids, fits, single = self.ids, self.fits, self.single
        n_pieces, longest = len(self.pieces), self.longest
        last: list[int] = [-1]  # by prefix length; -1: start or a character outside the vocabulary, FAR: undecided
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :]
            for d in range(same + 1, len(word) + 1):
                if word[d - 1] not in single:
                    last.append(-1)
                    continue
                found = FAR
                for k in range(d - 1, max(-1, d - 1 - longest), -1):
                    piece = ids.get(word[k:d])
                    if piece is None:
                        continue
                    prev = last[k]
                    if prev < 0:
                        found = piece
                        break
                    if prev == FAR:
                        continue
                    key = prev * n_pieces + piece
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = self._fit(prev, piece)
                    if fit:
                        found = piece
                        break
                last.append(found)
            yield last
            before = word

    def _viterbi(self, words: list[str]) -> Iterator[list[int]]:
        """As :meth:`_bpe`, for a Unigram model: best scores of prefixes, with the piece that ends each."""
        last, score = [-1], [0.0]
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], score[same + 1 :]
            for d in range(same + 1, len(word) + 1):
                best, piece = (-np.inf, -1) if word[d - 1] in self.single else (score[d - 1] + self.unknown, -1)
                for k in range(max(0, d - self.longest), d):
                    i = self.ids.get(word[k:d])
                    if i is not None and score[k] + self.scores[i] > best:
                        best, piece = score[k] + self.scores[i], i
                last.append(piece)
                score.append(best)
            yield last
            before = word

    def _ids(self, word: str, last: list[int]) -> list[int]:
        out, at = [], len(word)
        while at:
            piece = last[at]
            if piece == FAR:  # the pass left it open: ask the library
                return self.library.encode(word[1:])
            if piece < 0:
                at -= 1
                out += [self.bytes[b] for b in reversed(word[at].encode())]
            else:
                at -= len(self.pieces[piece])
                out.append(piece)
        return out[::-1]

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words (without their mark) into the table of words."""
        plain = sorted(MARK + w for w in words if MARK not in w)
        for word, last in zip(plain, (self._viterbi if self.unigram else self._bpe)(plain), strict=True):
            self.words[word[1:]] = np.array(self._ids(word, last), "<u4").tobytes()
        if len(self.fits) > 2_000_000:
            self.fits.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.kept:
            self.words.clear()
        known, split = self.words, []
        for text in texts:
            words = text.split(" ") if text else []
            if "" in words or MARK in text:
                words = self._runs(text)
            split.append(words)
        self.learn({w for ws in split for w in ws if w not in known and not w.startswith(" ")})
        for w in {w for ws in split for w in ws if w not in known}:
            ids = [self.ids[MARK]] if w == " " else self.library.encode(w[1:] if w.startswith(" ") else w)
            known[w] = np.array(ids, "<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    @staticmethod
    def _runs(text: str) -> list[str]:
        """Words of a text with runs of blanks or marks; those with more than one mark keep all blanks before them."""
        marked = (" " + text).replace(MARK, " ") if text else ""
        out, at, n = [], 0, len(marked)
        while at < n:
            word = at
            while word < n and marked[word] == " ":
                word += 1
            end = marked.find(" ", word)
            end = n if end < 0 else end
            out.append(marked[word:end] if word - at == 1 and end > word else marked[at:end])
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, marks as blanks, the first of them dropped."""
        text = b"".join(map(self.value.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder a worker process."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


CODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, the text's crc32 and ids (little-endian uint32) of each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in slices(texts, 1 << 21):
                part = texts.slice(i, j - i).to_pylist()
                coded, crcs = c.encode(part), [zlib.crc32(t.encode()) for t in part]
                yield batch(CODED_ARROW, doc_id=b.column(0).slice(i, j - i), n_tokens=[len(x) // 4 for x in coded], ids_crc32=[zlib.crc32(x) for x in coded], text_crc32=crcs, ids=coded)

    return chosen(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, ids binary")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` (doc_id, ids, ...) with its ids turned into text; null ids give null."""
    at = coded.columns.index("ids")
    kept = [c for c in coded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [None if x is None else c.decode(np.frombuffer(x, "<u4")) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = coded.select(*kept).schema.add("text", "string")
    return coded.mapInArrow(run, schema)
