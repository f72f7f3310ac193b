"""Token counts by document: whole texts through the tokenizer's library, only lengths come back.

Within each Arrow batch, texts are cut at safe boundaries into parts of at most ``PART`` characters where
they are longer, and the parts, of one text or of many, go to the library in calls of about ``BATCH`` bytes. A part is longer
only where a text has no safe boundary for so long.

A safe boundary of a SentencePiece model that normalises nothing and whose pieces never hold a blank after another
character: a single blank between two other characters. The blank goes; the library puts one before each part.
Other tokenizers get whole texts. Null and empty texts count 0 tokens. Every row gives one row, repeated ones too;
an empty table gives none.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chosen, slices, texts_of

PART = 1 << 16
BATCH = 1 << 20
MARK = "▁"


def safe_parts(text: str, most: int = PART) -> list[str]:
    """Cut before ``most`` characters, where a single blank stands between two characters that are neither blank nor mark."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        while cut > at and (text[cut - 1] in (" ", MARK) or text[cut + 1] in (" ", MARK)):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:  # no boundary in reach: take the next one after it
            cut = text.find(" ", at + most)
            while 0 < cut and (cut + 1 >= len(text) or text[cut - 1] in (" ", MARK) or text[cut + 1] in (" ", MARK)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        parts.append(text[at:cut])
        at = cut + 1
    return [*parts, text[at:]]


_COUNTERS: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether texts may be cut by :func:`safe_parts`."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2 as proto

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            spec = proto.ModelProto()
            with open(path, "rb") as f:
                spec.ParseFromString(f.read())
            normal = spec.normalizer_spec
            plain = not normal.precompiled_charsmap and not normal.normalization_rule_tsv and normal.add_dummy_prefix and normal.escape_whitespaces
            # pieces of the user's own are found before all else, over any boundary
            own = any(p.type == 4 and MARK in p.piece for p in spec.pieces)
            word_bound = not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
            cuttable = bool(plain and word_bound and not own and not spec.trainer_spec.treat_whitespace_as_suffix)
            _COUNTERS[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), cuttable
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _COUNTERS[path] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), False
    return _COUNTERS[path]


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def calls(parts: Iterator[tuple[int, str]], most: int = BATCH) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and parts in runs of about ``most`` bytes; a longer part stands alone."""
    owners, texts, size = [], [], 0
    for owner, text in parts:
        n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if texts and size + n > most:
            yield owners, texts
            owners, texts, size = [], [], 0
        owners.append(owner)
        texts.append(text)
        size += n
    if texts:
        yield owners, texts


def _count(tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cuttable = counter(tokenizer)
        for b in batches:
            texts = texts_of(b.column(1))
            total = np.zeros(len(texts), np.int64)

            def parts(texts: pa.Array = texts) -> Iterator[tuple[int, str]]:
                for i, j in slices(texts, BATCH):
                    for k, text in enumerate(texts.slice(i, j - i).to_pylist(), i):
                        yield from ((k, x) for x in (safe_parts(text) if cuttable else [text]))

            for owners, some in calls(parts()):
                np.add.at(total, owners, count(some))
            yield batch(COUNTS_ARROW, doc_id=b.column(0), n_bytes=pc.binary_length(texts).cast(pa.int64()), n_tokens=total, over_limit=total > limit)

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row of ``docs``; no shuffle."""
    return chosen(docs).mapInArrow(_count(tokenizer, limit), COUNTS)
