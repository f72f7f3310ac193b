"""A bigram language model in a log-frequency Bloom filter, and exact add-one unigram scores.

Counts of all words and all word bigrams are gathered exactly, over all learning documents, then
quantised: level 1 + floor(log(count) / log(BASE)). An n-gram of level q is put into the filter q times,
as (n-gram, 1) to (n-gram, q); a probe counts up until the first miss, or the filter's highest level.

The filter lies in segments by ranges of n-gram hashes, and their number grows with the tokens. Each block
of texts sends its distinct n-grams, with its own counts, to the segments, which add them up, are filled,
and are probed for the same n-grams; the levels go back to the block. No task and not the driver holds
more than a segment, or the vocabulary. A segment has ENTRY_BITS bits for each entry put into it, so the rate
of false positives, (1 - exp(-HASHES / ENTRY_BITS)) ** HASHES = 0.5 % a probe, is the same whatever the corpus.

The model: with c the counts that the filter gives back and u(w) = (c(w) + 1) / (N + V + 1),
  P(w | v) = (c(v, w) + ALPHA * u(w)) / (c(v) + ALPHA).
A document begins after the end of another; as every word has a next token, c(v) is v's count as context. With exact counts
the probabilities after v sum to 1; with quantised ones to within a factor of BASE ** 0.5 either way, and none is taken as above 1.

Edge cases: a null or empty text is its end alone. A null id is neither held out nor learned from; its
text is scored. Very long texts count whole. Repeated rows are learned from and scored each. Nothing learned: N = V = 0.
An empty table gives no rows. Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, learned, save, scratch, texts_of
from .wordhash import U, mix, word_batches

SEGMENTS = 256  # at least
SEGMENT_BITS = 1 << 20  # of a filter filled by _fill
ENTRY_BITS = 16  # bits for each (n-gram, level)
HASHES = 3
BASE = 1.5
ALPHA = 50.0
BLOCK_WORDS = 2_000_000
SEGMENT_TOKENS = 1 << 20
END = 0x9D39247E33776D41  # the end's word hash


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for 0, else 1 + floor(log(count) / log(BASE))."""
    counts = np.asarray(counts, np.float64)
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


HIGHEST = int(levels_of([2**63 - 1])[0])


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range."""
    return np.where(levels > 1, BASE ** (levels - 0.5), np.where(levels == 1, 1.0, 0.0))


def bits_of(keys: np.ndarray, level: int, n_bits: int = SEGMENT_BITS) -> np.ndarray:
    """Bit positions within the segment of (key, level), a row a hash function."""
    with np.errstate(over="ignore"):
        h = mix(keys + U(level) * U(0x9E3779B97F4A7C15))
        step = (h >> U(32)) | U(1)
        return np.array([(h + U(i) * step) % U(n_bits) for i in range(HASHES)])


def segment_of(keys: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    return (mix(keys ^ U(0x5851F42D4C957F2D)) % U(segments)).astype(np.int64)


class Filter:
    """Equal segments' bits, for probing."""

    def __init__(self, bits: np.ndarray, segments: int = SEGMENTS, highest: int = HIGHEST) -> None:
        self.bits, self.segments, self.n_bits, self.highest = bits, segments, len(bits) * 8 // segments, highest

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by repeated membership probes."""
        found = np.zeros(len(keys), np.int64)
        alive, level = np.arange(len(keys)), 1
        segment = segment_of(keys, self.segments).astype(np.uint64) * U(self.n_bits)
        while len(alive) and level <= self.highest:
            at = bits_of(keys[alive], level, self.n_bits) + segment[alive]
            hit = ((self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).all(axis=0)
            alive = alive[hit]
            found[alive] = level
            level += 1
        return found


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that high zero bytes compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def of_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


BLOCKS = "block long, size long, doc_ids binary, flags binary, lengths binary, words binary, keys binary, counts binary"
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("size", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "flags", "lengths", "words", "keys", "counts"))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    docs, flags, lengths, words, size = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        every, flag, length = np.concatenate(words), np.concatenate(flags), np.concatenate(lengths)
        keys, local = np.unique(every, return_inverse=True)
        counts = np.bincount(local[np.repeat(flag & 2 > 0, length)], minlength=len(keys))
        data = {"doc_ids": np.concatenate(docs).astype("<i8"), "flags": flag, "lengths": length.astype("<u4"), "words": local.astype("<u4"), "keys": np.diff(keys, prepend=U(0)), "counts": counts.astype("<u4")}
        return batch(BLOCKS_ARROW, block=[part << 24 | number], size=[len(every)], **{k: [planes(v)] for k, v in data.items()})

    for b in batches:
        ids = b.column(0)
        code = np.asarray(ids.is_null()) * 4 + np.asarray(b.column(1)) * 1 + np.asarray(b.column(2)) * 2
        ids = ids.fill_null(0).to_numpy()
        for i, h, at in word_batches(texts_of(b.column(3))):
            n = len(at) - 1
            words.append(np.insert(h, at[1:], U(END)))
            lengths.append(np.diff(at) + 1)
            docs.append(ids[i : i + n])
            flags.append(code[i : i + n].astype(np.uint8))
            size += len(words[-1])
            if size >= BLOCK_WORDS:
                yield flush()
                number, docs, flags, lengths, words, size = number + 1, [], [], [], [], 0
    if docs:
        yield flush()


@dataclass
class Block:
    docs: np.ndarray
    flags: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    keys: np.ndarray
    counts: np.ndarray  # empty where only texts are read

    @staticmethod
    def of(row: dict) -> Block:
        kinds = {"doc_ids": "<i8", "flags": "u1", "lengths": "<u4", "words": "<u4", "keys": "<u8", "counts": "<u4"}
        block = Block(*(of_planes(row.get(k) or b"", t) for k, t in kinds.items()))
        block.keys = np.cumsum(block.keys, dtype=np.uint64)
        return block

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local words of the distinct bigrams, the first's and the second's, and each token's place among them."""
        codes = np.roll(self.words, 1).astype(np.int64)
        codes[np.cumsum(self.lengths, dtype=np.int64) - self.lengths] = np.searchsorted(self.keys, U(END))
        codes *= len(self.keys)
        codes += self.words
        order = np.argsort(codes)
        codes = codes[order]
        new = np.diff(codes, prepend=-1) > 0
        place = np.empty(len(codes), np.uint32)
        place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        codes = codes[new]
        return (codes // len(self.keys)).astype(np.uint32), (codes % len(self.keys)).astype(np.uint32), place


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Filter keys of bigrams of word hashes."""
    return mix(mix(first + U(0xC2B2AE3D27D4EB4F)) ^ (second + U(0x165667B19E3779F9)))


def range_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key; segments are ranges of keys."""
    return ((keys >> U(32)) * U(segments)) >> U(32)


ASKED = "segment int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"
ASKED_NAMES = ["segment", "block", "words", "word_counts", "pairs", "pair_counts"]


def _ask(segments: int):
    """For each block and segment the distinct words and bigrams, as steps between sorted keys, with the block's learned counts."""

    def parts(keys: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype("<u4")
        cuts = np.searchsorted(range_of(keys, segments), np.arange(segments + 1, dtype=np.uint64)).tolist()
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return [planes(np.diff(keys[a:b], prepend=U(0))) for a, b in spans], [planes(counts[a:b]) for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block.of(row)
                first, second, place = block.bigrams()
                counts = np.bincount(place[np.repeat(block.flags & 2 > 0, block.lengths)], minlength=len(first))
                columns = [*parts(mix(block.keys), block.counts), *parts(pair_keys(block.keys[first], block.keys[second]), counts)]
                met = [i for i in range(segments) if columns[0][i] or columns[2][i]]
                for i in range(0, len(met), 1000):
                    some = met[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *(pa.array([c[k] for k in some], pa.binary()) for c in columns)], names=ASKED_NAMES)

    return run


def fill(bits: np.ndarray, keys: np.ndarray, levels: np.ndarray, n_bits: int) -> None:
    """Put each key into a segment's bits, at every level up to its own."""
    for q in range(1, int(levels.max(initial=0)) + 1):
        at = bits_of(keys[levels >= q], q, n_bits).ravel()
        np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' bits, from rows in any order; a task holds at most the segments it meets."""
    made: dict[int, np.ndarray] = {}
    for b in batches:
        segments, keys, levels = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
        for s in np.unique(segments):
            bits = made.setdefault(int(s), np.zeros(SEGMENT_BITS // 8, np.uint8))
            own, level = segments == s, levels[segments == s]
            fill(bits, keys[own], level, SEGMENT_BITS)
    for s, bits in made.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])


def segment_filter(keys: np.ndarray, counts: np.ndarray) -> Filter:
    """A filter of one segment, for distinct keys and their counts."""
    levels = levels_of(counts)
    n_bits = 8 * -(-max(1, int(levels.sum())) * ENTRY_BITS // 8)
    bits = np.zeros(n_bits // 8, np.uint8)
    fill(bits, keys, levels, n_bits)
    return Filter(bits, 1, int(levels.max(initial=0)))


ANSWERS = "segment int, block long, exact binary, word_levels binary, pair_levels binary, n long, v long"
ANSWERS_ARROW = pa.schema([("segment", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("exact", "word_levels", "pair_levels")), ("n", pa.int64()), ("v", pa.int64())])


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """A segment's answers to each block, in order of its keys; n and v, its learned tokens and words, stand in its first row."""
    rows = asked.select(ASKED_NAMES[1:]).to_pylist()

    def counted(keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        every = [np.cumsum(of_planes(r[keys], "<u8"), dtype=np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(every), return_inverse=True)
        total = np.bincount(place, np.concatenate([of_planes(r[counts], "<u4") for r in rows]), len(distinct)).astype(np.int64)
        return distinct, total, place, np.cumsum([len(e) for e in every])[:-1]

    words, c, word_at, word_cuts = counted("words", "word_counts")
    pairs, n, pair_at, pair_cuts = counted("pairs", "pair_counts")
    found = segment_filter(np.concatenate([words, pairs]), np.concatenate([c, n]))
    split = lambda x, cuts: [planes(part) for part in np.split(x, cuts)]
    rest = [0] * (len(rows) - 1)
    return pa.table([
        pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r["block"] for r in rows], pa.int64()), pa.array(split(c[word_at].astype("<i8"), word_cuts), pa.binary()),
        *(pa.array(split(found.levels(k).astype(np.uint8)[at], cuts), pa.binary()) for k, at, cuts in ((words, word_at, word_cuts), (pairs, pair_at, pair_cuts))),
        pa.array([int(c.sum()), *rest], pa.int64()), pa.array([int((c > 0).sum()), *rest], pa.int64()),
    ], schema=ANSWERS_ARROW)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(tokens: int, distinct: int):
    total = tokens + distinct + 1

    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        answers = answers.sort_by("segment")
        told = lambda name, kind, order: of_order(np.concatenate([of_planes(x, kind) for x in answers[name].to_pylist()]), order)
        for row in blocks.to_pylist():
            block = Block.of(row)
            order = np.argsort(mix(block.keys))
            exact, alone = told("exact", "<i8", order), count_of(told("word_levels", "u1", order).astype(np.int64))
            first, second, place = block.bigrams()
            both = count_of(told("pair_levels", "u1", np.argsort(pair_keys(block.keys[first], block.keys[second]))).astype(np.int64))
            p = (both + ALPHA * (alone[second] + 1) / total) / (alone[first] + ALPHA)
            starts = np.cumsum(block.lengths, dtype=np.int64) - block.lengths
            sums = lambda x, at, kind: np.add.reduceat(x[at], starts, dtype=kind)
            out.append(pa.table([pa.array(block.docs, mask=block.flags & 4 > 0), pa.array(block.flags & 1 > 0), block.lengths.astype(np.int64), sums(exact > 0, block.words, np.int64), np.full(len(starts), tokens), sums(np.log10((exact + 1) / total), block.words, np.float64), sums(np.log10(np.minimum(p, 1.0)), place, np.float64)], schema=SCORED_ARROW))
        return pa.concat_tables(out) if out else SCORED_ARROW.empty_table()

    return run


def of_order(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values given in sorted order, back in their own."""
    out = np.empty_like(x)
    out[order] = x
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``."""
    spark = docs.sparkSession
    held, use = learned("doc_id", 7, 2)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), use.alias("use"), F.col("text").cast("string").alias("text"))
    blocks = save(chosen.mapInArrow(_blocks, BLOCKS), scratch(spark, "lm-blocks"))
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    segments = max(SEGMENTS, -(-size // SEGMENT_TOKENS))
    asked = blocks.drop("size").mapInArrow(_ask(segments), ASKED)
    answers = save(asked.groupBy("segment").applyInArrow(_answer, ANSWERS), scratch(spark, "lm-answers"))
    totals = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    told = answers.drop("n", "v")
    return blocks.drop("size", "counts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(totals["n"], totals["v"]), SCORED)
