"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Pieces of equal length are interchangeable, so best-fit decreasing over all documents needs only how
many pieces each length has: at most ``capacity`` numbers, however large the corpus. The driver runs it
on those counts with a segment tree over remaining capacities; each step places a run of equal pieces
into a run of equally full sequences. The steps (a table bounded by the capacity, not by the data) go to
all workers, where every piece finds its sequence and offset from its place among pieces of its length.

That place is a piece's place in the file of its partition, plus how many of its length lie in earlier partitions. The
latter are summed by partition and length and lie in small files beside the pieces, where each task reads those of
its own partitions: neither the pieces nor their ids are shuffled.

Edge cases: a null or empty text is the end id alone. Repeated rows and repeated or null doc_ids are
each packed; pieces of equal length are placed in no stated order. An empty table gives no row. Only texts longer than the capacity are cut, into full pieces and a rest.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, chosen, only, save, scratch, slices, texts_of
from .wordids import encoder


class CapacityTree:
    """A segment tree over remaining capacities 0..n: which of them some open sequence has."""

    def __init__(self, n: int) -> None:
        self.size = 1 << (n + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, present: bool) -> None:
        i = capacity + self.size
        self.any[i] = present
        while i := i >> 1:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest present capacity that is ``least`` or more; -1 if there is none."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Steps (length, first, end, sequence, per, offset), and how many sequences they fill.

    The pieces ``first..end-1`` of a length go ``per`` to a sequence, from number ``sequence`` on, at ``offset``.
    """
    tree, open_runs = CapacityTree(capacity), defaultdict(list)
    steps, sequences = [], 0

    def add(room: int, first: int, end: int) -> None:
        if room and end > first:
            if not open_runs[room]:
                tree.set(room, True)
            runs = open_runs[room]
            if runs and runs[-1][1] == first:
                runs[-1] = (runs[-1][0], end)
            else:
                runs.append((first, end))

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room < 0:
                per = capacity // length
                first, room = sequences, capacity
                end = sequences = first + -(-(total - done) // per)
            else:
                per = room // length
                first, end = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
            full = min(end - first, (total - done) // per)
            rest = min(total - done - full * per, per - 1) if full < end - first else 0
            placed = full * per + rest
            steps.append((length, done, done + placed, first, per, capacity - room))
            done += placed
            add(room, first + full + (rest > 0), end)
            add(room - per * length, first, first + full)
            if rest:
                add(room - rest * length, first + full, first + full + 1)
    return np.array(steps, np.int64).reshape(-1, 6), sequences


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        coder, step = encoder(tokenizer), 4 * capacity
        end = np.array([end_id], coder.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            docs, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for i, j in slices(texts, 1 << 20):
                rows = []
                for doc, coded in zip(docs[i:j], coder.encode(texts.slice(i, j - i).to_pylist()), strict=True):
                    coded = np.frombuffer(coded + end, coder.dtype).astype("<u4").tobytes()
                    for piece, at in enumerate(range(0, len(coded), step)):
                        ids = coded[at : at + step]
                        n = len(ids) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(ids), ids, part, seen[n]))
                        seen[n] += 1
                yield batch(PIECES_ARROW, **dict(zip(PIECES_ARROW.names, zip(*rows, strict=True), strict=True)))

    return run


CHUNK = 64  # partitions whose sums share a folder


def _place(steps: np.ndarray, bases: str, kept: list[str]):
    keys = steps[:, 0] << 40 | steps[:, 1]
    order = np.argsort(keys)
    keys, steps = keys[order], steps[order]

    def earlier(part: int) -> np.ndarray:
        """By length, how many pieces lie in earlier partitions."""
        store, root = pafs.FileSystem.from_uri(bases)
        rows = pq.read_table(f"{root}/chunk={part // CHUNK}", filesystem=store, filters=[("part", "=", part)], partitioning=None)
        found = np.zeros(int(steps[:, 0].max()) + 1, np.int64)
        found[rows["length"].to_numpy()] = rows["base"].to_numpy()
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, base = -1, np.zeros(0, np.int64)
        for b in batches:
            length, nth, parts = (b.column(n).to_numpy() for n in ("length", "nth", "part"))
            place = np.empty(len(nth), np.int64)
            for part in np.unique(parts).tolist():  # a file's rows are of one partition
                if part != of:
                    of, base = part, earlier(part)
                own = parts == part
                place[own] = nth[own] + base[length[own]]
            s = steps[np.searchsorted(keys, length << 40 | place, side="right") - 1]
            k = place - s[:, 1]
            where = [pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 5] + k % s[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *where], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """Pack ``docs`` (doc_id, text): a row a piece, with its ids (little-endian uint32), sequence and offset.

    The texts are tokenised once, where they are read; what is shuffled afterwards is a count by
    partition and length. A length that a third of all pieces share is numbered partition by partition.
    """
    if capacity >= 1 << 22:
        raise ValueError("capacity is too large")
    spark = docs.sparkSession
    pieces = save(chosen(docs).mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), scratch(spark, "pieces"))
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = plan_packing(counts, capacity)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = scratch(spark, "bases")
    base = sizes.select("part", "length", earlier.alias("base"), F.floor(F.col("part") / CHUNK).cast("int").alias("chunk"))
    save(base.repartition("chunk"), bases, "chunk")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return pieces.select(*kept, "part", "nth").mapInArrow(_place(steps, bases, kept), schema)
