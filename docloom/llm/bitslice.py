"""Exact top-k by integer inner product over a bit-sliced index.

Vectors become integers floor(1024 * x). A block of rows is indexed by attribute: each attribute, less
its minimum, keeps its leading bits, and each kept bit is one bitmap over the rows (a slice). A query adds its
weighted attributes with bitmap arithmetic (a weight's signed binary digits shift the slices, and
carry-save adders sum them), then finds the k-th value from the most significant slice of the sum
downward. What the dropped bits and weights can add is bounded, so the rows within that bound
of the k-th are the only ones that can be among the k best; they are scored exactly.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do vectors, of
the table or the queries, of another length than most of the table's. Every row but those with the query's own vec_id is
a candidate, repeated rows each. A query is a vec_id: if rows repeat it, the first of its vectors in order is
asked for. Ties go to the smaller vec_id. No candidates, no rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grid, usable_vectors

SCALE = 1024
SLICES = 6
DIGITS = 6
ROW_BLOCK = 16_384
QUERY_BLOCK = (64, 4096)


def signed_digits(n: int) -> list[tuple[int, int]]:
    """The signed binary digits (power, +1 or -1) of ``n``, no two in neighbouring places."""
    out, power, sign = [], 0, 1 if n >= 0 else -1
    n = abs(n)
    while n:
        if n & 1:
            digit = 2 - (n & 3)
            out.append((power, sign * digit))
            n -= digit
        n >>= 1
        power += 1
    return out


class SlicedBlock:
    """Bit slices of a block of integer rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, n = rows, len(rows)
        self.low = rows.min(axis=0)
        shifted = rows - self.low
        bits = int(shifted.max()).bit_length()
        self.shift = max(0, bits - SLICES)
        self.bits = max(1, bits - self.shift)
        self.most = shifted.max(axis=0)
        kept = (shifted >> self.shift).T
        words = -(-n // 64)
        padded = np.zeros((rows.shape[1], self.bits, 8 * words), np.uint8)
        for b in range(self.bits):
            packed = np.packbits((kept >> b & 1).astype(bool), axis=1, bitorder="little")
            padded[:, b, : packed.shape[1]] = packed
        self.slices = padded.view(np.uint64)
        every = np.zeros(8 * words, np.uint8)
        ones = np.packbits(np.ones(n, bool), bitorder="little")
        every[: len(ones)] = ones
        self.every = every.view(np.uint64)

    def weighted_sum(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices, lowest first, of sum(weight * kept attribute) + offset, which is never negative; the offset."""
        columns: dict[int, list[np.ndarray]] = {}
        offset = 0
        for attribute, weight in enumerate(weights):
            for power, sign in signed_digits(weight):
                slices = self.slices[attribute]
                if sign < 0:  # -x is its complement less the largest value
                    slices = ~slices
                    offset += ((1 << self.bits) - 1) << power
                for b in range(self.bits):
                    columns.setdefault(power + b, []).append(slices[b])
        total, carried, place = [], None, 0
        while columns or carried is not None:
            here = [np.array(columns.pop(place))] if place in columns else []
            if carried is not None:
                here.append(carried)
            stack = np.concatenate(here) if here else np.zeros((1, len(self.every)), np.uint64)
            carries = []
            while len(stack) > 2:
                t = len(stack) // 3
                a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                stack = np.concatenate([odd ^ c, stack[3 * t :]])
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            total.append(stack[0])
            carried = np.concatenate(carries) if carries else None
            place += 1
        return total, offset

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Row numbers that hold the k best of the ``allowed`` rows (a bitmap), and perhaps a few more."""
        most = max(1, int(np.abs(query).max()))
        drop = max(0, most.bit_length() - DIGITS)
        weights = [int(w) for w in (query + ((1 << drop) >> 1)) >> drop]
        slices, offset = self.weighted_sum(weights)
        # true sum - (sum of kept, scaled) lies within [under, over]
        over = under = 0
        rest, scale = (1 << self.shift) - 1, 1 << drop
        for q, w, top in zip(query.tolist(), weights, self.most.tolist(), strict=True):
            off = q - w * scale
            over += max(off * top, 0) + max(w * scale * rest, 0)
            under += min(off * top, 0) + min(w * scale * rest, 0)
        unit = scale << self.shift
        # the k-th largest kept sum, slice by slice
        above, equal, value = np.zeros_like(allowed), allowed.copy(), 0
        for place in range(len(slices) - 1, -1, -1):
            ones = equal & slices[place]
            value <<= 1
            if int(np.bitwise_count(above | ones).sum()) >= k:
                equal = ones
                value += 1
            else:
                above, equal = above | ones, equal & ~slices[place]
        least = value - (over - under) // unit - 1
        # all rows of at least that kept sum
        more, same = np.zeros_like(allowed), allowed.copy()
        if least > 0:
            for place in range(len(slices) - 1, -1, -1):
                if least >> place & 1:
                    same = same & slices[place]
                else:
                    more, same = more | (same & slices[place]), same & ~slices[place]
        found = more | same
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(self.rows)])


def integers(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.floor(SCALE * flat.flatten().to_numpy().reshape(len(flat), -1)).astype(np.int64)


RESULT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return RESULT_ARROW.empty_table()
        ids, block = rows["vec_id"].to_numpy(), SlicedBlock(integers(rows["vec"]))
        asked, weights = queries["vec_id"].to_numpy(), integers(queries["vec"])
        wide = float(np.abs(block.rows).max()) * float(np.abs(weights).max()) * block.rows.shape[1] >= 2**62
        out = []
        for own, query in zip(asked.tolist(), weights, strict=True):
            allowed = block.every
            if (mine := np.flatnonzero(ids == own)).size:
                bits = np.unpackbits(allowed.view(np.uint8), bitorder="little")
                bits[mine] = 0
                allowed = np.packbits(bits, bitorder="little").view(np.uint64)
            found = block.top(query, k, allowed)
            scores = block.rows[found].astype(object) @ query.astype(object) if wide else block.rows[found] @ query
            best = np.lexsort((ids[found], -scores))[:k]
            out += [(own, i, s) for i, s in zip(ids[found][best].tolist(), scores[best].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], schema=RESULT_ARROW)

    return run


def exact_topk(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` the k rows of ``table`` of largest integer inner product.

    Blocks of rows meet blocks of queries; each pair of blocks returns at most k rows a query.
    """
    rows, asked = (df.withColumn("cell", F.lit(0)) for df in usable_vectors(table, queries))
    rows, asked = grid(rows, asked, ROW_BLOCK, QUERY_BLOCK)
    keys = ["cell", "rb", "qb"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
