"""Approximate nearest neighbours by cosine: inverted lists scanned dimension by dimension.

Unit vectors are rotated by a random orthogonal matrix, so that after some of its columns a partial
distance tells how far a vector will end up. Lists come from k-means on a bounded sample (at most ``SAMPLE``
vectors and ``SAMPLE_BYTES`` bytes, ``MOST_LISTS`` lists); every vector is indexed. A query probes as many lists as the
sample says, and more until they hold enough other rows. In each probed list a query adds up squared
differences by blocks of columns and drops a candidate as soon as a hypothesis test rejects, at
``STRICT`` deviations, that it is as near as the k-th found. Survivors are scored on original vectors.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors, of the table or the queries, of another length than most of the table's. Every row but those with the query's own
vec_id is a candidate, repeated rows each. A query is a vec_id: if rows repeat it, the first of its vectors in
order is asked for. Ties go to the smaller vec_id. Fewer rows than k come only where the table has no more candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, grid, save, scratch, usable_vectors

SAMPLE = 20_000
SAMPLE_BYTES = 1 << 26
MOST_LISTS = 4096
CALIBRATED = 256
COLUMNS = 8
STRICT = 3.0
ROW_BLOCK = 8192
QUERY_BLOCK = (256, 4096)


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced seeds; an empty list keeps its centre."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(points[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(points), 4096)])
        for c in range(k):
            if (own := points[nearest == c]).size and (norm := np.linalg.norm(total := own.sum(axis=0))) > 0:
                centres[c] = total / norm
    return centres


def probes_needed(points: np.ndarray, centres: np.ndarray, k: int, share: float) -> int:
    """How many lists hold ``share`` of the true k nearest of some sample points among the sample."""
    asked = np.linspace(0, len(points) - 1, min(len(points), CALIBRATED)).astype(int)
    own = (points @ centres.T).argmax(axis=1)
    near = points[asked] @ points.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-near, min(k, len(points) - 1) - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(points[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[best], axis=1), share, method="higher")) + 1


ROWS = "cell int, vec_id long, rotated binary, vec array<double>"
ROWS_ARROW = pa.schema([("cell", pa.int32()), ("vec_id", pa.int64()), ("rotated", pa.binary()), ("vec", pa.list_(pa.float64()))])


def _assign(turn: np.ndarray, centres: np.ndarray):
    """Each row in its nearest list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                rotated = (unit(matrix(b.column(1))) @ turn).astype(np.float32)
                lists = (rotated @ centres.T).argmax(axis=1).astype(np.int32)
                yield batch(ROWS_ARROW, cell=lists, vec_id=b.column(0), rotated=[r.tobytes() for r in rotated], vec=b.column(1))

    return run


def _probe(turn: np.ndarray, centres: np.ndarray, sizes: np.ndarray, probes: int, k: int):
    """Each query in its ``probes`` nearest lists, and in further ones until they hold k rows beside its own (``own``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rotated = (unit(matrix(b.column(1))) @ turn).astype(np.float32)
                lists = np.argsort(-(rotated @ centres.T), axis=1, kind="stable")
                held = np.cumsum(sizes[lists], axis=1)
                enough = (held < b.column(2).to_numpy()[:, None] + k).sum(axis=1) + 1
                n = np.minimum(np.maximum(enough, probes), len(centres))
                take = np.repeat(np.arange(b.num_rows), n)
                place = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
                coded = pa.array([r.tobytes() for r in rotated], pa.binary())
                for i in range(0, len(take), 8192):
                    part = pa.array(take[i : i + 8192])
                    yield batch(ROWS_ARROW, cell=lists[take[i : i + 8192], place[i : i + 8192]].astype(np.int32), vec_id=b.column(0).take(part), rotated=coded.take(part), vec=b.column(1).take(part))

    return run


def scan(rows: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Rows among which the query's k nearest are, by adaptive dimension scan."""
    n, d = rows.shape
    if n <= 4 * k:
        return np.arange(n)
    alive = np.arange(n)
    part = ((rows[:, :COLUMNS] - query[:COLUMNS]) ** 2).sum(axis=1)
    first = np.argpartition(part, 2 * k)[: 2 * k]
    limit = np.partition(((rows[first] - query) ** 2).sum(axis=1), k - 1)[k - 1] + 1e-5  # k of them are that near
    for m in range(COLUMNS, d, COLUMNS):
        # rejected if the distance estimated from m of d columns is too far to be below the limit
        keep = part * (d / m) <= limit * (1 + STRICT / math.sqrt(m)) ** 2
        alive, part = alive[keep], part[keep]
        part = part + ((rows[alive, m : m + COLUMNS] - query[m : m + COLUMNS]) ** 2).sum(axis=1)
    alive = np.union1d(alive[part <= limit], first)
    return alive


RESULT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return RESULT_ARROW.empty_table()
        columns = lambda t: np.frombuffer(b"".join(t["rotated"].to_pylist()), np.float32).reshape(t.num_rows, -1)
        ids, index, vectors = rows["vec_id"].to_numpy(), columns(rows), unit(matrix(rows["vec"]))
        out = []
        for own, query, vector in zip(queries["vec_id"].to_pylist(), columns(queries), unit(matrix(queries["vec"])), strict=True):
            others = ids != own
            found = scan(index, query, k + int((~others).sum()))
            found = found[others[found]]
            scores = (vectors[found] * vector).sum(axis=1)
            best = np.lexsort((ids[found], -scores))[:k]
            out += [(own, i, s) for i, s in zip(ids[found][best].tolist(), scores[best].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(RESULT_ARROW)], schema=RESULT_ARROW)

    return run


def sampled(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """At most ``SAMPLE`` vectors, by a hash of their ids; the same ones however the table is partitioned."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, 1.25 * most / n)
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).dropDuplicates(["vec_id"])
    return matrix(some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec").toArrow().column("vec"))


def ann(table: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` about the k rows of ``table`` of largest cosine.

    The number of lists a query scans is the least that holds ``share`` of the true neighbours of
    ``CALIBRATED`` sample vectors among the sample. A list with many rows or queries is dealt out over many groups.
    """
    spark, nonzero = table.sparkSession, F.exists("vec", lambda x: x != 0)
    rows, asked = (df.where(nonzero) for df in usable_vectors(table, queries))
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n = first["n"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = sampled(rows, n, first["d"])
    turn = rotation(sample.shape[1])
    lists = max(1, min(MOST_LISTS, len(sample), int(math.sqrt(n) / 2)))
    points = (unit(sample) @ turn).astype(np.float32)
    centres = kmeans(points, lists)
    probes = probes_needed(points, centres, k, share)
    indexed = save(rows.select("vec_id", "vec").mapInArrow(_assign(turn, centres), ROWS), scratch(spark, "ann-index"))
    sizes = np.zeros(len(centres), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most as many as there are lists
        sizes[r["cell"]] = r["count"]
    own = rows.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    sent = asked.join(own, "vec_id", "left").select("vec_id", "vec", F.coalesce("own", F.lit(0).cast("long")).alias("own")).mapInArrow(_probe(turn, centres, sizes, probes, k), ROWS)
    left, right = grid(indexed, sent, ROW_BLOCK, QUERY_BLOCK)
    keys = ["cell", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
