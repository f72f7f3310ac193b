"""What the operators share: the cluster's shared folder, staged tables, Arrow text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def chosen(docs: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """The named columns of ``docs`` in these types and order, whatever others it has."""
    from pyspark.sql import functions as F

    return docs.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns or (("doc_id", "long"), ("text", "string"))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the session names none, a temporary folder is set; a cluster that names none is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='docloom-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 2000  # handed to Python at a time while a table is staged


def save(df: DataFrame, path: str, *folders: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage with files that outlive executors.

    The write's own shuffle files go when it ends, and the session's settings are then as they were. What isn't dropped
    before goes with the driver.
    """
    spark = df.sparkSession
    before = {name: spark.conf.get(name) for name in (CLEANUP, ROWS)}
    spark.conf.set(CLEANUP, "true")
    if not 0 < int(before[ROWS]) <= ROWS_PER_BATCH:
        spark.conf.set(ROWS, ROWS_PER_BATCH)
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(folders))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    at, system = _file(spark, path)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    for path in paths:
        at, system = _file(spark, path)
        system.delete(at, True)


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as large strings without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` bytes of text each; a longer text stands alone."""
    n = len(column)
    ends = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64)) if n else np.zeros(0, np.int64)
    i = 0
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield i, j
        i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large-string array and its offsets, counted from 0."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


_KEPT: dict[str, Callable[[], None]] = {}


def keep(name: str, forget: Callable[[], None]) -> None:
    """Note that this worker process keeps large tables from task to task, and what forgets them."""
    _KEPT[name] = forget


def only(*names: str) -> None:
    """Forget all tables that this worker process keeps but those named, and give their memory back.

    Spark hands a worker the tasks of all stages, so what one operator has kept would lie beside the tables of the next.
    """
    others = [name for name in _KEPT if name not in names]
    for name in others:
        _KEPT.pop(name)()
    if others:
        release()


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the memory that a task has freed given back at its end: the worker waits beside other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def learned(column: str, modulus: int, left_out: int):
    """(held out, learned from) by crc32 of the id as text; a null id is neither."""
    from pyspark.sql import functions as F

    rest = F.crc32(F.col(column).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == left_out, F.lit(False)), F.coalesce(rest != left_out, F.lit(False))


def usable_vectors(table: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vec) of the table's and the queries' vectors without null or non-finite components, of one length.

    The length is the table's most common one (of equally common ones the smallest). A query is a vec_id: of several
    usable vectors under it the first in order is asked for.
    """
    from pyspark.sql import functions as F

    def sound(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
        bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)))

    rows = sound(table)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    fits = F.size("vec") == (lengths[0]["d"] if lengths else 0)
    return rows.where(fits), sound(queries).where(fits).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def grid(rows: DataFrame, queries: DataFrame, row_block: int, query_block: tuple[int, int], spread: int = 8) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns cell, rb, qb: each row block of a cell meets each query block of that cell once.

    ``rows`` and ``queries`` have ``cell`` and ``vec_id``. A cell with many rows or queries is dealt out over
    many groups of bounded size. Query blocks are as large as ``query_block`` (least, most) lets them, and no more
    than ``spread`` in a cell if they can, as each costs a copy of the cell's rows. The table of cells is bounded by the caller.
    """
    from pyspark.sql import functions as F

    n = rows.groupBy("cell").agg(F.count("*").alias("n"))
    q = queries.groupBy("cell").agg(F.count("*").alias("q"))
    size = F.least(F.lit(query_block[1]), F.greatest(F.lit(query_block[0]), F.ceil(F.col("q") / spread)))
    cells = n.join(q, "cell").select("cell", F.ceil(F.col("n") / row_block).cast("int").alias("nb"), F.ceil(F.col("q") / size).cast("int").alias("qbs"))
    cells = F.broadcast(rows.sparkSession.createDataFrame(cells.collect(), "cell int, nb int, qbs int"))  # at most as many as there are cells

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "vec", F.lit(own)), F.col(own_n)).cast("int")
        both = df.join(cells, "cell").withColumn(own, block)
        return both.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("nb", "qbs")

    return dealt(rows, "rb", "nb", "qb", "qbs"), dealt(queries, "qb", "qbs", "rb", "nb")
