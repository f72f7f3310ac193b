"""Views over a stream of changes: micro-batches of a log, merged into a store.

A batch's operations, its position, its epoch and the rows of transactions that are still open become visible together,
so a repeated batch changes nothing; versions decide, and no late change is dropped by time. Rules are read anew for each batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.store import Store


def read_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of change files, with admission by number of files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def complete_transactions(batch: DataFrame, waiting: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of committed transactions, rows still waiting), of a batch and what waited before it.

    A row of kind ``commit`` ends its transaction; its position goes with every row as ``commit_lsn``. A row without
    a transaction is committed by itself.
    """
    rows = batch if waiting is None else waiting.unionByName(batch)
    commits = rows.where(F.col("kind") == "commit").groupBy("txn_id").agg(F.max("version").alias("commit_lsn"))
    data = rows.where(F.col("kind").isin("row", "truncate"))
    alone = F.col("txn_id").isNull()
    done = data.where(~alone).join(commits, "txn_id").select(*rows.columns, "commit_lsn")
    return done.unionByName(data.where(alone).withColumn("commit_lsn", F.col("version"))), data.where(~alone).join(commits, "txn_id", "left_anti").select(*rows.columns)


def run(changes: DataFrame, store: Store, compile: Callable[[], Callable[[DataFrame], DataFrame]], stream: str, checkpoint: str, max_rejects: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that takes log rows batch by batch through the rules that ``compile`` gives.

    By default it ends when all that is there has been taken; ``trigger`` (such as ``{"processingTime": "1 second"}``)
    keeps it running.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        if store.applied(stream, epoch):
            return
        room = store.room()
        log = store.stage(batch, room)
        done, still = complete_transactions(log, store.waiting(stream, batch.schema))
        done = store.stage(done, room)
        moved = log.where(F.col("kind") == "position").agg(F.max("version")).first()[0]
        position = done.agg(F.max("commit_lsn")).first()[0]
        if moved is not None and still.isEmpty():  # an idle stream moves on, but never past an open transaction
            position = max(moved, position or moved)
        ops = compile()(done.drop("commit_lsn"))
        store.apply(ops, stream=stream, epoch=epoch, position=position, waiting=still, max_rejects=max_rejects)
        store.leave(room)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retried(start: Callable[[], StreamingQuery], attempts: int = 8, first: float = 1.0, most: float = 60.0, within: float = 900.0, pause: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Run a query to its end, starting it again after a failure: waits double up to ``most`` seconds; the last failure is raised."""
    began, wait = time.monotonic(), first
    for attempt in range(1, attempts + 1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            if attempt == attempts or time.monotonic() - began + wait > within:
                raise
        pause(wait)
        wait = min(most, wait * 2)
    raise ValueError("attempts is 1 or more")


def run_all(starts: dict[str, Callable[[], StreamingQuery]]) -> dict[str, str | None]:
    """Several configurations in one session, each its own query: name to its failure, or None. One's failure doesn't stop the others."""
    queries = {}
    failed: dict[str, str | None] = {}
    for name, start in starts.items():
        try:
            queries[name] = start()
        except Exception as e:
            failed[name] = str(e)
    for name, query in queries.items():
        try:
            query.awaitTermination()
            failed[name] = None
        except Exception as e:
            failed[name] = str(e)
    return failed


def wait_for(store: Store, stream: str, position: int, seconds: float = 30.0, grace: float = 0.05) -> bool:
    """Whether the store has taken in ``position`` within the time: for reading one's own writes."""
    end = time.monotonic() + seconds
    while (store.position(stream) or 0) < position:
        if time.monotonic() > end:
            return False
        time.sleep(grace)
    return True
