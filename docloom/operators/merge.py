"""Versioned last-writer-wins merging of operations into documents.

An operation applies if it or what is stored has no version, or if the stored version is not larger; an
unversioned one stores no version. Taken in order of ``seq``, what remains of a key is: the last unversioned
operation, or the one of largest (version, seq) among those after it. That closed form takes one shuffle by
key, whatever the order in which operations arrive: two windows over one partitioning, or, where every operation
has a version, a rank whose losers already go before the shuffle. A delete that wins stays as a tombstone, as an
operation of the next merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.templates import matches

KEY = ["index", "id", "routing"]


def latest(ops: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last operation of each key in an order; a rank limit, so losers go before the shuffle."""
    last = Window.partitionBy(*key).orderBy(*(c.desc() for c in order))
    return ops.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).drop("_rank")


def winners(ops: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The operation that remains of each key, tombstones included."""
    key = key or KEY
    # the last unversioned operation: what came before it no longer counts
    floor = F.max(F.when(F.col("version").isNull(), F.col("seq"))).over(Window.partitionBy(*key))
    alive = ops.withColumn("_floor", floor).where(F.col("_floor").isNull() | (F.col("seq") >= F.col("_floor"))).drop("_floor")
    return latest(alive, key, F.coalesce("version", F.lit(-1).cast("bigint")), F.col("seq"))


def versioned_winners(ops: DataFrame, key: list[str] | None = None) -> DataFrame:
    """As :func:`winners` where every operation has a version."""
    return latest(ops, key or KEY, F.col("version"), F.col("seq"))


def merge(stored: DataFrame, ops: DataFrame, profile: str = "versioned") -> DataFrame:
    """Stored winners and new operations to new winners.

    Profiles: ``versioned`` compares versions; ``last_write`` takes operations in the order of ``seq``.
    Stored rows come before all new ones.
    """
    old = stored.withColumn("_new", F.lit(0))
    both = old.unionByName(ops.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("seq", F.struct("_new", "seq"))
    if profile == "last_write":
        best = latest(both, KEY, F.col("seq"))
    else:
        best = winners(both)
    return best.withColumn("seq", F.col("seq.seq")).drop("_new")


def documents(winning: DataFrame) -> DataFrame:
    """What a reader sees: winners that are no deletes."""
    return winning.where(F.col("action") == "upsert")


def truncate(stored: DataFrame, pattern: str, version: int, only: tuple[str, str] | None = None) -> DataFrame:
    """Stored rows after a truncate at ``version``: those of matching indexes that are not newer, or unversioned, become tombstones of it.

    ``only`` restricts it to documents with a field of that value.
    """
    hit = matches(pattern, F.col("index")) & (F.col("version").isNull() | (F.col("version") <= version)) & (F.col("action") == "upsert")
    if only:
        hit = hit & F.coalesce(F.col("doc")[only[0]].cast("string") == only[1], F.lit(False))
    return stored.withColumns({"action": F.when(hit, "delete").otherwise(F.col("action")), "version": F.when(hit, F.lit(version).cast("bigint")).otherwise(F.col("version"))})


def above_floors(loaded: DataFrame, floors: DataFrame) -> DataFrame:
    """Loaded rows that are not below a remembered truncate of their index (``index``, ``floor``); equal versions stay."""
    top = floors.groupBy("index").agg(F.max("floor").alias("floor"))
    return loaded.join(top, "index", "left").where(F.col("floor").isNull() | F.col("version").isNull() | (F.col("version") >= F.col("floor"))).drop("floor")


def without_deleted(loaded: DataFrame, deletes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Loaded rows but those of keys deleted at a strictly larger version."""
    key = key or KEY
    last = deletes.groupBy(*key).agg(F.max("version").alias("_deleted_at"))
    return loaded.join(last, key, "left").where(F.col("_deleted_at").isNull() | (F.col("_deleted_at") <= F.col("version"))).drop("_deleted_at")


def cascade(stored: DataFrame, parent_deletes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Deletes of the children of deleted parents (index, id, version), at the parent's version, of children not newer."""
    gone = parent_deletes.groupBy("index", F.col("id").alias("_parent")).agg(F.max("version").alias("_at"))
    hit = stored.where(F.col("action") == "upsert").join(gone, (stored["index"] == gone["index"]) & (stored[parent] == gone["_parent"])).where(stored["version"].isNull() | (stored["version"] <= F.col("_at")))
    return hit.select(stored["index"], stored["id"], stored["routing"], F.lit("delete").alias("action"), F.col("_at").alias("version"))
