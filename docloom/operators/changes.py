"""From row changes to document operations.

A change row has: kind, table, op (insert, update, delete), pk (map), prev_pk (map), after, before (structs),
unchanged (array of columns the log left out), version, txn_id, seq. An operation has: index, id,
routing, action (upsert, delete), doc (struct), version, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.predicate import Predicate

KEY = ["index", "id", "routing"]


def committed(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of transactions whose commit has arrived; an open transaction stays invisible. ``commit_lsn`` comes along."""
    return changes.join(commits.select("txn_id", "commit_lsn").dropDuplicates(["txn_id"]), "txn_id")


def after_filter(changes: DataFrame, where: str) -> DataFrame:
    """Changes with rows that the predicate doesn't keep turned into deletes; what they were before stays."""
    keeps = Predicate(where).keeps(changes.schema["after"].dataType, "after.")
    leaves = (F.col("op") != "delete") & ~keeps
    return changes.withColumn("op", F.when(leaves, F.lit("delete")).otherwise(F.col("op")))


def complete(changes: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Fill columns that the log left out (``unchanged``) from stored documents (``doc``), in one left join."""
    rows = changes.join(stored.select(*key, F.col("doc").alias("_stored")), key, "left")
    old = stored.schema["doc"].dataType.names
    fields = [F.when(F.array_contains("unchanged", n), F.col("_stored")[n]).otherwise(F.col("after")[n]).alias(n) if n in old else F.col("after")[n].alias(n) for n in changes.schema["after"].dataType.names]
    return rows.withColumn("after", F.when(F.col("after").isNotNull(), F.struct(*fields))).drop("_stored")


def append_only(changes: DataFrame) -> DataFrame:
    """Fails the query at an update or a delete."""
    bad = F.raise_error(F.concat(F.lit("append-only table got "), F.col("op"))).cast("string")
    return changes.withColumn("op", F.when(F.col("op") == "insert", F.col("op")).otherwise(bad))


def operations(changes: DataFrame, index: Column, id: Column, old_index: Column, old_id: Column, routing: Column | None = None, old_routing: Column | None = None) -> DataFrame:
    """Upserts and deletes of changes. A moved document is deleted at its old place after it is written at the new one.

    ``id`` and such read ``after``; ``old_id`` and such read ``before`` or the previous key, null where nothing moved.
    """
    none = F.lit(None).cast("string")
    new = F.struct(index.alias("index"), id.alias("id"), (none if routing is None else routing).alias("routing"))
    old = F.struct(old_index.alias("index"), old_id.alias("id"), (none if old_routing is None else old_routing).alias("routing"))
    rows = changes.withColumns({"_new": F.when(F.col("op") != "delete", new), "_old": old})
    same = F.col("_new").eqNullSafe(F.col("_old"))
    empty = F.array().cast("array<struct<at:struct<index:string,id:string,routing:string>,action:string,step:int>>")
    one = lambda at, action, step: F.array(F.struct(F.col(at).alias("at"), F.lit(action).alias("action"), F.lit(step).alias("step")))
    steps = F.when(F.col("op") == "delete", one("_old", "delete", 0)).otherwise(F.concat(one("_new", "upsert", 0), F.when((F.col("op") == "update") & F.col("_old.id").isNotNull() & ~same, one("_old", "delete", 1)).otherwise(empty)))
    made = rows.withColumn("_s", F.explode(steps))
    doc = F.when(F.col("_s.action") == "upsert", F.col("after"))
    return made.select(*(F.col(f"_s.at.{k}").alias(k) for k in KEY), F.col("_s.action").alias("action"), doc.alias("doc"), "version", (F.col("seq") * 2 + F.col("_s.step")).alias("seq"))


def fan_out_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents (index, id, routing) that a change no longer gives; all the old ones, if the index moved."""
    same = [before[k].eqNullSafe(after[k]) for k in KEY]
    return before.join(after, same[0] & same[1] & same[2], "left_anti")


def relation(parents: DataFrame, children: DataFrame, index: str) -> DataFrame:
    """Parents and children as documents of one index, with missing columns null."""
    return parents.unionByName(children, allowMissingColumns=True).withColumn("index", F.lit(index))

