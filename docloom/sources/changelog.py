"""Change logs: rows of many tables with their images as JSON, decoded into typed row changes.

A log row has: kind (``row``, ``truncate``, ``commit`` or ``position``), schema, table, op (insert, update, delete),
key, old_key, before and after (JSON objects), unchanged (columns that the log left out), version, txn_id and seq, the
place in the log. ``commit`` ends a transaction; ``position`` moves an idle stream on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "kind string, schema string, table string, op string, key string, old_key string, before string, after string, unchanged array<string>, version long, txn_id long, seq long"


def of_table(log: DataFrame, schema: str, table: str, kind: str = "row") -> DataFrame:
    return log.where((F.col("kind") == kind) & (F.col("schema") == schema) & (F.col("table") == table))


def image(text: str, row: T.StructType) -> Column:
    """A JSON image as a struct; null without one. One that is no such row fails the query."""
    return F.when(F.col(text).isNotNull(), F.from_json(text, row, {"mode": "FAILFAST"}))


def decode(log: DataFrame, schema: str, table: str, row: T.StructType, key: list[str]) -> DataFrame:
    """A table's row changes: op, key, old_key, before, after (structs), unchanged, version, txn_id, seq.

    The key is the log's own, else that of the row after or before; the old key stands only where a change tells it.
    """
    keys = T.StructType([row[k] for k in key])
    rows = of_table(log, schema, table)
    read = {"before": image("before", row), "after": image("after", row)}
    if not key:
        return rows.select("op", F.lit(None).cast("struct<none:string>").alias("key"), F.lit(None).cast("struct<none:string>").alias("old_key"), *(c.alias(n) for n, c in read.items()), _unchanged(), "version", "txn_id", "seq")
    part = lambda image: F.when(F.col(image).isNotNull(), F.struct(*(F.col(image)[k].alias(k) for k in key)))
    rows = rows.withColumns({**read, "key": image("key", keys), "old_key": image("old_key", keys)})
    return rows.select("op", F.coalesce("key", part("after"), part("before")).alias("key"), F.coalesce("old_key", part("before")).alias("old_key"), "before", "after", _unchanged(), "version", "txn_id", "seq")


def _unchanged() -> Column:
    return F.coalesce("unchanged", F.array().cast("array<string>")).alias("unchanged")


def log_rows(changes: DataFrame, schema: str, table: str) -> DataFrame:
    """Typed changes (op, key, old_key, before, after, unchanged, version, txn_id, seq; any may be left out but op) as log rows."""
    names = changes.columns
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    text = lambda n: (F.when(F.col(n).isNotNull(), F.to_json(n, {"ignoreNullFields": "false"})) if n in names and not isinstance(kinds[n], T.NullType) else F.lit(None).cast("string")).alias(n)
    plain = lambda n, kind: (F.col(n).cast(kind) if n in names else F.lit(None).cast(kind)).alias(n)
    return changes.select(
        F.lit("row").alias("kind"), F.lit(schema).alias("schema"), F.lit(table).alias("table"), "op", *(text(n) for n in ("key", "old_key", "before", "after")),
        plain("unchanged", "array<string>"), plain("version", "bigint"), plain("txn_id", "bigint"), plain("seq", "bigint"),
    )


def roles(table: str, views: list) -> dict[str, list[str]]:
    """What changes of a table mean to each of ``views``: ``row`` (its own), ``parent`` (they name parents by a foreign key),
    ``through`` (by a junction), ``junction`` (they are the junction); tables that mean nothing give nothing."""
    found: dict[str, list[str]] = {}
    for v in views:
        here = ["row"] if v.table == table else []
        here += [("through" if c.through_table else "parent") for c in v.children if c.table == table]
        here += ["junction" for c in v.children if c.through_table == table]
        here += ["parent" for c in v.counts if c.table == table]
        if here:
            found[f"{v.schema}.{v.table}"] = list(dict.fromkeys(here))
    return found
