"""Snapshots, pages, ranges and polls of source tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.predicate import Predicate


def snapshot(table: DataFrame, where: str | None = None, extra: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of a table to load; ``extra`` is SQL given by an operator for one reload, ``version`` the position read before."""
    if where:
        table = table.where(Predicate(where).column(table.schema))
    if extra:
        table = table.where(F.expr(extra))
    return table if version is None else table.withColumn("version", F.lit(version).cast("bigint"))


def bounds(table: DataFrame, key: str, ranges: int, share: float = 0.1, seed: int = 1) -> list:
    """Boundaries of about equal ranges of a single key, from a sample of the table."""
    if ranges < 2:
        return []
    sample = table.select(key).where(F.col(key).isNotNull()).sample(share, seed) if share < 1 else table.select(key)
    at = ", ".join(f"percentile_disc({i / ranges}) WITHIN GROUP (ORDER BY `{key}`)" for i in range(1, ranges))
    row = sample.select(F.expr(f"array({at})").alias("b")).first()
    return sorted({int(x) if isinstance(table.schema[key].dataType, T.IntegralType) else x for x in row["b"] if x is not None})


def in_range(key: str, low, high) -> Column:
    """``low <= key < high``; None leaves an end open."""
    terms = ([F.col(key) >= F.lit(low)] if low is not None else []) + ([F.col(key) < F.lit(high)] if high is not None else [])
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def ranges_of(boundaries: list) -> list[tuple]:
    """Half-open ranges with open ends."""
    ends = [None, *boundaries, None]
    return list(zip(ends, ends[1:], strict=False))


def after_key(keys: list[str], values: list) -> Column:
    """Rows after a cursor in the order of a composite key, spelled out so that scans can use it."""
    terms = []
    for i, k in enumerate(keys):
        equal = [F.col(x) == F.lit(v) for x, v in zip(keys[:i], values, strict=False)]
        terms.append(reduce(lambda a, b: a & b, [*equal, F.col(k) > F.lit(values[i])]))
    return reduce(lambda a, b: a | b, terms)


def key_page(table: DataFrame, keys: list[str], after: list | None, size: int) -> DataFrame:
    """The next rows in key order: a top-k, not a full sort."""
    rows = table if after is None else table.where(after_key(keys, after))
    return rows.orderBy(*keys).limit(size)


def poll(table: DataFrame, column: str, watermark, page: int, soft_delete: str | None = None) -> DataFrame:
    """The next page of rows past a watermark, as changes: flagged rows are deletes with the row as what was before.

    The row filter is applied to changes later, not here: else a row that leaves it would never be deleted.
    """
    rows = table if watermark is None else table.where(F.col(column) > F.lit(watermark))
    return polled(rows.orderBy(column, *[c for c in table.columns if c != column]).limit(page), column, soft_delete)


def polled(rows: DataFrame, column: str, soft_delete: str | None = None) -> DataFrame:
    """Polled rows as changes: op, after, before, position."""
    gone = F.coalesce(F.expr(soft_delete), F.lit(False)) if soft_delete else F.lit(False)
    row = F.struct(*(F.col(c) for c in rows.columns))
    return rows.select(F.when(gone, "delete").otherwise("insert").alias("op"), F.when(~gone, row).alias("after"), F.when(gone, row).alias("before"), F.col(column).alias("position"))


def next_watermark(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("position").alias("watermark"))


def copy_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""A table in tab-separated dump form, with ``\N`` for null."""
    return spark.read.csv(path, schema=schema, sep="\t", nullValue="\\N", quote="", escape="\\")


def range_read_jdbc(spark: SparkSession, url: str, table: str, key: str, boundaries: list, **options: str) -> DataFrame:
    """A table over JDBC, one partition a key range."""
    shown = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    parts = [" AND ".join([*([f"{key} >= {shown(a)}"] if a is not None else []), *([f"{key} < {shown(b)}"] if b is not None else [])]) or "1 = 1" for a, b in ranges_of(boundaries)]
    return spark.read.jdbc(url, table, predicates=parts, properties=options)


def schema_drift(old: T.StructType, new: T.StructType) -> list[tuple[str, str]]:
    """(column, added / removed / retyped) between two schemas; reported, never applied."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (old, new))
    found = [(n, "added") for n in b if n not in a] + [(n, "removed") for n in a if n not in b]
    return sorted(found + [(n, "retyped") for n in a if n in b and a[n] != b[n]])


def contained(wanted: T.StructType, live: T.StructType, at: str = "") -> tuple[list[str], list[str]]:
    """(missing, conflicting) paths of a wanted target schema in a live one."""
    missing, conflicting = [], []
    for f in wanted.fields:
        path = f"{at}{f.name}"
        if f.name not in live.names:
            missing.append(path)
        elif isinstance(f.dataType, T.StructType) and isinstance(live[f.name].dataType, T.StructType):
            m, c = contained(f.dataType, live[f.name].dataType, f"{path}.")
            missing, conflicting = missing + m, conflicting + c
        elif f.dataType != live[f.name].dataType:
            conflicting.append(path)
    return missing, conflicting


def _islands(intervals: DataFrame, *within: str) -> DataFrame:
    order = Window.partitionBy(*within).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0)
    grouped = intervals.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order))
    return grouped.groupBy(*within, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")


def coalesced_intervals(intervals: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(uuid, first, last) with overlapping and neighbouring intervals of a uuid made one.

    First within blocks of ``block`` numbers, so that a uuid with most of all intervals is spread; what is left of it, its gaps, second.
    """
    parts = _islands(intervals.withColumn("_block", F.floor(F.col("first") / block)), "uuid", "_block")
    return _islands(parts.drop("_block"), "uuid")


def interval_set(text: Column) -> Column:
    """The intervals (uuid, first, last) of a set's text ``uuid:1-5:7,uuid:3``; a single number is an interval of its own."""
    one = lambda uuid, part: F.struct(uuid.alias("uuid"), F.substring_index(part, "-", 1).cast("bigint").alias("first"), F.substring_index(part, "-", -1).cast("bigint").alias("last"))
    of = lambda item: F.transform(F.slice(F.split(item, ":"), 2, F.size(F.split(item, ":")) - 1), lambda part: one(F.substring_index(item, ":", 1), part))
    return F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), of))


def interval_texts(intervals: DataFrame) -> DataFrame:
    """(uuid, text): each uuid's coalesced intervals in a set's form."""
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    parts = coalesced_intervals(intervals).groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("p"))
    return parts.select("uuid", F.concat_ws(":", "uuid", F.transform("p", lambda x: x["part"])).alias("text"))
