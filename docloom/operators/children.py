"""Related rows within a document: ordered and capped collections, single objects, many-to-many, counts.

Each collection is aggregated by its key before it is joined, with keys in their own type, so the
join is an equi-join of one row a parent, and Catalyst picks how. What is capped is cut by rank before
elements are built and, by the rank limit, before the shuffle; totals come from a count with map-side combine,
one for all collections and counts over the same table and key. Where only some parents are asked for, their keys cut
the related tables first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.predicate import Predicate

from .shape import q


@dataclass(frozen=True)
class Through:
    """A junction: its parent key and its child key."""

    table: DataFrame
    parent_key: str
    child_key: str


@dataclass(frozen=True)
class Child:
    """A collection of related rows under ``field``."""

    field: str
    table: DataFrame
    key: str  # the child's foreign key, or its key at the junction's child side
    order: list[str] = field(default_factory=list)
    columns: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    where: str | None = None
    max_rows: int | None = None
    single: bool = False
    through: Through | None = None

    def __post_init__(self) -> None:
        if self.single and self.max_rows is not None:
            raise ValueError(f"{self.field}: max_rows makes no sense with single")
        if self.max_rows is not None and self.max_rows < 1:
            raise ValueError(f"{self.field}: max_rows is 1 or more")


@dataclass(frozen=True)
class Count:
    """The number of related rows that a predicate keeps, under ``field``."""

    field: str
    table: DataFrame
    key: str
    where: str | None = None


def kept(rows: DataFrame, where: str | None) -> DataFrame:
    return rows.where(Predicate(where).column(rows.schema)) if where else rows


def keyed(child: Child, keys: DataFrame | None = None) -> DataFrame:
    """The child's rows that its predicate keeps, with their parent's key as ``_fk``; of the parents in ``keys`` (``_fk``), if given."""
    rows = kept(child.table, child.where)
    if child.through:
        junction = child.through.table.select(F.col(q(child.through.parent_key)).alias("_fk"), F.col(q(child.through.child_key)).alias("_ck"))
        junction = (junction if keys is None else junction.join(keys, "_fk", "left_semi")).distinct()
        return rows.join(junction, rows[child.key] == junction["_ck"]).drop("_ck").where(F.col("_fk").isNotNull())
    rows = rows.withColumn("_fk", F.col(q(child.key))).where(F.col("_fk").isNotNull())
    return rows if keys is None else rows.join(keys, "_fk", "left_semi")


def collected(child: Child, keys: DataFrame | None = None) -> DataFrame:
    """A row a parent: _fk and the elements in order, at most as many as are kept."""
    names = [c for c in child.table.columns if (child.columns is None or c in child.columns) and c not in child.exclude]
    order = child.order or child.table.columns
    rows, element = keyed(child, keys), F.struct(*(F.col(q(n)) for n in names))
    most = 1 if child.single else child.max_rows
    if most is None:
        # no cap: order within the aggregate, without a window
        found = rows.groupBy("_fk").agg(F.array_sort(F.collect_list(F.struct(F.struct(*(F.col(q(o)) for o in order)).alias("o"), element.alias("e")))).alias("a"))
    else:
        rank = F.row_number().over(Window.partitionBy("_fk").orderBy(*map(q, order)))
        found = rows.withColumn("_rn", rank).where(F.col("_rn") <= most).groupBy("_fk").agg(F.array_sort(F.collect_list(F.struct("_rn", element.alias("e")))).alias("a"))
    return found.select("_fk", F.transform("a", lambda x: x["e"]).alias("_items"))


def counted(counts: list[Count | Child], keys: DataFrame | None = None) -> DataFrame:
    """A row a parent: _fk and a number for each of ``counts`` over one table and key (``_0``, ``_1``, ...): one aggregate."""
    first = counts[0]
    if isinstance(first, Child) and first.through:
        rows = keyed(first, keys)
        return rows.groupBy("_fk").agg(F.count("*").alias("_0"))
    rows = first.table.withColumn("_fk", F.col(q(first.key))).where(F.col("_fk").isNotNull())
    tests = [Predicate(c.where).keeps(rows.schema) if c.where else None for c in counts]
    if all(t is not None for t in tests):
        some = tests[0]
        for t in tests[1:]:
            some = some | t
        rows = rows.where(Predicate(first.where).column(rows.schema) if len(tests) == 1 else some)
    rows = rows if keys is None else rows.join(keys, "_fk", "left_semi")
    return rows.groupBy("_fk").agg(*((F.count("*") if t is None or len(tests) == 1 else F.count_if(t)).alias(f"_{i}") for i, t in enumerate(tests)))


def attach_all(parents: DataFrame, key: str, children: list[Child], counts: list[Count], restrict: bool = False) -> DataFrame:
    """``parents`` with their collections and counts, each under its field: ``[]`` or 0 where there is nothing.

    A capped collection that was cut also has ``<field>_truncated`` (true) and ``<field>_total``, null where it was
    not. ``restrict`` cuts the related tables to these parents first: for when they are a part of all.
    """
    keys = parents.select(F.col(q(key)).alias("_fk")).where(F.col("_fk").isNotNull()) if restrict else None
    out = parents
    for child in children:
        found = collected(child, keys)
        empty = F.array().cast(found.schema["_items"].dataType)
        out = out.join(found, out[key] == found["_fk"], "left").drop("_fk")
        out = out.withColumn(child.field, F.get("_items", F.lit(0)) if child.single else F.coalesce("_items", empty)).drop("_items")
    groups: dict[tuple, list[Count | Child]] = {}
    for c in [*(c for c in children if c.max_rows is not None), *counts]:
        alone = isinstance(c, Child) and c.through is not None
        groups.setdefault((id(c),) if alone else (c.table.semanticHash(), c.key), []).append(c)
    for group in groups.values():
        found = counted(group, keys)
        out = out.join(found, out[key] == found["_fk"], "left").drop("_fk")
        for i, c in enumerate(group):
            n = F.coalesce(f"_{i}", F.lit(0).cast("bigint"))
            if isinstance(c, Count):
                out = out.withColumn(c.field, n)
            else:
                cut = n > c.max_rows
                out = out.withColumns({f"{c.field}_truncated": F.when(cut, F.lit(True)), f"{c.field}_total": F.when(cut, n)})
        out = out.drop(*(f"_{i}" for i in range(len(group))))
    return out


def attach(parents: DataFrame, key: str, child: Child) -> DataFrame:
    """``parents`` with one collection."""
    return attach_all(parents, key, [child], [])


def attach_count(parents: DataFrame, key: str, name: str, table: DataFrame, fk: str, where: str | None = None) -> DataFrame:
    """``parents`` with one count."""
    return attach_all(parents, key, [], [Count(name, table, fk, where)])


def affected(changes: DataFrame, fk: str, before_fk: str | None = None, through: Through | None = None, present: DataFrame | None = None) -> DataFrame:
    """The distinct parent keys (``key``) that changed child rows name, by their new and their old foreign key.

    ``through`` resolves child keys over a junction; keys in ``present`` (``key``) need no refresh.
    """
    keys = F.array_distinct(F.array(F.col(q(fk)), F.col(q(before_fk)))) if before_fk else F.array(F.col(q(fk)))
    named = changes.select(F.explode(keys).alias("key")).where(F.col("key").isNotNull()).distinct()
    if through:
        junction = through.table.select(F.col(q(through.parent_key)).alias("_p"), F.col(q(through.child_key)).alias("_c"))
        named = junction.join(named, junction["_c"] == named["key"], "left_semi").select(F.col("_p").alias("key")).distinct()
    return named if present is None else named.join(present, "key", "left_anti")


def refetch(snapshot: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The present rows of the named keys."""
    return snapshot.join(keys, snapshot[key] == keys["key"], "left_semi")


def collection_report(child: Child) -> DataFrame:
    """How many parents have more children than are kept, and which has the most (key and number)."""
    most = 1 if child.single else child.max_rows or 2**31 - 1
    return counted([child]).agg(F.count_if(F.col("_0") > most).alias("cut_parents"), F.max_by("_fk", F.struct("_0", "_fk")).alias("largest"), F.max("_0").alias("largest_total"))
