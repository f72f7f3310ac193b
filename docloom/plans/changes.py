"""Views compiled to changes: a batch of a change log becomes operations on documents.

The steps and their order: append-only check, completion of columns that the log left out, filter, ids and such from raw
values, then the same shaping as over a snapshot. A row that leaves the filter is a delete. A row's former documents are deleted
one step before its new ones are written, within the same place of the log, so what a change no longer gives goes and
what it still gives stays, without a comparison. Changes of related rows write their parents anew, from the tables as
they now are, at the change's version; parents that changed themselves are not asked for again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.predicate import Predicate
from docloom.operators import changes as ch
from docloom.operators.shape import q
from docloom.plans.config import View, documents, place
from docloom.sources.changelog import decode, of_table

OPERATION = ("index", "id", "routing", "action", "doc", "version", "seq", "scope")
AT = ("_version", "_seq")


def document_type(views: list[View], tables: dict[str, DataFrame]) -> T.StructType:
    """One struct that holds every view's documents; fields of one name and different types are refused."""
    fields: dict[str, T.DataType] = {}
    for v in views:
        for f in documents(v, tables).schema.fields:
            if not f.name.startswith("_") and fields.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"{v.table}: {f.name} is of another type than elsewhere")
    return T.StructType([T.StructField(n, t) for n, t in sorted(fields.items())])


def shaped(docs: DataFrame, doc: T.StructType) -> Column:
    """A document in the store's struct; fields that it doesn't have are null."""
    return F.struct(*((F.col(q(f.name)).cast(f.dataType) if f.name in docs.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in doc.fields))


def operation(action: str, doc: T.StructType, value: Column | None = None, scope: str | None = None) -> list[Column]:
    return [F.lit(action).alias("action"), (F.lit(None).cast(doc) if value is None else value).alias("doc"), F.lit(scope).cast("string").alias("scope")]


def _needed(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(what)).cast("string"))


@dataclass
class ChangePlan:
    """Rules for the changes of some views' tables.

    ``types`` are the tables' row types, ``tables`` gives the tables as they are when a batch is applied,
    ``doc`` is the store's document type and ``lookup`` finds stored documents (index, id, routing) for completion.
    """

    views: list[View]
    types: dict[str, T.StructType]
    tables: Callable[[], dict[str, DataFrame]]
    doc: T.StructType
    lookup: Callable[[DataFrame], DataFrame] | None = None

    def __call__(self, log: DataFrame) -> DataFrame:
        """The operations of a batch of committed log rows, for all views."""
        tables = self.tables()
        truncate, partial = F.when(F.col("kind") == "truncate", F.struct("version", "seq")), F.size("unchanged") > 0
        facts = log.groupBy("schema", "table").agg(F.max(truncate).alias("at"), F.count_if(partial).alias("partial")).collect()  # one row a table
        emptied = {(r["schema"], r["table"]): (r["at"]["version"], r["at"]["seq"]) for r in facts if r["at"]}
        partial = {(r["schema"], r["table"]) for r in facts if r["partial"]}
        made = []
        for view in self.views:
            rows = self._rows(view, log, (view.schema, view.table) in partial)
            made += self._own(view, rows, tables)
            if view.children or view.counts:
                made += self._parents(view, rows, log, tables, emptied)
            if (view.schema, view.table) in emptied:
                made += self._truncated(view, log, *emptied[view.schema, view.table])
        return reduce(DataFrame.unionByName, (m.select(*OPERATION) for m in made))

    def skipped_truncates(self) -> list[str]:
        """Tables whose truncates are not followed, as others' documents are in their index too."""
        return [f"{v.schema}.{v.table}" for v in self.views if self._truncate_scope(v) is False]

    # a table's own rows -----------------------------------------------------------------------------
    def _rows(self, view: View, log: DataFrame, partial: bool) -> DataFrame:
        rows = decode(log, view.schema, view.table, self.types[view.table], view.key)
        if view.append_only:
            rows = ch.append_only(rows)
        rows = self._completed(view, rows) if partial and self.lookup and view.key and not view.fan_out else rows.withColumn("_held", F.lit(None).cast(self.doc))
        return ch.after_filter(rows, view.where) if view.where else rows

    def _former(self, view: View, schema: T.StructType) -> Column:
        """Where the row's document was: by the row before, else by its old key; null where neither tells."""
        images = [(n, schema[n].dataType) for n in ("before", "old_key")]
        first = lambda of: F.coalesce(*(of(n, s) for n, s in images))
        return F.struct(first(view.image_index).alias("index"), first(view.image_id).alias("id"), first(view.image_routing).alias("routing"))

    def _completed(self, view: View, rows: DataFrame) -> DataFrame:
        """Columns left out of an update: from the row's last change in this batch that has them, else from the stored document.

        The latter gives raw columns where it holds them raw; what it holds transformed stays with ``_held``, and in ``unchanged``.
        """
        former, schema = self._former(view, rows.schema), rows.schema["after"].dataType
        left_out = (F.col("op") == "update") & (F.size("unchanged") > 0)
        key = lambda n: F.coalesce(former[n], getattr(view, f"image_{n}")("after", schema))
        held = self.lookup(rows.where(left_out).select("seq", *(key(n).alias(n) for n in ch.KEY))).select("seq", F.col("doc").alias("_held"))
        names = schema.names
        known = [F.when(~F.array_contains("unchanged", n), F.struct(F.col("after")[n].alias("v"))).alias(f"_{i}") for i, n in enumerate(names)]
        states = rows.where(F.col("after").isNotNull()).select(F.col("key").alias("_k"), "seq", F.lit(1).alias("_turn"), *known)
        asks = rows.where(left_out).select(F.coalesce("old_key", "key").alias("_k"), "seq", F.lit(0).alias("_turn"))
        before = Window.partitionBy("_k").orderBy("seq", "_turn").rowsBetween(Window.unboundedPreceding, -1)
        found = states.unionByName(asks, allowMissingColumns=True).select("seq", "_turn", *(F.last(f"_{i}", ignorenulls=True).over(before).alias(f"_{i}") for i in range(len(names))))
        rows = rows.join(held, "seq", "left").join(found.where(F.col("_turn") == 0).drop("_turn"), "seq", "left")
        fields, still = [], F.col("unchanged")
        for i, f in enumerate(schema.fields):
            out, stored = F.array_contains("unchanged", f.name), view.rename.get(f.name, f.name)
            raw = f.name not in view.transform and stored in self.doc.names and self.doc[stored].dataType == f.dataType
            value = F.when(out & F.col(f"_{i}").isNotNull(), F.col(f"_{i}")["v"])
            value = value.when(out, F.col("_held")[stored]) if raw else value
            fields.append(value.otherwise(F.col("after")[f.name]).alias(f.name))
            still = F.when(F.col(f"_{i}").isNotNull(), F.array_remove(still, f.name)).otherwise(still)
        return rows.withColumns({"after": F.when(F.col("after").isNotNull(), F.struct(*fields)), "unchanged": still}).drop(*(f"_{i}" for i in range(len(names))))

    def _written(self, view: View, rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        """Upserts of rows with the columns of the table and ``_version``, ``_seq``, ``_unchanged`` and ``_held``."""
        docs = documents(view, tables, rows, filtered=False, carry=(*AT, "_unchanged", "_held"))
        for column in view.transform:  # a stored value went through its transform when it was written
            name = view.rename.get(column, column)
            if name in docs.columns and name in self.doc.names:
                docs = docs.withColumn(name, F.when(F.array_contains("_unchanged", column), F.col("_held")[name]).otherwise(F.col(q(name))))
        meta = [F.col(f"_{n}").alias(n) for n in ch.KEY]
        return docs.select(*meta, F.col("_version").alias("version"), (F.col("_seq") * 2 + 1).alias("seq"), *operation("upsert", self.doc, shaped(docs, self.doc)))

    def _own(self, view: View, rows: DataFrame, tables: dict[str, DataFrame]) -> list[DataFrame]:
        schema, at = rows.schema, [F.col("version").alias("_version"), F.col("seq").alias("_seq")]
        present = rows.where(F.col("op") != "delete").select("after.*", *at, F.col("unchanged").alias("_unchanged"), "_held")
        made = [self._written(view, present, tables)]
        if view.append_only:
            return made
        gone = [F.col("_version").alias("version"), (F.col("_seq") * 2).alias("seq"), *operation("delete", self.doc)]
        if view.fan_out:
            what = F.raise_error(F.lit(f"{view.table}: a delete of a fanned-out row needs the row before")).cast("boolean")
            former = rows.where(F.col("op").isin("update", "delete")).where(F.when((F.col("op") == "delete") & F.col("before").isNull(), what).otherwise(F.col("before").isNotNull()))
            raw = schema["before"].dataType
            old = place(view, former.select("before.*", *at), raw, AT)
            return [*made, old.select(*(F.col(f"_{n}").alias(n) for n in ch.KEY), *gone)]
        old, after = self._former(view, schema), schema["after"].dataType
        new = {n: getattr(view, f"image_{n}")("after", after) for n in ch.KEY}
        # of a delete, what neither the row before nor the key tells may stand in the row that the filter refused
        told = {n: F.coalesce(old[n], getattr(view, f"image_{n}")("key", schema["key"].dataType), new[n]) for n in ch.KEY}
        moved = (F.col("op") == "update") & ~reduce(lambda a, b: a & b, (told[n].eqNullSafe(new[n]) for n in ch.KEY))
        leaves = rows.where((F.col("op") == "delete") | moved)
        routed = view.routing or (view.join and view.join.parent_key)
        named = [_needed(told["index"], f"{view.table}: the index of a delete can't be told").alias("index"), _needed(told["id"], f"{view.table}: the id of a delete can't be told").alias("id")]
        named.append((_needed(told["routing"], f"{view.table}: the routing of a delete can't be told") if routed else told["routing"]).alias("routing"))
        made.append(leaves.select(*named, *at).select(*ch.KEY, *gone))
        if view.join and not view.join.parent_key:
            fallen = rows.where(F.col("op") == "delete").select(named[0], named[1], F.lit(None).cast("string").alias("routing"), *at)
            made.append(fallen.select(*ch.KEY, F.col("_version").alias("version"), (F.col("_seq") * 2).alias("seq"), *operation("cascade", self.doc, scope=view.join.field)))
        return made

    # parents of changed related rows ----------------------------------------------------------------
    def _parents(self, view: View, own: DataFrame, log: DataFrame, tables: dict[str, DataFrame], emptied: dict) -> list[DataFrame]:
        key, snapshot = view.key[0], tables[view.table]
        named = []

        def changed(table: str, fk: str) -> DataFrame:
            rows = decode(log, view.schema, table, self.types[table], [])
            keys = F.array_distinct(F.array(F.col("after")[fk], F.col("before")[fk]))
            return rows.select(F.explode(keys).alias("_key"), "version", "seq").where(F.col("_key").isNotNull())

        for c in [*view.children, *view.counts]:
            if through := getattr(c, "through_table", None):
                junction = tables[through].select(F.col(q(c.through_parent_key)).alias("_p"), F.col(q(c.through_child_key)).alias("_c"))
                keys = changed(c.table, c.key).groupBy("_key").agg(F.max("version").alias("version"), F.max("seq").alias("seq"))
                named += [junction.join(keys, F.col("_c") == F.col("_key")).select(F.col("_p").alias("_key"), "version", "seq"), changed(through, c.through_parent_key)]
            else:
                named.append(changed(c.table, c.key))
            for t in filter(None, (c.table, through)):
                if (view.schema, t) in emptied:  # every parent lost its collection
                    version, seq = emptied[view.schema, t]
                    named.append(snapshot.select(F.col(q(key)).alias("_key"), F.lit(version).cast("bigint").alias("version"), F.lit(seq).cast("bigint").alias("seq")))
        keys = reduce(DataFrame.unionByName, named).groupBy("_key").agg(F.max("version").alias("_version"), F.max("seq").alias("_seq"))
        mine = own.where(F.col("op") != "delete").select(F.col("after")[key].alias("_key"))
        keys = keys.join(mine, "_key", "left_anti")
        rows = snapshot.join(keys, F.col(q(key)) == F.col("_key")).drop("_key")
        if view.where:
            rows = rows.where(Predicate(view.where).column(snapshot.schema))
        rows = rows.withColumns({"_unchanged": F.array().cast("array<string>"), "_held": F.lit(None).cast(self.doc)})
        return [self._written(view, rows, tables)]

    # truncates --------------------------------------------------------------------------------------
    def _truncate_scope(self, view: View) -> str | None | bool:
        """The relation that a truncate of the table empties, None for whole indexes, False where that would take others' documents."""
        if view.join:
            return f"{view.join.field}={view.join.name}"
        return None if [v for v in self.views if v.index == view.index] == [view] else False

    def _truncated(self, view: View, log: DataFrame, version: int | None, seq: int) -> list[DataFrame]:
        from docloom.functions.templates import Template

        scope = self._truncate_scope(view)
        if scope is False:
            return []
        one = of_table(log, view.schema, view.table, "truncate").where(F.col("seq") == seq).limit(1)
        where = [F.lit(Template.parse(view.index).pattern()).alias("index"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("routing")]
        return [one.select(*where, "version", (F.col("seq") * 2 + 1).alias("seq"), *operation("truncate", self.doc, scope=scope))]
