"""The configuration of a view: read from TOML, checked, and compiled to DataFrame expressions."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.predicate import Predicate, PredicateError
from docloom.functions.scalars import content_id, json_number
from docloom.functions.templates import INDEX_NAME, Template, TemplateError, index_name, key_id, matches
from docloom.functions.transforms import Transform, java_pattern, quoted
from docloom.operators import children as related
from docloom.operators import shape


class ConfigError(ValueError):
    """What is wrong with a configuration, all of it."""


@dataclass(frozen=True)
class ChildRule:
    field: str
    table: str
    key: str
    order: list[str] = field(default_factory=list)
    columns: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    where: str | None = None
    max_rows: int | None = None
    single: bool = False
    flatten: bool = False
    rename: dict[str, str] = field(default_factory=dict)
    through_table: str | None = None
    through_parent_key: str | None = None
    through_child_key: str | None = None


@dataclass(frozen=True)
class CountRule:
    field: str
    table: str
    key: str
    where: str | None = None
    op: str = "count"


@dataclass(frozen=True)
class FanOutRule:
    field: str
    id: str
    by: str | None = None


@dataclass(frozen=True)
class JoinRule:
    name: str
    field: str = "join"
    parent_key: str | None = None  # set on children: the column that names the parent
    parent_id: str | None = None  # the parent's id as a template over that column; set by :func:`from_toml`


@dataclass(frozen=True)
class View:
    """The rules of one table."""

    table: str
    index: str
    schema: str = "public"
    key: list[str] = field(default_factory=list)
    id: str | None = None
    where: str | None = None
    columns: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    transform: dict[str, Transform] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    routing: str | None = None
    pipeline: str | None = None
    children: list[ChildRule] = field(default_factory=list)
    counts: list[CountRule] = field(default_factory=list)
    fan_out: FanOutRule | None = None
    join: JoinRule | None = None
    append_only: bool = False
    soft_delete: str | None = None
    poll_column: str | None = None  # read by polls past a watermark on this column, not from a change log

    def doc_id(self) -> Column | None:
        """The id of a document; None for a content id."""
        if self.id:
            return Template.parse(self.id).render()
        return key_id(self.key) if self.key else None

    def image_id(self, image: str, schema: T.StructType) -> Column:
        """The id of a row image (a struct column); null where the image doesn't tell it."""
        if self.id:
            return Template.parse(self.id).maybe(schema, f"{image}.")
        return F.when(F.col(image).isNotNull(), key_id(self.key, f"{image}.")) if set(self.key) <= set(schema.names) else F.lit(None).cast("string")

    def image_index(self, image: str, schema: T.StructType) -> Column:
        template = Template.parse(self.index)
        return template.maybe(schema, f"{image}.") if template.columns else F.lit(self.index)

    def image_routing(self, image: str, schema: T.StructType) -> Column:
        """The routing of a row image: its routing column, or its parent's id."""
        if self.join and self.join.parent_key:
            return Template.parse(self.join.parent_id or f"{{{self.join.parent_key}}}").maybe(schema, f"{image}.")
        return Template.parse(f"{{{self.routing}}}").maybe(schema, f"{image}.") if self.routing else F.lit(None).cast("string")


def from_toml(text: str) -> list[View]:
    """The views of a configuration: ``[[sync.tables]]`` entries."""
    views = []
    for entry in tomllib.loads(text).get("sync", {}).get("tables", []):
        e = dict(entry)
        e["transform"] = {c: Transform(t.pop("op"), from_=t.pop("from", ""), **t) for c, t in ((c, dict(t)) for c, t in e.get("transform", {}).items())}
        e["children"] = [ChildRule(**c) for c in e.get("children", [])]
        e["counts"] = [CountRule(**c) for c in e.get("counts", [])]
        if "fan_out" in e:
            e["fan_out"] = FanOutRule(**e["fan_out"])
        if "join" in e:
            e["join"] = JoinRule(**e["join"])
        views.append(View(**e))
    check(views)
    return [related_ids(v, views) for v in views]


def parent_of(view: View, views: list[View]) -> View | None:
    """The view whose documents are the parents of a join's children: the one of that index without a parent key."""
    return next((v for v in views if v.join and not v.join.parent_key and v.index == view.index and v.join.field == view.join.field), None)


def related_ids(view: View, views: list[View]) -> View:
    """A join's child with its parent's id written by the parent's own rule, over the foreign key."""
    if not view.join or not view.join.parent_key or not (parent := parent_of(view, views)):
        return view
    rule = (parent.id or f"{{{parent.key[0]}}}").replace(f"{{{parent.key[0]}}}", f"{{{view.join.parent_key}}}")
    return replace(view, join=replace(view.join, parent_id=rule))


def check(views: list[View]) -> None:
    """Refuse what can't work, before any data is read; all faults are named at once."""
    faults: list[str] = []
    for v in views:
        at = f"{v.schema}.{v.table}"
        say = lambda x, at=at: faults.append(f"{at}: {x}")
        if not v.index:
            say("no index")
        try:
            if v.index and not Template.parse(v.index).columns and not re.match(INDEX_NAME, v.index):
                say(f"{v.index!r} is no index name")
            if v.id:
                Template.parse(v.id)
            if v.fan_out:
                Template.parse(v.fan_out.id)
                if not Template.parse(v.fan_out.id).columns:
                    say("the id of fan_out names no column, so all elements would be one document")
        except TemplateError as e:
            say(str(e))
        if v.poll_column and v.append_only:
            say("poll_column and append_only together: a row that is polled again would be another document")
        if v.columns is not None and v.exclude:
            say("columns and exclude together")
        if v.columns is not None and not v.columns:
            say("columns is empty")
        for text in [v.where, *(c.where for c in v.children), *(c.where for c in v.counts)]:
            try:
                if text is not None:
                    Predicate(text)
            except PredicateError as e:
                say(f"where: {e}")
        for column, t in v.transform.items():
            if not hasattr(Transform, f"_{t.kind}"):
                say(f"{column}: no transform {t.kind!r}")
            if t.kind == "split" and not t.by:
                say(f"{column}: split by nothing")
            if t.kind == "date":
                try:
                    if not t.from_:
                        say(f"{column}: date needs a format")
                    java_pattern(t.from_)
                except ValueError as e:
                    say(f"{column}: {e}")
            if t.kind == "lookup" and not t.map:
                say(f"{column}: lookup without a map")
            if t.kind == "pseudonym" and not re.fullmatch("[0-9a-fA-F]{128}", os.environ.get(t.key_env, "")):
                say(f"{column}: {t.key_env or 'key_env'} holds no key of 128 hex digits")
            if column in v.exclude or (v.columns is not None and column not in v.columns):
                say(f"{column} is transformed but left out")
            if column in v.key and t.kind not in ("pseudonym", "hash", "redact"):
                say(f"key column {column} is transformed")
        new = list(v.rename.values())
        if len(set(new)) < len(new):
            say("two columns renamed to one name")
        names = [c.field for c in v.children] + [c.field for c in v.counts]
        if len(set(names)) < len(names):
            say("two collections or counts of one name")
        for name in set(names) & set(v.constants):
            say(f"constant {name} is also a collection or count")
        for c in v.children:
            if c.single and c.max_rows is not None:
                say(f"{c.field}: max_rows with single")
            if c.max_rows is not None and c.max_rows < 1:
                say(f"{c.field}: max_rows below 1")
            if c.flatten and not c.single:
                say(f"{c.field}: only a single child can be flattened")
            if c.columns is not None and c.exclude:
                say(f"{c.field}: columns and exclude together")
            if sum(x is not None for x in (c.through_table, c.through_parent_key, c.through_child_key)) in (1, 2):
                say(f"{c.field}: through needs a table and both keys")
        for c in v.counts:
            if c.op != "count":
                say(f"{c.field}: only count is supported")
        if (v.children or v.counts) and len(v.key) != 1:
            say("collections and counts need a key of one column")
        if v.join and not v.join.parent_key and len(v.key) != 1:
            say("a join's parents need a key of one column")
        if v.append_only and v.key:
            say("append_only is for tables without a key")
        if v.join and v.join.parent_key:
            parent = parent_of(v, views)
            if parent is None:
                say("no parents in this index")
            elif parent.id and not Template.parse(parent.id).only_of(parent.key):
                say("the parents' id needs more than their key")
        if v.append_only and (v.id or v.children or v.fan_out):
            say("append_only goes with neither id, children nor fan_out")
        if not v.key and not v.id and not v.append_only:
            say("neither key nor id")
        if v.join and v.fan_out and v.join.parent_key:
            say("fan_out elements can't be children of a join")
        if v.routing and v.join and v.join.parent_key:
            say("routing of a join's child is its parent's id")
    shared: dict[str, list[View]] = {}
    for v in views:
        shared.setdefault(v.index, []).append(v)
    for index in shared:
        try:
            template = Template.parse(index) if index else None
        except TemplateError:
            continue
        for other in shared:
            if template and template.columns and other != index and other and matches(template.pattern(), other):
                faults.append(f"{index} and {other}: one may name the other's index")
    for index, group in shared.items():
        if len(group) > 1 and not all(v.id or v.join for v in group):
            faults.append(f"{index}: tables that share an index need an explicit id or a join")
        if len(group) > 1 and len({(v.schema, v.table) for v in group}) < len(group):
            faults.append(f"{index}: one table twice")
    if faults:
        raise ConfigError("; ".join(faults))


def place(view: View, df: DataFrame, raw: T.StructType, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``_index``, ``_id``, ``_routing`` and ``_join`` from their raw values, and fanned out."""
    meta = {"_index": index_name(view.index), "_pipeline": F.lit(view.pipeline).cast("string")}
    id = view.doc_id()
    id = content_id(raw) if id is None else id
    meta["_routing"] = F.lit(None).cast("string")
    if view.join and view.join.parent_key:
        parent = Template.parse(view.join.parent_id or f"{{{view.join.parent_key}}}").render(what="the parent's id")
        meta |= {"_routing": parent, "_join": shape.join_field(view.join.name, parent)}
    elif view.join:
        meta["_join"] = shape.join_field(view.join.name)
    if view.routing:
        meta["_routing"] = shape.routing(view.routing)
    if not view.fan_out:
        return df.withColumns(meta | {"_id": id})
    return shape.fan_out(df.withColumns(meta), view.fan_out.field, Template.parse(view.fan_out.id), id, view.fan_out.by)


def documents(view: View, tables: dict[str, DataFrame], rows: DataFrame | None = None, filtered: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """The view's documents over a snapshot, or over ``rows`` of it: _index, _id, _routing, _pipeline, the document's fields, _unconverted, _absent.

    ``_absent`` names the fields that a document lacks, which are null here. The columns ``carry`` of ``rows`` are no part of
    the document and stay as they are.
    """
    df = tables[view.table] if rows is None else rows
    if filtered and view.soft_delete:
        df = df.where(~F.coalesce(F.expr(view.soft_delete), F.lit(False)))
    if filtered and view.where:
        predicate = Predicate(view.where)
        predicate.check(df.schema)
        df = df.where(predicate.column(df.schema))
    raw = T.StructType([f for f in df.schema.fields if f.name not in carry])
    if view.children or view.counts:
        if len(view.key) != 1:
            raise ConfigError(f"{view.table}: collections and counts need a key of one column")
        through = lambda c: related.Through(tables[c.through_table], c.through_parent_key, c.through_child_key) if c.through_table else None
        children = [related.Child(c.field, tables[c.table], c.key, c.order, c.columns, c.exclude, c.where, c.max_rows, c.single, through(c)) for c in view.children]
        counts = [related.Count(c.field, tables[c.table], c.key, c.where) for c in view.counts]
        part = rows is not None or (filtered and bool(view.where or view.soft_delete))
        df = related.attach_all(df, view.key[0], children, counts, restrict=part)
    df = place(view, df, raw, carry)
    meta = [c for c in ("_index", "_id", "_routing", "_pipeline", "_join") if c in df.columns]
    extra = [n for c in view.children for n in (c.field, f"{c.field}_truncated", f"{c.field}_total")] + [c.field for c in view.counts]
    df = shape.project(df, view.columns, view.exclude, (*meta, *extra, *carry))
    df = shape.transform(df, view.transform, view.schema, view.table)
    for c in view.children:
        if c.rename:
            df = shape.rename_nested(df, c.field, c.rename)
    df = shape.rename(df, view.rename)
    absent = [F.when(F.col(f"`{c.field}_total`").isNull(), F.array(F.lit(f"{c.field}_truncated"), F.lit(f"{c.field}_total"))) for c in view.children if c.max_rows is not None]
    absent += [F.when(F.col(f"`{c.field}`").isNull(), F.array(*map(F.lit, df.schema[c.field].dataType.names))) for c in view.children if c.flatten]
    none = F.array().cast("array<string>")
    df = df.withColumn("_absent", F.flatten(F.array(*(F.coalesce(a, none) for a in absent))) if absent else none)
    for c in view.children:
        if c.flatten:
            df = shape.flatten(df, c.field)
    df = shape.constants(df, view.constants, view.schema, view.table)
    return df.withColumnRenamed("_join", view.join.field) if view.join else df


def json_value(value: Column, kind: T.DataType) -> Column:
    """A value as a document's JSON holds it: decimals are text, bytes base64, a float that is no finite number fails the query."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), F.coalesce(json_value(value[f.name], f.dataType), F.lit("null"))) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(json_value(x, kind.elementType), F.lit("null")))
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(quoted(k.cast("string")), F.lit(":"), F.coalesce(json_value(value[k], kind.valueType), F.lit("null"))))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.BinaryType):
        return quoted(F.base64(value))
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType):
        return json_number(value, kind).cast("string")
    return F.when(value.isNotNull(), quoted(value.cast("string")))


def as_json(docs: DataFrame, view: View | None = None) -> DataFrame:
    """_index, _id, _routing and the document as JSON with sorted keys: nulls are shown, and what ``_absent`` names is left out.

    With ``view``, a join's parent has its bare name in the join field.
    """
    fields = []
    for f in sorted((f for f in docs.schema.fields if not f.name.startswith("_")), key=lambda f: f.name):
        value = F.col(f"`{f.name}`")
        text = F.coalesce(json_value(value, f.dataType), F.lit("null"))
        if view and view.join and not view.join.parent_key and f.name == view.join.field:
            text = quoted(value["name"])
        text = F.concat(F.lit(f'"{f.name}":'), text)
        fields.append(F.when(~F.array_contains("_absent", f.name), text) if "_absent" in docs.columns else text)
    return docs.select("_index", "_id", "_routing", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json"))


def with_index(view: View, index: str) -> View:
    return replace(view, index=index)
