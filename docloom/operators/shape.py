"""From row to document: projection, transforms, renames, flattening, constants, join field and fan-out.

The order is part of the contract: filter, then ids, index and routing from the raw row, then fan-out,
projection, transforms, renames, flattening, constants, join field. Absence exists only at the JSON edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.templates import Template, text_of
from docloom.functions.transforms import Transform, pieces


def q(name: str) -> str:
    return f"`{name}`"


def project(df: DataFrame, columns: list[str] | None = None, exclude: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only ``columns``, or all but ``exclude``; ``keep`` stays anyhow."""
    chosen = [c for c in df.columns if c in keep or ((columns is None or c in columns) and c not in (exclude or []))]
    return df.select(*map(q, chosen))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """All renames at once, so two columns can swap; a renamed column displaces one that has its new name."""
    taken = {new for old, new in names.items() if old in df.columns}
    return df.select(*(F.col(q(c)).alias(names.get(c, c)) for c in df.columns if c in names or c not in taken))


def rename_nested(df: DataFrame, field: str, names: dict[str, str]) -> DataFrame:
    """Renames within an array of structs, or within one struct."""
    kind = df.schema[field].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    taken = {new for old, new in names.items() if old in inner.names}
    made = lambda x: F.struct(*(x[n].alias(names.get(n, n)) for n in inner.names if n in names or n not in taken))
    if isinstance(kind, T.ArrayType):
        return df.withColumn(field, F.transform(F.col(q(field)), made))
    return df.withColumn(field, F.when(F.col(q(field)).isNotNull(), made(F.col(q(field)))))


def flatten(df: DataFrame, field: str) -> DataFrame:
    """A single child's fields beside the parent's; an own column of the same name is displaced. An absent child leaves nulls."""
    inner = df.schema[field].dataType.names
    return df.select(*(q(c) for c in df.columns if c != field and c not in inner), *(F.col(f"{q(field)}.{q(n)}").alias(n) for n in inner))


def constants(df: DataFrame, values: dict[str, object], schema: str, table: str) -> DataFrame:
    """Constant fields, in place of columns of their name; ``{schema}`` and ``{table}`` are filled in."""
    shown = {k: v.replace("{schema}", schema).replace("{table}", table) if isinstance(v, str) else v for k, v in values.items()}
    return df.withColumns({k: F.lit(v) for k, v in shown.items()})


def routing(column: str) -> Column:
    """The routing text of a row; null or empty fails the query."""
    shown = text_of(column)
    return F.when(shown != "", shown).otherwise(F.raise_error(F.lit(f"routing column {column} is null, missing or empty")).cast("string"))


def join_field(name: str, parent_id: Column | None = None) -> Column:
    """What a document of a parent-child relation holds: a name and, for children, the parent's id."""
    return F.struct(F.lit(name).alias("name"), (F.lit(None).cast("string") if parent_id is None else parent_id).alias("parent"))


def transform(df: DataFrame, rules: dict[str, Transform], schema: str, table: str) -> DataFrame:
    """Columns transformed; ``_unconverted`` lists those whose value could not be converted."""
    made, failed = {}, []
    for name, rule in rules.items():
        if name in df.columns:
            out = rule.apply(F.col(q(name)), df.schema[name].dataType, f"{schema}.{table}.{name}")
            made[name] = out.value
            failed.append(F.when(out.unconverted, F.lit(name)))
    found = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return df.withColumns({"_unconverted": found, **made})


def fan_out(df: DataFrame, field: str, id: Template, base_id: Column, by: str | None = None) -> DataFrame:
    """One document an element of an array (or of a delimited text, with ``by``), with ``_id`` from the merged element.

    Struct elements merge into the parent and win; others stand under the array's name. A NULL array
    gives the parent itself under its base id, an empty one nothing.
    """
    kind = df.schema[field].dataType
    if by is None and not isinstance(kind, T.ArrayType):
        raise ValueError(f"fan_out column {field} is neither an array nor NULL")
    if by is not None and not isinstance(kind, T.StringType):
        raise ValueError(f"fan_out column {field} is not a text, but by splits a text")
    items = F.col(q(field)) if by is None else pieces(F.col(q(field)), by)
    inner = kind.elementType if by is None else T.StringType()
    whole = F.array(F.struct(F.lit(True).alias("parent"), F.lit(None).cast(inner).alias("item")))
    each = F.transform(items, lambda x: F.struct(F.lit(False).alias("parent"), x.alias("item")))
    rows = df.withColumn("_base", base_id).withColumn("_e", F.explode(F.when(F.col(q(field)).isNull(), whole).otherwise(each)))
    if isinstance(inner, T.StructType):
        own = [c for c in df.columns if c != field and c not in inner.names]
        # fields of the element win; for the parent itself its own columns stay
        merged = [F.when(F.col("_e.parent"), F.col(q(n)) if n in df.columns else F.lit(None)).otherwise(F.col("_e.item")[n]).alias(n) for n in inner.names]
        out = rows.select(*map(q, own), *merged, "_base", F.col("_e.parent").alias("_parent"))
    else:
        out = rows.select(*(q(c) for c in df.columns if c != field), F.col("_e.item").alias(field), "_base", F.col("_e.parent").alias("_parent"))
    shown = F.when(F.col("_parent"), F.col("_base")).otherwise(id.maybe(out.schema))
    return out.withColumn("_id", F.coalesce(shown, F.raise_error(F.lit("fan_out: a column of the id is null")).cast("string"))).drop("_base", "_parent")


def vector_document(df: DataFrame, field: str, size: int) -> DataFrame:
    """Rows with ``_reject``: a reason where the vector has another length or a component that is no number; null vectors pass."""
    v = F.col(q(field))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
    reason = F.when(v.isNull(), None).when(F.size(v) != size, F.concat(F.lit(f"vector of {size} expected, found "), F.size(v).cast("string"))).when(bad, F.lit("a component is no number"))
    return df.withColumn("_reject", reason)
