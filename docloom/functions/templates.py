"""Templates of document ids, index names and routing: ``orders-{region}``, and patterns of index names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TemplateError(ValueError):
    """A template that can't be used."""


def text_of(column: str | Column) -> Column:
    """The text form of a scalar: text as it is, numbers and booleans rendered."""
    return (F.col(f"`{column}`") if isinstance(column, str) else column).cast("string")


@dataclass(frozen=True)
class Template:
    """Literal parts and columns in turn."""

    parts: tuple[tuple[bool, str], ...]  # (is a column, text)

    @staticmethod
    def parse(spec: str) -> Template:
        parts, at = [], 0
        for m in re.finditer(r"\{([^{}]*)\}", spec):
            parts.append((False, spec[at : m.start()]))
            if not m[1].strip():
                raise TemplateError(f"empty braces in {spec!r}")
            parts.append((True, m[1].strip()))
            at = m.end()
        parts.append((False, spec[at:]))
        if any("{" in text or "}" in text for is_column, text in parts if not is_column):
            raise TemplateError(f"unbalanced braces in {spec!r}")
        parts = [p for p in parts if p[1]]
        if not parts:
            raise TemplateError("an empty template")
        return Template(tuple(parts))

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(text for is_column, text in self.parts if is_column))

    def only_of(self, keys: list[str]) -> bool:
        """Whether a key alone is enough to render it."""
        return set(self.columns) <= set(keys)

    def maybe(self, schema: T.StructType | None = None, prefix: str = "") -> Column:
        """The rendered text; null where a column is null or absent."""
        shown = []
        for is_column, text in self.parts:
            if not is_column:
                shown.append(F.lit(text))
            elif schema is not None and text not in schema.names:
                shown.append(F.lit(None).cast("string"))
            else:
                shown.append(F.col(f"{prefix}`{text}`").cast("string"))
        return F.concat(*shown)

    def render(self, schema: T.StructType | None = None, prefix: str = "", what: str = "id") -> Column:
        """The rendered text; a null or absent column fails the query, as a document can't go without its name."""
        out = self.maybe(schema, prefix)
        return F.coalesce(out, F.raise_error(F.lit(f"{what}: a column of the template is null or missing: {', '.join(self.columns)}")).cast("string"))

    def pattern(self) -> str:
        """The index-name pattern that all rendered names match; neighbouring stars are one."""
        return re.sub(r"\*+", "*", "".join("*" if is_column else text for is_column, text in self.parts))


INDEX_NAME = "^[a-z][a-z0-9_-]*$"


def index_name(spec: str, schema: T.StructType | None = None, prefix: str = "") -> Column:
    """The index a row goes to; a name outside ``[a-z][a-z0-9_-]*`` fails the query."""
    template = Template.parse(spec)
    if not template.columns and not re.match(INDEX_NAME, spec):
        raise TemplateError(f"no index name: {spec!r}")
    name = template.render(schema, prefix, "index")
    return F.when(name.rlike(INDEX_NAME), name).otherwise(F.raise_error(F.concat(F.lit("no index name: "), name)).cast("string"))


def matches(pattern: str, name: str | Column) -> bool | Column:
    """Whether an index name matches a pattern with stars."""
    regex = "^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"
    return bool(re.match(regex, name)) if isinstance(name, str) else name.rlike(regex)


def key_id(keys: list[str], prefix: str = "") -> Column:
    """A document id from the key alone: a single column's text, or sorted ``col=val`` joined by commas."""
    shown = {k: F.coalesce(F.col(f"{prefix}`{k}`").cast("string"), F.lit("__null__" if len(keys) == 1 else "null")) for k in keys}
    if len(keys) == 1:
        return shown[keys[0]]
    return F.array_join(F.array_sort(F.array(*(F.concat(F.lit(f"{k}="), v) for k, v in shown.items()))), ",")


def first_rendered(template: Template, schema: T.StructType, keys: list[str]) -> Column:
    """An id of a changed row whose image may be partial: from the row, else the row before, else the key."""
    ladder = [template.maybe(schema["after"].dataType, "after."), template.maybe(schema["before"].dataType, "before.")]
    if template.only_of(keys):
        ladder.append(template.maybe(schema["pk"].dataType, "pk.") if isinstance(schema["pk"].dataType, T.StructType) else F.concat(*(F.col("pk").getItem(t) if c else F.lit(t) for c, t in template.parts)))
    return F.coalesce(*ladder)
