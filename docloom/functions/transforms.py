"""Named column transforms: redact, hash, json, split, number, date, lookup and pseudonym.

NULL stays NULL. A value that can't be converted is kept as it is and counted (``Applied.unconverted`` is true for its
row); for a protective transform it becomes ``***`` instead. All but ``pseudonym`` are built-in expressions.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .siv import Siv

REDACTED = "***"


@dataclass(frozen=True)
class Applied:
    """The new value, and whether the row's value could not be converted."""

    value: Column
    unconverted: Column


@dataclass(frozen=True)
class Transform:
    """One configured transform: its kind and parameters."""

    kind: str
    by: str = ","
    from_: str = ""
    map: dict[str, str] = field(default_factory=dict)
    default: str | None = None
    key_env: str = ""
    scope: str | None = None

    def apply(self, value: Column, kind: T.DataType, where: str) -> Applied:
        """``where`` is ``schema.table.column``, the default scope of a pseudonym."""
        out = getattr(self, f"_{self.kind}")(value, kind, where)
        return Applied(F.when(value.isNotNull(), out.value), value.isNotNull() & F.coalesce(out.unconverted, F.lit(False)))

    def _redact(self, value: Column, kind: T.DataType, where: str) -> Applied:
        return Applied(F.lit(REDACTED), F.lit(False))

    def _hash(self, value: Column, kind: T.DataType, where: str) -> Applied:
        return Applied(F.substring(F.sha2(json_text(value, kind), 256), 1, 16), F.lit(False))

    def _json(self, value: Column, kind: T.DataType, where: str) -> Applied:
        if not isinstance(kind, T.StringType):
            return Applied(value, F.lit(False))
        parsed = F.try_parse_json(value)
        return Applied(F.coalesce(parsed, F.parse_json(quoted(value))), parsed.isNull())

    def _split(self, value: Column, kind: T.DataType, where: str) -> Applied:
        if isinstance(kind, T.ArrayType):
            return Applied(value, F.lit(False))
        return Applied(pieces(value.cast("string"), self.by), F.lit(not isinstance(kind, T.StringType)))

    def _number(self, value: Column, kind: T.DataType, where: str) -> Applied:
        """An integer where the text is one of 64 bits, else a finite double, as a struct of which one is set."""
        if isinstance(kind, T.NumericType):
            return Applied(F.struct(value.try_cast("bigint").alias("integer"), value.cast("double").alias("number")), F.lit(False))
        text = F.trim(value.cast("string"))
        integer = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
        number = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
        finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
        return Applied(F.struct(integer.alias("integer"), finite.alias("number")), integer.isNull() & finite.isNull())

    def _date(self, value: Column, kind: T.DataType, where: str) -> Applied:
        text = F.trim(value.cast("string"))
        return Applied(F.coalesce(iso_date(text, self.from_), value.cast("string")), iso_date(text, self.from_).isNull())

    def _lookup(self, value: Column, kind: T.DataType, where: str) -> Applied:
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            hit = F.lit(None).cast("string")
        else:
            pairs = [F.lit(x) for kv in self.map.items() for x in kv]
            hit = F.try_element_at(F.create_map(*pairs), value.cast("string")) if pairs else F.lit(None).cast("string")
        rest = F.lit(self.default) if self.default is not None else value.cast("string")
        return Applied(F.coalesce(hit, rest), hit.isNull())

    def _pseudonym(self, value: Column, kind: T.DataType, where: str) -> Applied:
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            return Applied(F.lit(REDACTED), F.lit(True))
        return Applied(pseudonym(self.key_env, self.scope or where)(value.cast("string")), F.lit(False))


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.to_json(F.struct(text.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)


def json_text(value: Column, kind: T.DataType) -> Column:
    """The JSON rendering of a value: quoted text, bare numbers, objects with sorted keys."""
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, (T.StringType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quoted(value.cast("string"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.parse_json(F.to_json(value)))
    return value.cast("string")


def pieces(text: Column, by: str) -> Column:
    """A delimited text's pieces, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\\Q" + by.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda x: F.trim(x)), lambda x: x != "")


# Strptime directives and the Java pattern letters for them.
DIRECTIVES = {
    "%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%e": "d", "%z": "xx", "%:z": "xxx", "%f": "SSSSSSSSS", "%.f": "[.SSSSSSSSS]",
    "%T": "HH:mm:ss", "%R": "HH:mm", "%F": "yyyy-MM-dd", "%D": "MM/dd/yy", "%%": "%",
}
OFFSETS = ("%z", "%:z")
TIMES = ("%H", "%I", "%T", "%R")


def java_pattern(strptime: str) -> str:
    """The Java date pattern of a strptime format."""
    out = []
    for part in re.findall(r"%(?::z|\.f|.)|[A-Za-z]+|'|.", strptime):
        if part.startswith("%"):
            if part not in DIRECTIVES:
                raise ValueError(f"unsupported date directive {part}")
            out.append(DIRECTIVES[part])
        else:
            out.append("''" if part == "'" else f"'{part}'" if part.isalpha() else part)
    return "".join(out)


def iso_date(text: Column, strptime: str) -> Column:
    """ISO text of a date, time or offset time; null if it doesn't parse. An offset stays as it was written."""
    pattern = F.lit(java_pattern(strptime))
    moment = F.try_to_timestamp(text, pattern)
    if any(z in strptime for z in OFFSETS):
        # parsing normalises the offset away: read it from the text, and shift the moment back to it
        shown = F.regexp_extract(text, r"([+-][0-9]{2}):?([0-9]{2})\s*$", 1)
        minutes = F.regexp_extract(text, r"([+-][0-9]{2}):?([0-9]{2})\s*$", 2)
        seconds = (F.abs(shown.try_cast("int")) * 60 + minutes.try_cast("int")) * 60 * F.when(shown.startswith("-"), -1).otherwise(1)
        local = F.date_format(F.timestamp_seconds(F.unix_seconds(moment) + seconds), "yyyy-MM-dd'T'HH:mm:ss")
        return F.concat(local, shown, F.lit(":"), minutes)
    if any(t in strptime for t in TIMES):
        return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.date_format(moment, "yyyy-MM-dd")


def pseudonym(key_env: str, scope: str):
    """A vectorised function from texts to tokens under the key in an environment variable (128 hex digits)."""
    named = os.environ.get(key_env)
    if named is None:
        raise ValueError(f"no key in {key_env}")
    key = bytes.fromhex(named)
    Siv(key)

    @F.pandas_udf("string")
    def tokens(texts: pd.Series) -> pd.Series:
        siv = Siv(key)
        some = texts.dropna().unique().tolist()
        return texts.map(dict(zip(some, siv.tokens(scope, some), strict=True)))

    return tokens
