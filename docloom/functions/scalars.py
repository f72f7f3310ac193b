"""Scalar conversions at the source's and the target's edge, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import json_text

EPOCH_2000 = 946_684_800  # seconds from 1970 to 2000


def content_id(schema: T.StructType) -> Column:
    """An id of a row without key: 32 hex digits of SHA-256 over its JSON with sorted keys and nulls shown."""
    fields = sorted(schema.fields, key=lambda f: f.name)
    shown = [F.concat(F.lit(f'"{f.name}":'), F.coalesce(json_text(F.col(f"`{f.name}`"), f.dataType), F.lit("null"))) for f in fields]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")), 256), 1, 32)


def position_text(position: Column) -> Column:
    """A log position as ``HI/LO`` in upper-case hex."""
    return F.concat(F.hex(F.shiftrightunsigned(position, 32)), F.lit("/"), F.hex(position.bitwiseAND(F.lit(0xFFFFFFFF))))


def position_of(text: Column) -> Column:
    """The number of a ``HI/LO`` text; null if it is none."""
    part = lambda i: F.conv(F.regexp_extract(text, "^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$", i), 16, 10).try_cast("bigint")
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), F.shiftleft(part(1), 32).bitwiseOR(part(2)))


def file_token(index: Column, offset: Column) -> Column:
    """A binlog file's number and an offset in it as one growing number."""
    return F.shiftleft(index.cast("bigint"), 32).bitwiseOR(offset.cast("bigint"))


def file_token_text(token: Column, base: str = "binlog") -> Column:
    return F.concat(F.lit(f"{base}."), F.lpad(F.shiftrightunsigned(token, 32).cast("string"), 6, "0"), F.lit(":"), token.bitwiseAND(F.lit(0xFFFFFFFF)).cast("string"))


def external_version(version: Column) -> Column:
    """A usable version: positive; 0 and below mean unversioned."""
    return F.when(version > 0, version)


def generation_base(generation: Column) -> Column:
    """What is added to versions after a failover, so that a new server's positions come later."""
    return F.when(generation > 0, F.shiftleft(generation.cast("bigint"), 40)).otherwise(F.lit(0))


def reject_id(index: Column, id: Column) -> Column:
    """A reject's own id: its index and id, with all but letters, digits, ``-`` and ``_`` as ``_``."""
    return F.regexp_replace(F.concat_ws("-", index, id), "[^A-Za-z0-9_-]", "_")


def fresh_index_name(index: str, epoch: int) -> str:
    """The name to rebuild an index under; an earlier epoch at its end is replaced."""
    return f"{re.sub(r'-[0-9]{9,}$', '', index)}-{epoch}"


def commit_latency_us(commit_us_2000: Column, now: Column) -> Column:
    """Microseconds from a commit (counted from 2000) to ``now``."""
    return F.unix_micros(now) - (commit_us_2000 + F.lit(EPOCH_2000 * 1_000_000))


def document_bytes(schema: T.StructType) -> Column:
    """About how large a row's document is."""
    return F.length(F.to_json(F.struct(*(F.col(f"`{f}`") for f in schema.names))))


def base64_of_hex(text: Column) -> Column:
    r"""``\x…`` bytes as base64."""
    return F.base64(F.unhex(F.substring(text, 3, 2_000_000_000)))


def enum_label(labels: list[str], ordinal: Column) -> Column:
    """The label of an ordinal from 1; 0 is the empty label."""
    return F.when(ordinal == 0, F.lit("")).otherwise(F.get(F.array(*map(F.lit, labels)), ordinal.cast("int") - 1))


def set_labels(labels: list[str], mask: Column) -> Column:
    """The labels of a bit mask, lowest bit first."""
    bits = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(1 << i).cast("bigint").alias("bit")) for i, x in enumerate(labels)))
    return F.transform(F.filter(bits, lambda x: mask.bitwiseAND(x["bit"]) != 0), lambda x: x["label"])


def bit_number(data: Column) -> Column:
    """Up to 8 big-endian bytes as an unsigned number."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def array_items(text: Column) -> Column:
    """The items of a flat array literal ``{a,"b c",NULL}``: an unquoted NULL is null, a quoted one is text."""
    found = F.regexp_extract_all(F.substring(text, 2, 2_000_000_000), F.lit(r'("(?:[^"\\]|\\.)*"|[^,{}"]+)(?=[,}])'), F.lit(1))
    bare = lambda x: F.regexp_replace(F.substring(x, 2, 2_000_000_000).substr(F.lit(1), F.length(x) - 2), r"\\(.)", "$1")
    return F.transform(found, lambda x: F.when(x.startswith('"'), bare(x)).when(F.upper(x) != "NULL", x))


def json_number(value: Column, kind: T.DataType) -> Column:
    """A number as a document holds it: decimals as text, a float that is no finite number fails the query."""
    if isinstance(kind, T.DecimalType):
        return value.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("a float that JSON can't hold")).cast("double")).otherwise(value)
    return value


def truncated_table(statement: Column) -> Column:
    """The table of a TRUNCATE or DROP TABLE statement, without quotes; null for other statements."""
    name = F.regexp_extract(statement, r"(?is)^\s*(?:TRUNCATE(?:\s+TABLE)?|DROP\s+TABLE(?:\s+IF\s+EXISTS)?)\s+((?:`[^`]+`|[\w$]+)(?:\.(?:`[^`]+`|[\w$]+))?)\s*;?\s*$", 1)
    return F.when(name != "", F.regexp_replace(name, "`", ""))
