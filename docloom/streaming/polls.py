"""Views over tables without a change log: what lies past a watermark is read and merged, poll by poll.

The watermark is the largest value of the view's ``poll_column`` that was taken in, compared by the column's type. It
becomes visible together with the documents that it stands for, so a poll that failed is done again whole. A page never ends
within rows of one value. Rows that share the watermark's value are read again when their number has changed, as some may
have come later. Rows without a value and hard deletes can't be seen; ``soft_delete`` names rows that are to go.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.store import Store
from docloom.plans import admin
from docloom.plans.config import View, documents
from docloom.sources.changelog import log_rows
from docloom.sources.readers import polled


def as_text(value: Column, kind: T.DataType) -> Column:
    """A watermark as text; timestamps as microseconds, which no time zone changes."""
    return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")


def from_text(text: str, kind: T.DataType) -> Column:
    return F.timestamp_micros(F.lit(int(text))) if isinstance(kind, T.TimestampType) else F.lit(text).cast(kind)


def watermark(view: View, store: Store) -> dict | None:
    """``at``, the value taken in last, as text, and ``ties``, how many rows had it; None before the first poll."""
    return store.note(f"poll-{view.schema}.{view.table}")


def poll(view: View, tables: dict[str, DataFrame], store: Store, plan: Callable[[DataFrame], DataFrame], page: int | None = None, max_rejects: int | None = None) -> bool:
    """Take in what is new of a table, or of that the first ``page`` rows; whether there was anything.

    The first poll loads the rows as they are, later ones go through ``plan`` as changes, so a row that left the view's
    filter is deleted. Both write without versions: what is polled last stands.
    """
    name, known = view.poll_column, watermark(view, store)
    table, column = tables[view.table], F.col(name)
    kind = table.schema[name].dataType
    rows = fresh = table.where(column.isNotNull())
    ties = 0
    if known:
        since = from_text(known["at"], kind)
        rows, fresh = rows.where(column >= since), rows.where(column > since)
        ties = rows.where(column == since).count()
    values = fresh.select(name)
    if page is not None:
        values = values.orderBy(name).limit(page)
    end = values.agg(as_text(F.max(name), kind).alias("end")).first()["end"]
    again = known is not None and ties != known["ties"]
    if end is None and not again:
        return False
    end = known["at"] if end is None else end
    last = from_text(end, kind)
    # counted before the rows are read: a row that comes in between is read now, and once more by the next poll
    note = {"at": end, "ties": rows.where(column == last).count()}
    taken = (rows if again else fresh).where(column <= last)
    room = store.room()
    if known is None:
        ops = admin.as_operations(documents(view, tables, taken), store, None)
    else:
        changes = polled(taken, name, view.soft_delete).orderBy("position").withColumn("seq", F.monotonically_increasing_id())
        ops = plan(store.stage(log_rows(changes, view.schema, view.table), room))
    store.apply(ops, stream=f"poll-{view.schema}.{view.table}", max_rejects=max_rejects, notes={f"poll-{view.schema}.{view.table}": note})
    store.leave(room)
    return True


def follow(views: list[View], tables: Callable[[], dict[str, DataFrame]], store: Store, plan: Callable[[], Callable[[DataFrame], DataFrame]], page: int | None = None, every: float | None = None, max_rejects: int | None = None, pause: Callable[[float], None] = time.sleep) -> int:
    """Poll all views that have a ``poll_column`` until none has anything new; with ``every``, go on after so many seconds. The number of pages taken in."""
    views, pages = [v for v in views if v.poll_column], 0
    while True:
        found = sum(poll(v, tables(), store, plan(), page, max_rejects) for v in views)
        pages += found
        if not found:
            if every is None:
                return pages
            pause(every)
