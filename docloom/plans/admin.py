"""Keeping a view true: load, reconcile, rebuild, resume, reload of rules, status."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import fresh_index_name
from docloom.functions.templates import Template, matches
from docloom.operators.store import Store
from docloom.plans.changes import operation, shaped
from docloom.plans.config import View, documents, with_index
from docloom.sources import readers

LOADED = -1  # the place in the log of rows that aren't from it


def as_operations(docs: DataFrame, store: Store, version: int | None) -> DataFrame:
    """Upserts of loaded documents, in the store's struct; fields that a document lacks are null."""
    return docs.select(*(F.col(f"_{k}").alias(k) for k in ("index", "id", "routing")), *operation("upsert", store.doc, shaped(docs, store.doc)), F.lit(version).cast("long").alias("version"), F.lit(LOADED).cast("long").alias("seq"))


def load(view: View, tables: dict[str, DataFrame], store: Store, version: int | None = None, extra: str | None = None) -> None:
    """Load (again) a table's documents at a version, or those of rows that ``extra`` (SQL) names; nothing is deleted and no position moves.

    ``version`` is the source's position read before the rows: a later delete or truncate wins over them.
    """
    rows = None if extra is None else tables[view.table].where(F.expr(extra))
    store.apply(as_operations(documents(view, tables, rows), store, version))


def load_ranges(view: View, tables: dict[str, DataFrame], store: Store, boundaries: list, version: int | None = None, at_once: int = 1) -> int:
    """Load a table by ranges of its key, ``at_once`` ranges a wave; how many waves this call did.

    Each wave's documents and its progress become visible together, so a load that was stopped goes on where it stood, at
    the version it began with. Other boundaries than those begun with are refused.
    """
    note = f"load-{view.schema}.{view.table}"
    known = store.note(note) or {"version": version, "boundaries": [str(b) for b in boundaries], "done": 0, "finished": False}
    if known["boundaries"] != [str(b) for b in boundaries]:
        raise ValueError(f"{view.table}: a load with other ranges is under way")
    ranges, waves = readers.ranges_of(boundaries), 0
    while known["done"] < len(ranges):
        wave = ranges[known["done"] : known["done"] + at_once]
        part = tables[view.table].where(readers.in_range(view.key[0], wave[0][0], wave[-1][1]))
        known["done"] += len(wave)
        known["finished"] = known["done"] == len(ranges)
        store.apply(as_operations(documents(view, tables, part), store, known["version"]), notes={note: known})
        waves += 1
    return waves


def loaded(view: View, store: Store) -> bool:
    return bool((store.note(f"load-{view.schema}.{view.table}") or {}).get("finished"))


def admit(views: list[View], tables: dict[str, DataFrame], store: Store, version: int) -> list[str]:
    """Load the tables of a configuration that were never loaded, as when one is added to a running stream; their names."""
    new = [v for v in views if not loaded(v, store)]
    for v in new:
        load_ranges(v, tables, store, [], version)
    return [f"{v.schema}.{v.table}" for v in new]


def orphans(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Documents without a live row, by the columns that both sides have (id, or index, id and routing); filtered rows don't count as live."""
    keys = [c for c in ("index", "id", "routing") if c in stored.columns and c in live.columns]
    named = live.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return stored.join(named, same, "left_anti")


def reconcile(view: View, tables: dict[str, DataFrame], store: Store, delete: bool = False) -> tuple[int, int]:
    """(documents scanned, documents without a row in that index under that routing); the latter go, if asked.

    All indexes that the view's template can name are scanned. A view of a join answers for its own relation only.
    """
    pattern = Template.parse(store.named(view.index)).pattern()
    held = store.documents().where(matches(pattern, F.col("index")))
    if view.join:
        held = held.where(F.col("doc")[view.join.field]["name"] == view.join.name)
    stored = held.select("index", "id", "routing")
    live = documents(view, tables).select(F.col("_index").alias("index"), F.col("_id").alias("id"), F.col("_routing").alias("routing"))
    if view.index == pattern:  # an alias's index goes by another name
        live = live.withColumn("index", F.lit(store.named(view.index)))
    gone = orphans(stored, live)
    n = gone.count()
    if delete and n:
        store.apply(gone.select("index", "id", "routing", *operation("delete", store.doc), F.lit(None).cast("long").alias("version"), F.lit(LOADED).cast("long").alias("seq")))
    return stored.count(), n


def verdict(before: int, after: int, loaded: int, append_only: bool = False) -> str:
    """Whether a rebuild holds what its source did: ``exact``, ``within_drift`` (the source moved meanwhile) or ``mismatch``."""
    if append_only:
        return "exact" if before == after == loaded else "within_drift" if loaded <= max(before, after) else "mismatch"
    if before == after:
        return "exact" if loaded == before else "mismatch"
    return "within_drift" if min(before, after) <= loaded <= max(before, after) else "mismatch"


def reindex(view: View, tables: dict[str, DataFrame], store: Store, alias: str, drop_old: bool = False) -> str:
    """Load under a fresh name, compare counts, switch the alias, and drop the old index if asked."""
    if "{" in view.index:
        raise ValueError("an index template can't be rebuilt under one alias")
    old = store.named(alias)
    count = lambda: documents(view, tables).count()
    before = count()
    fresh = fresh_index_name(old, int(time.time()))
    load(with_index(view, fresh), tables, store)
    told = verdict(before, count(), store.size(fresh) or 0, view.append_only)
    if told != "mismatch":
        store.name(alias, fresh)
        if drop_old and old != fresh:
            store.remove(old)
    return told


def resume(checkpoint: tuple[str, int] | None, stream: str, oldest: int, load_finished: bool) -> str:
    """What to do at a start: ``load`` anew, ``continue_load``, or ``stream`` from the checkpoint."""
    if checkpoint is None or checkpoint[0] != stream or checkpoint[1] < oldest:
        return "load"
    return "stream" if load_finished else "continue_load"


def unsafe_edits(old: list[View], new: list[View]) -> list[str]:
    """Edits of rules that a running stream can't take up, as documents written before would stay under the old rule: reload those tables.

    Edits of what a document holds apply to later changes alone and are safe in this sense.
    """
    before = {(v.schema, v.table, v.index): v for v in old}
    found = []
    for v in new:
        was = before.get((v.schema, v.table, v.index))
        at = f"{v.schema}.{v.table}"
        if was is None:
            found.append(f"{at}: a new table or index")
            continue
        for rule in ("key", "id", "where", "routing", "fan_out", "join", "append_only"):
            if getattr(was, rule) != getattr(v, rule):
                found.append(f"{at}: {rule} changed")
    gone = set(before) - {(v.schema, v.table, v.index) for v in new}
    return found + [f"{s}.{t}: no longer written to {i}" for s, t, i in sorted(gone)]


def status(store: Store, stream: str, position: int) -> dict[str, object]:
    """How far a stream has come."""
    acked = store.position(stream)
    return {"acked": acked, "caught_up": acked is not None and acked >= position, "behind": None if acked is None else max(0, position - acked), "rejects": store.rejected().count()}

