"""One configuration file as a whole: where its tables, its change log and its store lie, and its views.

    [source]
    tables = "file:///data"            # a folder of <table>.parquet
    changes = "file:///log"            # a folder of change-log files; not needed where every view has a poll_column
    page = 100000                      # rows a poll takes in at most, ties aside; optional
    [store]
    root = "file:///views"
    buckets = 64
    profile = "versioned"
    max_rejects = 100
    [[sync.tables]]
    ...
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.store import Store
from docloom.plans import admin
from docloom.plans.changes import ChangePlan, document_type
from docloom.plans.config import ConfigError, View, from_toml
from docloom.sources.changelog import LOG
from docloom.streaming import apply, polls


@dataclass(frozen=True)
class Project:
    name: str
    views: list[View]
    source: dict
    target: dict

    @staticmethod
    def read(path: str, name: str = "main") -> Project:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = tomllib.loads(text)
        if "tables" not in spec.get("source", {}) or "root" not in spec.get("store", {}):
            raise ConfigError("[source] tables and [store] root are needed")
        return Project(name, from_toml(text), spec["source"], spec["store"])

    def needed(self) -> list[str]:
        """Every table that a view or its related rows are read from."""
        names = [t for v in self.views for t in (v.table, *(c.table for c in v.children), *(c.through_table for c in v.children), *(c.table for c in v.counts)) if t]
        return list(dict.fromkeys(names))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {t: spark.read.parquet(f"{self.source['tables'].rstrip('/')}/{t}.parquet") for t in self.needed()}

    def store(self, spark: SparkSession) -> Store:
        store = Store(spark, self.target["root"], document_type(self.views, self.tables(spark)), self.target.get("profile", "versioned"), self.target.get("buckets", 64))
        store.prepare()
        return store

    def plan(self, spark: SparkSession, store: Store) -> ChangePlan:
        return ChangePlan(self.views, {t: df.schema for t, df in self.tables(spark).items()}, lambda: self.tables(spark), store.doc, store.lookup)

    def start(self, spark: SparkSession, trigger: dict | None = None) -> StreamingQuery:
        """Load what was never loaded, then follow the change log; polled views are left to :meth:`poll`."""
        if "changes" not in self.source:
            raise ConfigError("[source] changes is needed to follow a log")
        store = self.store(spark)
        admin.admit([v for v in self.views if not v.poll_column], self.tables(spark), store, store.position(self.name) or 0)
        changes = apply.read_changes(spark, self.source["changes"], LOG, self.source.get("files_per_batch"))
        return apply.run(changes, store, lambda: self.plan(spark, store), self.name, f"{self.target['root'].rstrip('/')}/check-{self.name}", self.target.get("max_rejects"), trigger)

    def poll(self, spark: SparkSession, every: float | None = None) -> int:
        """Take in what is new in the polled views' tables; the number of pages."""
        store = self.store(spark)
        return polls.follow(self.views, lambda: self.tables(spark), store, lambda: self.plan(spark, store), self.source.get("page"), every, self.target.get("max_rejects"))
