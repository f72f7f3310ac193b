"""A document store in files: buckets by key behind one manifest that is swapped in one rename.

A document's key (index, id, routing) hashes to a bucket. A batch of operations is staged once; the buckets it
touches are merged and written anew, all others keep their files, and the manifest then names the new ones. The manifest
also holds the streams' epochs, positions and open transactions, truncates, aliases and notes, so a batch and all
that belongs to it show at once or not at all, and a repeated batch changes nothing.

A truncate only adds a floor to the manifest: stored documents below it are skipped by readers and left out
when their bucket is next written; later operations below it are dropped when they come.

Replaced files stay for ``grace`` seconds, for readers that began before. One writer at a time. All paths go
through Hadoop's file system, so any store that Spark writes will do.

Profiles: ``versioned`` orders writes by version; ``positional`` takes them as they arrive but truncates at a
position; ``last_write`` has neither, and refuses what it would have to put aside.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.scalars import reject_id
from docloom.functions.templates import matches
from docloom.operators import merge as merging
from docloom.sources.readers import contained

KEY = merging.KEY


@dataclass(frozen=True)
class Profile:
    name: str
    by_version: bool
    at_a_position: bool
    puts_aside: bool


PROFILES = {
    "versioned": Profile("versioned", True, True, True),
    "positional": Profile("positional", False, True, True),
    "last_write": Profile("last_write", False, False, False),
}


class TooManyRejects(RuntimeError):
    """More refused documents than the budget allows."""


def scoped(scope: str | None, doc: T.StructType) -> Column:
    """Whether a stored or written document is of a relation, given as ``field=name``; all are, without a scope."""
    if not scope:
        return F.lit(True)
    field, name = scope.split("=", 1)
    held = F.col("doc")[field]
    held = held["name"] if isinstance(doc[field].dataType, T.StructType) else held.cast("string")
    return F.coalesce(held == name, F.lit(False))


class Store:
    """Documents of one struct type, of any number of indexes."""

    def __init__(self, spark: SparkSession, root: str, doc: T.StructType, profile: str = "versioned", buckets: int = 64, grace: float = 3600.0) -> None:
        self.spark, self.root, self.doc, self.profile, self.grace = spark, root.rstrip("/"), doc, PROFILES[profile], grace
        self.schema = T.StructType([T.StructField(k, T.StringType()) for k in KEY] + [T.StructField("action", T.StringType()), T.StructField("doc", doc), T.StructField("version", T.LongType()), T.StructField("seq", T.LongType())])
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fresh = {"commit": 0, "buckets": buckets, "files": {}, "floors": [], "aliases": {}, "streams": {}, "notes": {}, "retired": []}

    # files ------------------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.fs.Path(name if "://" in name else f"{self.root}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.conf)

    def manifest(self) -> dict:
        """What the store holds now."""
        if not self._system().exists(self._path("manifest")):
            return json.loads(json.dumps(self._fresh))
        stream = self._system().open(self._path("manifest"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        half = self._path(f".manifest.{uuid.uuid4().hex}")
        self._system().mkdirs(half.getParent())
        stream = self._system().create(half, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self.fs.FileContext.getFileContext(half.toUri(), self.conf)
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(half, self._path("manifest"), options)

    def _commit(self, manifest: dict, replaced: list[str] = ()) -> None:
        """Swap the manifest; files replaced longer ago than the grace time go."""
        now = time.time()
        retired = manifest["retired"] + [[p, now] for p in replaced]
        old = [p for p, at in retired if now - at >= self.grace]
        manifest["retired"] = [r for r in retired if now - r[1] < self.grace]
        manifest["commit"] += 1
        self._swap(manifest)
        for p in old:
            self._system().delete(self._path(p), True)

    def room(self) -> str:
        """A name for what one batch stages."""
        return f"staged-{uuid.uuid4().hex}"

    def stage(self, rows: DataFrame, room: str) -> DataFrame:
        """Rows written once, so that a batch is computed once and survives lost executors."""
        path = f"{self.root}/{room}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def leave(self, room: str) -> None:
        self._system().delete(self._path(room), True)

    # documents --------------------------------------------------------------------------------------
    def prepare(self, wanted: T.StructType | None = None) -> list[str]:
        """Make the store if there is none; missing fields of a wanted document type are returned, conflicting ones refused."""
        missing, conflicting = contained(wanted or self.doc, self.doc)
        if conflicting:
            raise ValueError(f"fields of another type: {', '.join(conflicting)}")
        if not self._system().exists(self._path("manifest")):
            self._swap(self.manifest())
        return missing

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(manifest["buckets"])).cast("int")

    def _winners(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Stored operations, tombstones included, less what a truncate took; of some buckets, or all."""
        kind = T.StructType([*self.schema.fields, T.StructField("commit", T.LongType())])
        paths = [p for b, p in manifest["files"].items() if buckets is None or int(b) in set(buckets)]
        rows = self.spark.read.schema(kind).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], kind)
        for pattern, scope, version, _, commit in manifest["floors"]:
            below = F.lit(True) if version is None else F.col("version").isNull() | (F.col("version") <= version)
            rows = rows.where(~((F.col("commit") <= commit) & matches(pattern, F.col("index")) & scoped(scope, self.doc) & below))
        return rows

    def winners(self) -> DataFrame:
        return self._winners(self.manifest()).drop("commit")

    def documents(self, index: str | None = None) -> DataFrame:
        found = merging.documents(self.winners())
        return found if index is None else found.where(F.col("index") == self.named(index))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (index, id, routing and more) with ``doc`` and ``version``, null where there is none; only the buckets named are read."""
        manifest = self.manifest()
        named = [r[0] for r in keys.select(self._bucket(manifest)).distinct().collect()]  # at most as many as there are buckets
        docs = merging.documents(self._winners(manifest, named)).select(*(F.col(k).alias(f"_{k}") for k in KEY), "doc", "version")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
        return keys.join(docs, same[0] & same[1] & same[2], "left").drop(*(f"_{k}" for k in KEY))

    def totals(self) -> DataFrame:
        """(index, n) of all indexes that hold documents."""
        return self.documents().groupBy("index").agg(F.count("*").alias("n"))

    def size(self, index: str) -> int | None:
        """How many documents an index holds; None if there is no such index."""
        return self.documents(index).count() or None

    def page(self, index: str, after: str | None, size: int) -> DataFrame:
        """The next ids in order."""
        rows = self.documents(index).select("id")
        return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(size)

    # operations -------------------------------------------------------------------------------------
    #: Counted of each batch beside rejects, cascades and truncates, in the one pass that looks for those.
    COUNTS = {"operations": "count(*)", "upserts": "count_if(action = 'upsert')", "deletes": "count_if(action = 'delete')", "unversioned": "count_if(version IS NULL)"}

    def apply(self, ops: DataFrame, *, stream: str | None = None, epoch: int | None = None, position: int | None = None, waiting: DataFrame | None = None, max_rejects: int | None = None, notes: dict | None = None) -> bool:
        """Merge a batch: operations ``upsert`` and ``delete``, ``cascade`` (deletes what names ``id`` as its parent in the
        field ``scope``) and ``truncate`` (of the index pattern ``index`` and the relation ``scope``).

        Operations with a ``reject`` reason are put aside first; more than ``max_rejects`` of them in all, or any
        without such a budget, fail the batch. False if the stream's epoch was applied before.
        """
        manifest = self.manifest()
        state = manifest["streams"].setdefault(stream, {}) if stream else {}
        if epoch is not None and epoch <= state.get("epoch", -1):
            return False
        for name in ("reject", "scope"):
            if name not in ops.columns:
                ops = ops.withColumn(name, F.lit(None).cast("string"))
        room = self.room()
        staged = self.stage(ops.select(*self.schema.names, "reject", "scope", self._bucket(manifest).alias("bucket")), room)
        seen = staged.agg(F.count("reject").alias("rejects"), F.count_if(F.col("action") == "cascade").alias("cascades"), F.count_if(F.col("action") == "truncate").alias("truncates"), *(F.expr(x).alias(n) for n, x in self.COUNTS.items())).first()
        if seen["rejects"]:
            self._put_aside(staged.where(F.col("reject").isNotNull()), max_rejects)
        rows = staged.where(F.col("reject").isNull())
        if seen["truncates"]:
            last = rows.where(F.col("action") == "truncate").groupBy("index", "scope").agg(F.max(F.struct("version", "seq")).alias("at"))
            for r in last.collect():  # at most one a configured table
                self._floor(manifest, r["index"], r["scope"], r["at"]["version"], r["at"]["seq"])
        writes = self._above_floors(rows.where(F.col("action").isin("upsert", "delete")), manifest).drop("reject", "scope")
        if seen["cascades"]:
            writes = self.stage(self._cascaded(manifest, rows, writes), room)
        replaced = self._merge(manifest, writes)
        if stream:
            counts = state.get("counts", {})
            state["counts"] = {n: counts.get(n, 0) + k for n, k in (seen.asDict() | {"batches": 1}).items()}
            if epoch is not None:
                state["epoch"] = epoch
            if position is not None:
                state["position"] = max(position, state.get("position") or position)
            if waiting is not None:
                replaced += [state["waiting"]] if state.get("waiting") else []
                state["waiting"] = f"waiting-{uuid.uuid4().hex}"
                waiting.write.parquet(f"{self.root}/{state['waiting']}")
        manifest["notes"] |= notes or {}
        self._commit(manifest, replaced)
        self.leave(room)
        return True

    def _merge(self, manifest: dict, writes: DataFrame) -> list[str]:
        """Write the touched buckets anew; the manifest names them. What they replace is returned."""
        touched = [r["bucket"] for r in writes.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return []
        old = self._winners(manifest, touched).withColumns({"bucket": self._bucket(manifest), "_new": F.lit(0)})
        new = writes.withColumns({"commit": F.lit(manifest["commit"] + 1).cast("long"), "_new": F.lit(1)})
        # one shuffle: the merge's grouping by key is within buckets, and so is the written layout
        both = old.unionByName(new).repartition("bucket").withColumn("seq", F.struct("_new", "seq"))
        best = merging.winners(both, ["bucket", *KEY]) if self.profile.by_version else merging.latest(both, ["bucket", *KEY], F.col("seq"))
        return self._write(manifest, best.withColumn("seq", F.col("seq.seq")), touched)

    def _write(self, manifest: dict, rows: DataFrame, touched: list[int]) -> list[str]:
        name = f"c-{uuid.uuid4().hex}"
        rows.select(*self.schema.names, "commit", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}")
        replaced = [manifest["files"].pop(str(b)) for b in touched if str(b) in manifest["files"]]
        for status in self._system().listStatus(self._path(name)):
            if (part := status.getPath().getName()).startswith("bucket="):
                manifest["files"][part[7:]] = f"{name}/{part}"
        return replaced

    def _cascaded(self, manifest: dict, rows: DataFrame, writes: DataFrame) -> DataFrame:
        """``writes`` with deletes of the children of the cascades' parents, stored or of this batch."""
        held = self._winners(manifest).withColumn("bucket", self._bucket(manifest)).drop("commit").unionByName(writes).where(F.col("action") == "upsert")
        fields = [f.name for f in self.doc.fields if isinstance(f.dataType, T.StructType) and "parent" in f.dataType.names]
        out = writes
        for field in fields:
            gone = rows.where((F.col("action") == "cascade") & (F.col("scope") == field)).groupBy(F.col("index").alias("_index"), F.col("id").alias("_parent")).agg(F.max(F.struct("version", "seq")).alias("_at"))
            hit = held.join(gone, (F.col("index") == F.col("_index")) & (F.col("doc")[field]["parent"] == F.col("_parent")))
            hit = hit.where(F.col("version").isNull() | F.col("_at.version").isNull() | (F.col("version") <= F.col("_at.version")))
            out = out.unionByName(hit.select(*KEY, F.lit("delete").alias("action"), F.lit(None).cast(self.doc).alias("doc"), F.col("_at.version").alias("version"), F.col("_at.seq").alias("seq"), "bucket"))
        return out

    # truncates --------------------------------------------------------------------------------------
    def _floor(self, manifest: dict, pattern: str, scope: str | None, version: int | None, seq: int) -> None:
        version = version if self.profile.at_a_position else None
        for floor in manifest["floors"]:
            if floor[:2] == [pattern, scope]:
                floor[2:] = [None if None in (version, floor[2]) else max(version, floor[2]), seq, manifest["commit"]]
                return
        manifest["floors"].append([pattern, scope, version, seq, manifest["commit"]])

    def _above_floors(self, ops: DataFrame, manifest: dict) -> DataFrame:
        """Operations without those that a truncate came after; a loaded row (seq below 0) of the truncate's own version stays."""
        for pattern, scope, version, seq, commit in manifest["floors"]:
            before = (F.col("seq") >= 0) & (F.col("seq") < seq)
            if version is not None:
                before = F.col("version").isNotNull() & ((F.col("version") < version) | ((F.col("version") == version) & before))
            elif commit != manifest["commit"]:
                continue  # a target without positions knows no later than its own batch
            ops = ops.where(~(matches(pattern, F.col("index")) & scoped(scope, self.doc) & before))
        return ops

    def truncate(self, pattern: str, version: int, scope: str | None = None) -> None:
        """Empty the indexes of a pattern, of documents not newer than ``version``; O(1) in the documents."""
        if scope and not self.profile.at_a_position:
            raise ValueError("this profile truncates whole indexes only")
        manifest = self.manifest()
        self._floor(manifest, pattern, scope, version, 0)
        self._commit(manifest)

    def remove(self, index: str) -> None:
        """Take an index away, with its tombstones; only the buckets that hold it are written."""
        manifest = self.manifest()
        rows = self._winners(manifest).withColumn("bucket", self._bucket(manifest))
        touched = [r["bucket"] for r in rows.where(F.col("index") == index).select("bucket").distinct().collect()]
        kept = self._winners(manifest, touched).where(F.col("index") != index).withColumn("bucket", self._bucket(manifest))
        self._commit(manifest, self._write(manifest, kept.repartition("bucket"), touched) if touched else [])

    # names, streams, notes --------------------------------------------------------------------------
    def named(self, name: str) -> str:
        """The index that an alias names, or the name itself."""
        return self.manifest()["aliases"].get(name, name)

    def name(self, alias: str, index: str) -> None:
        """The alias names that index from now on, in one step."""
        manifest = self.manifest()
        if alias not in manifest["aliases"] and self.size(alias):
            raise ValueError(f"{alias} is an index")
        manifest["aliases"][alias] = index
        self._commit(manifest)

    def position(self, stream: str) -> int | None:
        return self.manifest()["streams"].get(stream, {}).get("position")

    def counts(self, stream: str) -> dict[str, int]:
        """Batches, operations, upserts, deletes, unversioned operations, rejects, cascades and truncates that a stream brought; a repeated batch counts once."""
        return self.manifest()["streams"].get(stream, {}).get("counts", {})

    def applied(self, stream: str, epoch: int) -> bool:
        return epoch <= self.manifest()["streams"].get(stream, {}).get("epoch", -1)

    def waiting(self, stream: str, schema: T.StructType) -> DataFrame | None:
        """Rows of transactions that were open after the last batch."""
        path = self.manifest()["streams"].get(stream, {}).get("waiting")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}") if path else None

    def advance(self, stream: str, position: int) -> None:
        manifest = self.manifest()
        manifest["streams"].setdefault(stream, {})["position"] = position
        self._commit(manifest)

    def note(self, key: str) -> dict | None:
        return self.manifest()["notes"].get(key)

    def set_note(self, key: str, value: dict | None) -> None:
        """Keep a small value by a key; None forgets it."""
        manifest = self.manifest()
        manifest["notes"].pop(key, None)
        if value is not None:
            manifest["notes"][key] = value
        self._commit(manifest)

    # rejects ----------------------------------------------------------------------------------------
    IDENTITY = ("reject_id", "version", "seq")

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}") if self._system().exists(self._path(name)) else None

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        named = others.select(*(F.col(c).alias(f"_{c}") for c in self.IDENTITY)).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.IDENTITY]
        return rows.join(named, same[0] & same[1] & same[2], "left_anti")

    def _put_aside(self, bad: DataFrame, most: int | None) -> None:
        """Append rejects that aren't there yet: a repeated batch neither repeats them nor counts them twice."""
        rows = bad.select(reject_id(F.col("index"), F.col("id")).alias("reject_id"), *self.schema.names, "reject", F.lit(int(time.time())).cast("long").alias("at_epoch")).dropDuplicates(list(self.IDENTITY))
        present = self._table("rejects")
        new = rows if present is None else self._without(rows, present)
        n = new.count()
        if n and (most is None or not self.profile.puts_aside or n + self.rejected().count() > most):
            raise TooManyRejects(f"{n} documents refused")
        if n:
            new.write.mode("append").parquet(f"{self.root}/rejects")

    def rejected(self) -> DataFrame:
        """Documents put aside and not cleared."""
        rows, cleared = self._table("rejects"), self._table("cleared")
        if rows is None:
            kind = T.StructType([T.StructField("reject_id", T.StringType()), *self.schema.fields, T.StructField("reject", T.StringType()), T.StructField("at_epoch", T.LongType())])
            return self.spark.createDataFrame([], kind)
        rows = rows.dropDuplicates(list(self.IDENTITY))
        return rows if cleared is None else self._without(rows, cleared)

    def newest_rejects(self, limit: int) -> tuple[DataFrame, int]:
        """The newest rejects, and how many there are."""
        rows = self.rejected()
        return rows.orderBy(F.desc("at_epoch"), "reject_id").limit(limit), rows.count()

    def clear(self, rejects: DataFrame) -> None:
        rejects.select(*self.IDENTITY).write.mode("append").parquet(f"{self.root}/cleared")

    def retry_rejects(self) -> None:
        """Merge all rejects again at their own versions; they are then cleared."""
        room = self.room()
        rows = self.stage(self.rejected(), room)
        self.apply(rows.select(*self.schema.names))
        self.clear(rows)
        self.leave(room)


def point_id(namespace: str, id):
    """A name-based UUID (version 5) of an id in a namespace, as an expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), id.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))
