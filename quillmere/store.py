"""Stored tables that are changed in part: rows lie in buckets of a key's hash, and a commit names the files of each.

A commit is one small file that lists, table by table, the data files of every bucket. Writers prepare new data files
first and then publish a commit, over as many tables as they changed, by a rename that fails if the version is taken;
so readers see all of a commit or nothing of it, and go on reading the version they began with. A writer that finds
its version taken looks at what was committed since: if none of the buckets that it read and wrote anew have changed,
its files are published on top, else it gets a Conflict and may begin again.

A merge reads and writes anew only the buckets that its rows fall in; an append writes files beside the others.
`rename` excludes a second writer where the file system's own rename does (HDFS does; the local one checks first, so two
processes in the same millisecond could both pass).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.merge import insert_or_ignore, upsert
from .tables import sent

BUCKETS = 16


@dataclass(frozen=True)
class Layout:
    """A table's schema, what its rows are told apart by, and the columns whose hash names a row's bucket; or one column that
    has the bucket's number itself."""

    schema: str
    keys: tuple[str, ...]
    by: tuple[str, ...]
    buckets: int = BUCKETS
    numbered: bool = False

    def bucket(self) -> Column:
        if self.numbered:
            return F.col(self.by[0]).cast("int")
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def bucket_of(self, spark: SparkSession, rows: Iterable[tuple]) -> list[int]:
        """Buckets of a few values of `by`, for lookups."""
        kinds = {f.name: f for f in T.StructType.fromDDL(self.schema).fields}
        few = spark.createDataFrame([tuple(r) for r in rows], T.StructType([kinds[c] for c in self.by]))
        return sorted({r[0] for r in few.select(self.bucket()).collect()})


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since."""


@dataclass
class Snapshot:
    """One version of all tables; what is read from it stays the same whatever is committed meanwhile."""

    store: Store
    version: int
    tables: dict[str, list[list]] = field(default_factory=dict)  # of [bucket, file]
    facts: dict = field(default_factory=dict)

    def files(self, name: str, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        return [f for b, f in self.tables.get(name, []) if wanted is None or b in wanted]

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or those of its buckets, without reading files of others. Columns that were added to the layout since a
        file was written are null."""
        spark, schema = self.store.spark, self.store.layouts[name].schema
        files = [f"{self.store.folder}/{f}" for f in self.files(name, buckets)]
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


class Store:
    def __init__(self, spark: SparkSession, folder: str, layouts: dict[str, Layout]):
        self.spark, self.folder, self.layouts = spark, folder.rstrip("/"), layouts
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        at = self._path("commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _get(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        stream = self.fs.create(self._path(name), False)
        stream.write(json.dumps(value).encode())
        stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last version, or an earlier one that is still there."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if not version:
            return Snapshot(self, 0)
        held = self._get(f"commits/{version:012d}.json")
        return Snapshot(self, version, {n: self._get(f)["files"] for n, f in held["tables"].items()}, held["facts"])

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def begin(self) -> Transaction:
        return Transaction(self, self.snapshot())

    def _publish(self, version: int, value: dict) -> bool:
        """False if the version is taken."""
        held = f"commits/.{uuid.uuid4().hex}"
        self._put(held, value)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(held), self._path(f"commits/{version:012d}.json"), none)
        except Exception as e:  # py4j wraps the file system's own
            self.fs.delete(self._path(held), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def vacuum(self, keep: int = 10, older_than: float = 86_400.0) -> int:
        """Delete commits but the last `keep`, and files that only these named or that a lost writer left, of at least
        so many seconds; return how many files went. Readers of a version have that long to finish."""
        known = self.versions()
        kept = [self.snapshot(v) for v in known[-keep:]]
        named = {f for s in kept for n in s.tables for f in s.files(n)}
        for v in known[:-keep]:
            self.fs.delete(self._path(f"commits/{v:012d}.json"), False)
        gone, root, limit = 0, self._path("data"), 1000 * (time.time() - older_than)
        files = self.fs.listFiles(root, True) if self.fs.exists(root) else None
        while files is not None and files.hasNext():
            one = files.next()
            name = "data/" + one.getPath().toUri().getPath().split(root.toUri().getPath() + "/")[1]
            if name not in named and one.getModificationTime() <= limit:
                gone += bool(self.fs.delete(one.getPath(), False))
        return gone


class Transaction:
    """Changes of several tables, which one commit publishes."""

    def __init__(self, store: Store, base: Snapshot):
        self.store, self.base = store, base
        self.dropped: dict[str, set[int] | None] = {}  # buckets written anew; None: the whole table
        self.added: dict[str, list[list]] = {}
        self.facts: dict = {}

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.base.read(name, buckets)

    def _write(self, name: str, rows: DataFrame) -> None:
        """Rows by bucket; a bucket with very many rows is written by several tasks."""
        layout, place = self.store.layouts[name], f"data/{name}/{uuid.uuid4().hex}"
        columns = [f.name for f in T.StructType.fromDDL(layout.schema).fields]
        dealt = rows.select(*columns).withColumn("bucket", layout.bucket()).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.store.folder}/{place}")
        at = self.store._path(place)
        files, found = self.store.fs.listFiles(at, True), []
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet") and path.getParent().getName().startswith("bucket="):
                bucket = path.getParent().getName()
                found.append([int(bucket[7:]), f"{place}/{bucket}/{path.getName()}"])
        self.added.setdefault(name, []).extend(sorted(found))

    def buckets(self, name: str, *changes: DataFrame) -> list[int]:
        """The buckets in which rows fall, all where their columns do not tell."""
        layout = self.store.layouts[name]
        every = set(range(layout.buckets))
        found: set[int] = set()
        for rows in changes:
            found |= {r[0] for r in rows.select(layout.bucket()).distinct().collect()} if set(layout.by) <= set(rows.columns) else every
        return sorted(found)

    def merge(self, name: str, incoming: DataFrame | None = None, deleted: DataFrame | None = None, sequence: str | None = None, keep_first: tuple[str, ...] = (), insert_only: bool = False, single: bool = False) -> Transaction:
        """Delete rows that match `deleted` (in the columns that it has), then put `incoming` over rows of equal keys
        (insert_only: beside them). Of several incoming rows of a key the last (insert_only: the first) by `sequence` counts;
        without one they must not repeat; rows that are known to be the only ones of their keys (single) are not sorted for that.
        Call once a table."""
        if name in self.dropped:
            raise ValueError(f"{name} is changed already")
        layout = self.store.layouts[name]
        changes = [rows for rows in (incoming, deleted) if rows is not None]
        touched = self.buckets(name, *changes)
        self.dropped[name] = set(touched)
        if not touched:
            return self
        rows = self.base.read(name, touched)
        if deleted is not None:
            match = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in deleted.columns]
            rows = rows.join(sent(deleted.distinct().select(*(F.col(c).alias(f"__{c}") for c in deleted.columns))), match, "left_anti")
        if incoming is not None:
            order = sequence or layout.keys[0]
            if single and not self.base.files(name, touched):
                rows = incoming
            else:
                rows = insert_or_ignore(rows, incoming, list(layout.keys), order) if insert_only else upsert(rows, incoming, list(layout.keys), None if single else order, keep_first)
        self._write(name, rows)
        return self

    def append(self, name: str, rows: DataFrame) -> Transaction:
        """Rows beside what is there, which is neither read nor compared."""
        self.dropped.setdefault(name, set())
        self._write(name, rows)
        return self

    def replace(self, name: str, rows: DataFrame) -> Transaction:
        self.dropped[name] = None
        self._write(name, rows)
        return self

    def add_facts(self, **numbers: int) -> Transaction:
        """Numbers that the commit adds to those kept beside the tables."""
        for k, v in numbers.items():
            self.facts[k] = self.facts.get(k, 0) + v
        return self

    def _over(self, now: Snapshot) -> dict[str, list[list]]:
        """The tables after this commit, on top of a version that may be later than the one read."""
        out = dict(now.tables)
        for name in self.dropped.keys() | self.added.keys():
            gone = self.dropped.get(name, set())
            of = lambda s: sorted(f for b, f in s.tables.get(name, []) if gone is None or b in gone)  # noqa: B023, E731
            if now.version != self.base.version and of(now) != of(self.base):
                raise Conflict(f"{name} was changed by version {now.version}")
            out[name] = [x for x in now.tables.get(name, []) if gone is not None and x[0] not in gone] + self.added.get(name, [])
        return out

    def commit(self, **values) -> int:
        """Publish, and return the version; `values` are set among the facts. Raises Conflict."""
        now = self.base
        while True:
            tables, version = self._over(now), now.version + 1
            states = self.store._get(f"commits/{now.version:012d}.json")["tables"] if now.version else {}
            for name in self.dropped.keys() | self.added.keys():
                states[name] = f"states/{name}-{uuid.uuid4().hex}.json"
                self.store._put(states[name], {"files": tables[name]})
            facts = now.facts | {k: now.facts.get(k, 0) + v for k, v in self.facts.items()} | values
            if self.store._publish(version, {"version": version, "tables": states, "facts": facts}):
                return version
            now = self.store.snapshot()
