"""Sharded storage with size-tiered compaction and versioned manifests, on DataFrame functions only.

A store is a folder:

    data/<run>/...parquet     the files of a run: immutable shards
    manifests/<version>.json  one JSON object a version, from 00000001 on: its runs and the table's columns

An arrival is appended as a run of small shards. Compaction puts the runs whose shards have not reached the
target size into tiers (powers of `fan` of their bytes) and merges all runs of a tier once it has `fan` of
them, into files of about the target size, without a shuffle. A version lists the runs that make up the
table. It is committed by one rename that fails if the version is there already: a reader sees a version or
does not, two writers cannot commit the same one, and files of an attempt that failed are never listed.

Defined results: rows are stored as they come, so nulls, empty and very long texts, ties and repeated rows are
read back as often as they were appended, in any order. Rows with a null and with an empty string in the column that
tells arrivals apart are one arrival, as folders of partitions have one name for both. A version is committed by a
rename that fails if it exists, as far as the file system's rename does. Columns may have any names; those that later arrivals add are null in earlier rows. An empty
first arrival makes a version without rows that has its columns; a store without any version cannot be read.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET, FAN = 128 << 20, 4


@dataclass(frozen=True)
class Run:
    name: str
    files: tuple[str, ...]
    n_bytes: int
    rows: int


class Store:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fan: int = FAN):
        self.spark, self.folder, self.target, self.fan = spark, folder.rstrip("/"), target, fan
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        at = self._path(f"{self.folder}/manifests")
        if not self.fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "columns": None, "runs": []}
        stream = self.fs.open(self._path(f"{self.folder}/manifests/{version:08d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(r["name"], tuple(r["files"]), r["n_bytes"], r["rows"]) for r in self._manifest(version)["runs"]]

    def _commit(self, base: int, runs: list[Run], columns: dict | None = None) -> int:
        """Make `runs` version base + 1, unless somebody else has."""
        body = json.dumps({"version": base + 1, "columns": columns or self._manifest(base)["columns"], "runs": [asdict(r) for r in runs]}, indent=1).encode()
        held = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(held, False)
        out.write(bytearray(body))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.getFileSystem(self.conf).getUri(), self.conf)
        context.rename(self.fs.makeQualified(held), self.fs.makeQualified(self._path(f"{self.folder}/manifests/{base + 1:08d}.json")), options)
        return base + 1

    def _listed(self, names: list[str]) -> list[Run]:
        """Files, sizes and rows of runs from their folders. One job reads the footers of all of them for the rows."""
        files: dict[str, list[tuple[str, int]]] = {}
        for name in names:
            at = self._path(f"{self.folder}/data/{name}")
            for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if s.getPath().getName().endswith(".parquet"):
                    files.setdefault(name, []).append((f"data/{name}/{s.getPath().getName()}", s.getLen()))
        if not files:
            return []
        rows = self.spark.read.parquet(*(f"{self.folder}/{f}" for some in files.values() for f, _ in some))
        run = F.element_at(F.split(F.input_file_name(), "/data/"), -1)
        counts: dict[str, int] = {}
        for r in rows.groupBy(F.regexp_replace(run, "/[^/]*$", "").alias("run")).count().collect():  # a row a run
            counts[unquote(r["run"])] = r["count"]
        return [Run(name, tuple(sorted(f for f, _ in some)), sum(n for _, n in some), counts.get(name, 0)) for name, some in files.items()]

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Write arrivals and commit them in one version: one run, or one for each value of column `by` (which is
        kept), all written by one job. Empty arrivals change nothing but a store that has no version yet."""
        batch = uuid.uuid4().hex[:12]
        if by is None:
            arrivals.write.parquet(f"{self.folder}/data/{batch}")
            names = [batch]
        else:
            own = "__run"
            while own in map(str.lower, arrivals.columns):
                own += "_"
            arrivals.withColumn(own, F.col(by)).write.partitionBy(own).parquet(f"{self.folder}/data/{batch}")
            names = sorted(f"{batch}/{s.getPath().getName()}" for s in self.fs.listStatus(self._path(f"{self.folder}/data/{batch}")) if s.isDirectory())
        new = [run for run in self._listed(names) if run.rows]
        now = self._manifest()
        if not new and now["version"]:
            return now["version"]
        known = {} if now["columns"] is None else {f.name: f for f in StructType.fromJson(now["columns"])}
        columns = StructType([*known.values(), *(f for f in arrivals.schema if f.name not in known)])
        return self._commit(now["version"], [*self.runs(now["version"]), *new], columns.jsonValue())

    def tiers(self) -> dict[int, list[Run]]:
        """Open runs (those whose shards are on average under three quarters of the target) by tier."""
        out: dict[int, list[Run]] = {}
        for run in self.runs():
            if run.n_bytes / len(run.files) < 0.75 * self.target:
                out.setdefault(int(math.log(max(run.n_bytes, 1), self.fan)), []).append(run)
        return out

    def compact(self) -> int:
        """Merge tiers until none has `fan` open runs; return the last version."""
        while True:
            full = [runs for _, runs in sorted(self.tiers().items()) if len(runs) >= self.fan]
            if not full:
                return self.version()
            base, merged = self.version(), full[0]
            total = sum(r.n_bytes for r in merged)
            name = uuid.uuid4().hex[:12]
            files = max(1, round(total / self.target))
            self._frame(merged, self._manifest(base)["columns"]).coalesce(files).write.parquet(f"{self.folder}/data/{name}")
            gone = {r.name for r in merged}
            self._commit(base, [*(r for r in self.runs(base) if r.name not in gone), *self._listed([name])])

    def _frame(self, runs: list[Run], columns: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(columns)).parquet(*(f"{self.folder}/{f}" for r in runs for f in r.files))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (default: the last)."""
        runs, columns = self.runs(version), self._manifest(version)["columns"]
        if columns is None:
            raise ValueError("the store is empty")
        return self._frame(runs, columns) if runs else self.spark.createDataFrame([], StructType.fromJson(columns))

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the last `keep` versions lists; return the number of runs deleted. Only to be
        called while no append or compaction is under way."""
        last = self.version()
        live = {f for v in range(max(1, last - keep + 1), last + 1) for r in self.runs(v) for f in r.files}
        gone = {r.name for v in range(1, last - keep + 1) if self.fs.exists(self._path(f"{self.folder}/manifests/{v:08d}.json")) for r in self.runs(v) if not live & set(r.files)}
        for name in gone:
            self.fs.delete(self._path(f"{self.folder}/data/{name}"), True)
        for v in range(1, last - keep + 1):
            self.fs.delete(self._path(f"{self.folder}/manifests/{v:08d}.json"), False)
        return len(gone)
