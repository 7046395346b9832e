"""Vector top-k: exact by a scan, or approximate by cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, query_similarity
from ..store import Layout, Store, Transaction
from ..tables import cut, scratch, sent
from .catalog import chunk_embeddings, dominant_model


class DimensionError(ValueError):
    pass


class StaleIndex(ValueError):
    """The embeddings have changed since the index was made."""


def top_k(rows: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "id") -> DataFrame:
    """The k rows of highest cosine with one vector, ties to the smaller key; with score. A plan of one scan and
    a top-k in each task. k <= 0 gives none, an empty query is an error."""
    if not query:
        raise DimensionError("empty query vector")
    return rows.withColumn("score", query_similarity(F.col(vector), query)).orderBy(F.desc("score"), key).limit(max(k, 0))


def brute_force(chunks: DataFrame, embeddings: DataFrame, query: list[float], k: int, model: str | None = None) -> DataFrame:
    """Exact top-k chunks of a model (default: the one most embeddings have). Vectors are scored and cut to k
    before they meet the chunks' texts."""
    model = model or dominant_model(embeddings)
    hits = top_k(embeddings.where((F.col("model") == model) & (F.size("vector") > 0)).select(F.col("chunk_id").alias("id"), "vector"), query, k).select("id", "score")
    return chunks.join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id")  # k rows


def add(index: DataFrame, rows: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """With rows added or replaced; all vectors must be as long as those of the index."""
    known = index.select(F.size(vector).alias("n")).first() or rows.select(F.size(vector).alias("n")).first()
    if known and not rows.where(F.coalesce(F.size(vector), F.lit(0)) != known["n"]).isEmpty():
        raise DimensionError(f"vectors must have {known['n']} components")
    return index.join(rows.select(key), key, "left_anti").select(*index.columns).unionByName(rows.select(*index.columns))


def remove(index: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return index.join(ids.select(key), key, "left_anti").select(*index.columns)


def size_and_dims(index: DataFrame, vector: str = "vector") -> tuple[int, int]:
    row = index.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    return row["n"], row["d"] or 0


def build(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """id, vector of the dominant model's non-empty vectors."""
    model = dominant_model(embeddings)
    return chunk_embeddings(chunks, embeddings, model).where(F.size("vector") > 0).select("id", "vector")


#: Vectors and queries that meet in one group of a batch search at most.
SLICE, QUERIES = 20_000, 2_000
#: Products of queries and vectors that a task holds, and vectors multiplied at once where products are exact.
PRODUCTS, PIECE = 1 << 20, 1 << 12


class CellIndex:
    """Vectors dealt to the nearest of `cells` centres; a search reads the `probes` cells nearest the query and
    ranks their vectors exactly. Centres come from k-means on a sample of at most `sample` vectors; every
    vector is in the index.

    It is a stored table with a bucket for each cell, so a search reads the files of its cells only. Adding appends files
    to the cells of the new vectors and removing appends names to a list; each row has the stamp of its batch, so a
    vector that was replaced or removed is passed over until `compact`. Changes are commits: what is open goes on
    with its version, `refresh` takes the last. The commit also keeps the version of the embeddings that the index was made
    from; `open` with a later one raises StaleIndex."""

    def __init__(self, store: Store, key_type: str):
        self.store, self.key_type = store, key_type
        self.refresh()

    def refresh(self) -> CellIndex:
        self.now = self.store.snapshot()
        found = self.now.read("centres").orderBy("cell").collect()
        self.centres = np.array([r["centre"] for r in found], float) if found else np.zeros((0, 0))
        return self

    @staticmethod
    def _store(spark: SparkSession, folder: str, cells: int, key_type: str) -> Store:
        return Store(
            spark,
            folder,
            {
                "centres": Layout("cell int, centre array<double>", ("cell",), ("cell",), 1),
                "rows": Layout(f"id {key_type}, cell int, vector array<double>, stamp string", ("id",), ("cell",), max(cells, 1), numbered=True),
                "gone": Layout(f"id {key_type}, stamp string", ("id", "stamp"), ("id",)),
            },
        )

    @classmethod
    def build(cls, rows: DataFrame, cells: int, key: str = "id", vector: str = "vector", folder: str | None = None, sample: int = 20_000, rounds: int = 8, source_version: int = 0) -> CellIndex:
        """Written to `folder` (default: a new one in the shared folder)."""
        spark = rows.sparkSession
        some = rows.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
        x = _unit(np.array([r[0] for r in some], float)) if some else np.zeros((0, 0))
        centres = x[:cells].copy()
        for _ in range(rounds if some else 0):
            nearest = np.argmax(x @ centres.T, axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, nearest, x)
            there = np.bincount(nearest, minlength=len(centres)) > 0
            centres[there] = _unit(total[there])
        key_type = rows.schema[key].dataType.simpleString()
        store = cls._store(spark, folder or scratch(spark, "cells"), len(centres), key_type)
        dealt = cls._dealt(rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")), centres, uuid.uuid4().hex)
        change = store.begin().replace("rows", dealt).replace("gone", spark.createDataFrame([], store.layouts["gone"].schema))
        change.replace("centres", spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>"))
        change.commit(source_version=source_version, cells=len(centres), dims=int(centres.shape[1]), key_type=key_type)
        return cls(store, key_type)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, source_version: int | None = None) -> CellIndex:
        facts = Store(spark, folder, {}).snapshot().facts
        if source_version is not None and facts.get("source_version", -1) < source_version:
            raise StaleIndex(f"the index was made from version {facts.get('source_version')}, the embeddings have {source_version}")
        return cls(cls._store(spark, folder, facts["cells"], facts["key_type"]), facts["key_type"])

    @staticmethod
    def _dealt(rows: DataFrame, centres: np.ndarray, stamp: str) -> DataFrame:
        @F.pandas_udf("int")
        def nearest_cell(vectors: pd.Series) -> pd.Series:
            return pd.Series(np.argmax(_unit(np.stack(vectors.to_numpy()).astype(float)) @ centres.T, axis=1).astype("int32")) if len(vectors) else pd.Series([], dtype="int32")

        full = rows.where(F.size("vector") > 0)
        return full.select("id", nearest_cell(F.col("vector")).alias("cell"), F.col("vector").cast("array<double>").alias("vector"), F.lit(stamp).alias("stamp"))

    def _bury(self, change: Transaction, ids: DataFrame) -> None:
        old = self._live(change.read("rows"), change.read("gone")).join(sent(ids), "id", "left_semi")
        change.append("gone", cut(old.select("id", "stamp"), "gone"))

    @staticmethod
    def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone.distinct(), ["id", "stamp"], "left_anti")

    def add(self, rows: DataFrame, source_version: int | None = None) -> CellIndex:
        """Add or replace vectors (id, vector); all must be as long as those of the index."""
        if not rows.where(F.coalesce(F.size("vector"), F.lit(0)) != self.now.facts["dims"]).isEmpty():
            raise DimensionError(f"vectors must have {self.now.facts['dims']} components")
        change = self.store.begin()
        new = cut(self._dealt(rows.select("id", "vector"), self.centres, uuid.uuid4().hex), "dealt")
        self._bury(change, new.select("id"))
        change.append("rows", new).commit(**({} if source_version is None else {"source_version": source_version}))
        return self.refresh()

    def remove(self, ids: DataFrame, source_version: int | None = None) -> CellIndex:
        change = self.store.begin()
        self._bury(change, ids.select("id").distinct())
        change.commit(**({} if source_version is None else {"source_version": source_version}))
        return self.refresh()

    def compact(self) -> CellIndex:
        change = self.store.begin()
        change.replace("rows", self._live(change.read("rows"), change.read("gone"))).replace("gone", change.read("gone").limit(0))
        change.commit()
        return self.refresh()

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """Vectors (id, cell, vector) of all cells, or of some, whose files alone are read."""
        return self._live(self.now.read("rows", cells), self.now.read("gone")).select("id", "cell", "vector")

    def _probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(_unit(queries) @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def search(self, query: list[float], k: int, probes: int) -> DataFrame:
        if len(self.centres) and len(query) != self.centres.shape[1]:
            raise DimensionError(f"the index has {self.centres.shape[1]} components")
        cells = self._probed(np.array([query], float), probes)[0].tolist() if len(self.centres) else []
        return top_k(self.rows(cells), query, k)

    def search_many(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, id, score, rank: the k nearest of each query (query_id, query_vector) among the vectors of its `probes`
        nearest cells, ties to the smaller id. Queries meet vectors cell by cell, in slices of about SLICE vectors and
        QUERIES queries, so no group grows with the tables; each group keeps k a query. Queries whose vector is null, empty or
        of another length have no neighbours."""
        key = queries.schema["query_id"].dataType.simpleString()
        out = f"query_id {key}, id {self.key_type}, score double"
        centres, dims = self.centres, self.now.facts["dims"]

        @F.pandas_udf("array<int>")
        def cells_of(vectors: pd.Series) -> pd.Series:
            found = np.argsort(-(_unit(np.stack(vectors.to_numpy()).astype(float)) @ centres.T), axis=1, kind="stable")[:, :probes]
            return pd.Series(found.astype("int32").tolist())

        fit = queries.where(F.size("query_vector") == dims).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        asked = cut(fit.select("query_id", "query_vector", F.explode(cells_of("query_vector")).alias("cell")), "asked")
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # cells of the index at most
        rows = self.rows(wanted)
        count = lambda frame, size, name: sent(cut(frame.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name)), name))
        slices, blocks = count(rows, SLICE, "slices"), count(asked, QUERIES, "blocks")
        numbers = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        left = asked.join(slices, "cell").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("slice", numbers("slices")).select("cell", "slice", "block", "query_id", "query_vector")
        right = rows.join(slices, "cell").join(blocks, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("block", numbers("blocks")).select("cell", "slice", "block", "id", "vector")

        def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return pd.DataFrame({"query_id": asked["query_id"][:0], "id": held["id"][:0], "score": pd.Series([], dtype=float)})
            held = held.sort_values("id", ignore_index=True)
            at, best, scores = best_of(_unit(np.stack(asked.pop("query_vector").to_numpy())), _unit(np.stack(held.pop("vector").to_numpy())), k)
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[at], "id": held["id"].to_numpy()[best], "score": scores})

        by = ["cell", "slice", "block"]
        met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, out)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def best_of(queries: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of held and their product, for the k highest of each query, ties to the smaller row; some queries
    at a time, so that no more than about PRODUCTS products are in memory. A pair's product does not depend on where it
    stands, so equal vectors tie."""
    found, step, k = [], max(1, PRODUCTS // len(held)), min(k, len(held))
    for first in range(0, len(queries) if k > 0 else 0, step):
        some = queries[first : first + step]
        about = some @ held.T
        about[np.isnan(about)] = -np.inf
        least = np.partition(about, len(held) - k, axis=1)[:, len(held) - k] - 1e-9
        for n in range(len(some)):
            near = np.flatnonzero(about[n] >= least[n])
            exact = np.concatenate([(held[near[i : i + PIECE]] * some[n]).sum(axis=1) for i in range(0, len(near), PIECE)])
            order = np.lexsort((near, -exact))[:k]
            found.append((np.full(len(order), first + n), near[order], exact[order]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, (int, int, float)[i]) for i in range(3))


def grouped_top_k(queries: DataFrame, rows: DataFrame, k: int, by: str) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of each query (query_id, query_vector) among those of its
    group `by`, a column of both: a join on the group, then a limit inside each query that works before the
    shuffle."""
    scored = queries.join(rows, by).select("query_id", "id", cosine_similarity(F.col("query_vector"), F.col("vector")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def embed_rows(rows: DataFrame, text: str, provider, batch_size: int = 20) -> DataFrame:
    """With `vector`, from a provider called by the tasks for batches no larger than it takes, in order."""
    limit = max(1, min(batch_size, provider.batch_ceiling()))

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out: list = []
            values = [t or "" for t in part]
            for i in range(0, len(values), limit):
                vectors = provider.embed_batch(values[i : i + limit])
                if len(vectors) != len(values[i : i + limit]):
                    raise ValueError("the provider gave another number of vectors")
                out += vectors
            yield pd.Series(out)

    return cut(rows.withColumn("vector", embed(F.col(text))), "embedded")
