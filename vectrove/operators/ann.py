"""Approximate search: inverted lists and an exact look into the nearest ones.

Centroids split space into lists.  The index is the rows themselves, written
once in a folder for each list, so that a search reads the lists nearest to its
query and no others (partition pruning), and ranks what it reads by exact
distance.  Cosine search clusters unit vectors; inner product is turned into a
Euclidean problem by one more coordinate that gives all rows the same length
(Bachrach et al., RecSys 2014).

Centroids are fitted on a sample bounded by SAMPLE_ROWS and SAMPLE_BYTES; every
row is indexed.  How many lists a search reads is measured on the sample: as
many as hold RECALL of the ten nearest of its queries.  Data without clusters
make it read many.  Rows without vector are in a list of their own that every
search reads.  Should a search find fewer than k rows, the exact one answers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrove.functions.distance import norm
from vectrove.operators.search import batch_top_k, top_k
from vectrove.sources import files

#: Rows and bytes of the sample on which centroids are fitted.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 64 << 20
#: Share of the ten nearest that the lists read shall hold, on the sample.
RECALL = 0.97
#: Rows of a data file of the index.
FILE_ROWS = 1 << 20
#: The list of rows without vector.
NO_LIST = -1

_LIST = "__list"


@dataclass
class AnnIndex:
    path: str
    metric: str
    longest: float
    probes: int
    centroids: np.ndarray
    #: Folders of the collection whose rows the index holds.
    covers: list[str]

    def saved(self) -> dict:
        return {"path": self.path, "metric": self.metric, "longest": self.longest, "probes": self.probes, "covers": self.covers}

    @classmethod
    def load(cls, spark: SparkSession, saved: dict) -> AnnIndex:
        centroids = np.array(json.loads(files.read_text(spark, f"{saved['path']}/centroids.json")), dtype=np.float64)
        return cls(saved["path"], saved["metric"], saved["longest"], saved["probes"], centroids, saved["covers"])

    def lists(self, query) -> list[int]:
        """The lists to read for a query, nearest first."""
        if not len(self.centroids):
            return [NO_LIST]
        order = np.argsort(_to_centroids(_queries(self.metric, [query]), self.centroids)[0], kind="stable")
        return [*(int(i) for i in order[: self.probes]), NO_LIST]

    def read(self, spark: SparkSession, schema: T.StructType, lists: list[int]) -> DataFrame:
        held = T.StructType([*schema.fields, T.StructField(_LIST, T.IntegerType())])
        return spark.read.schema(held).parquet(f"{self.path}/rows").where(F.col(_LIST).isin(lists)).drop(_LIST)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length == 0, 1.0, length)


def _stored(metric: str, v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of rows as the centroids see them."""
    if metric == "cosine":
        return _unit(v)
    if metric == "inner_product":
        return np.concatenate([v, np.sqrt(np.maximum(0.0, longest**2 - (v * v).sum(axis=1)))[:, None]], axis=1)
    return v


def _queries(metric: str, q) -> np.ndarray:
    q = np.asarray(q, dtype=np.float64)
    if metric == "cosine":
        return _unit(q)
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1) if metric == "inner_product" else q


def _to_centroids(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less the square of each vector's own length."""
    return (centroids * centroids).sum(axis=1)[None, :] - 2 * (v @ centroids.T)


def _fit(v: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's iterations; a centroid that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centroids = v[rng.choice(len(v), lists, replace=False)]
    for _ in range(rounds):
        nearest = _to_centroids(v, centroids).argmin(axis=1)
        by_list = np.argsort(nearest, kind="stable")
        held, first = np.unique(nearest[by_list], return_index=True)
        centroids = centroids.copy()
        centroids[held] = np.add.reduceat(v[by_list], first, axis=0) / np.diff(np.append(first, len(v)))[:, None]
    return centroids


def _needed(metric: str, raw: np.ndarray, v: np.ndarray, centroids: np.ndarray, recall: float, queries: int = 256, near: int = 10) -> int:
    """How many lists hold ``recall`` of the ten nearest, over queries spread evenly through the sample."""
    asked = np.unique(np.linspace(0, len(v) - 1, min(queries, len(v))).astype(int))
    q = _queries(metric, raw[asked])
    away = _to_centroids(q, v)
    away[np.arange(len(asked)), asked] = np.inf
    closest = np.argsort(away, axis=1, kind="stable")[:, : min(near, max(1, len(v) - 1))]
    place = np.argsort(np.argsort(_to_centroids(q, centroids), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, _to_centroids(v, centroids).argmin(axis=1)[closest], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _listed(centroids: np.ndarray, metric: str, longest: float, at: int):
    """Batches with the number of the nearest centroid as a last column."""

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            lists = np.full(batch.num_rows, NO_LIST, dtype=np.int32)
            known = np.flatnonzero(np.array(column.is_valid()))
            for places in np.array_split(known, max(1, -(-len(known) // 4096))) if len(centroids) else ():
                if len(places):
                    v = np.asarray(column.take(pa.array(places)).flatten().cast(pa.float64())).reshape(len(places), -1)
                    lists[places] = _to_centroids(_stored(metric, v, longest), centroids).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=[*batch.schema.names, _LIST])

    return run


def build_index(rows: DataFrame, metric: str, path: str, covers: list[str] | None = None, vector: str = "vector", lists: int | None = None, recall: float = RECALL, rounds: int = 10, seed: int = 42) -> AnnIndex:
    """Write all rows to ``path`` by list.

    ``lists`` is the square root of the number of rows unless given, and a
    sixteenth of the sample at the most.  A list of many rows is written by
    several tasks, in several files.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(vector).isNotNull())
    n, longest, dimension = known.agg(F.count("*"), F.max(norm(vector)), F.max(F.size(vector))).first()
    longest, centroids, probes = float(longest or 0.0), np.empty((0, 0)), 0
    if n:
        wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dimension))))
        some = known.select(vector) if n <= wanted else known.select(vector).sample(0.95 * wanted / n, seed)
        raw = np.array([r[0] for r in some.limit(wanted).collect()] or [known.first()[vector]], dtype=np.float64)
        v = _stored(metric, raw, longest)
        centroids = _fit(v, max(1, min(lists or int(n**0.5), max(1, len(v) // 16))), rounds, seed)
        probes = _needed(metric, raw, v, centroids, recall)
    schema = T.StructType([*rows.schema.fields, T.StructField(_LIST, T.IntegerType())])
    listed = rows.mapInArrow(_listed(centroids, metric, longest, rows.columns.index(vector)), schema)
    listed.hint("rebalance", _LIST).write.partitionBy(_LIST).option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/rows")
    files.replace_text(spark, f"{path}/centroids.json", json.dumps(centroids.tolist()))
    return AnnIndex(path, metric, longest, probes, centroids, list(covers or []))


def ann_top_k(near: DataFrame, everything: DataFrame, query, k: int, metric: str, vector: str = "vector", id_col: str = "_id") -> DataFrame:
    """The k nearest of ``near``, the rows of the lists to read; of ``everything`` if these are fewer than k."""
    best = top_k(near, query, k, metric, vector, id_col)
    found = best.collect()  # k rows
    if len(found) < k:
        return top_k(everything, query, k, metric, vector, id_col)
    return near.sparkSession.createDataFrame(found, best.schema)


def ann_batch_top_k(index: AnnIndex, queries: DataFrame, lists_of, k: int, query_vector: str = "query", query_id: str = "query_id", block_queries: int = 256) -> DataFrame:
    """query_id, id, distance, rank for every query of a stated set.

    Queries are dealt into blocks by their nearest list, so that a block reads
    few lists; ``lists_of`` gives the rows of the lists that it is told.  A
    query competes with all rows that its block reads.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    schema = T.StructType([*asked.schema.fields, T.StructField(_LIST, T.IntegerType())])
    # A query has no coordinate to fill up: its length is that of the rows as they are.
    sought = index.centroids[:, :-1] if index.metric == "inner_product" and len(index.centroids) else index.centroids
    ordered = asked.mapInArrow(_listed(sought, "cosine" if index.metric == "cosine" else "l2", 0.0, 1), schema).orderBy(_LIST, query_id).drop(_LIST)
    best, block = None, []

    def searched(block):
        lists = sorted({i for row in block for i in index.lists(row[1])})
        part = spark.createDataFrame(block, asked.schema)
        return batch_top_k(part, lists_of(lists), k, index.metric, query_vector, query_id)

    for row in ordered.toLocalIterator():
        block.append(row)
        if len(block) == block_queries:
            best, block = searched(block) if best is None else best.unionByName(searched(block)), []
    if block or best is None:
        best = searched(block) if best is None else best.unionByName(searched(block))
    return best
