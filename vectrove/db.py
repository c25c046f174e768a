"""The database: collections in a data folder, searched and queried through Spark."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from vectrove.errors import DimensionMismatch
from vectrove.operators import search as exact
from vectrove.operators.ann import AnnIndex, ann_batch_top_k, ann_top_k, build_index
from vectrove.operators.maintenance import BackgroundCompactor
from vectrove.plans.sqlfront import SqlFront
from vectrove.sources import files
from vectrove.sources.catalog import Catalog
from vectrove.sources.rows import as_query, conform, frame_rows
from vectrove.sources.schema import CREATED, DELETED, ID, VECTOR, CollectionConfig, CompactionConfig, IndexConfig, metric_name
from vectrove.sources.storage import CompactionStats, Storage

#: Rows of un-flushed inserts from which an insert flushes, where it is asked to.
AUTO_FLUSH_ROWS = 100_000


class Database:
    """Opens or creates a data folder.

    Deleted rows are hidden from search at once and from SQL after compaction
    (at once with ``sql_hide_deleted``).  Ids need not be unique; a deleted id
    stays deleted until compaction, even if it is inserted again.
    """

    def __init__(self, data_dir: str, spark: SparkSession | None = None, sql_hide_deleted: bool = False):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.catalog = Catalog(self.spark, str(data_dir))
        self.storage = Storage(self.spark, self.catalog)
        self._front: SqlFront | None = None
        self._hide_deleted = sql_hide_deleted

    # Collections

    def create_collection(self, name: str, dimension: int, distance_metric: str | None = None, metadata_fields: Sequence[tuple[str, str]] | None = None, storage_format: str | None = None, index: IndexConfig | None = None) -> None:
        self.catalog.create(CollectionConfig.make(name, dimension, distance_metric, metadata_fields, storage_format, index))

    def drop_collection(self, name: str) -> None:
        self.catalog.drop(name)

    def list_collections(self) -> list[dict]:
        """By name; every collection's files are Parquet, whatever format was named."""
        configs = [self.catalog.state(n).config for n in self.catalog.names()]
        return [{"name": c.name, "dimension": c.dimension, "distance_metric": c.distance_metric, "metadata_fields": list(c.metadata_fields)} for c in configs]

    def collection_config(self, name: str) -> CollectionConfig:
        return self.catalog.state(name).config

    def collection_schema(self, name: str):
        return self.catalog.state(name).config.schema()

    def dataframe(self, name: str, live_only: bool = True) -> DataFrame:
        return self.storage.live(name) if live_only else self.storage.scan(name)

    # Rows

    def insert(self, collection: str, ids: Sequence[str], vectors, metadata: dict | None = None, auto_flush_rows: int | None = None) -> int:
        config = self.catalog.state(collection).config
        n = self.storage.insert(collection, frame_rows(self.spark, config, ids, vectors, metadata))
        if auto_flush_rows:
            self.storage.maybe_flush(collection, auto_flush_rows)
        return n

    def insert_dataframe(self, collection: str, rows: DataFrame) -> int:
        """Rows with ``_id``, ``vector`` and metadata columns, written by the executors."""
        return self.storage.insert(collection, conform(self.catalog.state(collection).config, rows))

    def delete(self, collection: str, ids: Sequence[str]) -> int:
        """How many ids were newly marked, known to the collection or not."""
        self.catalog.state(collection)
        return self.storage.delete(collection, self.spark.createDataFrame([(i,) for i in ids], "_id string"))

    def flush(self, collection: str) -> None:
        self.storage.flush(collection)

    def compact(self, collection: str) -> dict:
        before, after, removed = self.storage.compact(collection)
        return {"segments_before": before, "segments_after": after, "rows_removed": removed}

    def compaction_stats(self, collection: str) -> CompactionStats:
        return self.storage.stats(collection)

    def start_compactor(self, config: CompactionConfig = CompactionConfig()) -> BackgroundCompactor:
        return BackgroundCompactor(self, config).start()

    # Search

    def search(self, collection: str, query_vector, top_k: int = 10, filter: Column | str | None = None, metric: str | None = None, mode: str = "exact", ef: int | None = None) -> list[dict]:
        """Hits, nearest first: id, distance, metadata (values as text, nulls left out)."""
        fields = [n for n, _ in self.catalog.state(collection).config.metadata_fields]
        rows = self.search_df(collection, query_vector, top_k, filter, metric, mode, ef).collect()
        import numpy as np

        return [{"id": r[ID], "distance": float(np.float32(r["distance"])), "metadata": {f: exact.shown(r[f]) for f in fields if r[f] is not None}} for r in rows]

    def search_df(self, collection: str, query_vector, top_k: int = 10, filter: Column | str | None = None, metric: str | None = None, mode: str = "exact", ef: int | None = None) -> DataFrame:
        """Hits as rows: ``_id``, typed metadata, ``distance``."""
        state = self.catalog.state(collection)
        query = as_query(query_vector)
        if len(query) != state.config.dimension:
            raise DimensionMismatch(state.config.dimension, len(query))
        chosen = metric_name(metric) if metric else state.config.distance_metric
        rows = self.storage.live(collection).drop(CREATED, DELETED)
        if mode == "exact":
            return exact.top_k(rows, query, top_k, chosen, where=filter)
        if mode != "ann":
            raise ValueError(f"unknown search mode: {mode}")
        index = self._index(collection, chosen)
        near = self._listed(collection, index, index.lists(query))
        if filter is not None:
            rows, near = rows.where(filter), near.where(filter)
        return ann_top_k(near, rows, query, top_k, chosen)

    def search_batch(self, collection: str, queries: DataFrame, top_k: int = 10, metric: str | None = None, mode: str = "exact") -> DataFrame:
        """query_id, id, distance, rank for a DataFrame of query_id and query."""
        state = self.catalog.state(collection)
        chosen = metric_name(metric) if metric else state.config.distance_metric
        if mode == "exact":
            return exact.batch_top_k(queries, self.storage.live(collection), top_k, chosen)
        if mode != "ann":
            raise ValueError(f"unknown search mode: {mode}")
        index = self._index(collection, chosen)
        return ann_batch_top_k(index, queries, lambda lists: self._listed(collection, index, lists), top_k)

    def build_index(self, collection: str, metric: str | None = None, **options) -> None:
        """Write the approximate index of a collection, flushed first; flushes keep it, compaction drops it.

        Rows inserted later are searched exactly beside it, until it is built again.
        """
        chosen = metric_name(metric) if metric else self.catalog.state(collection).config.distance_metric
        with self.catalog.lock:
            self.storage.flush(collection)
            state = self.catalog.state(collection)
            path = f"{self.catalog.folder(collection)}/indexes/{chosen}-{uuid.uuid4().hex}"
            index = build_index(self.storage.live(collection).drop(CREATED, DELETED), chosen, path, [p.path for p in state.segments], **options)
            old = state.indexes.get(chosen)
            with self.catalog.change(collection) as draft:
                draft.indexes[chosen] = index.saved()
            if old:
                files.remove(self.spark, old["path"])

    def _index(self, collection: str, metric: str) -> AnnIndex:
        if metric not in self.catalog.state(collection).indexes:
            self.build_index(collection, metric)
        return AnnIndex.load(self.spark, self.catalog.state(collection).indexes[metric])

    def _listed(self, collection: str, index: AnnIndex, lists: list[int]) -> DataFrame:
        """Live rows of the given lists, and all that the index does not hold yet."""
        state = self.catalog.state(collection)
        schema = self.storage.read(state, []).drop(CREATED, DELETED).schema
        rows = index.read(self.spark, schema, lists)
        later = [p for p in [*state.segments, *state.fragments] if p.path not in index.covers]
        if later:
            rows = rows.unionByName(self.storage.read(state, later).drop(CREATED, DELETED))
        return self.storage.without_deleted(state, rows)

    # SQL

    def sql_df(self, query: str, args=None) -> DataFrame:
        if self._front is None:
            self._front = SqlFront(self.spark, self.storage, self._hide_deleted)
        return self._front.query(query, args)

    def sql(self, query: str, args=None) -> pa.RecordBatch:
        """The whole result as one record batch; an empty result has its schema and no rows."""
        table = self.sql_df(query, args).toArrow().combine_chunks()
        batches = table.to_batches()
        return batches[0] if batches else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)

    def sql_stream(self, query: str, args=None, batch_rows: int = 10_000):
        """The result as record batches of at most ``batch_rows`` rows; the driver holds one partition's at a time."""

        def packed(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, batch_rows):
                    part = pa.RecordBatch.from_arrays([c.slice(at, batch_rows) for c in batch.columns], schema=batch.schema)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_pydict({"batch": [sink.getvalue().to_pybytes()]})

        for row in self.sql_df(query, args).mapInArrow(packed, "batch binary").toLocalIterator():
            yield from pa.ipc.open_stream(bytes(row["batch"])).read_all().to_batches()
