"""Data folders of collections: fragments, segments, tombstones.

An insert writes a *fragment*; a flush turns the fragments into one *segment*;
compaction turns everything into one segment without the deleted rows.  Both
write new folders first, commit the catalog, and delete the old folders last.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.sources import files
from vectrove.sources.catalog import Catalog, CollectionState, Part
from vectrove.sources.schema import ID

#: Rows of a data file; a segment of more is several files, so that it can be read in parallel.
FILE_ROWS = 1 << 20
#: Tombstones up to which their table is broadcast.
BROADCAST_TOMBSTONES = 1 << 20

_IDS = "_id string"


@dataclass(frozen=True)
class CompactionStats:
    segments: int
    segment_rows: int
    tombstones: int


class Storage:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    def _write(self, name: str, kind: str, rows: DataFrame) -> Part:
        path = f"{self.catalog.folder(name)}/{kind}/{uuid.uuid4().hex}"
        # Rows are counted while they are written.
        watch = F.count(F.lit(1)).alias("rows")
        from pyspark.sql import Observation

        seen = Observation()
        rows.observe(seen, watch).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        return Part(path, int(seen.get["rows"]))

    def read(self, state: CollectionState, parts: list[Part]) -> DataFrame:
        schema = state.config.schema()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(p.path for p in parts))

    def scan(self, name: str) -> DataFrame:
        """All rows, deleted ones included until compaction."""
        state = self.catalog.state(name)
        return self.read(state, [*state.segments, *state.fragments])

    def tombstones(self, state: CollectionState) -> DataFrame:
        if state.tombstones is None:
            return self.spark.createDataFrame([], _IDS)
        return self.spark.read.schema(_IDS).parquet(state.tombstones.path)

    def without_deleted(self, state: CollectionState, rows: DataFrame) -> DataFrame:
        if state.tombstones is None:
            return rows
        gone = self.tombstones(state)
        return rows.join(F.broadcast(gone) if state.tombstones.rows <= BROADCAST_TOMBSTONES else gone, ID, "left_anti")

    def live(self, name: str) -> DataFrame:
        return self.without_deleted(self.catalog.state(name), self.scan(name))

    def insert(self, name: str, rows: DataFrame) -> int:
        part = self._write(name, "fragments", rows)
        with self.catalog.change(name) as state:
            if part.rows:
                state.fragments.append(part)
        return part.rows

    def delete(self, name: str, ids: DataFrame) -> int:
        """Add ids to the deleted ones; the number of those that were not there yet, known or not."""
        with self.catalog.lock:
            state = self.catalog.state(name)
            held = self.tombstones(state)
            every = held.union(ids.select(F.col(ids.columns[0]).cast("string").alias(ID)).where("_id IS NOT NULL")).distinct()
            part = self._write(name, "tombstones", every)
            before = state.tombstones.rows if state.tombstones else 0
            if part.rows == before:
                files.remove(self.spark, part.path)
                return 0
            old = state.tombstones
            with self.catalog.change(name) as draft:
                draft.tombstones = part
            if old:
                files.remove(self.spark, old.path)
            return part.rows - before

    def flush(self, name: str) -> bool:
        with self.catalog.lock:
            state = self.catalog.state(name)
            if not state.fragments:
                return False
            old = state.fragments
            part = self._write(name, "segments", self._packed(self.read(state, old), sum(p.rows for p in old)))
            with self.catalog.change(name) as draft:
                draft.segments.append(part)
                draft.fragments = []
            self._drop(old)
            return True

    def maybe_flush(self, name: str, max_rows: int) -> bool:
        rows = sum(p.rows for p in self.catalog.state(name).fragments)
        return rows >= max_rows and rows > 0 and self.flush(name)

    def compact(self, name: str) -> tuple[int, int, int]:
        """(segments before, segments after, rows removed); fragments count as one segment, as they are flushed first."""
        with self.catalog.lock:
            self.flush(name)
            state = self.catalog.state(name)
            before, old, gone = len(state.segments), state.segments, state.tombstones
            if not before:
                return 0, 0, 0
            rows = sum(p.rows for p in old)
            part = self._write(name, "segments", self._packed(self.without_deleted(state, self.read(state, old)), rows))
            with self.catalog.change(name) as draft:
                draft.segments = [part] if part.rows else []
                draft.tombstones = None
                draft.indexes = {}
            for index in state.indexes.values():
                files.remove(self.spark, index["path"])
            self._drop([*old, *([gone] if gone else []), *([] if part.rows else [part])])
            return before, len(self.catalog.state(name).segments), rows - part.rows

    def stats(self, name: str) -> CompactionStats:
        state = self.catalog.state(name)
        return CompactionStats(len(state.segments), sum(p.rows for p in state.segments), state.tombstones.rows if state.tombstones else 0)

    def read_by_ids(self, name: str, ids: DataFrame) -> DataFrame:
        """Rows not deleted whose id is among ``ids`` (one column)."""
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias(ID)).distinct()
        return self.scan(name).where("NOT _deleted").join(wanted, ID, "left_semi")

    def read_by_offsets(self, name: str, offsets: list[int], columns: list[str] | None = None) -> DataFrame:
        """Rows of a collection's segments at the given places, counted through the segments in their order."""
        paths = [p.path for p in self.catalog.state(name).segments]
        if not paths:
            raise ValueError(f"collection {name} has no segment")
        return read_by_offsets(numbered(self.spark, *paths), offsets, columns, paths)

    def _packed(self, rows: DataFrame, n: int) -> DataFrame:
        """As many tasks as files are wanted, without a shuffle when there is one: many small files become few."""
        wanted = max(1, -(-n // FILE_ROWS))
        return rows.coalesce(1) if wanted == 1 else rows.repartition(wanted)

    def _drop(self, parts: list[Part]) -> None:
        for p in parts:
            files.remove(self.spark, p.path)


def numbered(spark: SparkSession, *paths: str, schema=None) -> DataFrame:
    """Parquet data sets with ``file`` and ``row_id``, the row's place in its file."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_id"))


def read_by_offsets(numbered_rows: DataFrame, offsets: list[int], columns: list[str] | None = None, folders: list[str] = ()) -> DataFrame:
    """Rows at the given places, with ``ordinal``, their place in the request;
    repeated places give repeated rows, places beyond the end none.

    Places are counted through the files by name (within ``folders``, in that
    order, where given).  Each becomes a file and a row index, which also go to
    the scan as filters.
    """
    import bisect

    spark = numbered_rows.sparkSession
    sizes = numbered_rows.groupBy("file").agg((F.max("row_id") + 1).alias("n")).collect()  # a row a file
    folder = lambda file: next((i for i, f in enumerate(folders) if f.split(":", 1)[-1].lstrip("/").rstrip("/") + "/" in file), -1)
    sizes = sorted((folder(r["file"]), r["file"], r["n"]) for r in sizes)
    starts = [0]
    for *_, n in sizes:
        starts.append(starts[-1] + n)
    places = []
    for ordinal, offset in enumerate(offsets):
        if 0 <= offset < starts[-1]:
            at = bisect.bisect_right(starts, offset) - 1
            places.append((ordinal, sizes[at][1], offset - starts[at]))
    wanted = spark.createDataFrame(places, "ordinal long, file string, row_id long")
    kept = numbered_rows.where(F.col("file").isin(sorted({f for _, f, _ in places})) & F.col("row_id").isin(sorted({r for *_, r in places}))) if places else numbered_rows.limit(0)
    return kept.select(*(columns or [c for c in kept.columns if c not in ("file", "row_id")]), "file", "row_id").join(F.broadcast(wanted), ["file", "row_id"]).drop("file", "row_id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
