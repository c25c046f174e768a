"""The catalog: one JSON file that says what exists.

Every change of a collection (data files, tombstones, configuration) is one
replacement of this file, which is the commit.  Data files that it does not name
are not part of anything, so a write that fails leaves no trace for readers.
"""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from vectrove.errors import AlreadyExists, NotFound
from vectrove.sources import files
from vectrove.sources.schema import CollectionConfig


@dataclass
class Part:
    """A data folder and its number of rows."""

    path: str
    rows: int


@dataclass
class CollectionState:
    config: CollectionConfig
    segments: list[Part] = field(default_factory=list)
    fragments: list[Part] = field(default_factory=list)
    #: Folder of the deleted ids (one column, ``_id``) and how many there are.
    tombstones: Part | None = None
    #: Approximate indexes by metric: the folder of a saved model.
    indexes: dict[str, dict] = field(default_factory=dict)

    def dump(self) -> dict:
        parts = lambda ps: [vars(p) for p in ps]
        return {"config": self.config.dump(), "segments": parts(self.segments), "fragments": parts(self.fragments), "tombstones": vars(self.tombstones) if self.tombstones else None, "indexes": self.indexes}

    @classmethod
    def load(cls, raw: dict) -> CollectionState:
        return cls(CollectionConfig.load(raw["config"]), [Part(**p) for p in raw["segments"]], [Part(**p) for p in raw["fragments"]], Part(**raw["tombstones"]) if raw["tombstones"] else None, raw.get("indexes") or {})


class Catalog:
    """One writer at a time within a process; between processes, one writer by agreement."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.root = spark, data_dir.rstrip("/")
        self.path = f"{self.root}/catalog.json"
        self.lock = threading.RLock()
        files.make_folder(spark, self.root)
        raw = json.loads(files.read_text(spark, self.path)) if files.exists(spark, self.path) else {"collections": []}
        self._held = {c["config"]["name"]: CollectionState.load(c) for c in raw["collections"]}

    def names(self) -> list[str]:
        return sorted(self._held)

    def state(self, name: str) -> CollectionState:
        if name not in self._held:
            raise NotFound(f"collection not found: {name}")
        return self._held[name]

    def folder(self, name: str) -> str:
        return f"{self.root}/collections/{name}"

    @contextmanager
    def change(self, name: str):
        """The state of a collection to be altered; leaving the block commits it, an error undoes it."""
        with self.lock:
            draft = CollectionState.load(self.state(name).dump())
            yield draft
            self._commit({**self._held, name: draft})

    def create(self, config: CollectionConfig) -> None:
        with self.lock:
            if config.name in self._held:
                raise AlreadyExists(f"collection already exists: {config.name}")
            self._commit({**self._held, config.name: CollectionState(config)})

    def drop(self, name: str) -> None:
        with self.lock:
            self.state(name)
            self._commit({k: v for k, v in self._held.items() if k != name})
            files.remove(self.spark, self.folder(name))

    def _commit(self, held: dict[str, CollectionState]) -> None:
        files.replace_text(self.spark, self.path, json.dumps({"collections": [held[n].dump() for n in sorted(held)]}, indent=1))
        self._held = held
