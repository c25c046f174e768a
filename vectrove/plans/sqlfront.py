"""SQL over collections: each is a view, read when a query runs, and only queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrove.functions.dialect import register_dialect, translated
from vectrove.functions.distance import register_distances
from vectrove.sources.storage import Storage

#: Kinds of parsed statements that read only.
_QUERY_NODES = ("Command", "Insert", "Create", "Drop", "Alter", "Update", "Delete", "Merge", "Set", "Cache", "Refresh", "Load", "Truncate")


class SqlFront:
    def __init__(self, spark: SparkSession, storage: Storage, hide_deleted: bool = False):
        # A session of its own: views and functions of the caller's session stay what they are.
        self.session = spark.newSession()
        self.storage, self.hide_deleted = storage, hide_deleted
        self._views: set[str] = set()
        register_distances(self.session)
        register_dialect(self.session)

    def _refresh(self) -> None:
        names = set(self.storage.catalog.names())
        for gone in self._views - names:
            self.session.catalog.dropTempView(gone)
        for name in names:
            state = self.storage.catalog.state(name)
            own = Storage(self.session, self.storage.catalog)
            rows = own.read(state, [*state.segments, *state.fragments])
            (own.without_deleted(state, rows) if self.hide_deleted else rows).createOrReplaceTempView(name)
        self._views = names

    def query(self, text: str, args=None) -> DataFrame:
        """The DataFrame of a query; ``args`` fill ``:name`` or ``?`` markers. DDL and DML are refused."""
        text = translated(text)
        plan = self.session._jsparkSession.sessionState().sqlParser().parsePlan(text)
        kind = plan.getClass().getSimpleName()
        if kind not in ("ExplainCommand",) and not kind.startswith("Show") and any(kind.startswith(n) or kind.endswith("Command") for n in _QUERY_NODES):
            raise ValueError(f"only queries can be run here, not {kind}")
        self._refresh()
        return self.session.sql(text, args=args) if args is not None else self.session.sql(text)
