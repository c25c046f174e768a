"""Joins that no frequent key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1 / HEAVY_KEYS of all rows, so a table of them is small enough to broadcast.
HEAVY_KEYS = 1 << 12


def split_join(rows: DataFrame, keyed: DataFrame, on: list[tuple[str, str]], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and, in
    ``count``, how many of the ``total`` rows hold it.

    Keys of more than a share of 1 / HEAVY_KEYS are broadcast: there are at most
    HEAVY_KEYS of them, whatever the data.  The others are joined as Spark sees
    fit; none of them can fill a task.  ``how`` is inner or left.
    """
    most = total // HEAVY_KEYS
    match = None
    for a, b in on:
        match = F.col(a) == F.col(b) if match is None else match & (F.col(a) == F.col(b))
    heavy = F.broadcast(keyed.where(F.col(count) > most))
    light = keyed.where(F.col(count) <= most)
    return rows.join(heavy, match).unionByName(rows.join(heavy.select(*(b for _, b in on)), match, "left_anti").join(light, match, how))
