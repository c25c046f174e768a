"""Exact nearest-neighbour search.

Deleted rows and filters come before the distances, so a search returns the k
nearest of the rows that count.  Ties go by id; NaN distances come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrove.functions.distance import distance, literal


def top_k(rows: DataFrame, query, k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "_id", where: Column | str | None = None) -> DataFrame:
    """The k rows nearest to ``query`` with their ``distance``, nearest first; the vector column is left out.

    Each task keeps its k best and only those meet (TakeOrderedAndProject).
    """
    if where is not None:
        rows = rows.where(where)
    near = rows.withColumn("distance", distance(metric, vector, literal(query))).drop(vector)
    return near.orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last(id_col)).limit(k)


def batch_top_k(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", query_vector: str = "query", query_id: str = "query_id", vector: str = "vector", id_col: str = "_id", block_queries: int = 256) -> DataFrame:
    """query_id, id, distance, rank (1..k) for every query of a stated set.

    Queries are taken ``block_queries`` at a time, broadcast to the scan as one
    small array.  Within a task each query keeps its k best (an array_sort of at
    most k + 1 entries never grows with the data), and only k rows per query
    and task are shuffled for the final ranking.
    """
    import numpy as np

    blocks, block = [], []
    for row in queries.select(query_id, query_vector).toLocalIterator():
        block.append((row[0], [float(x) for x in row[1]]))
        if len(block) == block_queries:
            blocks.append(block)
            block = []
    if block:
        blocks.append(block)
    kind = queries.schema[query_id].dataType.simpleString()
    id_kind = rows.schema[id_col].dataType.simpleString()
    best = None
    for block in blocks:
        part = rows.select(F.col(id_col).alias("__id"), F.col(vector).alias("__v")).mapInArrow(_nearest(block, k, metric, np), f"query_id {kind}, id {id_kind}, distance double")
        best = part if best is None else best.union(part)
    if best is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, id {id_kind}, distance double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(block: list, k: int, metric: str, np):
    import pyarrow as pa
    import pyarrow.compute

    def run(batches):
        q = np.array([v for _, v in block], dtype=np.float64)
        held_d = np.empty((len(block), 0))
        held_i = np.empty((len(block), 0), dtype=object)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            keep = batch.filter(pa.compute.is_valid(batch.column(1)))
            for at in range(0, keep.num_rows, 4096):
                part = keep.slice(at, 4096)
                lengths = part.column(1).value_lengths()
                if pa.compute.any(pa.compute.not_equal(lengths, q.shape[1])).as_py():
                    raise ValueError(f"dimension mismatch: expected {q.shape[1]}")
                v = np.asarray(part.column(1).flatten().cast(pa.float64())).reshape(-1, q.shape[1])
                ids = np.array(part.column(0).to_pylist(), dtype=object)
                if metric == "l2":
                    d = np.stack([np.sqrt(((v - row) ** 2).sum(axis=1)) for row in q])
                else:
                    d = q @ v.T
                    if metric == "cosine":
                        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                        d = np.where(scale == 0, 1.0, 1.0 - d / np.where(scale == 0, 1.0, scale))
                    else:
                        d = -d
                held_d, held_i = _cut(np, np.concatenate([held_d, d], axis=1), np.concatenate([held_i, np.broadcast_to(ids, d.shape)], axis=1), k)
        if id_type is not None and held_d.shape[1]:
            held_d, held_i = _cut(np, held_d, held_i, k)
            names = [block[i][0] for i in range(len(block)) for _ in range(held_d.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held_i.ravel().tolist(), type=id_type), pa.array(held_d.ravel())], names=["query_id", "id", "distance"])

    return run


def _cut(np, d, ids, k: int):
    """Per row the k smallest, ties by id (null last): k entries, however many are equally near."""
    if d.shape[1] <= 4 * k:
        return d, ids
    d_sorted = np.where(np.isnan(d), np.inf, d)
    keep = np.argsort(d_sorted, axis=1, kind="stable")[:, :k]
    last = np.take_along_axis(d_sorted, keep[:, -1:], axis=1)
    for row in np.flatnonzero((d_sorted <= last).sum(axis=1) > k):
        nearer = np.flatnonzero(d_sorted[row] < last[row])
        tied = sorted(np.flatnonzero(d_sorted[row] == last[row]), key=lambda i: (bool(np.isnan(d[row, i])), ids[row, i] is None, ids[row, i] if ids[row, i] is not None else 0))
        keep[row] = np.concatenate([nearer, tied[: k - len(nearer)]])
    return np.take_along_axis(d, keep, axis=1), np.take_along_axis(ids, keep, axis=1)


def within(rows: DataFrame, query, radius: float, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """All rows nearer than ``radius``, with their ``distance``."""
    return rows.withColumn("distance", distance(metric, vector, literal(query))).where(F.col("distance") < radius).drop(vector)


def shown(value) -> str:
    """A metadata value as text: booleans in lower case, floats without exponent or needless zeros."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "inf" if value > 0 else "-inf"
        import decimal

        text = format(decimal.Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)
