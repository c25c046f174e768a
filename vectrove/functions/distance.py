"""Distances between vectors: Column expressions and SQL functions.

The expressions compute in double and stay in the JVM.  A null vector gives
null; vectors of different lengths are an error; the cosine distance of a zero
vector is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vectrove.sources.schema import metric_name


def literal(vector) -> Column:
    """A constant array<double>, as one literal."""
    return F.lit(np.asarray(vector, dtype=np.float64))


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    message = F.concat(F.lit("dimension mismatch: expected "), F.size(b).cast("string"), F.lit(", got "), F.size(a).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value).otherwise(F.raise_error(message).cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _double(a), _double(b)
    return _same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.when(dot(a, b).isNotNull(), F.lit(1.0))).otherwise(F.lit(1.0) - dot(a, b) / scale)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _double(a), _double(b)
    return _same_length(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def inner_product_distance(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def normalize(a: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    a = _double(a)
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


BY_METRIC = {"cosine": cosine_distance, "l2": l2_distance, "inner_product": inner_product_distance}


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    return BY_METRIC[metric_name(metric)](a, b)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as double, lengths, validity) of a list column; null elements are NaN."""
    valid = np.array(column.is_valid())
    flat = column.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float64)
    lengths = np.where(valid, np.asarray(column.value_lengths().fill_null(0)), 0)
    return values, lengths, valid


def _kernel(metric: str):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if isinstance(a, pa.ChunkedArray):
            a = a.combine_chunks()
        if isinstance(b, pa.ChunkedArray):
            b = b.combine_chunks()
        (x, nx, vx), (y, ny, vy) = _rows(a), _rows(b)
        both = vx & vy
        if (bad := np.flatnonzero(both & (nx != ny))).size:
            raise ValueError(f"dimension mismatch: expected {ny[bad[0]]}, got {nx[bad[0]]}")
        x, y = x[np.repeat(both, nx)], y[np.repeat(both, ny)]
        n = nx[both]
        total = lambda z: np.add.reduceat(np.append(z, 0.0), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)) * (n > 0) if len(n) else np.empty(0)
        if metric == "l2":
            d = np.sqrt(total((x - y) ** 2))
        else:
            d = total(x * y)
            if metric == "cosine":
                scale = np.sqrt(total(x * x)) * np.sqrt(total(y * y))
                d = np.where(scale == 0, 1.0, 1.0 - d / np.where(scale == 0, 1.0, scale))
            else:
                d = -d
        out = np.zeros(len(both), np.float32)
        out[both] = d
        return pa.array(out, type=pa.float32(), mask=~both)

    return run


def register_distances(spark: SparkSession) -> None:
    """cosine_distance, l2_distance and inner_product_distance for SQL text, in any clause; they return float."""
    from pyspark.sql.pandas.functions import arrow_udf

    for metric, name in (("cosine", "cosine_distance"), ("l2", "l2_distance"), ("inner_product", "inner_product_distance")):
        kernel = _kernel(metric)
        kernel.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
        spark.udf.register(name, arrow_udf(kernel, "float"))
