"""Rows of a collection from Python values, numpy arrays or DataFrames."""

from __future__ import annotations

import datetime
import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.errors import DimensionMismatch
from vectrove.sources.schema import CREATED, DELETED, ID, RESERVED, VECTOR, CollectionConfig

_ARROW = {"string": pa.string(), "int64": pa.int64(), "float64": pa.float64(), "bool": pa.bool_()}


def as_vectors(vectors) -> list[np.ndarray]:
    """2-D numpy array or sequence of sequences; lengths may differ here and are checked against the collection later."""
    if isinstance(vectors, np.ndarray) and vectors.ndim != 2:
        raise ValueError("vectors must be a 2-D array")
    return [np.asarray(v, dtype=np.float32) for v in vectors]


def as_query(vector) -> list[float]:
    v = np.asarray(vector, dtype=np.float32)
    if v.ndim != 1:
        raise ValueError("a query vector has one dimension")
    return [float(x) for x in v]


def fitted(value, kind: str):
    """``value`` if it is of the field's type, else null; a bool is no number, and an int no float."""
    if value is None:
        return None
    if isinstance(value, np.generic):
        value = value.item()
    if not isinstance(value, (bool, int, float, str)):
        raise TypeError(f"unsupported metadata type: {type(value).__name__}")
    fits = {"string": isinstance(value, str), "bool": isinstance(value, bool), "int64": isinstance(value, int) and not isinstance(value, bool), "float64": isinstance(value, float)}
    return value if fits[kind] else None


def arrow_rows(config: CollectionConfig, ids: Sequence[str], vectors, metadata: dict | None) -> pa.Table:
    """Typed rows with one creation time for all; unknown metadata names are left out, with a warning."""
    made = as_vectors(vectors)
    if len(ids) != len(made):
        raise ValueError(f"ids length ({len(ids)}) != vectors length ({len(made)})")
    for v in made:
        if v.shape != (config.dimension,):
            raise DimensionMismatch(config.dimension, v.size)
    metadata = metadata or {}
    for name, values in metadata.items():
        if len(values) != len(ids):
            raise ValueError(f"metadata '{name}' length ({len(values)}) != ids length ({len(ids)})")
    for name in metadata:
        if name not in dict(config.metadata_fields):
            warnings.warn(f"metadata field '{name}' is not part of collection '{config.name}' and is ignored", stacklevel=3)
    known = {n: [fitted(x, t) for x in metadata[n]] if n in metadata else [None] * len(ids) for n, t in config.metadata_fields}
    flat = np.concatenate(made) if made else np.empty(0, np.float32)
    offsets = np.arange(len(made) + 1, dtype=np.int32) * config.dimension
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    columns = {ID: pa.array(list(ids), pa.string()), VECTOR: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
    columns |= {n: pa.array(known[n], _ARROW[t]) for n, t in config.metadata_fields}
    columns |= {CREATED: pa.array([now] * len(ids), pa.timestamp("us")), DELETED: pa.array([False] * len(ids), pa.bool_())}
    return pa.table(columns)


def frame_rows(spark: SparkSession, config: CollectionConfig, ids: Sequence[str], vectors, metadata: dict | None) -> DataFrame:
    return spark.createDataFrame(arrow_rows(config, ids, vectors, metadata), schema=config.schema())


def conform(config: CollectionConfig, rows: DataFrame) -> DataFrame:
    """A DataFrame with ``_id``, ``vector`` and any metadata columns, in the collection's schema.

    Ids and vectors must not be null and vectors must have the collection's
    dimension: a row that breaks this fails the write.  Metadata of another type
    becomes null, missing fields are null, other columns are left out.
    """
    kinds = {"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean"}
    have = dict(rows.dtypes)
    vector = F.col(VECTOR).cast("array<float>")
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull())
    sized = F.when(bad, F.raise_error(F.lit("a vector is null or has null elements"))).when(
        F.size(vector) != config.dimension, F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {config.dimension}, got "), F.size(vector).cast("string")))
    )
    columns = [
        F.coalesce(F.col(ID).cast("string"), F.raise_error(F.lit("an id is null")).cast("string")).alias(ID),
        F.coalesce(sized.cast("array<float>"), vector).alias(VECTOR),
        *((F.col(n) if have.get(n) == kinds[t] else F.lit(None).cast(kinds[t])).alias(n) for n, t in config.metadata_fields),
        F.current_timestamp().cast("timestamp_ntz").alias(CREATED),
        F.lit(False).alias(DELETED),
    ]
    assert all(n not in RESERVED for n, _ in config.metadata_fields)
    return rows.select(*columns)
