"""Collection configuration and the schema it fixes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from vectrove.errors import InvalidConfig

ID, VECTOR, CREATED, DELETED = "_id", "vector", "_created_at", "_deleted"
RESERVED = (ID, VECTOR, CREATED, DELETED)

# Names that are accepted for metadata types, metrics and storage formats, in any case.
FIELD_TYPES = {
    "string": "string", "utf8": "string",
    "int64": "int64", "int": "int64", "integer": "int64",
    "float64": "float64", "float": "float64", "double": "float64",
    "bool": "bool", "boolean": "bool",
}
METRICS = {
    "cosine": "cosine",
    "l2": "l2", "euclidean": "l2",
    "inner_product": "inner_product", "ip": "inner_product", "dot": "inner_product",
}
FORMATS = ("parquet", "vortex")

_SPARK_TYPES = {"string": T.StringType(), "int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType()}


def metric_name(name: str | None) -> str:
    if name is None:
        return "cosine"
    if name.lower() not in METRICS:
        raise ValueError(f"unknown distance metric: {name}")
    return METRICS[name.lower()]


def field_type(name: str) -> str:
    if name.lower() not in FIELD_TYPES:
        raise ValueError(f"unknown metadata type: {name}")
    return FIELD_TYPES[name.lower()]


def format_name(name: str | None) -> str:
    """Both names are kept as given; the files are Parquet with zstd either way."""
    if name is None:
        return "vortex"
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown storage format: {name}")
    return name.lower()


@dataclass(frozen=True)
class IndexConfig:
    """Graph-index settings are kept for callers that set them; none of them has an effect."""

    m: int = 16
    max_elements: int = 1_000_000
    ef_construction: int = 200
    ef_search: int = 50


@dataclass(frozen=True)
class CompactionConfig:
    check_interval_secs: float = 60
    max_segments: int = 4
    max_delete_ratio: float = 0.2


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    distance_metric: str = "cosine"
    metadata_fields: tuple[tuple[str, str], ...] = ()
    storage_format: str = "vortex"
    index: IndexConfig = field(default_factory=IndexConfig)

    @classmethod
    def make(cls, name: str, dimension: int, distance_metric: str | None = None, metadata_fields=None, storage_format: str | None = None, index: IndexConfig | None = None) -> CollectionConfig:
        metric = metric_name(distance_metric)
        fields = tuple((n, field_type(t)) for n, t in metadata_fields or ())
        if dimension <= 0:
            raise InvalidConfig("dimension must be greater than 0")
        if not name or name[0] in "._" or "/" in name or "\\" in name:
            raise InvalidConfig(f"not a collection name: {name!r}")
        names = [n for n, _ in fields]
        if bad := [n for n in names if n in RESERVED or names.count(n) > 1]:
            raise InvalidConfig(f"reserved or repeated metadata field: {bad[0]}")
        return cls(name, int(dimension), metric, fields, format_name(storage_format), index or IndexConfig())

    @classmethod
    def load(cls, raw: dict) -> CollectionConfig:
        return cls(raw["name"], raw["dimension"], raw["distance_metric"], tuple(tuple(f) for f in raw["metadata_fields"]), raw["storage_format"], IndexConfig(**raw["index"]))

    def dump(self) -> dict:
        return asdict(self)

    def schema(self) -> T.StructType:
        fields = [T.StructField(ID, T.StringType(), False), T.StructField(VECTOR, T.ArrayType(T.FloatType(), False), False)]
        fields += [T.StructField(n, _SPARK_TYPES[t], True) for n, t in self.metadata_fields]
        return T.StructType([*fields, T.StructField(CREATED, T.TimestampNTZType(), False), T.StructField(DELETED, T.BooleanType(), False)])
