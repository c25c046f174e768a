"""Queries over vector collections, each with its SQL counterpart where there is one.

The ``embeddings`` table is read as a collection: id, vector, one metadata field.
Distances are rounded to six places, computed in double.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.db import Database
from vectrove.functions.distance import cosine_distance, inner_product_distance, l2_distance, literal, normalize
from vectrove.operators import search
from vectrove.operators.maintenance import should_compact
from vectrove.sources.schema import CompactionConfig
from vectrove.sources.storage import CompactionStats, numbered, read_by_offsets

DELETED_IDS = (1, 2, 3, 5, 8)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection view: _id, vector, label, and the integer id for stable ties."""
    e = embeddings(spark, sf_dir)
    return e.select(F.col("vec_id").cast("string").alias("_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"), "vec_id")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return embeddings(spark, sf_dir).where("vec_id = 0").first()["embedding"]


def rounded(c):
    """Six places, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _scratch(spark: SparkSession) -> str:
    """A folder for collections that a query writes, in the shared folder of the session where it names one."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vectrove-")
    return f"{base.rstrip('/')}/collections-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str, parts: int = 1, fragment: bool = False) -> Database:
    """A database with the embeddings in ``parts`` segments by vec_id modulo, the last one left un-flushed if wanted."""
    db = Database(_scratch(spark), spark)
    db.create_collection("items", 64, "l2", [("label", "int64"), ("vec_id", "int64")])
    rows = collection(spark, sf_dir)
    for i in range(parts):
        db.insert_dataframe("items", rows.where(F.col("vec_id") % parts == i))
        if not (fragment and i == parts - 1):
            db.flush("items")
    return db


def _delete(db: Database, ids) -> int:
    return db.delete("items", [str(i) for i in ids])


def coll_scan(spark, sf_dir):
    return collection(spark, sf_dir).select("_id", "label")


def coll_filter_eq(spark, sf_dir):
    return collection(spark, sf_dir).where("label = 3").select("_id", "label")


def coll_filter_range(spark, sf_dir):
    return collection(spark, sf_dir).where("label BETWEEN 2 AND 5").select("_id", "label")


def coll_count(spark, sf_dir):
    return collection(spark, sf_dir).agg(F.count("*").alias("n"))


def _dist(kind):
    def run(spark, sf_dir):
        q = literal(first_vector(spark, sf_dir))
        return collection(spark, sf_dir).select("_id", rounded(kind("vector", q)).alias("d"))

    return run


def dist_cosine_zero(spark, sf_dir):
    zero = F.when(F.col("vec_id") % 2 == 0, F.transform("vector", lambda x: x * 0.0)).otherwise(F.col("vector").cast("array<double>"))
    q = literal(first_vector(spark, sf_dir))
    return collection(spark, sf_dir).select("_id", rounded(cosine_distance(zero, q)).alias("d"))


def vec_normalize(spark, sf_dir):
    doubled = F.transform("vector", lambda x: x * (F.col("vec_id") % 3))
    unit = normalize(doubled)
    length = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))
    return collection(spark, sf_dir).select("_id", rounded(length).alias("length"), rounded(F.get(unit, F.lit(0))).alias("x0"))


def _topk(metric, where=None):
    def run(spark, sf_dir):
        near = search.top_k(collection(spark, sf_dir), first_vector(spark, sf_dir), 10, metric, id_col="vec_id", where=where)
        return near.select("_id", rounded(F.col("distance")).alias("d"))

    return run


def topk_after_delete(spark, sf_dir):
    db = _stored(spark, sf_dir)
    _delete(db, DELETED_IDS)
    near = search.top_k(db.dataframe("items"), first_vector(spark, sf_dir), 10, "l2", id_col="vec_id")
    return near.select("_id", rounded(F.col("distance")).alias("d"))


def topk_multi_segment(spark, sf_dir):
    db = _stored(spark, sf_dir, parts=4, fragment=True)
    near = search.top_k(db.dataframe("items"), first_vector(spark, sf_dir), 10, "l2", id_col="vec_id")
    return near.select("_id", rounded(F.col("distance")).alias("d"))


def read_by_ids(spark, sf_dir):
    db = _stored(spark, sf_dir)
    ids = spark.createDataFrame([(str(i),) for i in (7, 11, 13, 999_999)], "_id string")
    return db.storage.read_by_ids("items", ids).select("_id", "label")


def read_by_row_ids(spark, sf_dir):
    rows = numbered(spark, f"{sf_dir}/embeddings.parquet")
    return read_by_offsets(rows, [9, 3, 3, 20, 10_000_000], ["vec_id", "label"]).select("ordinal", "vec_id", F.col("label").cast("long").alias("label"))


def meta_projection_by_offset(spark, sf_dir):
    rows = numbered(spark, f"{sf_dir}/embeddings.parquet")
    return read_by_offsets(rows, [0, 2, 4, 6], ["vec_id", "label"]).select("vec_id", F.col("label").cast("long").alias("label"))


def insert_coercion(spark, sf_dir):
    db = Database(_scratch(spark), spark)
    db.create_collection("typed", 2, "l2", [("s", "string"), ("i", "int64"), ("f", "float64"), ("b", "bool")])
    db.insert("typed", ["r1", "r2", "r3"], [[0, 1], [1, 0], [1, 1]], {"s": ["x", 5, None], "i": [1, 2.5, True], "f": [1.5, 2, None], "b": [True, 1, "no"]})
    return db.dataframe("typed").select("_id", "s", "i", "f", "b")


def flush_roundtrip(spark, sf_dir):
    return _stored(spark, sf_dir, parts=2).dataframe("items").select("_id", "label")


def delete_count(spark, sf_dir):
    db = _stored(spark, sf_dir)
    first = _delete(db, DELETED_IDS)
    second = _delete(db, [*DELETED_IDS, 10_000_001])
    return spark.createDataFrame([(1, first), (2, second)], "call long, newly_deleted long")


def compact_live_rows(spark, sf_dir):
    db = _stored(spark, sf_dir, parts=3, fragment=True)
    _delete(db, DELETED_IDS)
    db.compact("items")
    return db.dataframe("items", live_only=False).select("_id", "label")


def compact_stats(spark, sf_dir):
    db = _stored(spark, sf_dir, parts=3, fragment=True)
    _delete(db, DELETED_IDS)
    out = db.compact("items")
    return spark.createDataFrame([tuple(out.values())], "segments_before long, segments_after long, rows_removed long")


_STATS = [(1, 100, 0), (1, 100, 21), (1, 100, 20), (2, 100, 0), (4, 100, 0), (5, 0, 3), (0, 0, 0)]


def compaction_policy(spark, sf_dir):
    rows = [(*s, should_compact(CompactionStats(*s), CompactionConfig())) for s in _STATS]
    return spark.createDataFrame(rows, "segments long, segment_rows long, tombstones long, compact boolean")


def reinsert_hidden(spark, sf_dir):
    db = _stored(spark, sf_dir)
    _delete(db, (0,))
    db.insert_dataframe("items", collection(spark, sf_dir).where("vec_id = 0"))
    return db.dataframe("items").select("_id", "label")


def sql_shows_deleted(spark, sf_dir):
    db = _stored(spark, sf_dir)
    _delete(db, DELETED_IDS)
    return db.sql_df("SELECT _id, label, _deleted FROM items")


def sql_distance(spark, sf_dir):
    """The registered SQL functions, with a parameter, in SELECT, WHERE and ORDER BY."""
    db = _stored(spark, sf_dir)
    q = [float(x) for x in first_vector(spark, sf_dir)]
    text = "SELECT _id, round(CAST(l2_distance(vector, :q) AS DOUBLE), 3) AS d FROM items WHERE cosine_distance(vector, :q) < 1.2 ORDER BY l2_distance(vector, :q), vec_id LIMIT 15"
    return db.sql_df(text, {"q": F.array(*map(F.lit, q))})


def batch_knn(spark, sf_dir):
    rows = collection(spark, sf_dir)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    best = search.batch_top_k(queries, rows, 3, "l2", id_col="vec_id")
    return best.select("query_id", F.col("id").alias("vec_id"), rounded(F.col("distance")).alias("d"), F.col("rank").cast("long").alias("rank"))


def range_search(spark, sf_dir):
    near = search.within(collection(spark, sf_dir), first_vector(spark, sf_dir), 1.3, "l2")
    return near.select("_id", rounded(F.col("distance")).alias("d"))


def dist_by_label(spark, sf_dir):
    q = literal(first_vector(spark, sf_dir))
    return collection(spark, sf_dir).groupBy("label").agg(rounded(F.avg(l2_distance("vector", q))).alias("mean_d"), F.count("*").alias("n"))


def centroid_by_label(spark, sf_dir):
    flat = collection(spark, sf_dir).select("label", F.posexplode("vector").alias("i", "x"))
    return flat.groupBy("label", F.col("i").cast("long").alias("i")).agg(rounded(F.avg(F.col("x").cast("double"))).alias("mean_x"))


def _asked(spark, sf_dir):
    return embeddings(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def ann_topk(spark, sf_dir):
    near = _stored(spark, sf_dir).search_batch("items", _asked(spark, sf_dir), 10, mode="ann")
    return near.select("query_id", F.col("id").alias("_id"), rounded(F.col("distance")).alias("d"), "rank")


def ann_recall(spark, sf_dir):
    """Whether 0.9 of the ten nearest of every hundredth row, by exact distance, are found in the lists read."""
    db, asked = _stored(spark, sf_dir), _asked(spark, sf_dir)
    want = db.search_batch("items", asked, 10).select("query_id", "id")
    got = db.search_batch("items", asked, 10, mode="ann").select("query_id", "id", F.lit(1).alias("hit"))
    both = want.join(got, ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n_sought"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


_V = "embedding::DOUBLE[]"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_ID = "CAST(vec_id AS VARCHAR) AS _id"
_L2 = f"list_distance({_V}, {_Q})"
_COS = f"list_cosine_distance({_V}, {_Q})"
_IP = f"-list_inner_product({_V}, {_Q})"
_GONE = ", ".join(map(str, DELETED_IDS))


def _top_sql(d: str, where: str = "TRUE") -> str:
    return f"SELECT {_ID}, ROUND({d}, 6) + 0.0 AS d FROM embeddings WHERE {where} ORDER BY {d}, vec_id LIMIT 10"


_LABEL = "CAST(label AS BIGINT) AS label"

QUERIES = {
    "coll_scan": coll_scan,
    "coll_filter_eq": coll_filter_eq,
    "coll_filter_range": coll_filter_range,
    "coll_count": coll_count,
    "dist_l2": _dist(l2_distance),
    "dist_cosine": _dist(cosine_distance),
    "dist_ip": _dist(inner_product_distance),
    "dist_cosine_zero": dist_cosine_zero,
    "vec_normalize": vec_normalize,
    "topk_l2": _topk("l2"),
    "topk_cosine": _topk("cosine"),
    "topk_ip": _topk("inner_product"),
    "topk_filtered": _topk("l2", "label = 3"),
    "topk_after_delete": topk_after_delete,
    "topk_multi_segment": topk_multi_segment,
    "read_by_ids": read_by_ids,
    "read_by_row_ids": read_by_row_ids,
    "meta_projection_by_offset": meta_projection_by_offset,
    "insert_coercion": insert_coercion,
    "flush_roundtrip": flush_roundtrip,
    "delete_count": delete_count,
    "compact_live_rows": compact_live_rows,
    "compact_stats": compact_stats,
    "should_compact": compaction_policy,
    "reinsert_hidden": reinsert_hidden,
    "sql_shows_deleted": sql_shows_deleted,
    "sql_distance": sql_distance,
    "batch_knn": batch_knn,
    "range_search": range_search,
    "dist_by_label": dist_by_label,
    "centroid_by_label": centroid_by_label,
    "ann_topk": ann_topk,
    "ann_recall": ann_recall,
}

ORACLE_SQL = {
    "ann_recall": "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) * least(10, (SELECT count(*) FROM embeddings)) AS n_sought, true AS reached",
    "coll_scan": f"SELECT {_ID}, {_LABEL} FROM embeddings",
    "coll_filter_eq": f"SELECT {_ID}, {_LABEL} FROM embeddings WHERE label = 3",
    "coll_filter_range": f"SELECT {_ID}, {_LABEL} FROM embeddings WHERE label BETWEEN 2 AND 5",
    "coll_count": "SELECT COUNT(*) AS n FROM embeddings",
    "dist_l2": f"SELECT {_ID}, ROUND({_L2}, 6) + 0.0 AS d FROM embeddings",
    "dist_cosine": f"SELECT {_ID}, ROUND({_COS}, 6) + 0.0 AS d FROM embeddings",
    "dist_ip": f"SELECT {_ID}, ROUND({_IP}, 6) + 0.0 AS d FROM embeddings",
    "dist_cosine_zero": f"SELECT {_ID}, CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE ROUND({_COS}, 6) + 0.0 END AS d FROM embeddings",
    "vec_normalize": f"""
        WITH s AS (SELECT vec_id, list_transform({_V}, lambda x: x * (vec_id % 3)) AS v FROM embeddings),
             n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS len FROM s)
        SELECT {_ID}, ROUND(CASE WHEN len = 0 THEN 0.0 ELSE sqrt(list_inner_product(list_transform(v, lambda x: x / len), list_transform(v, lambda x: x / len))) END, 6) + 0.0 AS length,
               ROUND(CASE WHEN len = 0 THEN 0.0 ELSE v[1] / len END, 6) + 0.0 AS x0 FROM n""",
    "topk_l2": _top_sql(_L2),
    "topk_cosine": _top_sql(_COS),
    "topk_ip": _top_sql(_IP),
    "topk_filtered": _top_sql(_L2, "label = 3"),
    "topk_after_delete": _top_sql(_L2, f"vec_id NOT IN ({_GONE})"),
    "topk_multi_segment": _top_sql(_L2),
    "read_by_ids": f"SELECT {_ID}, {_LABEL} FROM embeddings WHERE vec_id IN (7, 11, 13, 999999)",
    "read_by_row_ids": f"""
        WITH e AS (SELECT vec_id, {_LABEL}, ROW_NUMBER() OVER () - 1 AS row_id FROM embeddings)
        SELECT CAST(w.ordinal AS BIGINT) AS ordinal, vec_id, label FROM e JOIN (VALUES (0, 9), (1, 3), (2, 3), (3, 20), (4, 10000000)) AS w(ordinal, row_id) ON e.row_id = w.row_id""",
    "meta_projection_by_offset": f"SELECT vec_id, label FROM (SELECT vec_id, {_LABEL}, ROW_NUMBER() OVER () - 1 AS row_id FROM embeddings) WHERE row_id IN (0, 2, 4, 6)",
    "insert_coercion": """
        SELECT * FROM (VALUES ('r1', 'x', CAST(1 AS BIGINT), CAST(1.5 AS DOUBLE), TRUE), ('r2', NULL, NULL, NULL, NULL), ('r3', NULL, NULL, NULL, NULL)) AS t(_id, s, i, f, b)""",
    "flush_roundtrip": f"SELECT {_ID}, {_LABEL} FROM embeddings",
    "delete_count": f"SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST({len(DELETED_IDS)} AS BIGINT)), (2, 1)) AS t(call, newly_deleted)",
    "compact_live_rows": f"SELECT {_ID}, {_LABEL} FROM embeddings WHERE vec_id NOT IN ({_GONE})",
    "compact_stats": f"SELECT CAST(3 AS BIGINT) AS segments_before, CAST(1 AS BIGINT) AS segments_after, COUNT(*) AS rows_removed FROM embeddings WHERE vec_id IN ({_GONE})",
    "should_compact": "SELECT *, CASE WHEN segments < 2 AND tombstones = 0 THEN FALSE ELSE segments >= 4 OR (segment_rows > 0 AND tombstones > 0.2 * segment_rows) END AS compact FROM (VALUES "
    + ", ".join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT))" for a, b, c in _STATS)
    + ") AS t(segments, segment_rows, tombstones)",
    "reinsert_hidden": f"SELECT {_ID}, {_LABEL} FROM embeddings WHERE vec_id <> 0",
    "sql_shows_deleted": f"SELECT {_ID}, {_LABEL}, FALSE AS _deleted FROM embeddings",
    "sql_distance": f"SELECT {_ID}, ROUND({_L2}, 3) AS d FROM embeddings WHERE {_COS} < 1.2 ORDER BY {_L2}, vec_id LIMIT 15",
    "batch_knn": """
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS x FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS rank FROM p)
        SELECT query_id, vec_id, ROUND(x, 6) + 0.0 AS d, rank FROM r WHERE rank <= 3""",
    "range_search": f"SELECT {_ID}, ROUND({_L2}, 6) + 0.0 AS d FROM embeddings WHERE {_L2} < 1.3",
    "dist_by_label": f"SELECT {_LABEL}, ROUND(AVG({_L2}), 6) + 0.0 AS mean_d, COUNT(*) AS n FROM embeddings GROUP BY label",
    "centroid_by_label": f"""
        SELECT label, i, ROUND(AVG(x), 6) + 0.0 AS mean_x FROM (
          SELECT {_LABEL}, unnest({_V}) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i""",
}
