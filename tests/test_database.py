import math
import warnings

import numpy as np
import pyarrow as pa
import pytest

from vectrove.db import Database
from vectrove.operators.maintenance import BackgroundCompactor, should_compact
from vectrove.operators.search import shown
from vectrove.sources.schema import CompactionConfig
from vectrove.sources.storage import CompactionStats

E = np.eye(4, dtype=np.float32)


@pytest.fixture
def db(spark, tmp_path):
    d = Database(str(tmp_path / "data"), spark)
    d.create_collection("test", 4, metadata_fields=[("category", "string"), ("score", "int64")])
    return d


def ids(hits):
    return [h["id"] for h in hits]


def test_collections(db, spark):
    assert db.list_collections() == [{"name": "test", "dimension": 4, "distance_metric": "cosine", "metadata_fields": [("category", "string"), ("score", "int64")]}]
    with pytest.raises(ValueError, match="already exists"):
        db.create_collection("test", 4)
    with pytest.raises(ValueError):
        db.create_collection("x", 4, distance_metric="manhattan")
    with pytest.raises(ValueError):
        db.create_collection("x", 4, metadata_fields=[("a", "decimal")])
    with pytest.raises(RuntimeError):
        db.create_collection("x", 0)
    with pytest.raises(RuntimeError):
        db.create_collection("x", 4, metadata_fields=[("vector", "string")])
    db.create_collection("b", 2, "EUCLIDEAN", [("f", "Double"), ("g", "BOOL")], "Parquet")
    assert [c["name"] for c in db.list_collections()] == ["b", "test"]
    db.drop_collection("b")
    with pytest.raises(KeyError):
        db.drop_collection("b")
    assert [f.name for f in db.collection_schema("test")] == ["_id", "vector", "category", "score", "_created_at", "_deleted"]


def test_insert_search(db):
    assert db.insert("test", ["a", "b"], E[:2], {"category": ["tech", "sci"], "score": [42, 99]}) == 2
    hits = db.search("test", [1, 0, 0, 0], top_k=1)
    assert ids(hits) == ["a"] and hits[0]["distance"] == pytest.approx(0.0, abs=1e-6)
    assert hits[0]["metadata"] == {"category": "tech", "score": "42"}
    assert ids(db.search("test", np.array([0, 1, 0, 0], dtype=np.float32))) == ["b", "a"]
    assert ids(db.search("test", [1, 1, 0, 0], filter="score > 50")) == ["b"]
    assert ids(db.search("test", [1, 0, 0, 0], top_k=0)) == []


def test_errors(db):
    with pytest.raises(ValueError, match="dimension mismatch: expected 4, got 3"):
        db.insert("test", ["a"], [[1, 2, 3]])
    with pytest.raises(ValueError, match=r"ids length \(2\) != vectors length \(1\)"):
        db.insert("test", ["a", "b"], [[1, 0, 0, 0]])
    with pytest.raises(ValueError, match="dimension mismatch"):
        db.search("test", [1, 0])
    with pytest.raises(KeyError):
        db.search("none", [1, 0])
    with pytest.raises(KeyError):
        db.insert("none", ["a"], [[1]])
    with pytest.raises(TypeError):
        db.insert("test", ["a"], E[:1], {"category": [object()]})


def test_metadata_coercion(db):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        db.insert("test", ["a", "b"], E[:2], {"category": [5, None], "score": [True, 7], "other": [1, 2]})
    assert any("other" in str(w.message) for w in seen)
    rows = {r["_id"]: r for r in db.dataframe("test").collect()}
    assert rows["a"]["category"] is None and rows["a"]["score"] is None and rows["b"]["score"] == 7
    assert db.search("test", [1, 0, 0, 0], top_k=1)[0]["metadata"] == {}


def test_delete_flush_compact(db):
    db.insert("test", ["a", "b"], E[:2])
    db.flush("test")
    db.flush("test")
    db.insert("test", ["c"], E[2:3])
    db.flush("test")
    assert db.compaction_stats("test") == CompactionStats(2, 3, 0)
    assert db.delete("test", ["a", "absent"]) == 2
    assert db.delete("test", ["a"]) == 0
    assert ids(db.search("test", [1, 0, 0, 0])) == ["b", "c"]
    assert db.sql("SELECT COUNT(*) AS n FROM test").to_pylist() == [{"n": 3}]
    db.insert("test", ["a"], E[:1])
    assert "a" not in ids(db.search("test", [1, 0, 0, 0]))
    assert db.compact("test") == {"segments_before": 3, "segments_after": 1, "rows_removed": 2}
    assert db.compaction_stats("test") == CompactionStats(1, 2, 0)
    db.insert("test", ["a"], E[:1])
    assert ids(db.search("test", [1, 0, 0, 0], top_k=1)) == ["a"]


def test_compact_to_nothing_and_empty(db):
    assert db.compact("test") == {"segments_before": 0, "segments_after": 0, "rows_removed": 0}
    db.insert("test", ["a"], E[:1])
    db.delete("test", ["a"])
    assert db.compact("test") == {"segments_before": 1, "segments_after": 0, "rows_removed": 1}
    assert db.search("test", [1, 0, 0, 0]) == []
    assert db.sql("SELECT * FROM test").num_rows == 0


def test_reopen(db, spark):
    db.insert("test", ["a"], E[:1])
    db.flush("test")
    db.insert("test", ["b", "b"], E[[1, 1]])
    db.delete("test", ["a"])
    again = Database(db.catalog.root, spark)
    assert ids(again.search("test", [0, 1, 0, 0])) == ["b", "b"]


def test_circle_is_exact(db):
    theta = 2 * np.pi * np.arange(100) / 100
    v = np.stack([np.cos(theta), np.sin(theta), 0 * theta, 0 * theta], axis=1).astype(np.float32)
    db.insert("test", [f"v{i:02d}" for i in range(100)], v, {"category": ["even" if i % 2 == 0 else "odd" for i in range(100)], "score": list(range(100))})
    assert ids(db.search("test", [1, 0, 0, 0], top_k=3)) == ["v00", "v01", "v99"]
    q = np.array([0.3, -0.7, 0, 0])
    d = 1 - v.astype(np.float64) @ q / (np.linalg.norm(v.astype(np.float64), axis=1) * np.linalg.norm(q))
    assert ids(db.search("test", q, top_k=10)) == [f"v{i:02d}" for i in np.lexsort((np.arange(100), np.round(d, 12)))[:10]]


def test_sql(db):
    db.insert("test", ["a", "b", "c"], E[:3], {"category": ["tech", "sci", "tech"], "score": [42, 99, 10]})
    out = db.sql("SELECT _id, score FROM test WHERE category = 'tech' ORDER BY score DESC")
    assert isinstance(out, pa.RecordBatch) and out.to_pylist() == [{"_id": "a", "score": 42}, {"_id": "c", "score": 10}]
    assert db.sql("SELECT _id FROM test WHERE score > :s", {"s": 50}).to_pylist() == [{"_id": "b"}]
    assert db.sql("SELECT _id FROM test WHERE score > 1000").num_rows == 0
    assert sum(b.num_rows for b in db.sql_stream("SELECT * FROM test", batch_rows=2)) == 3
    for text in ("CREATE TABLE t (a INT)", "DROP TABLE test", "INSERT INTO test VALUES (1)", "CREATE TEMP VIEW v AS SELECT 1", "SET a=b"):
        with pytest.raises(ValueError):
            db.sql(text)
    assert db.sql("EXPLAIN SELECT * FROM test").num_rows == 1


def test_sql_hide_deleted(db, spark):
    db.insert("test", ["a", "b"], E[:2])
    db.delete("test", ["a"])
    assert Database(db.catalog.root, spark, sql_hide_deleted=True).sql("SELECT _id FROM test").to_pylist() == [{"_id": "b"}]


def test_metadata_filter_and_projection_reach_the_scan(db):
    db.insert("test", ["a"], E[:1], {"category": ["x"], "score": [1]})
    plan = db.sql_df("SELECT _id FROM test WHERE score > 5")._jdf.queryExecution().toString()
    assert "GreaterThan(score,5)" in plan
    assert "vector" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_ann_recall(db, metric):
    rng = np.random.default_rng(3)
    db.create_collection("wide", 16, "l2")
    db.insert("wide", [str(i) for i in range(400)], rng.normal(size=(400, 16)).astype(np.float32))
    db.build_index("wide", metric)
    queries = rng.normal(size=(5, 16))
    hit = sum(len(set(ids(db.search("wide", q, 10, metric=metric))) & set(ids(db.search("wide", q, 10, metric=metric, mode="ann")))) for q in queries)
    assert hit >= 0.9 * 50


def test_ann_reads_few_lists_of_clustered_rows(db, spark):
    rng = np.random.default_rng(8)
    centers = 10 * rng.normal(size=(40, 32))
    v = (centers[np.arange(8000) % 40] + rng.normal(size=(8000, 32))).astype(np.float32)
    db.create_collection("near", 32, "l2")
    db.insert("near", [str(i) for i in range(8000)], v)
    db.build_index("near")
    index = db._index("near", "l2")
    read = db._listed("near", index, index.lists(v[0])).count()
    assert read < 0.2 * 8000 and index.read(spark, db.storage.live("near").drop("_created_at", "_deleted").schema, [*range(len(index.centroids)), -1]).count() == 8000
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 8000, 400)], "query_id long, query array<double>")
    want = {(r["query_id"], r["id"]) for r in db.search_batch("near", asked, 10).collect()}
    got = {(r["query_id"], r["id"]) for r in db.search_batch("near", asked, 10, mode="ann").collect()}
    assert len(want & got) >= 0.9 * len(want) == 0.9 * 200


def test_index_and_later_rows(db):
    rng = np.random.default_rng(9)
    db.create_collection("grown", 8, "inner_product")
    db.insert("grown", [str(i) for i in range(300)], rng.normal(size=(300, 8)))
    db.build_index("grown")
    # Longer than all that the index has seen, and far along the query.
    db.insert("grown", ["late"], [[50.0] * 8])
    assert ids(db.search("grown", [1.0] * 8, 3, mode="ann"))[0] == "late"
    db.flush("grown")
    assert db.catalog.state("grown").indexes and ids(db.search("grown", [1.0] * 8, 3, mode="ann"))[0] == "late"
    db.delete("grown", ["late"])
    assert "late" not in ids(db.search("grown", [1.0] * 8, 3, mode="ann"))
    db.compact("grown")
    assert not db.catalog.state("grown").indexes
    assert len(db.search("grown", [1.0] * 8, 400, mode="ann")) == 300


def test_index_of_an_empty_collection(db):
    db.create_collection("none", 4, "cosine")
    assert db.search("none", [1.0, 0, 0, 0], 3, mode="ann") == []


def test_batch_search_equals_single(db, spark):
    rng = np.random.default_rng(4)
    db.insert("test", [f"{i:03d}" for i in range(60)], rng.normal(size=(60, 4)))
    queries = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(5)]
    frame = spark.createDataFrame(queries, "query_id long, query array<double>")
    for metric in ("cosine", "l2", "inner_product"):
        rows = db.search_batch("test", frame, 7, metric).orderBy("query_id", "rank").collect()
        for i, q in queries:
            assert [r["id"] for r in rows if r["query_id"] == i] == [h["_id"] for h in db.search_df("test", q, 7, metric=metric).collect()]


def test_insert_dataframe_checks_rows(db, spark):
    assert db.insert_dataframe("test", spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0], "x", "no number", 1)], "_id string, vector array<double>, category string, score string, extra int")) == 1
    row = db.dataframe("test").first()
    assert row["category"] == "x" and row["score"] is None and row["_deleted"] is False
    for bad in (("b", [1.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), ("b", None)):
        with pytest.raises(Exception):
            db.insert_dataframe("test", spark.createDataFrame([bad], "_id string, vector array<double>"))
    assert db.dataframe("test").count() == 1


def test_policy_and_background(db):
    c = CompactionConfig()
    assert not should_compact(CompactionStats(1, 10, 0), c)
    assert should_compact(CompactionStats(4, 10, 0), c)
    assert not should_compact(CompactionStats(1, 10, 2), c)
    assert should_compact(CompactionStats(1, 10, 3), c)
    db.insert("test", ["a", "b"], E[:2])
    db.flush("test")
    assert BackgroundCompactor(db, c).check() == []
    db.delete("test", ["a"])
    assert BackgroundCompactor(db, c).check() == ["test"]
    assert db.compaction_stats("test") == CompactionStats(1, 1, 0)


def test_auto_flush(db):
    db.insert("test", ["a"], E[:1], auto_flush_rows=2)
    assert db.compaction_stats("test").segments == 0
    db.insert("test", ["b"], E[1:2], auto_flush_rows=2)
    assert db.compaction_stats("test") == CompactionStats(1, 2, 0)


def test_failed_write_leaves_nothing(db, spark):
    db.insert("test", ["a"], E[:1])
    with pytest.raises(Exception):
        db.insert_dataframe("test", spark.createDataFrame([("b", [1.0])], "_id string, vector array<double>"))
    assert ids(Database(db.catalog.root, spark).search("test", [1, 0, 0, 0])) == ["a"]


def test_shown():
    assert [shown(x) for x in (1.0, 1e20, 0.1, -2.5, True, False, 7, "x", math.inf, math.nan)] == ["1", "1" + "0" * 20, "0.1", "-2.5", "true", "false", "7", "x", "inf", "NaN"]


def test_stream_ingest(db, spark, tmp_path):
    from vectrove.streaming.ingest import ingest_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0], "x", 1), ("b", [0.0, 1.0, 0.0, 0.0], "y", 2)], "_id string, vector array<float>, category string, score long").write.parquet(source)
    stream = spark.readStream.schema("_id string, vector array<float>, category string, score long").parquet(source)
    ingest_stream(db, "test", stream, str(tmp_path / "cp"), {"availableNow": True}, flush_rows=1).awaitTermination()
    assert ids(db.search("test", [0, 1, 0, 0])) == ["b", "a"]
    assert db.compaction_stats("test").segments == 1


def test_offsets_count_through_files_and_segments(spark, tmp_path):
    store = Database(str(tmp_path / "offsets"), spark)
    store.create_collection("places", 2, "l2", [("n", "int64")])
    for part in range(2):
        ids = range(part * 40, part * 40 + 40)
        with_files = {"spark.sql.files.maxRecordsPerFile": "7"}
        for key, value in with_files.items():
            spark.conf.set(key, value)
        store.insert("places", [f"r{i}" for i in ids], [[i, 0.5] for i in ids], {"n": list(ids)})
        store.flush("places")
        for key in with_files:
            spark.conf.unset(key)
    wanted = [79, 0, 41, 41, 12, 500, -1]
    got = store.storage.read_by_offsets("places", wanted, ["n"]).collect()
    assert len(got) == 5 and len({r.ordinal for r in got}) == 5
    every = {r.n for r in store.storage.read_by_offsets("places", list(range(80)), ["n"]).collect()}
    assert every == set(range(80))
    assert {r.n // 40 for r in store.storage.read_by_offsets("places", list(range(40)), ["n"]).collect()} == {0}


def test_names_of_functions_are_translated(spark, tmp_path):
    from vectrove.functions.dialect import translated

    assert translated("SELECT 'make_array(1)', make_array (1, 2), x.array_has(3) -- array_cat(") == "SELECT 'make_array(1)', array (1, 2), x.array_has(3) -- array_cat("
    store = Database(str(tmp_path / "names"), spark)
    query = "SELECT array_has(make_array(1, 2), 2) AS a, array_to_string(string_to_array('x.y.z', '.'), '-') AS b, array_element(array_cat(array(1), array(7)), 2) AS c, array_length(array(4, 5)) AS d, unix_seconds(to_timestamp_seconds(9)) AS e"
    assert store.sql(query).to_pylist() == [{"a": True, "b": "x-y-z", "c": 7, "d": 2, "e": 9}]
    batches = list(store.sql_stream("SELECT id FROM range(25) ORDER BY id", batch_rows=10))
    assert [x for b in batches for x in b.column(0).to_pylist()] == list(range(25)) and max(b.num_rows for b in batches) <= 10


def test_equally_near_rows_are_cut_by_id(spark):
    from vectrove.operators.search import batch_top_k

    rows = spark.createDataFrame([(f"{i:04}", [1.0, 0.0]) for i in range(900)] + [("near", [1.0, 0.1])], "_id string, vector array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, query array<float>")
    got = [(r.id, r["rank"]) for r in batch_top_k(queries, rows, 5, "l2").orderBy("rank").collect()]
    assert got == [("near", 1), ("0000", 2), ("0001", 3), ("0002", 4), ("0003", 5)]


def test_qualify(db):
    db.create_collection("ranked", 2, "l2", [("kind", "string"), ("n", "int64")])
    db.insert("ranked", list("abcd"), [[0, 0], [0, 1], [1, 0], [1, 1]], {"kind": ["x", "x", "y", "y"], "n": [4, 7, 2, 9]})
    first = "SELECT _id, n FROM ranked QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC) = 1"
    assert db.sql(first + " ORDER BY n").to_pylist() == [{"_id": "b", "n": 7}, {"_id": "d", "n": 9}]
    assert db.sql(f"SELECT sum(n) AS s FROM ({first}) t").to_pylist() == [{"s": 16}]
    assert db.sql("WITH w AS (" + first + ") SELECT _id FROM w WHERE n > 8").to_pylist() == [{"_id": "d"}]
    assert db.sql("SELECT DISTINCT kind FROM ranked QUALIFY count(*) OVER (PARTITION BY kind) = 2 UNION ALL SELECT 'QUALIFY' ORDER BY kind").to_pylist() == [{"kind": "QUALIFY"}, {"kind": "x"}, {"kind": "y"}]
    assert db.sql("SELECT kind, count(*) AS c FROM ranked GROUP BY kind QUALIFY rank() OVER (ORDER BY kind) < 2").to_pylist() == [{"kind": "x", "c": 2}]
    assert db.sql("SELECT 1 AS qualify").to_pylist() == [{"qualify": 1}]


def test_flight(db):
    flight = pytest.importorskip("pyarrow.flight")
    from vectrove import server

    db.create_collection("served", 2, "l2", [("n", "int64")])
    db.insert("served", [str(i) for i in range(50)], np.zeros((50, 2)), {"n": list(range(50))})
    query = "SELECT n, concat('id ', _id) AS t FROM served WHERE n < 30"
    packed = server._field(1, b"type.googleapis.com/arrow.flight.protocol.sql.CommandStatementQuery") + server._field(2, server._field(1, query.encode()))
    with server.FlightServer(db, port=0, batch_rows=7) as served, flight.connect(f"grpc://127.0.0.1:{served.port}") as client:
        for command in (packed, query.encode()):
            info = client.get_flight_info(flight.FlightDescriptor.for_command(command))
            assert info.schema.names == ["n", "t"]
            read = list(client.do_get(info.endpoints[0].ticket))
            assert sorted(n for b in read for n in b.data["n"].to_pylist()) == list(range(30)) and max(b.data.num_rows for b in read) <= 7
        empty = client.get_flight_info(flight.FlightDescriptor.for_command(b"SELECT n FROM served WHERE n < 0"))
        assert client.do_get(empty.endpoints[0].ticket).read_all().num_rows == 0
        for refused in (b"DROP TABLE served", b"SELECT nothing FROM served", server._field(1, b"type.googleapis.com/arrow.flight.protocol.sql.CommandGetCatalogs") + server._field(2, b"")):
            with pytest.raises(flight.FlightError):
                client.get_flight_info(flight.FlightDescriptor.for_command(refused))
    long = "SELECT '" + "x" * 300 + "'"
    assert server.statement(server._field(1, server._TICKET.encode()) + server._field(2, server._field(1, long.encode()))) == long
