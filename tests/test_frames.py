"""Counts over RANGE frames against Spark's own sliding frame."""

import math
import os
import random

import pytest

from vectrove.operators.frames import range_count
from vectrove.plans import relational

SF = "/root/testdata/sf0.001"


def rows_of(spark, values):
    return spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(values)], "id long, p string, v double")


ODD = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1000.0, -1000.0, 1000.0000001, 999.9999999, 1e300, 5.0, 5.0]
NEAR = [random.Random(3).gauss(0, 40) for _ in range(300)]
CASES = {
    "odd": [(p, v) for p in ("a", "b", None) for v in ODD],
    "equal": [("a", 7.0)] * 300,
    "within_one_frame": [("a", v) for v in NEAR],
    "spread": [(random.Random(i).choice("ab"), round(random.Random(i).uniform(0, 20_000), 2)) for i in range(500)] + [(None, None)] * 3,
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("bucket_rows", [7, 10_000])
@pytest.mark.parametrize("frame", [(1000, 1000), (0, 30.5)])
def test_range_count(spark, case, bucket_rows, frame):
    rows = rows_of(spark, CASES[case])
    rows.createOrReplaceTempView("framed")
    want = spark.sql(f"SELECT id, COUNT(*) OVER (PARTITION BY p ORDER BY v RANGE BETWEEN {frame[0]}D PRECEDING AND {frame[1]}D FOLLOWING) AS near FROM framed")
    got = range_count(rows, "p", "v", *frame, "near", bucket_rows=bucket_rows).select("id", "near")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect())


def test_repeated_rows_keep_their_number(spark):
    rows = rows_of(spark, [("a", 1.0)] * 4).drop("id")
    assert [r.near for r in range_count(rows, "p", "v", 1, 1, "near").collect()] == [4] * 4


def test_only_doubles(spark):
    with pytest.raises(ValueError):
        range_count(spark.sql("SELECT id, 'a' AS p FROM range(3)"), "p", "id", 1, 1, "near")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query_has_no_sliding_frame(spark):
    query = relational.QUERIES["rel_range_frame"](spark, SF)
    assert "RangeFrame" not in query._jdf.queryExecution().executedPlan().toString()
    text = relational._sql(relational.SHARED["rel_range_frame"])(spark, SF)
    assert query.schema.simpleString() == text.schema.simpleString()
    assert sorted(query.collect()) == sorted(text.collect())
