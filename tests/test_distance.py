import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrove.functions.distance import cosine_distance, inner_product_distance, l2_distance, normalize, register_distances

A, B = [0.0, 0.0], [3.0, 4.0]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def vec(x):
    return F.lit(np.array(x, dtype=np.float64))


def test_formulas(spark):
    assert value(spark, l2_distance(vec(A), vec(B))) == 5.0
    assert abs(value(spark, cosine_distance(vec(B), vec(B)))) < 1e-12
    assert value(spark, cosine_distance(vec([1, 0]), vec([0, 1]))) == pytest.approx(1.0)
    assert value(spark, inner_product_distance(vec([1, 2]), vec([3, 4]))) == -11.0


def test_zero_vector_and_null(spark):
    assert value(spark, cosine_distance(vec(A), vec(B))) == 1.0
    null = F.lit(None).cast("array<double>")
    for kind in (l2_distance, cosine_distance, inner_product_distance):
        assert value(spark, kind(null, vec(B))) is None


def test_length_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="dimension mismatch"):
        value(spark, l2_distance(vec([1, 2, 3]), vec(B)))


def test_normalize(spark):
    assert value(spark, normalize(vec(B))) == pytest.approx([0.6, 0.8])
    assert value(spark, normalize(vec(A))) == A


def test_sql_functions(spark):
    s = spark.newSession()
    register_distances(s)
    s.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<float>").createOrReplaceTempView("t")
    rows = s.sql("SELECT i, l2_distance(v, array(0.0, 0.0)) AS d, cosine_distance(v, array(3, 4)) AS c, inner_product_distance(v, array(1.0, 1.0)) AS p FROM t ORDER BY l2_distance(v, array(0.0, 0.0)) NULLS LAST").collect()
    assert [r.i for r in rows] == [2, 1, 3]
    assert [r.d for r in rows] == [0.0, 5.0, None]
    assert rows[0].c == 1.0 and abs(rows[1].c) < 1e-6 and rows[1].p == -7.0
    assert s.sql("SELECT l2_distance(array(1.0), array(1.0)) AS d").schema["d"].dataType.simpleString() == "float"
    with pytest.raises(Exception, match="dimension mismatch"):
        s.sql("SELECT l2_distance(v, array(1.0)) FROM t WHERE i = 1").collect()
