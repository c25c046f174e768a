"""Counts over RANGE frames without a scan of the frame for each row.

Spark sums a sliding frame anew whenever its bounds move, so its cost is the
different values times the rows of a frame, in one task for each partition of
the window.  Here a count is the difference of two running counts, that up to
the upper bound less that below the lower one, and running counts are taken in
buckets of the ordered values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of values is meant to hold, and the most quantiles that bounds are made of.
BUCKET_ROWS, QUANTILES = 100_000, 1_000


def range_count(rows: DataFrame, partition: str, order: str, preceding: float, following: float, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``name``: COUNT(*) OVER (PARTITION BY partition ORDER BY order RANGE BETWEEN preceding PRECEDING AND following FOLLOWING).

    ``order`` is a double column, the distances are 0 or more. As in SQL, nulls count nulls, NaN counts
    NaN, and null is a partition. Equal values are counted once. The bounds of the buckets come from a
    pass over the column when this is called; they decide how the work is dealt, not what is counted.
    """
    if rows.schema[order].dataType.typeName() != "double" or not (0 <= preceding < math.inf and 0 <= following < math.inf):
        raise ValueError("a range count takes a double column and finite distances of 0 or more")
    counted = rows.select(F.col(partition).alias("part"), F.col(order).alias("at")).groupBy("part", "at").agg(F.count(F.lit(1)).alias("n"))

    # Of equal values, lower bounds come before the rows and upper bounds after them.
    zero = F.lit(0).cast("long")
    kinds = [(F.col("at") - F.lit(float(preceding)), 0, zero), (F.col("at"), 1, F.col("n")), (F.col("at") + F.lit(float(following)), 2, zero)]
    points = counted.select("part", "at", F.inline(F.array(*(F.struct(v.alias("value"), F.lit(k).alias("kind"), n.alias("n")) for v, k, n in kinds))))
    points = _bucketed(points, _splits(rows, order, (0.0, -preceding, following), bucket_rows))

    # What lies in the buckets below is the first point of each.
    below = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy("part", "bucket").agg(F.sum("n").alias("n"))
    starts = totals.select("part", F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("value"), F.lit(-1).alias("kind"), F.coalesce(F.sum("n").over(below), zero).alias("n"), "bucket")
    running = Window.partitionBy("part", "bucket").orderBy(F.asc_nulls_first("value"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = points.unionByName(starts).withColumn("upto", F.sum("n").over(running)).where("kind IN (0, 2)")
    near = upto.groupBy("part", "at").agg(F.sum(F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto"))).alias("near"))

    # The value first: a sort compares the first column by its prefix.
    same = F.col(f"r.{order}").eqNullSafe(F.col("c.at")) & F.col(f"r.{partition}").eqNullSafe(F.col("c.part"))
    return rows.alias("r").join(near.alias("c"), same).select("r.*", F.col("c.near").alias(name))


def _splits(rows: DataFrame, order: str, shifts: tuple[float, ...], bucket_rows: int) -> list[float]:
    """Rising bounds of buckets that hold few of the values, and few of the values moved by each of ``shifts``."""
    buckets = min(QUANTILES, rows.count() // bucket_rows + 1)
    if buckets == 1:
        return []
    found = rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    # 0.0 is added to make 0.0 of -0.0, which a binary search would tell apart.
    return sorted({v for q in found for v in (q + s + 0.0 for s in shifts) if math.isfinite(v)})


def _bucketed(points: DataFrame, splits: list[float]) -> DataFrame:
    """``points`` with ``bucket``, rising with ``value`` in Spark's order: nulls first, NaN last."""
    from pyspark.ml.feature import Bucketizer

    bounds = [-math.inf, *(splits or [0.0]), math.inf]
    made = Bucketizer(splits=bounds, inputCol="value", outputCol="bucket", handleInvalid="keep").transform(points)
    return made.withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(-1)))
