"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
WORD_SPACES = " \t\n\x0b\x0c\r"

_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session names none (tests, one machine) is a folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vectrove-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/vectrove/{tag}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut,
    a lost executor takes nothing with it, and no step is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vectrove_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in frames:
        drop_path(df.sparkSession, df._vectrove_path)


#: Rows of two or three longs up to which a written table is broadcast.
BROADCAST_ROWS = 1 << 20


def sized(df: DataFrame) -> DataFrame:
    """A written table of a few longs a row, broadcast up to a counted number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _scratch.pop(path, None)


@atexit.register
def _drop_rest() -> None:
    for path, spark in list(_scratch.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the JVM is gone; the cluster owner's folder has its own retention
            return


def give_back(run):
    """``run`` for mapInArrow that, when a task ends, returns to the system what
    Arrow and the C library hold free: a worker serves many tasks and operators."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return trimmed


#: Bytes of rows that a Python worker gets at once (a longer row comes by itself).
BATCH_BYTES = 2 << 20


def in_arrow(rows: DataFrame, run, schema) -> DataFrame:
    """``rows.mapInArrow(give_back(run), schema)`` in batches of about BATCH_BYTES.

    Spark's own bound of 64 MB makes one batch of a whole partition, which the
    executor and its worker both hold.  The bound is read when a plan runs, so it
    is lowered for the session, and never raised.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = rows.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows.mapInArrow(give_back(run), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
