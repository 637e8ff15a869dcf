"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab,
#: form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Rows up to which a table that was counted first may be broadcast.
BROADCAST_ROWS = 20_000
#: Bytes of text that one Arrow batch to a Python worker holds.
BATCH_BYTES = 8 << 20
#: Bits of the bitmaps of ``with_mark``: 1,024 rows of 4 KB at most, which are broadcast.
SLOTS, ROW_BITS = 1 << 25, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long documents cannot pile up in a worker.

    Spark reads these settings when a plan runs, so they stay in the session; those that
    the caller has lowered already are kept.
    """
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 4000)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without any, as in tests."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cartolith-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


class _Runs(threading.local):
    """Folders of the runs of ``scratch_of_run`` that are open in a thread, the innermost last."""

    def __init__(self):
        self.open: list[str] = []


_RUNS = _Runs()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_RUNS.open[-1] if _RUNS.open else shared_dir(spark) + '/cartolith'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_of_run(spark: SparkSession):
    """Intermediate tables written inside, by this thread, are deleted at the end: only for work whose result is written elsewhere."""
    _RUNS.open.append(f"{shared_dir(spark)}/cartolith/run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete_path(spark, _RUNS.open.pop())


def materialize(spark: SparkSession, df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table; call it once results have been written."""
    delete_path(spark, f"{shared_dir(spark)}/cartolith")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if a count of ``df`` (written before) stays within ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_mark(rows: DataFrame, keys: DataFrame, on: list[str], name: str = "_mark") -> DataFrame:
    """``rows`` with a boolean ``name`` that is true where ``keys`` has a row of equal ``on``, and seldom elsewhere.

    The hashed keys are set in a bitmap of fixed size, so most rows that a join would drop
    need not be shuffled.  Beyond some millions of keys more rows are marked, none fewer.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS))
    bucket, bit, bits = (unused(c, rows.columns) for c in ("bucket", "bit", "bits"))
    map_ = keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / ROW_BITS).alias(bucket)).agg(F.bitmap_construct_agg(F.col("s") % ROW_BITS).alias(bits))
    placed = rows.withColumns({bucket: F.floor(slot / ROW_BITS), bit: slot % ROW_BITS}).join(F.broadcast(map_), bucket, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return placed.withColumn(name, F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))).drop(bucket, bit, bits)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even if used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")
