"""Session construction and the two run-time decisions every operator shares: where lineage is cut, what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of a batch of long rows (texts, words, lists) on its way to a Python worker; Spark's own bound is 64 MB.
LONG_ROWS_BYTES = 4 * 1024 * 1024
#: The same where a worker turns numbers into Python objects, some twenty times their size.
LISTED_BYTES = 512 * 1024
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str = "codeweft", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="codeweft-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def batches_of(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Actions run inside hand rows to Python workers in batches of ``size`` bytes; a longer row is a batch of its own.

    A batch exists in the JVM and in the worker, twice each while it grows, for every task of an executor.
    """
    before = spark.conf.get(_BATCH_BYTES, None)
    if size is not None:
        spark.conf.set(_BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if size is not None:
            spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)


def cut(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the checkpoint folder, so iterations neither regrow nor recompute their lineage.

    Unlike a checkpointed RDD the table is columnar, its scans prune columns and push filters down, and its known size lets
    the planner choose broadcasts. ``batch_bytes`` bounds the batches that Python workers are given.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    with batches_of(spark, batch_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Estimate of the size of ``df`` as Arrow or as broadcast rows, measured by one aggregate (nothing is collected)."""
    width = F.lit(0).cast("long")
    for field in df.schema:
        width = width + _width(F.col(f"`{field.name}`"), field.dataType)
    return df.agg(F.sum(width)).first()[0] or 0


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value; nested values are sized by what they hold."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType):
            return F.lit(16) + F.coalesce(F.size(value), F.lit(0)).cast("long") * 8
        own = F.aggregate(value, F.lit(0).cast("long"), lambda sum_, x: sum_ + _width(x, kind.elementType))
        return F.lit(16) + F.coalesce(own, F.lit(0))
    if isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return _width(F.map_keys(value), keys) + _width(F.map_values(value), values)
    if isinstance(kind, T.StructType):
        out = F.lit(8).cast("long")
        for field in kind:
            out = out + _width(value[field.name], field.dataType)
        return out
    return F.lit(16).cast("long")


def broadcast_if_small(df: DataFrame, size_of: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size is under ``limit``; otherwise leave the join to shuffle.

    ``size_of`` may be a cheaper table that bounds ``df`` from above, such as the input of a filtering join.
    """
    return F.broadcast(df) if measured_bytes(df if size_of is None else size_of) <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over all cores when its input is too small to be split that far by itself.

    Files far below cores * maxPartitionBytes arrive in fewer tasks than there are cores; before per-row heavy work that
    small input is worth one shuffle. Larger inputs are returned as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * split else df


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text[-1:] in units else int(text)
