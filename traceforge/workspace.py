"""Scratch tables and size checks shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Most rows, and bytes of them, that are ever broadcast or collected. Whatever
# may be larger is counted first and shuffled when it does not fit.
SMALL_ROWS = 400_000
SMALL_BYTES = 64 << 20

# Most rows of a scan of whole texts that ``spread`` shuffles, and rows per task of one of narrow columns.
SPREAD_ROWS, TASK_ROWS = 1_000_000, 100_000


def build_session(app_name: str = "traceforge", master: str | None = None, **settings) -> SparkSession:
    """Session with the settings the operators are tested under."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    session must name one, since executors cannot read each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="traceforge-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/traceforge/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later readers prune
    columns. Needed where a column depends on the physical partitioning, and
    where an expensive aggregate is read more than once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished work, which it does once the driver drops what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str, max_rows: int | None = None) -> DataFrame:
    """Hash a scan over all cores, in tasks of at most about ``TASK_ROWS`` rows, before costly per-row work.

    Narrow columns lie close together: a single read split may hold millions of
    rows and keep all cores but one idle. Scans beyond ``max_rows``, if given,
    are left as they are. The rows are counted from the file footers.
    """
    rows = df.count()
    if max_rows is not None and rows > max_rows:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: texts by length, nested values by their JSON."""

    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            nested = F.to_json(F.struct(F.col(f"`{field.name}`")))
            return F.octet_length(nested)
        return F.lit(8)

    return sum((size(f) for f in df.schema.fields), F.lit(0)).cast("long")


def small_or_none(
    df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES
) -> DataFrame | None:
    """``df`` as a local table marked for broadcast, or None when it is too large.

    Rows are counted first, then their bytes, and only then are they collected.
    """
    if df.count() > max_rows:
        return None
    if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) > max_bytes:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema))
