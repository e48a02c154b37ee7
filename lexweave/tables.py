"""Tables written once and read again, their sizes, and places of rows in an order that no single task has to sort."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20  #: of Parquet, up to which a written table goes to every worker
_local: list[str] = []
_registered: set[str] = set()


def folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder that the cluster shares, or a local one where none is set on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="lexweave-"))
        shared = f"file://{_local[0]}"
    return f"{shared.rstrip('/')}/lexweave-base-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet once and read again; it is removed when the application ends."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    base = folder(spark)
    if base not in _registered:
        _registered.add(base)

        def drop() -> None:
            try:
                fs, p = _path(spark, base)
                fs.delete(p, True)
            except Exception:  # the session may have ended before the interpreter
                pass

        atexit.register(drop)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, name: str = "small", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once, and marked for broadcast if its files have at most ``limit`` bytes; measured, not assumed."""
    table, path = _written(df, name)
    fs, p = _path(df.sparkSession, path)
    return F.broadcast(table) if fs.getContentSummary(p).getLength() <= limit else table


def _ranges(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` cut into ranges of (keys, order), the number of its range with each row.

    The numbers are written, since a later read may deal rows out differently.
    """
    return written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def placed(df: DataFrame, keys: list[str], order: list[str | Column], place: str) -> DataFrame:
    """Adds the place of each row, from 1, in the order within its keys.

    As row_number over a window, but a key's rows may be sorted by many tasks: ranges
    are numbered one by one and begin where the ranges before them end.
    """
    ranged = _ranges(df, keys, order)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_m"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*keys, "_range", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_first"))
    within = ranged.withColumn(place, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)).cast("long"))
    return _joined(within, firsts, keys).withColumn(place, F.col(place) + F.col("_first")).drop("_first", "_range")


def followed(df: DataFrame, keys: list[str], order: str, following: str) -> DataFrame:
    """Adds ``order`` of the next row within the keys, null after the last; distributed as ``placed``."""
    ranged = _ranges(df, keys, [order])
    begins = ranged.groupBy(*keys, "_range").agg(F.min(order).alias("_min"))
    firsts = begins.select(*keys, "_range", F.lead("_min").over(Window.partitionBy(*keys).orderBy("_range")).alias("_next"))
    within = ranged.withColumn(following, F.lead(order).over(Window.partitionBy(*keys, "_range").orderBy(order)))
    return _joined(within, firsts, keys).withColumn(following, F.coalesce(following, "_next")).drop("_next", "_range")


def _joined(rows: DataFrame, per_range: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their range; keys may be null."""
    other = per_range.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumnRenamed("_range", "_r")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, on).drop("_r", *[f"_k{i}" for i in range(len(keys))])
