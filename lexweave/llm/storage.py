"""Intermediate tables and session plumbing of the corpus operators.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``: every executor and the driver see it, so a lost
executor costs a re-read and not a recomputation.  Where the setting is absent and
the master is local (tests, a laptop) a local folder is made and used instead; on
a cluster that is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_local_folder: str | None = None
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small in bytes.

    The package goes to the executors as a zip file, once for an application.  A row
    is one text of any length, so batches are bounded in bytes too.
    """
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        made = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, made, True)
        with zipfile.ZipFile(f"{made}/lexweave.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(f"{ROOT}/lexweave"):
                for name in sorted(names):
                    if name.endswith(".py"):
                        z.write(f"{folder}/{name}", os.path.relpath(f"{folder}/{name}", ROOT))
        spark.sparkContext.addPyFile(f"{made}/lexweave.zip")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares; a local one only where none is set and the master is local."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _local_folder = _local_folder or tempfile.mkdtemp(prefix="lexweave-")
        folder = f"file://{_local_folder}"
    return folder.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    def drop() -> None:
        try:
            remove(spark, folder)
        except Exception:  # the session may have ended before the interpreter
            pass

    atexit.register(drop)


_registered: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return it reread."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and where it was written."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lexweave-{spark.sparkContext.applicationId}"
    if base not in _registered:
        _registered.add(base)
        _drop_at_exit(spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written with a number of its own for each row, and that column's name.

    The numbers are written because a later read may deal rows out differently when
    executors have come or gone.
    """
    name = "_row"
    while name in df.columns:
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without_rows(df: DataFrame, row: str, dropped: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose numbers are not in ``dropped``, without the number.

    Up to ``broadcast_rows`` numbers go to every worker; more are joined by a shuffle.
    """
    few = dropped.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(dropped) if few else dropped, row, "left_anti").drop(row)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
