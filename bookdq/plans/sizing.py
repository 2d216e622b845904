"""Size-checked broadcasts and intermediate tables in the shared folder of the cluster."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROADCAST_ROWS = 50_000
stored: list[str] = []  # folders of tables written by this process, in order

_local_dirs: dict[str, str] = {}


def collect_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> list[Row] | None:
    """The rows of a frame of at most `max_rows` rows, else None. The driver reads max_rows + 1 rows at most."""
    rows = df.limit(max_rows + 1).coalesce(1).collect()  # the limit as part of one job, not partition by partition
    return rows if len(rows) <= max_rows else None


def broadcast_rows(spark: SparkSession, rows: list[Row], schema: StructType) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only a local master may fall back to a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def store(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write a frame once as parquet in the shared folder and continue from the copy; the second value removes it.

    For intermediates that several later steps read and that are small next to the book (policy grain, aggregated
    levels): the lineage is cut, column pruning still works, and a lost executor re-reads instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    stored.append(path)
    return spark.read.schema(df.schema).parquet(path), lambda: delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """As `store`, kept until `drop_materialized`."""
    return store(df, label)[0]


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/bookdq/{spark.sparkContext.applicationId}"


def drop_materialized(spark: SparkSession) -> None:
    """Remove every table `materialize` wrote in this application."""
    delete(spark, _own_folder(spark))
