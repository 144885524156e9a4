"""Intermediate tables in the folder that all machines share, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as text, up to which a side of a join is broadcast.
FEW, FEW_BYTES = 100_000, 16 << 20
_left: list = []  # folders, with their file systems, that go when the driver ends


def store_of(spark: SparkSession, path: str):
    """The file system of a path, as Spark has it, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stage_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs on one machine, below a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pactum-"))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/pactum-{uuid.uuid4().hex}"
    _left.append(store_of(spark, path))
    return path


@atexit.register
def tidy() -> None:
    """Removes what stage_folder has named, as results are lazy and may need it until the end."""
    while _left:
        store, p = _left.pop()
        with contextlib.suppress(Exception):  # the driver's JVM may have gone first
            store.delete(p, True)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts lineage, and computes df once for all its uses: writes it as Parquet in the shared folder and reads it back."""
    path = path or stage_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    store, p = store_of(spark, path)
    store.delete(p, True)


def few(df: DataFrame, rows: int = FEW, size: int = FEW_BYTES) -> DataFrame | None:
    """df as a local table, if it has `rows` rows and `size` bytes at most, as counted now. It is computed twice; stage what is dear."""
    head = df.limit(rows + 1)
    n, b = head.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return df.sparkSession.createDataFrame(head.toArrow(), df.schema) if n <= rows and (b or 0) <= size else None


def small(df: DataFrame, rows: int = FEW, size: int = FEW_BYTES) -> DataFrame:
    """df for a join: broadcast if it is `few`; otherwise left to the planner."""
    local = few(df, rows, size)
    return df if local is None else F.broadcast(local)
