"""Tables written to the folder that driver and executors share, and ranks over a whole table."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
#: Masters whose executors are threads of the driver.
LOCAL = re.compile(r"local(\[[^\]]*\])?")


def ship_code(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application; nothing is done where PYTHONPATH
    already holds the package's folder."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp()) / "tessera_search.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "tessera").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir (a temporary one where executors are threads of the driver and it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """`df` with its row number in that order over the whole table, without one task that holds it all.

    Rows are range-partitioned once and written; each partition numbers its own rows, and the sizes of
    the partitions before it (one row a partition) are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = written(df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()), "ranked")
    sizes = parted.groupBy("part_").agg(F.count("*").alias("size_"))
    before = sizes.withColumn("before_", F.sum("size_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size_"))
    own = parted.withColumn("own_", F.row_number().over(W.partitionBy("part_").orderBy(*order)))
    # one row a partition: its size is bounded by the number of partitions
    return own.join(F.broadcast(before.select("part_", "before_")), "part_").withColumn(name, F.col("before_") + F.col("own_")).drop("part_", "own_", "before_")
