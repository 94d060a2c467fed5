"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="skerry-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for data that goes when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and
    survives the loss of any executor.  It goes when the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`written` that no later step reads, and lets the
    driver's collector find plans without use, whose shuffle files Spark then deletes."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n", most: int = 1_000_000) -> DataFrame:
    """Adds each row's number within its key, from 1 in ``order``.

    A window sorts each key's rows in one task.  Where a key has more than ``most``
    of them, all rows are sorted by ranges instead and counted in each; a key that
    fills many ranges gets its numbers from the counts of the ranges before, so no
    key has to fit into one task.  The numbers are the same.
    """
    largest = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= most:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    placed = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    here = placed.withColumn("_here", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_count"))  # a key has few ranges
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    both = here.join(offsets, [*keys, "_range"])
    return both.withColumn(name, (F.col("_here") + F.col("_before")).cast("long")).drop("_range", "_here", "_before")
