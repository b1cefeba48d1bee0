"""Session helpers shared by operators that iterate."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` of the session.

    A cluster names a folder there that all executors share. Only where the setting is
    absent and the master is plain ``local`` (tests) a temporary folder is set.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="estatelens-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder and cut its lineage there.

    Unlike ``checkpoint()`` the written table has a known size, so the planner of the next step chooses joins
    by facts instead of by products of estimates. The folder is removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/estatelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` returned and that nothing reads any more; other tables are left alone.

    The collection lets Spark remove the shuffle files of the steps that are over, which it else keeps until the driver's memory is short.
    """
    if path := getattr(df, "_cut_path", None):
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, for sessions that were not started beside it."""
    context = spark.sparkContext
    if getattr(context, "_estatelens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="estatelens-code-")) / "estatelens.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    context._estatelens_shipped = True


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its row number (from 0) in a total order, without sorting all rows in one task.

    Rows are range-partitioned and sorted per partition; the sizes of the partitions, one row each, give the offsets.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))
    offsets = sizes.select(F.col("__part").alias("__p"), "low", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("off"))
    return placed.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("off") + F.col("__at") - F.col("low")).drop("__part", "__at", "__p", "low", "off")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
