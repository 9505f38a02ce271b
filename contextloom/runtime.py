"""What every operator needs from the session: shipped code and a shared folder for lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so Python workers can import it."""
    sc = spark.sparkContext
    # Texts can be long: bound what a batch between JVM and Python holds, where the session has Spark's defaults.
    for key, default, ours in (("maxBytesPerBatch", "67108864b", "4m"), ("maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", ours)
    if getattr(sc, "_contextloom_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="contextloom-")) / "contextloom_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(str(target))
    sc._contextloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one under a local
    master (tests), an error under any other: executors could not see it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_contextloom_dir", None) or tempfile.mkdtemp(prefix="contextloom-shared-")
        sc._contextloom_dir = found
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession) -> str:
    """This application's folder of intermediate tables in the shared folder. It is deleted when the application ends."""
    path = f"{shared_dir(spark)}/contextloom-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_contextloom_scratch", None) != path:
        fs, p = _filesystem(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        spark.sparkContext._contextloom_scratch = path
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far. Frames that were not written yet can't be read afterwards."""
    fs, p = _filesystem(spark, scratch(spark))
    fs.delete(p, True)
    fs.mkdirs(p)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
