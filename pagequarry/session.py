"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagequarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; a temporary folder only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def discard(*settled: DataFrame) -> None:
    """Delete what settle() wrote for these, once nothing will read it again."""
    for df in settled:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: a lineage cut that outlives executors.

    The shuffle files of the job that wrote it are released as soon as it ends,
    as nothing has to be computed from them again.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out
