"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def build_session(app: str = "colscope", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    n = 8 if cores == "*" else int(cores)
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # recording the Python line of every column expression costs more than building it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster without the setting is
    an error, because executors on other machines could not read what is written there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
    root = tempfile.mkdtemp(prefix="colscope-")
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, below a folder of this application that goes when it ends."""
    sc = spark.sparkContext
    base = f"{scratch_root(spark)}/{sc.applicationId}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def ensure_checkpointing(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once and read back from the shared folder, so that its lineage ends there.

    The files have columns of plain names, and row groups that even a single file can be read in parallel by.
    """
    path = scratch_path(df.sparkSession, label)
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema.fields)])
    df.toDF(*plain.names).write.option("parquet.block.size", 16 << 20).parquet(path)
    back = df.sparkSession.read.schema(plain).parquet(path)
    return back.select(*[F.col(c).alias(f.name, metadata=f.metadata) for c, f in zip(plain.names, df.schema.fields)])


def forget(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split("/")[-2] == sc.applicationId:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    release_shuffles(df.sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to. It learns of these when the driver's heap is
    collected, which by itself may take half an hour."""
    spark.sparkContext._jvm.System.gc()
