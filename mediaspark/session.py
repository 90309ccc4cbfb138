"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small stages of costly text work still spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # The JVM never compiles methods above 8000 bytes; beyond that Spark's split-up projections are faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # State of streams lives outside the heap, and a batch stores its changes only.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC dates, last key wins in maps)."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cpus: int = 8, app: str = "mediaspark") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in one process (``local``) may do without; anywhere else a folder of the driver's machine would be out of
    the executors' reach, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="mediaspark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def clean(spark: SparkSession) -> int:
    """Remove the scratch tables that this application has written so far; results that still read them must be done."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage between rounds of an iterated join with a reliable checkpoint."""
    scratch(df.sparkSession)
    return df.checkpoint()
