"""Session helpers.

Library code never builds its own session: every operator takes DataFrames.
``local_session`` is for tests and the bench only; on a cluster the session and
its ``spark.checkpoint.dir`` come from the deployment.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "hirelens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HIRELENS_DRIVER_MEM", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``; only when it is unset and the
    master is local (tests, local runs) do we point it at a fresh scratch folder:
    executors on other machines could not share it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="hirelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and reread it:
    cuts the lineage like a checkpoint, and readers still prune columns and partitions."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    out = df.write.partitionBy(partition_by) if partition_by else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LANDED: dict[tuple, object] = {}


def landed(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable[[], object]):
    """What ``build`` has written for these input tables in this application: built at first
    use, then read by every query that needs it. A changed input is another key."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stamps = []
    for t in tables:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        status = p.getFileSystem(conf).getFileStatus(p)
        stamps.append((status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(stamps))
    if key not in _LANDED:
        _LANDED[key] = build()
    return _LANDED[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
