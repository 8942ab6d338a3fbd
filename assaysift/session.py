"""Session helpers: sensible defaults and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app_name: str = "assaysift", **conf: str) -> SparkSession:
    """Return a session with adaptive execution, skew handling and UTC timestamps on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording a Python call site per column expression doubles the time to define wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_table(spark: SparkSession, rows: Sequence[tuple], columns: dict[str, str]) -> DataFrame:
    """Return a small table of literals: JVM-side, of known size, without a job."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, columns.items(), strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def checkpoint_folder(spark: SparkSession) -> str:
    """Return this session's folder below the shared checkpoint directory.

    Only a session whose driver and executors are one process may do without that setting; it gets a temporary folder.
    """
    found = getattr(spark, "_assaysift_folder", None)
    if found is None:
        context = spark.sparkContext
        root = context._jsc.sc().getCheckpointDir()
        shared = root.get() if root.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="assaysift-checkpoint-")
        found = f"{shared.rstrip('/')}/assaysift-{uuid.uuid4().hex}"
        spark._assaysift_folder = found
    return found


def reliable_checkpoint(df: DataFrame, **options: object) -> DataFrame:
    """Cut the lineage of ``df`` by a table written to shared storage.

    Lost executors only re-read files. Being a Parquet table, it is pruned by column on every re-read, and its size is
    known to the optimiser. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._assaysift_path = path
    return found


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the table that ``reliable_checkpoint`` wrote for ``df``; frames defined on it become unreadable."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._assaysift_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete the tables this session has written; frames defined on them become unreadable."""
    folder = getattr(spark, "_assaysift_folder", None)
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._assaysift_folder = None
