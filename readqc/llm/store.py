"""Tables written to the shared folder, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_local: dict = {}  # application -> its own folder, where no other is set
_folders: dict = {}  # (application, shared folder) -> the folder of all its tables


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a new local one, but only for a local master: on a cluster
    each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local.get(spark.sparkContext.applicationId)
        if folder is None:
            local = tempfile.mkdtemp(prefix="readqc-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = _local[spark.sparkContext.applicationId] = "file://" + local
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> SparkSession:
    """For applications that read long texts (the registered queries do): where the session has the default of 64 MB for
    an Arrow batch, it gets 4 MB. The operators themselves leave the session as it is."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, "4m")
    return spark


def own_folder(spark: SparkSession) -> str:
    """This application's folder inside the shared one; release() deletes it."""
    shared = shared_folder(spark)
    return _folders.setdefault((spark.sparkContext.applicationId, shared), f"{shared}/readqc-{uuid.uuid4().hex}")


def mounted(folder: str) -> str | None:
    """The folder as a path that open() takes on every node, if it is one: no scheme or file://."""
    path = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    return path if path.startswith("/") else None


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages start from
    replicated files, so a lost executor never makes them recompute what came before."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has materialized; results not yet written can't be read after that."""
    context = spark.sparkContext
    for key in [k for k in _folders if k[0] == context.applicationId]:
        path = context._jvm.org.apache.hadoop.fs.Path(_folders.pop(key))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be one of df's columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
