"""Intermediate tables in the shared folder of the cluster.

A staged frame is computed once, survives the loss of executors, and reads
back with a size known to the optimizer. So the optimizer itself decides, by
``spark.sql.autoBroadcastJoinThreshold``, whether a staged key table may be
broadcast; beyond that size it plans a shuffled join, whose skewed partitions
adaptive execution splits.

Staged tables live until :func:`drop_staged`, which the owner of a session calls
when the results that read them are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_SETTING = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session.

    A session in local mode without one gets a temporary folder; on a cluster
    that is an error, as executors cannot see each other's folders.
    """
    folder = spark.conf.get(_FOLDER_SETTING, None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_FOLDER_SETTING} to a folder that all executors share")
    application = context.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="runsieve-")
    return _own_folders[application]


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`drop_staged` deletes."""
    folder = shared_folder(spark).rstrip("/")
    path = f"{folder}/runsieve/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``frame`` to the shared folder and return a scan of it.

    ``options`` are the Parquet writer's.
    """
    spark = frame.sparkSession
    path = staged_path(spark, name)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this application staged; how many folders that were."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
