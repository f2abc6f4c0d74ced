"""Written tables in the cluster's shared folder: cut lineage, survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_AGE: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, on a local master alone (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result no longer depends on the executors that computed it, carries true size
    statistics for the planner, and non-deterministic columns (row numbers of a scan) are fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def age(spark: SparkSession) -> int:
    """How often :func:`clear` was called in this session; tables of another age are gone."""
    return _AGE.get(spark.sparkContext.applicationId, 0)


def clear(spark: SparkSession) -> int:
    """Delete what this session has staged so far, once no result is needed any more; returns the number of folders."""
    app, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    paths = _WRITTEN.pop(app, [])
    _AGE[app] = _AGE.get(app, 0) + 1
    gone = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return gone
