"""Tables in the folder that the cluster shares. They cut lineage, and a lost executor takes nothing of them along."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_folders: dict[str, str] = {}
#: While a table is written: its shuffle files go when it is done, not when the driver happens to collect garbage, and
#: Python gets Arrow batches that are not much larger than what it takes at a time. Of plans whose generated methods are
#: larger than 8000 bytes, which the JVM does not compile, each operator has its own code instead.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.codegen.hugeMethodLimit": "8000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Without that setting it raises, except on a
    local master, where one machine is the whole cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="pentad-checkpoint-")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def tables_dir(spark: SparkSession) -> str:
    """A folder for the session's intermediate tables; it goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/pentad-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table and goes on from there: computed once, and with sizes that the planner can read. Checkpoints
    would hand on the estimated sizes of the plans before them, products over all joins. The shuffle files behind a table
    go as soon as it is written."""
    path = f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` has written, once nothing reads them any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _remove(df.sparkSession, path)
