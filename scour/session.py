"""Session helpers.

The library never creates its own cluster settings behind the user's back: it
reads what the session already has.  ``get_session`` exists for tests, the bench
and the command line, where a local session is wanted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Folders of the scratch scopes that are open, below the application's own.
_SCOPE: ContextVar[str] = ContextVar("scratch_scope", default="")


def get_session(master: str | None = None, app_name: str = "scour",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    Session time zone is UTC so timestamps compare equal to other engines; AQE is
    on so shuffle partition counts and skewed joins are re-planned at run time;
    the web UI is off.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only in local mode.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is read, never replaced, and its absence is an error: a folder of
    the driver's machine would be another folder on every executor.  Only a
    session in local mode (a test or a laptop run) gets a fresh temporary one.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not current:
        if not is_local(sc.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="scour-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scour/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for intermediate tables.

    Written tables cut lineage and survive executor loss; they live in the
    shared folder so any executor can read them back.
    """
    return f"{_scratch_root(spark)}{_SCOPE.get()}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted when the scope ends.

    For steps whose result is written inside as well, to a path from outside or
    elsewhere; a result that is still lazy would read tables that are gone.
    """
    token = _SCOPE.set(f"{_SCOPE.get()}/scope-{uuid.uuid4().hex[:12]}")
    try:
        yield
    finally:
        delete_path(spark, _scratch_root(spark) + _SCOPE.get())
        _SCOPE.reset(token)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer; a missing one is fine."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written.

    Call it when the results that read them have been written.
    """
    delete_path(spark, _scratch_root(spark))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and absolute, as Spark's own file system layer resolves it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def on_shared_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path lies below the checkpoint folder or the warehouse, which driver and executors share whatever their scheme."""
    at = qualified(spark, path).rstrip("/") + "/"
    shared = (ensure_checkpoint_dir(spark), spark.conf.get("spark.sql.warehouse.dir", None))
    return any(at.startswith(qualified(spark, s).rstrip("/") + "/") for s in shared if s)
