"""Session defaults and the shared folder in which lineage is cut.

Iterative operators write their intermediate tables below the folder that the
cluster names in ``spark.checkpoint.dir``.  All executors share that folder, so
a lost executor never loses a step.  Only where the setting is missing and the
master is local (tests) does a temporary folder stand in for it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_LEFT: set[str] = set()
_KEPT: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: dict[int, tuple[int, str]] = {}


def build_session(app: str = "memloom", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="memloom-")
    return _LOCAL_ROOT[app]


@contextmanager
def _shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are dropped at its end; the session's setting comes back once the last thread leaves."""
    with _LOCK:
        n, before = _WRITING.get(id(spark), (0, spark.conf.get(_CLEANUP, "false")))
        _WRITING[id(spark)] = (n + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING[id(spark)]
            if n == 1:
                del _WRITING[id(spark)]
                spark.conf.set(_CLEANUP, before)
            else:
                _WRITING[id(spark)] = (n - 1, before)


def materialize(df: DataFrame, name: str, *, keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` below the shared folder; return it as read back, and its path.

    The shuffle files behind the table are dropped as soon as it is written.  The
    path goes to :func:`release` once nothing reads the table any more; what is
    never released goes with :func:`release_all` between queries, unless ``keep``
    is set, and at last when the process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/memloom-{uuid.uuid4().hex}/{name}"
    with _shuffle_files_dropped(spark):
        df.write.parquet(path)
    (_KEPT if keep else _LEFT).add(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder for files that an operator writes itself; it is released as tables are."""
    path = f"{scratch_root(spark)}/memloom-{uuid.uuid4().hex}/{name}"
    _LEFT.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(parent, True)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`materialize`."""
    for path in paths:
        if path in _LEFT:
            _delete(spark, path)
            _LEFT.discard(path)


def release_all(spark: SparkSession) -> None:
    """Delete what no one released; for the time between two queries, as lazy results may still read it."""
    release(spark, *list(_LEFT))


@atexit.register
def _release_rest() -> None:
    spark = SparkSession.getActiveSession()
    try:
        for path in [*_LEFT, *_KEPT] if spark is not None else []:
            _delete(spark, path)
    except Exception:  # the JVM may be gone already
        pass
    for root in _LOCAL_ROOT.values():
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
