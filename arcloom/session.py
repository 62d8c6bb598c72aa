"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for.  None is required for right results.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites are looked up for every column otherwise, which doubles planning time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_local_scratch: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "arcloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master
    (tests, single machine) may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="arcloom-scratch-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; never reused, never local on a cluster."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the tasks this package, once per application.

    Not needed where it is installed on all workers or passed by ``--py-files``.
    """
    from arcloom.sources.files import open_output

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = scratch_path(spark, "package") + "/arcloom.zip"
    with open_output(path) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


# what the innermost open scope undoes; a thread has scopes of its own, so queries that run at once never share one
_scope: ContextVar[list[Callable[[], None]] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside are removed at the end: for work whose result is kept elsewhere.

    So are values that ``share`` broadcasts.  A scope covers the thread that
    opens it; threads started inside have none.
    """
    undo: list[Callable[[], None]] = []
    outer = _scope.set(undo)
    try:
        yield
    finally:
        _scope.reset(outer)
        for step in undo:
            step()


def _at_scope_end(step: Callable[[], None]) -> None:
    scope = _scope.get()
    if scope is not None:
        scope.append(step)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of known size to the tasks; inside a scope it is given back at its end."""
    shared = spark.sparkContext.broadcast(value)
    _at_scope_end(shared.destroy)
    return shared


def remove(path: str) -> None:
    """Delete a folder below the scratch root, if it is there."""
    from pyarrow import fs

    from arcloom.sources.files import locate

    system, p = locate(path)
    if system.get_file_info(p).type == fs.FileType.Directory:
        system.delete_dir(p)


_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: for a table that is written once and then read instead.

    Otherwise they stay until the driver's JVM happens to collect its garbage.
    """
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Unlike a cached plan the result survives the loss of any executor, and the
    Parquet footer gives later joins a true size to choose their strategy by.
    """
    return cut_whole(lambda: df, df.sparkSession, label)


def cut_whole(make: Callable[[], DataFrame], spark: SparkSession, label: str = "stage") -> DataFrame:
    """``cut_lineage`` of what ``make`` returns, without the tables that ``make`` writes on its way there."""
    path = scratch_path(spark, label)
    _at_scope_end(lambda: remove(path))
    with scratch_scope():
        df = make()
        with shuffles_go(spark):
            df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(df: DataFrame, label: str, *by: str) -> str:
    """Write ``df`` to the scratch folder, a folder below it for each value of ``by``, for tasks that read single parts; the path."""
    path = scratch_path(df.sparkSession, label)
    _at_scope_end(lambda: remove(path))
    with shuffles_go(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return path
