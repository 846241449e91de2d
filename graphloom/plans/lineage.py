"""Cutting lineage with tables in the folder that all executors share.

Iterative operators and operators that read an intermediate result more than
once write it as Parquet below ``spark.checkpoint.dir`` and read it back.  A
written table survives the loss of any executor, keeps column pruning and
costs less disk than an RDD checkpoint.  Nothing reads the shuffles of a written
table again, so the session is told to free a query's shuffle files when it is
done; tables of a :func:`scratch` block go at its end, and all others when the
application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_LOCK = Lock()
#: Folders written in the innermost open scratch block.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: Frees a query's shuffle files when it is done (Spark 4.1).
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in one process (tests), a
    temporary folder is made and kept for the session.  On a cluster a missing
    setting is an error, since a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        if spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        return _LOCAL_DIRS[app]


def setting(spark: SparkSession, name: str) -> str | None:
    """A setting's value or default; None where this Spark has no such setting."""
    try:
        return spark.conf.get(name)
    except Exception as e:
        if "SQL_CONF_NOT_FOUND" in str(e) or "NoSuchElement" in str(e):
            return None
        raise


def _folder(spark: SparkSession) -> str:
    """The application's own folder, which is deleted when the driver ends; made at the first use."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/graphloom/{app}"
    with _LOCK:
        if app not in _FOLDERS:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            system.mkdirs(path)
            system.deleteOnExit(path)
            _FOLDERS[app] = root
            if setting(spark, _FREE_SHUFFLES) == "false":
                spark.conf.set(_FREE_SHUFFLES, "true")
    return root


_FOLDERS: dict[str, str] = {}


def written(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's options, in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the folders behind a table made by :func:`written`; the caller must not read ``df`` again."""
    spark = df.sparkSession
    own = _folder(spark).split("://")[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end.

    Yields a function that writes a table which stays: the block's result.  In
    a block within another one it stays until that one ends.
    """
    outer = _SCRATCH.get()
    own: list[str] = []
    token = _SCRATCH.set(own)

    def kept(df: DataFrame, name: str = "result") -> DataFrame:
        out = written(df, name)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield kept
    finally:
        _SCRATCH.reset(token)
        for folder in own:
            _delete(spark, folder)
