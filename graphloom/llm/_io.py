"""Tables, span strings and shipping of this package to executors."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import tempfile
import zipfile
from pathlib import Path
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.lineage import setting

_SHIPPED: set[str] = set()
_LOCK = Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that go to Python at once; Spark's default is made for short rows, not for texts.
BATCH_ROWS = 1000
#: Bytes of such a batch, where rows are large.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, and keep batches of texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := (setting(spark, size) or "").removesuffix("b")).isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app in _SHIPPED:
            return
        root = Path(__file__).resolve().parent.parent
        name = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom_src.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` equals, case aside."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, T.StructType]:
    """The columns under names c0, c1, ... that can't clash, and their types."""
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])
    return df.toDF(*schema.names), schema


def tidy(run):
    """A task's function that hands free memory back to the system at its end.

    Python workers live on for other tasks; without this each keeps its peak.
    """

    def run_and_release(batches):
        yield from run(batches)
        release()

    return run_and_release


def release() -> None:
    """Hand free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def fold(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def span_text(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """kind:start:end of (start, kind's place, end), comma-joined."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
