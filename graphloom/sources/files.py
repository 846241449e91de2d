"""Small files that are read and replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it, so that readers see the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    goal = jvm.org.apache.hadoop.fs.Path(path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")
    out = goal.getFileSystem(conf).create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, goal, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
