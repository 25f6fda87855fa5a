"""Small texts on the shared file system, by the JVM's own client: no job, any scheme that Spark can write to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(conf)
    return jvm, conf, system, system.makeQualified(found)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` under a new name, then rename it over ``path``: readers see the old one or the new one, whole."""
    jvm, conf, system, target = _path(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text at ``path``, or none."""
    jvm, _, system, target = _path(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    _, _, system, target = _path(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    _, _, system, target = _path(spark, path)
    system.delete(target, True)
