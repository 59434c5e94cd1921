"""Folders that only Spark reaches: small text files in them, and names that appear at once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """(file system, Hadoop path)"""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, root = folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = folder(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = folder(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole or not at all; False if the name is taken."""
    fs, at = folder(spark, path)
    parent = at.getParent()
    part = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(
        getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        # Without the option to overwrite, a rename to a name that exists fails.
        context.rename(part, at, options)
    except Exception:
        if not fs.exists(at):
            raise
        fs.delete(part, False)
        return False
    return True
