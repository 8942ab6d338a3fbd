"""File-system access through Hadoop, so that local paths and object stores behave alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


def join(*parts: object) -> str:
    """Join path parts with slashes."""
    text = [str(p) for p in parts]
    return "/".join([text[0].rstrip("/"), *[p.strip("/") for p in text[1:]]])


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Return whether a file or directory exists."""
    hadoop, fs = _path(spark, path)
    return bool(fs.exists(hadoop))


def is_dir(spark: SparkSession, path: str) -> bool:
    """Return whether a path is a directory."""
    hadoop, fs = _path(spark, path)
    return bool(fs.exists(hadoop)) and bool(fs.getFileStatus(hadoop).isDirectory())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """List entry names of a directory, sorted; empty when it is absent."""
    hadoop, fs = _path(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop))


def read_text(spark: SparkSession, path: str) -> str:
    """Read one small text file."""
    hadoop, fs = _path(spark, path)
    stream = fs.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file, replacing it."""
    hadoop, fs = _path(spark, path)
    stream = fs.create(hadoop, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
