"""Looking at folders through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    made, files = _at(spark, path)
    return files.exists(made)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern with stars matches, in order of name."""
    made, files = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(made) or [])


def remove(spark: SparkSession, path: str) -> None:
    made, files = _at(spark, path)
    files.delete(made, True)
