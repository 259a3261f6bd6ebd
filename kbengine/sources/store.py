"""Small text files of a bundle, through the file systems that Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read(spark: SparkSession, path: str) -> str | None:
    where, fs = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(where) and fs.getFileStatus(where).getLen() else "" if fs.exists(where) else None


def write(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _fs(spark, path)
    fs.mkdirs(where.getParent())
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return bool(fs.delete(where, False))
