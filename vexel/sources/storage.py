"""Files through Hadoop's file systems, so that any scheme works and nothing depends on the driver's own disk."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict, new: bool = False) -> bool:
    """Written aside and renamed into place; with ``new`` False if the file is there already."""
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if new and fs.exists(p):
        fs.delete(aside, False)
        return False
    if not new and fs.exists(p):
        fs.delete(p, False)
    return fs.rename(aside, p)


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """A new file; False if it is there already, so of two writers one is told."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    return True


def rename(spark: SparkSession, a: str, b: str) -> bool:
    fs, p = _fs(spark, a)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(b))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
