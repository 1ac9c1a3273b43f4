"""Small files on whatever file system Spark knows: read, atomic replace, list, delete."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _place(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The new text or the old one, never a part: it is written aside and renamed over."""
    jvm = spark._jvm
    _, p = _place(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    fs, aside = _place(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, p, options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with the text; False if one is there already. Whole or not at all: it is written aside and renamed without overwriting,
    which HDFS and local file systems do for one caller alone."""
    jvm = spark._jvm
    fs, p = _place(spark, path)
    _, aside = _place(spark, f"{path}.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(p.getParent())
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        context.rename(aside, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    fs, p = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class KeyValues:
    """Global values by key, a small file each: the last one written stands, and it is there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{key.encode().hex() or '-'}.json"

    def set(self, key: str, value) -> None:
        replace_text(self.spark, self._path(key), json.dumps({"key": key, "value": value}))

    def get(self, key: str, default=None):
        return json.loads(read_text(self.spark, self._path(key)))["value"] if exists(self.spark, self._path(key)) else default

    def delete(self, key: str) -> bool:
        return delete(self.spark, self._path(key))

    def items(self) -> list[tuple]:
        got = [json.loads(read_text(self.spark, f"{self.root}/{n}")) for n in listing(self.spark, self.root) if n.endswith(".json")]
        return sorted((x["key"], x["value"]) for x in got)
