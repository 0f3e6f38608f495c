"""Small files and folders that all executors share: written whole or not at all."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """A small file, whole or not at all: written beside and moved over the old one in one step, so that a reader finds the one or the other."""
    fs, p = _at(spark, path)
    _, tmp = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    if fs.getScheme() == "file":
        os.replace(tmp.toUri().getPath(), p.toUri().getPath())
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _at(spark, path)  # not spark.read: it passes over names that begin with _
    f = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
    finally:
        f.close()


def temporary_folder() -> str:
    """A folder of this machine that goes when the driver ends; for sessions of one machine only."""
    path = tempfile.mkdtemp(prefix="hexloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: The folder of this application in the place all executors share, by application.
_WORK: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; a temporary one only on one machine, where none is named."""
    app = spark.sparkContext.applicationId
    if app not in _WORK:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = "file://" + temporary_folder()
        _WORK[app] = f"{base}/hexloom-{app}"
        if base.startswith("file://"):
            atexit.register(shutil.rmtree, _WORK[app].removeprefix("file://"), ignore_errors=True)
    return _WORK[app]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place all executors share."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
