"""Folders and small files that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. A temporary folder is set only where nothing is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def located(spark: SparkSession, path: str):
    """Hadoop's file system and path of an address."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = located(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = located(spark, path)
    system.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, at = located(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def stamp(spark: SparkSession, path: str) -> str:
    """Sizes and times of a file or of the files in a folder: differs once the data have been written anew."""
    system, at = located(spark, path)
    if not system.exists(at):
        return "-"
    own = system.listStatus(at)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in own))


def text_of(spark: SparkSession, path: str) -> str:
    system, at = located(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one: of several writers one alone gets True, and no one sees half a file.

    The text is written aside and given its name in one step, by a link on local systems and elsewhere by a rename that does not overwrite.
    """
    system, aside = located(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(urlparse(aside.toUri().toString()).path, urlparse(path).path)
            return True
        jvm = spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        to = jvm.org.apache.hadoop.fs.Path(path)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, to, options)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        system.delete(aside, False)
