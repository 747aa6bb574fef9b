"""Readers and writers: Parquet tables that may be absent, JSON records, atomic partition overwrite, JSON results."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.functions.numeric import finite
from panelforge.sources.versioned import Table


def scan_table_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def scan_for(table: DataFrame, symbols: DataFrame | list, first=None, last=None) -> DataFrame:
    """Rows of some symbols and dates: short lists are pushed to the scan, long ones come as a table for a semi join."""
    if first is not None or last is not None:
        table = table.where(F.col("dt").between(first, last))
    return table.where(F.col("sym").isin(symbols)) if isinstance(symbols, list) else table.join(symbols.select("sym").distinct(), "sym", "left_semi")


def json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON array files, with ``file``; broken files give NULL rows instead of a failure."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_name"))


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``df`` holds, and no others; readers see the old or the new files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without_non_finite(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def write_json_result(df: DataFrame, path: str) -> None:
    """JSON documents, with numbers that JSON cannot hold as null."""
    without_non_finite(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def refreshed(spark: SparkSession, source: str, cache: str, read: Callable[[list[str]], DataFrame]) -> tuple[DataFrame, int]:
    """What ``read`` makes of the files in folder ``source``, kept under ``cache``; and how many files were read this time.

    Of each file the cache knows size and time: only files that are new or differ are read again, those that are gone go, and others stay as
    they were written. ``read`` gets paths and returns rows; the listing is a Spark job on the files' metadata alone.
    """
    rows, known = Table(spark, f"{cache}/rows", "_file"), Table(spark, f"{cache}/files")
    kind = "_file string, length long, at timestamp"
    now = spark.read.format("binaryFile").load(source).select(F.col("path").alias("_file"), "length", F.col("modificationTime").alias("at"))
    before = known.read(schema=spark.createDataFrame([], kind).schema)
    changed = [r[0] for r in now.exceptAll(before).select("_file").collect()]  # names of files to be read, as the reader needs them
    gone = {r[0] for r in before.join(now, "_file", "left_anti").select("_file").collect()}
    if changed or gone:
        at = rows.latest()
        old = [p for p in rows.manifest(at)["parts"] if p["key"] not in gone and p["key"] not in changed]
        new = read(changed).withColumn("_file", F.col("_metadata.file_path")) if changed else None
        kept = json.loads(new.schema.json()) if new is not None else rows.manifest(at)["schema"]
        rows.commit(at, old + (rows.written(new) if new is not None else []), kept, "refresh")
        known.replace(now)
    return rows.read().drop("_file"), len(changed)
