"""Helpers that the corpus operators share: table access, staged tables and text splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it: blank and 0x09 to 0x0D. ``bytes.split()`` cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what ``spark.checkpoint.dir`` names. A temporary folder is set only where nothing is set and the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables of :func:`stage` that no plan reads any more."""
    for df in staged:
        if (path := _paths.pop(df, None)) is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A key with more than one in so many of a table's rows is heavy: there are fewer heavy keys than this.
HEAVY = 1000


def joined(rows: DataFrame, few: DataFrame, key: list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``few``, which holds one row a key and, in ``count``, how many of ``rows`` have that key.

    Keys that more than a thousandth of the rows have, fewer than a thousand by their definition, are sent to every task, so their
    rows stay where they are. The others meet by a shuffle. Both sides are read twice; ``total`` is the sum of ``count``, if known.
    """
    total = few.agg(F.sum(count)).first()[0] or 0 if total is None else total
    heavy, light = F.broadcast(few.where(F.col(count) * HEAVY > total)), few.where(F.col(count) * HEAVY <= total)
    rest = rows.join(heavy.select(*key), key, "left_anti").join(light, key)
    return rows.join(heavy, key).unionByName(rest)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``position`` (from 0) in a total order: a range sort, written with each row's place in its part, then the parts' offsets."""
    spark = rows.sparkSession
    sorted_rows = stage(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    sizes = sorted_rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a sorted part
    ends = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    offsets = spark.createDataFrame([(r.part, at) for r, at in zip(sizes, ends)], "part long, before long")
    here = sorted_rows.withColumn("part", part)
    return here.join(F.broadcast(offsets), "part").withColumn("position", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "place", "before")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores behind it until no column of ``taken`` has that name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


#: Texts that a worker takes up together: rows and bytes, at most (a longer text is taken up alone).
BATCH_BYTES = 8 << 20


def batches(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``BATCH_BYTES``, so that a run of very long texts does not fill the worker's memory."""
    for part in parts:
        each = max(1, min(rows, part.num_rows * BATCH_BYTES // max(part.nbytes, 1)))
        for at in range(0, part.num_rows, each):
            yield from _cut(part.slice(at, each))
    trim()  # the worker lives on for other tasks


def _cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Halves until a slice is small or one row: rows differ in length."""
    if part.num_rows > 1 and part.nbytes > 2 * BATCH_BYTES:
        half = part.num_rows // 2
        yield from _cut(part.slice(0, half))
        yield from _cut(part.slice(half))
    else:
        yield part


def trim() -> None:
    """Hand unused memory of Arrow and the C library back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_memory: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Say whose memory of words or chunks a worker holds: another operator's is cleared, as executors keep workers from stage to stage."""
    if _memory and _memory[0][0] != owner:
        _memory.pop()[1]()
        trim()
    if not _memory:
        _memory.append((owner, clear))


def spread(spark: SparkSession) -> int:
    """Partitions for a keyed exchange of rows that later steps hold together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def docs_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns, of any name, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Rows of ids that are sent to every executor at most: a few tens of MB.
MOST_IDS = 500_000


def sent_if_few(ids: DataFrame) -> DataFrame:
    """``ids`` (one column of ids, written before) to be broadcast if their counted rows allow; else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids
