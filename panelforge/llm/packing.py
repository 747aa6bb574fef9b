"""Bulk-synchronous best-fit packing of tokenized documents into sequences of a fixed size.

Documents become pieces; pieces and open gaps are sorted by size. Each round is one distributed pass: every gap gets at most
one piece, or several of one size where these outnumber the gaps. The successor sweep runs over size classes (at most ``capacity`` of them, whatever the corpus holds): from the
largest piece size down, pieces are matched with the smallest gap size that holds them. Within a class conflicts are
resolved by rank: the k-th piece of a matched class goes into the k-th gap of its partner. Ranks are counted within
(size, salt) groups and shifted by the counts before them, so no size, however common, meets in one task. Gaps are updated
and the rounds repeat until all pieces have a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.bpe import BATCH, codec, forget
from panelforge.llm.common import batches, claim, discard, docs_text, stage

#: (size class of the gap, first rank in it, size class of the piece, first rank in it, how many gaps, pieces for each)
Match = tuple[int, int, int, int, int, int]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids and ``end_id``, cut only if longer than ``capacity``.

    The first piece of a cut document takes what is over, so all later ones are full.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", forget)
        c, last = codec(vocabulary), np.array([end_id], "<u4").tobytes()
        for part in batches(parts, BATCH):
            rows: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), c.encode_batch([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids += last
                n = len(ids) // 4
                at, end = 0, n % capacity or capacity
                for k in range(-(-n // capacity)):
                    rows.append((doc, k, at, end - at, zlib.crc32(ids[at * 4 : end * 4])))
                    at, end = end, end + capacity
            cols = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(df: DataFrame, size: str, salts: int, *order: str) -> DataFrame:
    """Adds ``rank``: the row's number, from 0, among the rows of its ``size``. Rows of one size are dealt out by a salt."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(size, "_salt").agg(F.count(F.lit(1)).alias("_n")).select(size, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy(size, "_salt").orderBy(*order)))
    return own.join(counts, [size, "_salt"]).withColumn("rank", F.col("_before") + F.col("_k") - 1).drop("_salt", "_k", "_before")


def sweep(items: np.ndarray, used: np.ndarray, gaps: np.ndarray) -> list[Match]:
    """Match piece sizes, largest first, with the smallest gap sizes that hold them; ``items`` and ``used`` count by size and are updated.

    A gap takes one piece, or several of one size where pieces of that size outnumber the gaps.
    """
    out, free, taken = [], gaps.copy(), np.zeros(len(gaps), np.int64)
    for size in range(len(items) - 1, 0, -1):
        gap, open_gaps = size, int(free[size:].sum())
        want = -(-int(items[size]) // open_gaps) if open_gaps else 0
        while items[size] and gap < len(free):
            each = min(want, gap // size, int(items[size]))
            n = int(min(items[size] // each, free[gap])) if each else 0
            if not n:
                gap += 1
                continue
            out.append((gap, int(taken[gap]), size, int(used[size]), n, each))
            items[size] -= n * each
            used[size] += n * each
            free[gap] -= n
            taken[gap] += n
    return out


def opened(items: np.ndarray, used: np.ndarray, capacity: int) -> list[Match]:
    """Pieces that begin sequences of their own: all over half the capacity, else as many of the largest as the rest fills."""
    out, over = [], capacity // 2
    volume = int((items * np.arange(len(items))).sum())
    left = int(items[over + 1 :].sum()) or -(-volume // capacity)
    for size in range(len(items) - 1, 0, -1):
        if n := int(min(items[size], left)):
            out.append((capacity, 0, size, int(used[size]), n, 1))
            items[size] -= n
            used[size] += n
            left -= n
    return out


def best_fit(items: DataFrame, capacity: int, salts: int) -> DataFrame:
    """``length, rank, sequence_id, offset`` for pieces given as ``length, rank``.

    A sequence is named after the piece that opened it. The driver holds counts by size alone: ``capacity`` numbers.
    """
    spark = items.sparkSession
    left, used = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for size, n in items.groupBy("length").count().collect():
        left[size] = n
    name = F.col("length") * F.lit(1 << 44) + F.col("rank")
    placed: list[DataFrame] = []
    gaps: DataFrame | None = None
    counts = np.zeros(capacity + 1, np.int64)
    while left.sum() or not placed:
        found = sweep(left, used, counts) if counts.any() else []
        if found:
            plan = matches(spark, found)
            mine = ranked(gaps, "gap", salts, "sequence_id").join(F.broadcast(plan), (F.col("gap") == F.col("g")) & (F.col("rank") >= F.col("g_from")) & (F.col("rank") < F.col("g_from") + F.col("n")), "left")
            step = stage(
                mine.select("sequence_id", "gap", "size", "each", (F.col("size_from") + (F.col("rank") - F.col("g_from")) * F.col("each")).alias("first")),
                "packing-round",
            )
            each = step.where("size is not null").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)))
            placed.append(each.select(F.col("size").alias("length"), (F.col("first") + F.col("k")).alias("rank"), "sequence_id", (F.lit(capacity) - F.col("gap") + F.col("k") * F.col("size")).alias("offset")))
            gaps = step.select("sequence_id", (F.col("gap") - F.coalesce(F.col("size") * F.col("each"), F.lit(0))).alias("gap"))
        else:
            plan = matches(spark, opened(left, used, capacity)) if left.any() else matches(spark, [])
            new = items.join(F.broadcast(plan), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("size_from")) & (F.col("rank") < F.col("size_from") + F.col("n")))
            # written, so that the plan at the end reads what rounds have placed and does not place it again
            new = stage(new.select("length", "rank", name.alias("sequence_id"), F.lit(0).cast("long").alias("offset")), "packing-opened")
            placed.append(new)
            fresh = new.select("sequence_id", (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0")
            gaps = fresh if gaps is None else gaps.unionByName(fresh)
        least = int(np.flatnonzero(left)[0]) if left.any() else capacity
        gaps = gaps.where(F.col("gap") >= least)  # smaller gaps fit nothing that is left
        counts = np.zeros(capacity + 1, np.int64)
        if left.any():
            for size, n in gaps.groupBy("gap").count().collect():
                counts[size] = n
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def matches(spark: SparkSession, found: list[Match]) -> DataFrame:
    return spark.createDataFrame(found, "g long, g_from long, size long, size_from long, n long, each long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Place all documents in sequences of at most ``capacity`` tokens.

    Returns a row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is the end
    token alone (one piece of length 1), a null ``doc_id`` stays null, rows that repeat are packed each, an empty table gives
    no rows, other columns are left out.
    """
    cut = stage(pieces(docs, vocabulary, end_id, capacity), "packing-pieces")
    largest = cut.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = int(max(16, largest // 100_000))
    key = ("doc_id", "piece", "ids_crc32")
    items = stage(ranked(cut, "length", salts, *key), "packing-items")
    discard(cut)
    at = best_fit(items.select("length", "rank"), capacity, salts)
    return items.join(at, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
