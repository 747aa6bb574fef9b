"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``size`` coordinates. In round i < size every shingle is hashed into a random bin with a value that grows with the
round; in round size + i all shingles go to bin i. A bin keeps its smallest value, so it is filled by the earliest round
that reaches it, and after 2 size rounds every bin is filled. Two sketches agree in a coordinate with a chance equal to
their sets' similarity, with the concentration of independent coordinates, at the cost of about one hash a shingle for
large sets.

Runs of coordinates (bands) are joined. Documents of equal sets are one class and take part once. In each bucket all members
are verified against the bucket's smallest id on their full shingle sets; buckets in which a member fails are compared in
full, in blocks of bounded size, and return a spanning forest of the verified links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import batches, claim, discard, docs_text, joined, sent_if_few, stage
from panelforge.llm.components import components
from panelforge.llm.embed_dedup import spanning
from panelforge.llm.shingles import forget, mix, shingle_set

SIZE = 128
BIN_BITS, ROUND_BITS = 7, 9
#: Shingles that a comparison of full sets takes up together, about.
PER_RANGE = 1 << 18
SEEDS = np.random.default_rng(5).integers(0, 1 << 63, 2 * SIZE, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The ``SIZE`` coordinates of a set that is not empty: round and value, the smallest in each bin."""
    out, done = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64), 0
    low = np.uint64(64 - BIN_BITS)
    step = max(1, -(-700 // len(shingles)))  # about as many hashes as fill all bins
    while done < SIZE and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(done, min(SIZE, done + step))
        h = mix(shingles[None, :] ^ SEEDS[rounds][:, None])
        bins = h >> low
        values = (rounds.astype(np.uint64)[:, None] << np.uint64(64 - BIN_BITS - ROUND_BITS)) | ((h << np.uint64(BIN_BITS)) >> np.uint64(BIN_BITS + ROUND_BITS))
        keys = np.sort(((bins << low) | values).ravel())
        own = (keys >> low).astype(np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] = np.minimum(out[own[first]], keys[first] & np.uint64((1 << (64 - BIN_BITS)) - 1))
        done += len(rounds)
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max).tolist():  # the rounds that fill bin b for certain
        h = mix(shingles ^ SEEDS[SIZE + b])
        out[b] = np.uint64(SIZE + b) << np.uint64(64 - BIN_BITS - ROUND_BITS) | (h >> np.uint64(BIN_BITS + ROUND_BITS)).min()
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of ``rows`` coordinates; the run's number is part of it."""
    n = len(coordinates) // rows
    parts = coordinates[: n * rows].reshape(n, rows)
    h = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in range(rows):
        h = mix(h ^ parts[:, c]) + np.uint64(c)
    return h


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows ``left`` and ``right`` of ``sets`` with den * intersection >= num * union."""
    sizes = np.array([len(s) for s in sets])
    meet = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    # sets are sorted: one range of hashes at a time, so that memory does not grow with the texts
    n_ranges = max(1, -(-int(sizes.sum()) // PER_RANGE))
    edges = (np.arange(1, n_ranges, dtype=np.float64) / n_ranges * 2.0**64).astype(np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s.view(np.uint64), edges), [len(s)]]) for s in sets]
    width = 2048
    for k in range(n_ranges):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        values, column = np.unique(np.concatenate(own), return_inverse=True)
        common = np.bincount(column, minlength=len(values)) > 1
        keep = common[column]
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in own])[keep], (np.cumsum(common) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(common.sum()), width):
            a, b = np.searchsorted(column, [at, at + width])
            r, c = row[a:b], column[a:b] - at
            x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            x[place_l[r][place_l[r] >= 0], c[place_l[r] >= 0]] = 1
            y[place_r[r][place_r[r] >= 0], c[place_r[r] >= 0]] = 1
            meet += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - meet
    p, q = np.nonzero(den * meet >= num * union)
    return left[p], right[q]


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, rows: int = 6, block: int = 512, block_shingles: int = 1 << 20, meet_rows: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents are linked at a similarity of ``percent`` / 100 or more.

    Sets hold the distinct shingles of ``words`` words of the whole text, A to Z in lower case; a text of fewer words is one
    shingle, and a null, empty or blank text has none and links with nothing. With 21 bands of 6 coordinates a pair at 0.85 is
    found with 0.9999 and one at 0.80 with 0.998. Sets are compared by 64-bit hashes of their shingles. Rows that share a
    ``doc_id`` are one document in links and each a row of the result; rows with a null ``doc_id`` link with nothing and stay
    kept, with a null component. Other columns are left out.
    """
    spark = docs.sparkSession
    n_bands = SIZE // rows

    def signatures(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", forget)
        for part in batches(parts):
            n, same, keys = [], [], []
            for text in part.column("text").to_pylist():
                own = shingle_set(text, words)
                n.append(len(own))
                if len(own):
                    same.append(xxhash.xxh3_128_digest(own.tobytes()))
                    keys.append(bands(sketch(own), rows).view(np.int64))
                else:
                    same.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "same", "bands"])

    texts = docs_text(docs)
    signed = stage(texts.mapInArrow(signatures, "doc_id long, n_shingles long, same binary, bands array<long>"), "signatures")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets have equal 128-bit digests: one class, named after its smallest id
    kind = ["same", "n_shingles"]
    classes = stage(able.groupBy(*kind).agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    copies = joined(able.select("doc_id", *kind), classes.where("n > 1").select(*kind, "rep", "n"), kind, "n").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    entries = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = stage(entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"), F.min("rep").alias("head")).where("n > 1"), "heads")
    members = stage(joined(entries.drop("n_shingles"), buckets, ["band", "key"], "n"), "buckets")
    discard(buckets)
    # a head's set goes to as many groups as it takes to keep each small
    stars = members.where("rep <> head").groupBy("rep", "head").agg(F.ceil(F.max("n") / meet_rows).cast("int").alias("groups"))
    heads = stars.groupBy("head").agg(F.max("groups").alias("groups")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int")).drop("groups")
    # full sets of all members, made once
    wanted = sent_if_few(stage(members.select(F.col("rep").alias("doc_id")).distinct(), "members"))

    def full(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", forget)
        for part in batches(parts):
            sets = [shingle_set(t, words).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    chosen = texts.join(wanted, "doc_id", "left_semi")
    sets = stage(chosen.mapInArrow(full, "rep long, shingles array<long>").groupBy("rep").agg(F.min("shingles").alias("shingles")), "sets")
    both = stars.join(sets, "rep").join(heads.join(sets.select(F.col("rep").alias("head"), F.col("shingles").alias("other")), "head"), ["head", "salt"])
    meet = F.size(F.array_intersect("shingles", "other"))
    checked = stage(both.select("rep", "head", (100 * meet >= percent * (F.size("shingles") + F.size("other") - meet)).alias("linked")), "stars")
    # buckets with a member that is not linked to the head are compared in full
    open_buckets = stage(members.join(checked.where("not linked").select("rep", "head"), ["rep", "head"]).groupBy("band", "key").agg(F.max("n").alias("rows")), "open")
    rest = joined(members, open_buckets, ["band", "key"], "rows").where("n > 2").withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("total") / block_shingles)).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("b", "other")).withColumn("bj", F.greatest("b", "other"))
    rest = rest.select("band", "key", "bi", "bj", "b", "rep").join(sets, "rep")

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        first, last = own.bi.iloc[0], own.bj.iloc[0]
        own = own.sort_values("rep", ignore_index=True)
        b, ids = own.b.to_numpy(), own.rep.to_numpy()
        i, j = forest(list(own.shingles), np.flatnonzero(b == first), np.flatnonzero(b == last), percent, 100)
        low = ids[spanning(len(own), i, j)]
        return pd.DataFrame({"a": ids, "b": low})[low != ids]

    more = rest.groupBy("band", "key", "bi", "bj").applyInPandas(compare, "a long, b long")
    links = checked.where("linked").select(F.col("rep").alias("a"), F.col("head").alias("b")).unionByName(more).unionByName(copies)
    groups = components(links).select(F.col("id").alias("doc_id"), "component_id")
    out = signed.select("doc_id", "n_shingles").join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
