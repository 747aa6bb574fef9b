"""Removal of repeated passages by seed and extend.

Seeds: every run of ``window`` words keeps the smallest hash of its runs of ``SEED`` words (winnowing). Equal windows have equal
seeds, so a window can only repeat where its anchor does. Extension: an anchor is extended both ways over all windows that it
stands for, and the extended match is keyed by the 128-bit digest of its words. Documents are joined on their anchors: anchors of
one document end there; where all documents of an anchor agree over its whole reach the match is done, for any number of them.
Where they differ, the match is cut to the stretch on which they agree: one document for each different reach brings its
windows, keyed by the digests of their words, and each learns the smallest document that has it. So a window meets all its
partners at once and no pairs are made, however common a passage is. Adjoining windows are the maximal repeats of at least
``window`` words.

Seeds are 64-bit hashes and only propose; what is removed is decided on words (128-bit digests of them).

Documents of equal word sequences are one class: its later members are repeats from end to end and take no part as seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import batches, claim, discard, docs_text, free_name, joined, stage
from panelforge.llm.shingles import forget, window_hashes, word_hashes

SEED = 12


def seeds(h: np.ndarray, window: int) -> np.ndarray:
    """The seed of each window over the word hashes ``h``: the smallest hash of the runs of words in it."""
    runs = window_hashes(h, min(SEED, window))
    width = window - min(SEED, window) + 1
    have, low = 1, runs
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    over = width - have
    return np.minimum(low[: len(low) - over], low[over:]) if over else low


def pairs_of(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit digests as two columns of 64 bits, which group faster than bytes."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


def stretches(words: list[bytes], joined_words: bytes, first: np.ndarray, n: np.ndarray | int) -> list[bytes]:
    """The digest of the ``n`` words from each of ``first`` on."""
    begin = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    return [xxhash.xxh3_128_digest(joined_words[a:b]) for a, b in zip(begin[first].tolist(), (begin[first + n] - 1).tolist(), strict=True)]


def lists(counts: list[int], columns: dict[str, pa.Array]) -> pa.ListArray:
    """A list of structs a row."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def scan(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, digest, part, all_sha256, anchors``; ``digest`` names the word sequence, ``part`` is half of it.

    An anchor stands for ``n`` windows from word ``at`` on; ``x, y`` are the digest of all their words.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", forget)
        for part in batches(parts):
            n, digest, half, sha, counts, seed, at, size, reach = [], [], [], [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = (text or "").encode().split()
                whole = b" ".join(words)
                n.append(len(words))
                digest.append(xxhash.xxh3_128_digest(whole))
                half.append(int.from_bytes(digest[-1][:8], "little", signed=True))
                sha.append(hashlib.sha256(whole).hexdigest())
                if len(words) < window:
                    counts.append(0)
                    continue
                own = seeds(word_hashes(words), window)
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                each = np.diff(np.append(first, len(own)))
                counts.append(len(first))
                seed.append(own[first].view(np.int64))
                at.append(first.astype(np.int32))
                size.append(each.astype(np.int32))
                reach += stretches(words, whole, first, each + window - 1)
            x, y = pairs_of(reach)
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            anchors = lists(counts, {"seed": flat(seed, np.int64), "at": flat(at, np.int32), "n": flat(size, np.int32), "x": x, "y": y})
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(half, pa.int64()), pa.array(sha), anchors], ["doc_id", "n_words", "digest", "part", "all_sha256", "anchors"])

    return docs_text(docs).mapInArrow(run, "doc_id long, n_words long, digest binary, part long, all_sha256 string, anchors array<struct<seed:long,at:int,n:int,x:long,y:long>>")


def cut_windows(chosen: DataFrame, window: int) -> DataFrame:
    """``doc_id, digest, text, sure, windows``: of ``chosen`` (``doc_id, text, found``) the windows of anchors that are open, by their words.

    ``found`` holds anchors as ``part, at, n, sure, open``; ``part`` tells texts that share an id apart; ``sure`` keeps those that are
    repeats over their whole reach.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            digest, sure, counts, starts, found = [], [], [], [], []
            for text, own in zip(part.column("text").to_pylist(), part.column("found"), strict=True):
                words = (text or "").encode().split()
                whole = b" ".join(words)
                digest.append(xxhash.xxh3_128_digest(whole))
                mark, at, n, is_sure, is_open = (own.values.field(k).to_numpy(zero_copy_only=False) for k in ("part", "at", "n", "sure", "open"))
                mine = mark == int.from_bytes(digest[-1][:8], "little", signed=True)
                is_sure, is_open = is_sure & mine, is_open & mine
                sure.append([{"at": int(a), "n": int(k)} for a, k in zip(at[is_sure], n[is_sure], strict=True)])
                first = np.concatenate([np.arange(a, a + k) for a, k in zip(at[is_open], n[is_open], strict=True)] or [np.zeros(0, np.int64)])
                counts.append(len(first))
                starts.append(first.astype(np.int32))
                found += stretches(words, whole, first, window) if len(first) else []
            x, y = pairs_of(found)
            windows = lists(counts, {"start": pa.array(np.concatenate(starts) if starts else np.zeros(0, np.int32)), "x": x, "y": y})
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), part.column("text"), pa.array(sure, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))), windows], ["doc_id", "digest", "text", "sure", "windows"])

    return chosen.mapInArrow(run, "doc_id long, digest binary, text string, sure array<struct<at:int,n:int>>, windows array<struct<start:int,x:long,y:long>>")


def repeats(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """What is repeated in ``docs``: the scan, and the texts that hold repeats of an earlier document.

    (1) ``doc_id, n_words, digest, all_sha256, copy``: ``copy`` marks later documents of an equal word sequence.
    (2) ``doc_id, digest, text, stretches`` of first documents: ``stretches`` (``at, n``) are runs of ``n`` windows from word ``at`` on
    that a document with a smaller ``doc_id`` has.
    """
    texts = docs_text(docs)
    seen = stage(scan(docs, window), "scan")
    named = seen.where("doc_id is not null")
    first = stage(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")), "firsts")
    same = joined(named.select("doc_id", "digest"), first.where("n_same > 1"), ["digest"], "n_same").where("doc_id > first").select("doc_id", "digest").distinct()
    copies = stage(same.withColumn("later", F.lit(True)), "copies")
    rows = seen.join(copies, ["doc_id", "digest"], "left").withColumn("copy", F.coalesce("later", F.lit(False)) & (F.col("n_words") >= window))
    anchors = stage(rows.where(f"doc_id is not null and later is null and n_words >= {window}").select("doc_id", "part", F.inline("anchors")), "anchors")
    # anchors by their reach: documents that agree over all of it are one
    reach = ["seed", "n", "x", "y"]
    agreed = stage(anchors.groupBy(*reach).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")), "reaches")
    shared = stage(agreed.groupBy("seed").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("kinds")).where("least < most").select("seed", "kinds"), "shared")
    live = stage(joined(agreed, shared, ["seed"], "kinds").where("low < high or kinds > 1"), "live")
    own = joined(anchors, live.select(*reach, "low", "kinds", "rows"), reach, "rows")
    sure, is_open = F.col("doc_id") > F.col("low"), (F.col("doc_id") == F.col("low")) & (F.col("kinds") > 1)
    plan = own.select("doc_id", F.struct("part", "at", "n", sure.alias("sure"), is_open.alias("open")).alias("a")).where("a.sure or a.open").groupBy("doc_id").agg(F.collect_list("a").alias("found"))
    found = stage(cut_windows(texts.join(plan, "doc_id"), window), "extended")
    each = stage(found.where(F.size("windows") > 0).select("doc_id", "digest", F.inline("windows")), "windows")
    owners = stage(each.groupBy("x", "y").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high"), "owners")
    late = joined(each, owners, ["x", "y"], "rows").where("low < doc_id")
    more = late.groupBy("doc_id", "digest").agg(F.collect_set("start").alias("starts"))
    one = F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda s: F.struct(s.alias("at"), F.lit(1).alias("n")))
    cut = found.drop("windows").join(more, ["doc_id", "digest"], "left").select("doc_id", "digest", "text", F.concat("sure", one).alias("stretches")).where(F.size("stretches") > 0)
    discard(first, anchors, agreed, shared, live)
    return rows.drop("anchors", "later", "part"), cut


def maximal(n: int, found: list[dict], window: int) -> list[tuple[int, int]]:
    """The repeats of a text of ``n`` words, first word and end: unions of windows that overlap or adjoin."""
    edge = np.zeros(n + 2, np.int64)
    for s in found:
        edge[min(s["at"], n)] += 1
        edge[min(s["at"] + s["n"] + window - 1, n)] -= 1
    gone = np.append(np.cumsum(edge[:n]) > 0, False)
    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def kept_words(text: str | None, found: list[dict], window: int) -> list[bytes]:
    words, at, out = (text or "").encode().split(), 0, []
    for a, b in maximal(len(words), found, window):
        out += words[at:a]
        at = b
    return out + words[at:]


def maximal_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, start, end``: the maximal passages of at least ``window`` words of which each window is in a document with a smaller ``doc_id``.

    Words count from 0, ``end`` is exclusive. Cases are decided as in :func:`kept_digests`.
    """
    rows, texts = repeats(docs, window)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            out = [(d, a, b) for d, t, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "stretches")), strict=True) for a, b in maximal(len((t or "").encode().split()), found, window)]
            cols = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "end"])

    whole = rows.where("copy").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    return whole.unionByName(texts.mapInArrow(run, "doc_id long, start long, end long")).distinct()


def kept_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: what stays of each document without its repeated words.

    Words are runs of characters other than blanks and 0x09 to 0x0D. A word goes if a window of ``window`` words covers it whose
    words also start somewhere in a document with a smaller ``doc_id``; windows are judged on the input. A null or empty text
    has no words and an empty rest. Rows that repeat are judged alike, each a row of the result; rows with a null ``doc_id``
    lose nothing and take nothing from others. Other columns are left out.
    """
    rows, texts = repeats(docs, window)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            n, sha = [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("stretches").to_pylist(), strict=True):
                kept = kept_words(text, found, window)
                n.append(len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "digest", "n_kept", "rest_sha256"])

    cut = texts.mapInArrow(run, "doc_id long, digest binary, n_kept long, rest_sha256 string").dropDuplicates(["doc_id", "digest"])
    out = rows.join(cut, ["doc_id", "digest"], "left")
    n_kept = F.when(F.col("copy"), 0).otherwise(F.coalesce("n_kept", "n_words"))
    sha = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("rest_sha256", "all_sha256"))
    return out.select("doc_id", "n_words", (F.col("n_words") - n_kept).alias("n_removed"), sha.alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``; texts that lose nothing stay as they are, byte for byte.

    What stays of the others is joined by single blanks. Cases are decided as in :func:`kept_digests`; all columns stay, and
    ``n_chars``, if there, is counted anew for changed texts.
    """
    rows, texts = repeats(docs, window)
    plan, copy = free_name("plan", docs.columns), F.lit(True).alias("copy")
    cut = rows.where("copy").select("doc_id", "digest", copy, F.lit(None).cast("array<struct<at:int,n:int>>").alias("stretches"))
    cut = cut.unionByName(texts.select("doc_id", "digest", F.lit(False).alias("copy"), "stretches"))
    cut = cut.groupBy("doc_id").agg(F.collect_set(F.struct("digest", "copy", "stretches")).alias(plan))

    @F.pandas_udf("string")
    def apply(text, plan):
        import pandas as pd

        out = []
        for t, own in zip(text, plan, strict=True):
            digest = xxhash.xxh3_128_digest(b" ".join((t or "").encode().split()))
            for one in own:
                if bytes(one["digest"]) == digest:
                    t = "" if one["copy"] else b" ".join(kept_words(t, one["stretches"], window)).decode()
                    break
            out.append(t)
        return pd.Series(out)

    both = docs.join(cut, "doc_id", "left")
    touched = both.where(F.col(plan).isNotNull()).withColumn("text", apply("text", plan))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.where(F.col(plan).isNull()).unionByName(touched).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
