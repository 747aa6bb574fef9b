"""Importance resampling towards a target: hashed n-gram counts of corpus and target weigh documents, Gumbel noise draws among them.

The vocabulary has a head and a tail. Words that make up more than a stated share of the corpus are sent to every task with the exact
CRC state behind them, frequent pairs with their bucket. Other words go through the checksum directly, and longer runs go on from the
state of the run before. Both ways give the same numbers, so what is in the head decides about time alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import batches, discard, numbered, stage, table
from panelforge.llm.words import DIGITS, LETTERS, slices, translation

TABLE = translation(DIGITS + LETTERS)

#: A word (or pair) with more than one in so many of all occurrences is in the head; the head is at most twice as large.
HEAD = 4096
#: Bytes of the longest word that the head holds.
LONGEST = 64


class Frequent:
    """Counts that find all items with at least a share ``1 / most``, in bounded memory (a summary of Misra and Gries, in bulk).

    When there are too many items, the count below the ``2 * most`` largest is taken from all. What an item has lost in all is below
    ``total / (2 * most)``, also when summaries of several tasks are added up.
    """

    def __init__(self, most: int):
        self.room, self.counts = 2 * most, {}

    def add(self, items) -> None:
        counts = self.counts
        for k, n in Counter(items).items():
            counts[k] = counts.get(k, 0) + n
        if len(counts) > 4 * self.room:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.room:
            less = int(np.partition(np.fromiter(self.counts.values(), np.int64, len(self.counts)), -self.room - 1)[-self.room - 1])
            self.counts = {k: n - less for k, n in self.counts.items() if n > less}


def runs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").cast("binary").alias("text"))


def head(docs: DataFrame, n: int, most: int = HEAD) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """The head: frequent words and their CRC states, and (for ``n`` above 1) frequent pairs and their CRC states."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, seen = Frequent(most), Frequent(most), 0
        for part in batches(parts):
            for text in part.column(0).to_pylist():
                for ws in slices(text or b"", TABLE):
                    seen += len(ws)
                    words.add(w for w in ws if len(w) <= LONGEST) if len(ws) and max(map(len, ws)) > LONGEST else words.add(ws)
                    if n > 1:
                        pairs.add(b" ".join(p) for p in zip(ws, islice(ws, 1, None)) if len(p[0]) + len(p[1]) <= LONGEST)
        words.shrink()
        pairs.shrink()
        out = [*words.counts.items(), *pairs.counts.items()]
        for at in range(0, len(out), 10_000):
            some = out[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64())], ["item", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([seen], pa.int64())], ["item", "n"])

    # Counted never exceeds what is there, so at most 2 * most words and as many pairs pass.
    counts = stage(runs(docs).mapInArrow(run, "item binary, n long").groupBy("item").agg(F.sum("n").alias("n")), "head")
    total = counts.where("item IS NULL").agg(F.sum("n")).first()[0] or 0
    found = [bytes(r.item) for r in counts.where(F.col("item").isNotNull() & (F.col("n") * (2 * most) >= total)).select("item").collect()]
    discard(counts)
    return {w: crc32(w) for w in found if b" " not in w}, {tuple(p.split()): crc32(p) for p in found if b" " in p}


class _States(dict):
    """CRC states of words: the head's are looked up, others computed and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class _Pairs(dict):
    """Buckets of pairs: the head's are looked up, others go on from the first word's state."""

    def __init__(self, states: _States, buckets: int, pairs: dict):
        super().__init__((p, s % buckets) for p, s in pairs.items())
        self.states, self.buckets = states, buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(b" " + pair[1], self.states[pair[0]]) % self.buckets


class Features:
    """Buckets of all runs of 1 to ``n`` words of a text."""

    def __init__(self, n: int, buckets: int, words: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int]):
        self.n, self.buckets, self.states = n, buckets, _States(words)
        self.pairs = _Pairs(self.states, buckets, pairs)

    def of(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of features) of one slice after another; features that end in a slice are in it, with words of the one before."""
        last: list[bytes] = []
        for ws in slices(text or b"", TABLE):
            both = last + ws
            states = np.fromiter(map(self.states.__getitem__, both), np.int64, len(both))
            out = [states[len(last) :] % self.buckets]
            if self.n > 1:
                k = max(len(last) - 1, 0)  # pairs from the last word of the slice before
                out.append(np.fromiter(map(self.pairs.__getitem__, zip(islice(both, k, None), islice(both, k + 1, None))), np.int64))
            if self.n > 2:
                longer = [crc32(b" " + w, s) for w, s in zip(both[1:], states.tolist())]
                for length in range(3, self.n + 1):
                    longer = [crc32(b" " + w, s) for w, s in zip(both[length - 1 :], longer)]
                    new = longer[max(len(last) - length + 1, 0) :]
                    out.append(np.array(new, np.int64) % self.buckets)
            yield len(ws), np.concatenate(out)
            last = both[len(both) - self.n + 1 :] if self.n > 1 else []


def bucket_totals(docs: DataFrame, features: Features) -> DataFrame:
    """``bucket, n``: the features of all texts of ``docs`` by bucket; buckets without any are absent."""
    sent = docs.sparkSession.sparkContext.broadcast(features)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        total = np.zeros(f.buckets, np.int64)
        for part in batches(parts):
            for text in part.column(0).to_pylist():
                for _, found in f.of(text):
                    total += np.bincount(found, minlength=f.buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return runs(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A bucket's gain in thousandths of a nat: the smoothed share of the target over that of the corpus. One number a bucket."""
    spark = corpus.sparkSession
    each = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    sums = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row each
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    got = each.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # `buckets` rows, a parameter
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in got]] = [r.gain for r in got]
    return out


def weights(docs: DataFrame, features: Features, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((features, gain))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, gain = sent.value
        for part in batches(parts):
            rows = []
            for text in part.column("text").to_pylist():
                words = n = weight = 0
                for k, found in f.of(text):
                    words, n, weight = words + k, n + len(found), weight + int(gain[found].sum())
                rows.append((words, n, weight))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and ``doc_id`` alone (a null id counts as an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, most: int = HEAD) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs``.

    Features are runs of 1 to ``n`` words of whole texts. ``weight`` sums the gains of a document's features; ``score`` adds Gumbel noise; of
    the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores are drawn, and only
    they have a ``rank``. Ties go to the smaller ``doc_id``.

    A null text has no words (weight 0, never drawn if ``least_words`` is above 0). Rows without ``doc_id`` take part, behind their ties;
    rows that repeat an id share its noise and are drawn one by one. Empty tables give gains of 0 or no rows. Other columns are left out.
    Texts are read three times (head, totals, weights) and never shuffled; the sort moves six numbers a document.
    """
    features = Features(n, buckets, *head(docs, n, most))
    corpus, aim = stage(bucket_totals(docs, features), "totals"), stage(bucket_totals(target, features), "totals")
    gain = gains(corpus, aim, buckets)
    discard(corpus, aim)
    scored = stage(weights(docs, features, gain).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    out = numbered(scored, [enough.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")], "ranked")
    discard(scored)
    return out.withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1)).drop("position")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: The checksum is built in SQL from its polynomial, byte by byte, for each distinct word.
SQL = r"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8),
cut AS (SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL SELECT 't', item_id, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
flat AS (SELECT kind, r, unnest(words) AS w FROM cut),
counted AS (SELECT kind, r, w, count(*) AS n FROM flat GROUP BY kind, r, w),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)),
bytes AS (SELECT w, list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS b FROM coded),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
totals AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 't') AS t FROM counted JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM totals),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM totals, sums),
weighed AS (SELECT r, sum(n * g)::BIGINT AS weight FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
noise AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256(concat('2024:', doc_id)), i, 1)) - 1), lambda a, b: a * 16 + b)::DOUBLE AS h FROM cut WHERE kind = 'd'),
scored AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM noise LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""
