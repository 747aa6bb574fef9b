"""Positions of regular-expression matches with DataFrame functions alone.

Spark returns what matches, not where. Cutting the text at the same expression gives what stands between, and the lengths of
both add up to positions, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sums(lengths: Column) -> Column:
    """Running sums of an array, in rounds that double the reach: n log n steps, where appending one by one would take n squared."""
    rounds = F.ceil(F.log2(F.size(lengths))).cast("int")

    def add(acc: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2.0), k - 1).cast("int")
        return F.transform(acc, lambda v, i: v + F.when(i >= reach, F.get(acc, i - reach)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(lengths) < 2, lengths).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), lengths, add))


def bind(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it: a transform over one element."""
    return F.get(F.transform(F.array(x), f), 0)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>>, start inclusive, end exclusive, leftmost matches that do not overlap."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["before"], 1, F.size(x["found"])), x["found"], lambda b, f: (F.length(b) + F.length(f)).cast("long"))
        return F.zip_with(bind(lengths, sums), x["found"], lambda end, f: F.struct((end - F.length(f)).cast("long").alias("start"), end.alias("end"), f.alias("found")))

    return F.when(text.rlike(pattern), bind(F.struct(matched(text, pattern).alias("found"), between(text, pattern).alias("before")), placed)).otherwise(none)
