"""Keyed upserts as plain set operations: functions of the old rows and the new, for ``Table.update``, which writes their result as a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.cleaning import keep_last
from panelforge.operators.universe import interval_issues
from panelforge.sources.versioned import Table


def last_wins(existing: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Rows of both, new before existing on equal keys; within ``new`` the highest ``seq``."""
    order = F.col(seq) if seq else F.lit(0)
    old = existing.withColumn("_o", F.struct(F.lit(0).alias("new"), F.lit(None).cast("long").alias("seq")))
    own = new.withColumn("_o", F.struct(F.lit(1).alias("new"), order.cast("long").alias("seq")))
    return keep_last(old.unionByName(own.drop(seq) if seq and seq not in existing.columns else own), keys, "_o").drop("_o")


def coalescing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a NULL never replaces a value. One aggregate with partial sums."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_s")]
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_s"))).alias(c) for c in rest))


def replace_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new list, with a known ``list_date`` where the new one is blank."""
    known = old.select("sym", F.col("list_date").alias("_old"))
    return new.join(known, "sym", "left").withColumn("list_date", F.coalesce(F.nullif(F.trim("list_date"), F.lit("")), "_old")).drop("_old")


def replace_group(existing: DataFrame, new: DataFrame, group: str) -> DataFrame:
    return existing.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def intervals_validated(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The merged intervals; raises with the issues if there are any."""
    merged = last_wins(existing, new, ["index_code", "sym", "in_date"])
    if issues := interval_issues(merged).limit(20).collect():
        raise ValueError(f"interval issues: {issues}")
    return merged


def purge_not_in(table: DataFrame, keep: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows of symbols in ``keep``, or in ``failed`` (those that could not be fetched). An empty ``keep`` deletes nothing."""
    if keep.where("sym IS NOT NULL").isEmpty():
        return table
    own = keep.select("sym") if failed is None else keep.select("sym").unionByName(failed.select("sym"))
    return table.join(own.distinct(), "sym", "left_semi")


def purge_table(table: Table, keep: DataFrame, failed: DataFrame | None = None) -> tuple[int, int]:
    """:func:`purge_not_in` as the table's next version; returns the rows before and after. Nothing is written where nothing goes."""
    at = table.latest()
    old = table.read(at)
    left = purge_not_in(old, keep, failed)
    before, after = old.count(), left.count()
    if after < before:
        table.replace(left, at)
    return before, after


def data_status(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.count_distinct("sym").alias("n_symbols"))
