"""Signal quality: rank information coefficient, coverage and correlation between features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import average_rank
from panelforge.operators.blocks import packed, unpacked


def correlation(x: Column, y: Column, floor: float = 1e-12) -> Column:
    """An aggregate: Pearson correlation over rows, NULL for (near) constant columns."""
    x, y = x.cast("double"), y.cast("double")
    n, vx, vy = F.count(F.lit(1)), F.var_pop(x), F.var_pop(y)  # central moments: sums of squares lose a constant column's 0
    return F.when((vx * n > floor) & (vy * n > floor), F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))


def rank_ic(signals: DataFrame, min_stocks: int = 10) -> DataFrame:
    """``formula_id, dt, ic, n`` from rows ``formula_id, sym, dt, elig, signal, fwd``: Spearman over eligible pairs on each date."""
    own = signals.where("elig and signal is not null and fwd is not null")
    key = ["formula_id", "dt"]
    ranked = own.withColumn("_a", average_rank(key, "signal")).withColumn("_b", average_rank(key, "fwd"))
    return ranked.groupBy(*key).agg(correlation(F.col("_a"), F.col("_b")).alias("ic"), F.count(F.lit(1)).alias("n")).withColumn("ic", F.when(F.col("n") >= min_stocks, F.col("ic")))


def ic_stats(ics: DataFrame) -> DataFrame:
    """``formula_id, ic_mean, ic_abs_mean, icir, n_dates, direction``."""
    n = F.count("ic")
    icir = F.when(n >= 2, F.avg("ic") / (F.stddev_samp("ic") + 1e-9)).otherwise(0.0)
    return ics.groupBy("formula_id").agg(F.avg("ic").alias("ic_mean"), F.avg(F.abs("ic")).alias("ic_abs_mean"), icir.alias("icir"), n.alias("n_dates"), F.coalesce(F.when(F.avg("ic") >= 0, 1).when(F.avg("ic") < 0, -1), F.lit(1)).alias("direction"))


def coverage(long: DataFrame) -> DataFrame:
    """Share of eligible cells of each feature that are not neutral."""
    return long.where("elig").groupBy("factor_name").agg(F.avg((F.coalesce("value", F.lit(0.0)) != 0).cast("double")).alias("coverage"))


def wide_coverage(wide: DataFrame, names: list[str]) -> DataFrame:
    """:func:`coverage` of the columns ``names``: one row of sums."""
    own = wide.where("elig").agg(*(F.avg((F.coalesce(n, F.lit(0.0)) != 0).cast("double")).alias(n) for n in names))
    return own.unpivot([], names, "factor_name", "coverage").where("coverage is not null")


def wide_rank_ic(wide: DataFrame, names: list[str], fwd: str, min_stocks: int = 10, places: int = 9) -> DataFrame:
    """:func:`rank_ic` of the columns ``names`` against ``fwd``: ``formula_id, sess, ic, n``. Signals equal to ``places`` digits tie."""
    import numpy as np
    import pyarrow as pa

    def ranks(v):
        _, which, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[which]

    def one(keys, rows):
        group, values = unpacked(keys, rows, groups)
        out = []
        for name, v in zip(group[1:], values.T[1:], strict=True):
            seen = ~np.isnan(v) & ~np.isnan(values[:, 0])
            if not seen.any():
                continue
            a, b = (x - x.mean() for x in (ranks(np.round(v[seen], places)), ranks(values[seen, 0])))
            va, vb = a @ a, b @ b
            ic = float(a @ b / np.sqrt(va * vb)) if seen.sum() >= min_stocks and va > 1e-12 and vb > 1e-12 else None
            out.append({"formula_id": name, "sess": keys[0].as_py(), "ic": ic, "n": int(seen.sum())})
        return pa.Table.from_pylist(out, pa.schema([("formula_id", pa.string()), ("sess", pa.int32()), ("ic", pa.float64()), ("n", pa.int64())]))

    groups = [[fwd, *names[k : k + 8]] for k in range(0, len(names), 8)]
    return packed(wide.where("elig"), groups).groupBy("sess", "part").applyInArrow(one, "formula_id string, sess int, ic double, n long")


def wide_corr(wide: DataFrame, names: list[str]) -> DataFrame:
    """:func:`factor_corr` of the columns ``names``, missing values as 0: a task adds up a matrix of products for each session it meets, and
    a session's matrices are added up, so no task sees a whole session."""
    import numpy as np
    import pandas as pd

    size = len(names)
    upper = np.triu_indices(size, 1)

    def sums(parts):
        held = {}
        for p in parts:
            x = np.nan_to_num(p[names].to_numpy(np.float64))
            for day, at in p.groupby("sess").indices.items():
                v = np.column_stack([np.ones(len(at)), x[at]])  # the first row and column are the count and the sums
                held[day] = held[day] + v.T @ v if day in held else v.T @ v
        if held:
            yield pd.DataFrame({"sess": list(held), "m": [m.tobytes() for m in held.values()]})

    def one(rows):
        m = sum(np.frombuffer(b).reshape(size + 1, size + 1) for b in rows["m"])
        n, s, both = m[0, 0], m[0, 1:], m[1:, 1:]
        if n < 2 or not np.diag(both).any():
            return pd.DataFrame({"a": [], "b": [], "c": []})
        cov = both - np.outer(s, s) / n
        good = np.diag(cov) > 1e-12
        good = np.outer(good, good)
        spread = np.outer(np.diag(cov), np.diag(cov))
        c = np.where(good, np.abs(cov / np.sqrt(np.where(good, spread, 1.0))), 0.0)
        return pd.DataFrame({"a": np.array(names, object)[upper[0]], "b": np.array(names, object)[upper[1]], "c": c[upper]})

    names = sorted(names)
    own = wide.where("elig").select("sess", *(F.col(n).cast("double").alias(n) for n in names)).mapInPandas(sums, "sess int, m binary")
    return own.groupBy("sess").applyInPandas(one, "a string, b string, c double").groupBy("a", "b").agg(F.avg("c").alias("corr"))


def factor_corr(long: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``a, b, corr`` for a < b: the mean over dates of the absolute correlation across eligible symbols.

    Sums of products are made as matrices, a date at a time over batches of symbols, so neither the pairs of features nor a date's
    symbols multiply rows. ``names`` are the features, if known. Undefined correlations count 0; dates with fewer than two eligible
    symbols or without any value but 0 are left out.
    """
    import numpy as np
    import pandas as pd

    own = long.where("elig").select("dt", "sym", "factor_name", F.coalesce("value", F.lit(0.0)).alias("v"))
    names = sorted(names or [r[0] for r in own.select("factor_name").distinct().collect()])
    wide = own.groupBy("dt", "sym").agg(F.map_from_entries(F.collect_list(F.struct("factor_name", "v"))).alias("m"))  # a row holds the features
    wide = wide.select("dt", F.array(*(F.try_element_at("m", F.lit(n)) for n in names)).alias("x")).repartition("dt").sortWithinPartitions("dt")
    size = len(names)
    upper = np.triu_indices(size, 1)

    def sums(parts):
        def done(dt, n, top, m):
            if n < 2 or not top > 0 or not size > 1:
                return None
            both, sx, sxx, sxy = m
            with np.errstate(divide="ignore", invalid="ignore"):
                var = sxx - sx * sx / both  # of a, over the rows where b is too
                cov = sxy - sx * sx.T / both
                good = (both > 0) & (var > 1e-12) & (var.T > 1e-12)
                c = np.where(good, np.abs(cov / np.sqrt(np.where(good, var * var.T, 1.0))), 0.0)
            some = both[upper] > 0
            return pd.DataFrame({"a": np.array(names, object)[upper[0]][some], "b": np.array(names, object)[upper[1]][some], "c": c[upper][some]})

        now, n, top, m = None, 0, 0.0, None
        for part in parts:
            for dt, rows in part.groupby("dt", sort=False):
                if dt != now:
                    if now is not None and (out := done(now, n, top, m)) is not None:
                        yield out
                    now, n, top, m = dt, 0, 0.0, [np.zeros((size, size)) for _ in range(4)]
                x = np.array(rows["x"].tolist(), float)
                seen = ~np.isnan(x)
                x, k = np.where(seen, x, 0.0), seen.astype(float)
                n, top = n + len(x), max(top, float(np.abs(x).max(initial=0.0)))
                m = [old + new for old, new in zip(m, (k.T @ k, x.T @ k, (x * x).T @ k, x.T @ x), strict=True)]
        if now is not None and (out := done(now, n, top, m)) is not None:
            yield out

    return wide.mapInPandas(sums, "a string, b string, c double").groupBy("a", "b").agg(F.avg("c").alias("corr"))


def corr_within_family(corr: DataFrame, family: DataFrame) -> DataFrame:
    f = F.broadcast(family)
    own = corr.join(f.withColumnsRenamed({"factor_name": "a", "family": "fa"}), "a").join(f.withColumnsRenamed({"factor_name": "b", "family": "fb"}), "b")
    return own.where("fa = fb").groupBy(F.col("fa").alias("family")).agg(F.avg("corr").alias("corr"), F.count(F.lit(1)).alias("pairs"))


def top_pairs(corr: DataFrame, n: int = 15) -> DataFrame:
    return corr.orderBy(F.desc("corr"), "a", "b").limit(n)


def factor_report(cover: DataFrame, stats: DataFrame, family: DataFrame) -> DataFrame:
    return cover.join(stats.withColumnRenamed("formula_id", "factor_name"), "factor_name", "left").join(F.broadcast(family), "factor_name", "left")


def report_window(panel: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """One row on sessions ``first`` to ``last`` (None: the end): ``stock_count, date_count, mean_eligible_stocks, first_date, last_date``.

    Stocks are those of the whole panel; dates without an eligible stock count 0. No session in the window: counts 0, the rest NULL.
    """
    stocks = panel.agg(F.count_distinct("sym").alias("stock_count"))
    inside = panel.where(F.col("sess") >= first) if last is None else panel.where(F.col("sess").between(first, last))
    days = inside.groupBy("dt").agg(F.count(F.when(F.col("elig"), 1)).alias("n"))
    own = days.agg(F.count("dt").alias("date_count"), F.avg("n").alias("mean_eligible_stocks"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date"))
    return stocks.crossJoin(own)


def whole_report(panel: DataFrame, cover: DataFrame, stats: DataFrame, family: DataFrame, corr: DataFrame, pairs: int = 15) -> DataFrame:
    """The report as rows ``section, name, item, value``: the window (dates as yyyymmdd), each feature's figures, mean correlation within
    families and the closest pairs (``item`` is the partner)."""
    def tall(df: DataFrame, section: str, name, item, value: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), item.alias("item"), F.col(value).cast("double").alias("value"))

    number = lambda c: F.date_format(c, "yyyyMMdd").cast("double")
    window = report_window(panel).withColumns({"first_date": number("first_date"), "last_date": number("last_date"), "stock_count": F.col("stock_count").cast("double"), "date_count": F.col("date_count").cast("double")})
    figures = factor_report(cover, stats, family).drop("family")
    figures = figures.select("factor_name", *(F.col(c).cast("double").alias(c) for c in figures.columns if c != "factor_name"))
    none = F.lit(None).cast("string")
    return (
        tall(window.unpivot([], window.columns, "name", "v"), "window", F.col("name"), none, "v")
        .unionByName(tall(figures.unpivot(["factor_name"], figures.columns[1:], "item", "v"), "feature", F.col("factor_name"), F.col("item"), "v"))
        .unionByName(tall(corr_within_family(corr, family), "family", F.col("family"), none, "corr"))
        .unionByName(tall(top_pairs(corr, pairs), "pair", F.col("a"), F.col("b"), "corr"))
    )
