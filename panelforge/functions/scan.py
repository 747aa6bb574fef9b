"""Recursions along an order as column expressions: each step is an affine map, and maps are composed block by block.

y = a x + (1 - a) y' over a long order is not one window: y' has no frame. But a run of steps is itself an affine map, y' times a power of
(1 - a) plus a constant, and such maps compose associatively. So each block of rows is folded into its map side by side with all others,
maps are composed in arrays of bounded length, and rows go on from what enters their block, step by step, as the recursion says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks of an array.
BLOCK, ARRAY = 16, 256


def entering(maps: Column, beta: float) -> Column:
    """The value that enters each map (``n`` steps, adding ``add``) from those before it, and in the end the value that leaves."""
    step = lambda acc, m: F.concat(acc, F.array(F.pow(F.lit(beta), m["n"]) * F.element_at(acc, -1) + m["add"]))
    return F.aggregate(maps, F.array(F.lit(0.0)), step)


def folded(rows: Column | str, field: str, start: Column, a: float) -> Column:
    """The recursion over an array's ``field`` from ``start``; a NULL start means that the next value begins it, a NULL value is no step."""

    def step(acc: Column, r: Column) -> Column:
        return F.when(r[field].isNull(), acc).when(acc.isNull(), r[field]).otherwise(a * r[field] + (1 - a) * acc)

    return F.aggregate(rows, start, step)


def picked(i: int, j: int) -> Column:
    return F.transform("_maps", lambda m: F.struct(m[f"n{i}"].alias("n"), m[f"add{j}"].alias("add")))


def begun(i: int) -> Column:
    """For each of an array's maps the steps before it, and in the end all of them."""
    step = lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m[f"n{i}"]))
    return F.aggregate("_maps", F.array(F.lit(0).cast("long")), step)


def known(i: int) -> Column:
    """How many of a block's rows have a value."""
    return F.size(F.filter("_rows", lambda r: r[f"x{i}"].isNotNull())).cast("long")


def before_maps(i: int) -> Column:
    return F.transform("_maps", lambda m: m[f"_h{i}"])


def exponential_means(df: DataFrame, means: dict[str, tuple[str, float]], key: str = "sym", order: str = "sess") -> DataFrame:
    """``df`` with a column for each of ``means`` (name: input column and weight ``a`` of the new value, above 0 to 1), row for row.

    A mean begins with the first value that is not NULL, as that value; before it is NULL; a NULL behind it is no change (fill gaps forward
    before if they shall be steps). Rows of a key are ordered by ``order`` (without ties). What is held at once of a key is the rows of a
    block, 16, arrays of a map for every block of 4,096 rows and one for every 4,096 rows beyond that, and an array of what enters each
    block. Rows are dealt by ``key`` alone, so a frame that is dealt so already is not shuffled.
    """
    if any(not 0 < a <= 1 for _, a in means.values()):
        raise ValueError("weights have to lie above 0 and not above 1")
    inputs = list(dict.fromkeys(x for x, _ in means.values()))
    of = [inputs.index(x) for x, _ in means.values()]
    names, alphas = list(means), [a for _, a in means.values()]
    along, before = Window.partitionBy(key).orderBy(order), df.columns
    own = df.withColumn("_p", F.row_number().over(along) - 1).withColumn("_block", F.floor(F.col("_p") / BLOCK))
    values = F.struct("_p", *(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(inputs)))

    # Where a block's own fold begins depends on whether the key has begun before it: counts come with the maps.
    blocks = own.groupBy(key, "_block").agg(F.array_sort(F.collect_list(values)).alias("_rows"))
    had = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"n{i}": known(i) for i in range(len(inputs))})
    blocks = blocks.withColumns({f"_h{i}": F.coalesce(F.sum(f"n{i}").over(had), F.lit(0)) for i in range(len(inputs))})
    zero = lambda i: F.when(F.col(f"_h{i}") > 0, F.lit(0.0))
    maps = blocks.select(key, "_block", *(f"_h{i}" for i in range(len(inputs))), *(f"n{i}" for i in range(len(inputs))), *(F.coalesce(folded("_rows", f"x{i}", zero(i), a), F.lit(0.0)).alias(f"add{j}") for j, (i, a) in enumerate(zip(of, alphas))))

    def scanned(maps: DataFrame, group: list[str], at: str) -> DataFrame:
        """One row a group: its maps in order and what enters each of them from within the group."""
        arrays = maps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(at, *(c for c in maps.columns if c not in (*group, at))))).alias("_maps"))
        return arrays.withColumns({f"_in{j}": entering(picked(i, j), 1 - a) for j, (i, a) in enumerate(zip(of, alphas))})

    low = scanned(maps.withColumn("_tier", F.floor(F.col("_block") / ARRAY)), [key, "_tier"], "_block").withColumns({f"_s{i}": begun(i) for i in range(len(inputs))})
    zipped = F.arrays_zip(F.transform("_maps", lambda m: m["_block"]).alias("block"), *(before_maps(i).alias(f"h{i}") for i in range(len(inputs))), *(F.col(f"_in{j}") for j in range(len(means))), *(F.col(f"_s{i}") for i in range(len(inputs))))
    inner = F.filter(zipped, lambda z: z["block"].isNotNull()).alias("z")
    totals = low.select(key, "_tier", *(F.element_at(f"_s{i}", -1).alias(f"n{i}") for i in range(len(inputs))), *(F.element_at(f"_in{j}", -1).alias(f"add{j}") for j in range(len(means))), inner)
    # The tiers carry their blocks along, so nothing is joined back. A key's blocks are numbered from 0: what enters them is an array a key,
    # and rows stay with their key, whatever their block.
    value = lambda z, k, j, i, a: F.when(z[f"h{i}"] > 0, z[f"_in{j}"] + F.get(f"_in{j}", k) * F.pow(F.lit(1 - a), z[f"_s{i}"]))
    entry = lambda z, k: F.struct(*(value(z, k, j, i, a).alias(f"e{j}") for j, (i, a) in enumerate(zip(of, alphas))))
    enter = scanned(totals, [key], "_tier").select(key, F.flatten(F.transform("_maps", lambda t, k: F.transform(t["z"], lambda z: entry(z, k)))).alias("_enter"))
    inside = Window.partitionBy(key, "_block").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    both = own.join(enter, key).withColumn("_e", F.get("_enter", F.col("_block").cast("int"))).drop("_enter").withColumn("_rows", F.collect_list(values).over(inside))
    out = {name: folded("_rows", f"x{i}", F.col("_e")[f"e{j}"], a) for j, (name, i, a) in enumerate(zip(names, of, alphas))}
    return both.withColumns(out).select(*before, *names)
