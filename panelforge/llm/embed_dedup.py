"""Near duplicates among embeddings by a forest of random-projection trees with spill overlap.

Each tree splits the space at the median of a random projection, again and again; vectors within a margin of a split go to
both sides. Vectors are compared within leaves only. A pair that is close in angle lands on the same side of a split
unless it straddles the whole margin, so each tree misses few pairs and several trees miss next to none.

Trees grow in levels. The first splits are fitted on a bounded sample of all vectors; a leaf that still stands for many vectors
when its share of the sample is used up is sampled anew, in a task of its own, and split on, until leaves are small whatever the
table holds. All nodes of a depth share one direction, made from the seed, so a fit is a list of cuts. Equal vectors are one
class with a count and take part once. Leaves that no split takes apart (many vectors within the margin) are compared in pairs of
blocks, each a group of its own, so no leaf is cut short.

A pair is counted once, in the first leaf that it shares. A group returns link counts and a spanning label per vector,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import discard, joined, sent_if_few, stage
from panelforge.llm.components import components
from panelforge.llm.vectors import matrix, usable, vectors

#: A node is the path to it, 1 for a root and one more bit a split; a leaf's name has the tree's number above its path.
PATH_BITS, DEEPEST = 56, 54
#: Sample rows that a node needs to be split, and the least share that a split has to take off.
LEAST_ROWS, LEAST_GAIN = 32, 0.1
#: Fits that a pass over the vectors takes up at once, a few KB each.
FITS_AT_ONCE = 5000
#: A computed cosine this near to the threshold is computed again, component by component.
NEAR = 1e-9


@dataclass
class Fit:
    """Cuts of the nodes below (and with) one node, leaves to be split further, and the blocks of leaves that no split takes apart."""

    cuts: dict[int, float] = field(default_factory=dict)
    opened: set[int] = field(default_factory=set)
    blocks: dict[int, int] = field(default_factory=dict)


@lru_cache(maxsize=64)
def direction(seed: int, tree: int, depth: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([seed, tree, depth, dim]).standard_normal(dim)
    return d / np.linalg.norm(d)


def grow(sample: np.ndarray, labels: np.ndarray, weight: float, root: int, tree: int, seed: int, margin: float, leaf_rows: int, block: int) -> Fit:
    """Split until a row has at most ``leaf_rows`` others of its label in its leaf; a row of the sample stands for ``weight`` rows."""
    fit = Fit()

    def build(node: int, own: np.ndarray) -> None:
        counts = np.unique(labels[own], return_counts=True)[1]
        mates = float((counts * (counts - 1)).sum()) / max(len(own), 1) * weight
        if mates > leaf_rows and len(own) < LEAST_ROWS and weight > 1:
            fit.opened.add(node)
            return
        depth = node.bit_length() - 1
        if mates > leaf_rows and depth < DEEPEST:
            p = sample[own] @ direction(seed, tree, depth, sample.shape[1])
            cut = float(np.median(p))
            low, high = own[p <= cut + margin], own[p >= cut - margin]
            if max(len(low), len(high)) <= (1 - LEAST_GAIN) * len(own):
                fit.cuts[node] = cut
                build(2 * node, low)
                build(2 * node + 1, high)
                return
        if (n := -(-int(counts.max(initial=0) * weight) // block)) > 1:
            fit.blocks[node] = n

    build(root, np.arange(len(sample)))
    return fit


def route(fit: Fit, x: np.ndarray, root: int, tree: int, seed: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf of ``fit`` that a row of ``x`` belongs to."""
    rows, leaves, todo = [], [], [(root, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if node not in fit.cuts:
            rows.append(own)
            leaves.append(np.full(len(own), node, np.int64))
            continue
        p = x[own] @ direction(seed, tree, node.bit_length() - 1, x.shape[1])
        todo += [(2 * node, own[p <= fit.cuts[node] + margin]), (2 * node + 1, own[p >= fit.cuts[node] - margin])]
    return np.concatenate(rows), np.concatenate(leaves)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin_of(threshold: float, dim: int) -> float:
    """Three quarters of the deviation that a link's difference, of length sqrt(2 - 2 t), has when it is projected."""
    return 0.75 * float(np.sqrt(max(2 - 2 * threshold, 0.0)) / np.sqrt(dim))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that the links ``i``-``j`` reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def placed(rows: DataFrame, threshold: float, trees: int, leaf_rows: int, sample_rows: int, block: int, seed: int) -> DataFrame:
    """``rows`` (``vec_id, label, embedding, dim, times``) with ``leaves``: the names of the leaves of all trees, and ``blocks`` of each."""
    spark = rows.sparkSession
    shown = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("label", "embedding").toPandas()  # bounded
    total, forest = rows.count(), {}
    for dim, own in shown.groupby(shown.embedding.map(len)):
        x, labels = unit(matrix(own.embedding)), own.label.to_numpy()
        fit = lambda t: grow(x, labels, max(1.0, total / len(shown)), 1, t, seed, margin_of(threshold, x.shape[1]), leaf_rows, block)  # noqa: B023, E731
        one = fit(0)
        forest[int(dim)] = [one] if not one.cuts and not one.opened else [one, *map(fit, range(1, trees))]  # a tree of one leaf says it all
    shared = spark.sparkContext.broadcast(forest)

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            leaves, blocks, opened = ([[] for _ in range(len(part))] for _ in range(3))
            for dim, own in part.groupby("dim"):
                x, at = unit(matrix(own.embedding)), own.index.to_numpy()
                for t, fit in enumerate(shared.value.get(int(dim)) or [Fit()]):
                    r, leaf = route(fit, x, 1, t, seed, margin_of(threshold, int(dim)))
                    for a, node in zip(at[r].tolist(), leaf.tolist(), strict=True):
                        (opened if node in fit.opened else leaves)[a].append(t << PATH_BITS | node)
                        if node not in fit.opened:
                            blocks[a].append(fit.blocks.get(node, 1))
            yield part.assign(leaves=leaves, blocks=blocks, opened=opened)

    schema = f"vec_id long, label string, embedding {rows.schema['embedding'].dataType.simpleString()}, dim int, times long, leaves array<long>, blocks array<int>, opened array<long>"
    now = rows.mapInPandas(first, schema)
    if not any(fit.opened for fits in forest.values() for fit in fits):
        return now.drop("opened")
    now = stage(now, "placed")
    while not now.where(F.size("opened") > 0).isEmpty():
        after = deeper(now, schema, threshold, leaf_rows, sample_rows, block, seed)
        discard(now)
        now = after
    return now.drop("opened")


def deeper(now: DataFrame, schema: str, threshold: float, leaf_rows: int, sample_rows: int, block: int, seed: int) -> DataFrame:
    """One level more: every opened leaf is sampled, fitted in a task of its own and its vectors go on."""
    spark = now.sparkSession
    each = now.where(F.size("opened") > 0).select("vec_id", "dim", F.explode("opened").alias("leaf"))
    sizes = stage(each.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")
    share = F.pmod(F.xxhash64("vec_id", "leaf"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") < sample_rows
    drawn = joined(now.where(F.size("opened") > 0).select("vec_id", "label", "embedding", "dim", F.explode("opened").alias("leaf")), sizes, ["dim", "leaf"], "n").where(share)

    def fit_one(own: pd.DataFrame) -> pd.DataFrame:
        leaf, n = int(own.leaf.iloc[0]), int(own.n.iloc[0])
        tree, node = leaf >> PATH_BITS, leaf & ((1 << PATH_BITS) - 1)
        own = own.sort_values("vec_id")
        x = unit(matrix(own.embedding))
        fit = grow(x, own.label.to_numpy(), max(1.0, n / len(own)), node, tree, seed, margin_of(threshold, x.shape[1]), leaf_rows, block)
        return pd.DataFrame({"dim": [own.dim.iloc[0]], "leaf": [leaf], "nodes": [list(fit.cuts)], "cuts": [list(fit.cuts.values())], "again": [sorted(fit.opened)], "dense": [list(fit.blocks)], "n_blocks": [list(fit.blocks.values())]})

    fits = stage(drawn.groupBy("dim", "leaf").applyInPandas(fit_one, "dim int, leaf long, nodes array<long>, cuts array<double>, again array<long>, dense array<long>, n_blocks array<int>"), "fits")
    passes = max(1, -(-fits.count() // FITS_AT_ONCE))
    for k in range(passes):
        own = fits.where(F.pmod(F.xxhash64("dim", "leaf"), F.lit(passes)) == k).collect()  # as many as a pass takes up
        known = {(r.dim, r.leaf): Fit(dict(zip(r.nodes, r.cuts, strict=True)), set(r.again), dict(zip(r.dense, r.n_blocks, strict=True))) for r in own}
        shared = spark.sparkContext.broadcast(known)

        def on(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for part in parts:
                part = part.reset_index(drop=True)
                leaves, blocks, opened = (list(map(list, part[c])) for c in ("leaves", "blocks", "opened"))
                wanted: dict[tuple[int, int], list[int]] = {}
                for a, (dim, names) in enumerate(zip(part.dim, opened, strict=True)):
                    for leaf in names:
                        if (dim, leaf) in shared.value:
                            wanted.setdefault((dim, leaf), []).append(a)
                for (dim, leaf), own in wanted.items():
                    fit, tree, node = shared.value[dim, leaf], int(leaf) >> PATH_BITS, int(leaf) & ((1 << PATH_BITS) - 1)
                    r, found = route(fit, unit(matrix(part.embedding.iloc[own])), node, tree, seed, margin_of(threshold, int(dim)))
                    for a in own:
                        opened[a].remove(leaf)
                    for a, to in zip(np.array(own)[r].tolist(), found.tolist(), strict=True):
                        (opened if to in fit.opened else leaves)[a].append(tree << PATH_BITS | to)
                        if to not in fit.opened:
                            blocks[a].append(fit.blocks.get(to, 1))
                yield part.assign(leaves=leaves, blocks=blocks, opened=opened)

        after = stage(now.mapInPandas(on, schema), "placed")
        if k:
            discard(now)
        now = after
        shared.unpersist()
    discard(sizes, fits)
    return now


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, trees: int = 5, leaf_rows: int = 2048, sample_rows: int = 10_000, block: int = 4096, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector; links join equal labels with a cosine of ``threshold`` or more.

    Vectors that are null, empty or zero, hold a null or non-finite component, or have no label link with nothing. Rows
    without a ``vec_id`` are returned as they are: no links, a null component, kept. Of rows that share a ``vec_id`` one
    counts: a usable one before others, then the smallest label and vector. Vectors link within their dimension; equal ones link
    with each other. Samples hold at most about ``sample_rows`` vectors, those with the smallest hashes, of the table and of each leaf.
    """
    seen = vectors(embeddings).withColumn("usable", usable("embedding") & F.col("label").isNotNull())
    nameless, named = seen.where(F.col("vec_id").isNull()), seen.where(F.col("vec_id").isNotNull())
    twice = sent_if_few(stage(named.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "twice"))
    one = named.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct((~F.col("usable")).alias("unfit"), "label", "embedding")).alias("r"))
    rows = named.join(twice, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.embedding", "r.label", (~F.col("r.unfit")).alias("usable")))
    good = rows.where("usable").withColumn("dim", F.size("embedding"))
    # equal vectors by label and two 64-bit hashes: one class, named after its smallest id
    key = ["label", "dim", "h", "g"]
    hashed = good.select("vec_id", "label", "dim", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(seed), "embedding", F.lit(1)).alias("g"))
    classes = stage(hashed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1"), "classes")
    same = stage(joined(hashed, classes, key, "times").select("vec_id", "rep", "times"), "copies")
    single = good.join(sent_if_few(same), "vec_id", "left").where("rep is null or rep = vec_id")
    single = single.select("vec_id", "label", "embedding", "dim", F.coalesce("times", F.lit(1)).cast("long").alias("times"))
    at = placed(single, threshold, trees, leaf_rows, sample_rows, block, seed)
    each = at.select("vec_id", "label", "embedding", "dim", "times", "leaves", F.inline(F.arrays_zip(F.col("leaves").alias("leaf"), F.col("blocks").alias("n"))))
    each = each.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.withColumn("bi", F.least("b", "other")).withColumn("bj", F.greatest("b", "other")).drop("n", "other")

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        first, last, leaf = own.bi.iloc[0], own.bj.iloc[0], own.leaf.iloc[0]
        own = own.sort_values("vec_id", ignore_index=True)
        x, ids, b, times = matrix(own.embedding), own.vec_id.to_numpy(), own.b.to_numpy(), own.times.to_numpy()
        size = np.linalg.norm(x, axis=1)
        y = x / size[:, None]
        left, right = np.flatnonzero(b == first), np.flatnonzero(b == last)
        width = max(map(len, own.leaves))
        member = np.full((len(own), width), -1, np.int64)
        for k, names in enumerate(own.leaves):
            member[k, : len(names)] = names
        links, label = np.zeros(len(own), np.int64), np.arange(len(own))
        for a in range(0, len(left), 512):
            some = left[a : a + 512]
            about = y[some] @ y[right].T
            p, q = np.nonzero(about >= threshold - NEAR)
            i, j, about = some[p], right[q], about[p, q]
            if first == last:
                i, j, about = i[i < j], j[i < j], about[i < j]
            border = np.flatnonzero(about < threshold + NEAR)
            dot = np.zeros(len(border))
            for d in range(x.shape[1]):  # components in order, as a plain loop adds them
                dot += x[i[border], d] * x[j[border], d]
            fine = np.ones(len(i), bool)
            fine[border] = dot / (size[i[border]] * size[j[border]]) >= threshold
            i, j = i[fine], j[fine]
            # count a pair in the first leaf that both are in
            mine = np.ones(len(i), bool)
            for s in range(0, len(i), 100_000):
                s = slice(s, s + 100_000)
                for c in range(width):
                    lead = member[i[s], c]
                    mine[s] &= ~((lead >= 0) & (lead < leaf) & (member[j[s]] == lead[:, None]).any(axis=1))
            i, j = i[mine], j[mine]
            links += np.bincount(i, times[j], len(own)).astype(np.int64) + np.bincount(j, times[i], len(own)).astype(np.int64)
            label = spanning(len(own), np.concatenate([i, np.arange(len(own))]), np.concatenate([j, label]))
        linked = links > 0
        return pd.DataFrame({"vec_id": ids[linked], "links": links[linked], "low": ids[label[linked]]})

    found = stage(each.groupBy("label", "dim", "leaf", "bi", "bj").applyInPandas(compare, "vec_id long, links long, low long"), "links-found")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "vec_id")
    alone = rows.select("vec_id").join(sent_if_few(same.select("vec_id")), "vec_id", "left_anti")
    alone = alone.join(counts, "vec_id", "left").join(groups, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    heads = same.where("rep = vec_id").select("vec_id", "times").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    heads = heads.select(F.col("vec_id").alias("rep"), F.col("times").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    copies = joined(same.select("vec_id", "rep"), heads, ["rep"], "n")
    out = alone.unionByName(copies.select("vec_id", "n_links", "component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.unionByName(nameless.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings
  UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a
), low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM low LEFT JOIN n ON n.a = id
"""
