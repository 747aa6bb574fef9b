"""How far the sources of a language diverge in their words: exact integer shares, pairwise distances and the terms that stand out.

Texts become terms by one translation of their bytes; a counter a document gives frequencies and document counts, which are added up
sparsely: within a task first, then by (lang, source, term).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import batches, discard, stage, table
from panelforge.llm.words import LETTERS, slices, translation

TABLE = translation(LETTERS)

#: Entries that a task counts before it hands them on.
HELD = 300_000
#: Terms and sources of a block, about: a cell of the distance matrix holds at most two blocks of sources over one of terms.
TERMS, SOURCES = 2048, 32
#: Bytes of a table of groups that is sent to every task, at most; larger ones are joined by a shuffle.
SENT = 16 << 20

SHARE = 1_000_000_000


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; a row without term for each group, so that groups without terms stay."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict, Counter]] = {}
        entries = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for part in batches(parts):
            for lang, source, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                if (group := held.get((lang, source))) is None:
                    group = held[lang, source] = ({None: 0}, Counter({None: 0}))
                    entries += 1
                n, docs = group
                own: Counter = Counter()
                for words in slices(text, TABLE):
                    own.update(words)
                before = len(n)
                for term, k in own.items():
                    n[term] = n.get(term, 0) + k
                docs.update(own.keys())
                entries += len(n) - before
                if entries > HELD:
                    yield from out()
                    entries = 0
        yield from out()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = docs.select(text("lang"), text("source"), text("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return each.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)), exact: the product is a decimal, the quotient an integer."""
    return F.expr(f"1 + ({SHARE}BD * ({n} + 2)) div nullif({total} + 2 * {terms}, 0)")


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def sent_if_small(groups: DataFrame) -> DataFrame:
    """``groups`` (written before) to be broadcast if the bytes of its names and numbers allow; else joined by a shuffle."""
    names = [F.octet_length(c) for c, kind in groups.dtypes if kind == "string"]
    size = groups.agg(F.sum(sum(names, F.lit(64)))).first()[0] or 0
    return F.broadcast(groups) if size <= SENT else groups


def cell(rows: pa.Table) -> pa.Table:
    """Distances between two blocks of sources over one block of terms, as a dense integer matrix.

    Rows without term carry each source's share of an absent term. Terms that no source of the cell has give the same summand for a pair
    whatever the term; the first block of terms adds it for all kept terms of the language, the others hold what differs from it.
    """
    lang, block, i, j, terms = (rows.column(c)[0].as_py() for c in ("lang", "tb", "i", "j", "terms"))
    base, seen = rows.filter(pc.is_null(rows.column("term"))), rows.filter(pc.is_valid(rows.column("term")))
    names, zero, block_of = np.array(base.column("source").to_pylist(), object), base.column("p").to_numpy(), base.column("sb").to_numpy()
    codes = seen.column("term").combine_chunks().dictionary_encode()
    source = pc.index_in(seen.column("source"), base.column("source").combine_chunks()).to_numpy()
    p = np.repeat(zero[:, None], len(codes.dictionary), axis=1)
    p[source, codes.indices.to_numpy()] = seen.column("p").to_numpy()
    left, right = np.nonzero(block_of == i)[0], np.nonzero(block_of == j)[0]
    of, to, value = [], [], []
    for a in left:
        others = right[names[right] > names[a]] if i == j else right
        whole = (zero[a] - zero[others]) ** 2 // (zero[a] + zero[others])
        differ = ((p[a] - p[others]) ** 2 // (p[a] + p[others])).sum(axis=1) - p.shape[1] * whole
        of.append(np.full(len(others), a))
        to.append(others)
        value.append(differ + (terms * whole if block == 0 else 0))
    own = base.column("source")
    ends = [own.take(pa.array(np.concatenate([np.zeros(0, np.int64), *k]))) for k in (of, to)]
    value = np.concatenate([np.zeros(0, np.int64), *value])
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": ends[0].cast(pa.string()), "item": ends[1].cast(pa.string()), "value": pa.array(value, pa.int64())})


def pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways round. The result is as large as the pairs are many.

    Sources and terms are dealt into blocks by hash; a cell is two blocks of sources over one of terms, so a term that all sources have,
    or a source with a third of all rows, is spread over cells. What a cell emits is one sum a pair.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).alias("sbs"), F.greatest(F.ceil(F.max("terms") / TERMS), F.lit(1)).alias("tbs"))
    of_source = F.expr("pmod(xxhash64(source), sbs)")
    sized = sent_if_small(stage(groups.join(blocks, "lang").withColumn("sb", of_source), "blocks"))
    zeros = sized.withColumn("tb", F.explode(F.expr("sequence(0L, tbs - 1)"))).select("lang", "source", "sb", "sbs", "tb", F.lit(None).cast("string").alias("term"), "p0", "terms").withColumnRenamed("p0", "p")
    found = known.join(sized.select("lang", "source", "sb", "sbs", "tbs"), ["lang", "source"]).withColumn("tb", F.expr("pmod(xxhash64(term), tbs)"))
    rows = found.select("lang", "source", "sb", "sbs", "tb", "term", "p", "terms").unionByName(zeros).withColumn("other", F.explode(F.expr("sequence(0L, sbs - 1)")))
    cells = rows.withColumn("i", F.least("sb", "other")).withColumn("j", F.greatest("sb", "other")).drop("sbs", "other")
    half = cells.groupBy("lang", "tb", "i", "j").applyInArrow(cell, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return half.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources (`pair`) and the ``top`` terms that stand out (`term`).

    A language keeps the terms that at least ``least_docs`` of its documents have. A group's share of a kept term is
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)), a distance sums floor((p - q)^2 / (p + q)) over all kept terms, and a term stands out by that
    summand against the language's own share, where the group has it and its share is larger. All arithmetic is exact, in integers.

    Null ``text``, ``lang`` and ``source`` count as empty; a group without terms has distances and no terms; a language without kept terms has
    distances of 0; repeated rows are documents of their own; an empty table gives no rows; other columns are left out. Texts are read once.
    """
    counted = stage(counts(docs), "counts")
    kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    terms = stage(counted.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Each kept term occurs in some group, so a language's terms and their sum are those of `kept`.
    langs = stage(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")), "langs")
    groups = counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(sent_if_small(langs), "lang", "left").fillna(0)
    groups = stage(groups.withColumn("p0", F.coalesce(F.expr(f"1 + (2 * {SHARE}BD) div nullif(total + 2 * terms, 0)"), F.lit(1))), "groups")
    known = stage(terms.join(sent_if_small(groups), ["lang", "source"]).withColumn("p", share("n", "total", "terms")).withColumn("q", share("lang_n", "lang_total", "terms")).select("lang", "source", "term", "p", "q", "terms"), "shares")
    discard(counted, terms, langs)
    standing = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    one = standing.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    other = pairs(known, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by))
    return other.select("lang", "source", "part", "item", "value", "rank").unionByName(one.select("lang", "source", "part", "item", "value", "rank"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
flat AS (SELECT lang, source, r, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM flat GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM flat SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
groups AS (SELECT d.lang, d.source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v, coalesce(lang_total, 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, (1 + 1000000000 * (coalesce(n.n, 0)::HUGEINT + 2) // (total + 2 * v))::BIGINT AS p, (1 + 1000000000 * (lang_n::HUGEINT + 2) // (lang_total + 2 * v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
