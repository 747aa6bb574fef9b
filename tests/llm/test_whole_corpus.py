"""Corpus operators where a part used to be left out."""

import os
import string

import numpy as np
import pytest

from panelforge.llm import minhash, pii, secret_scan, toxicity
from pyspark.sql import functions as F


def test_more_short_mails_than_their_shape_has(spark):
    """900 entities with a one-letter name and domain, of which the shape has 676."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    forms = [(f"{a}@{b}.{top}",) for top in ("com", "org") for a in letters for b in letters][:900]
    t = spark.createDataFrame(forms, "form string").select(F.lit("mail").alias("kind"), "form")
    got = pii.distinct_surrogates(t, "k").collect()
    made = {r.made for r in got}
    assert len(got) == len(made) == 900 and not made & {f for f, in forms} and all(m.endswith(".example") for m in made)


def test_tokens_without_digits_are_tested(spark):
    """Random letters are spans; lines, words and repeated digits are dismissed."""
    rng = np.random.default_rng(5)
    tokens = ["".join(rng.choice(list(string.ascii_letters), 40)) for _ in range(40)]
    plain = ["-" * 40, "_" * 33, "ha" * 20, "0" * 40, "antidisestablishmentarianism" * 2, "1111122222" * 4] * 10
    rows = [(k, t) for k, t in enumerate(tokens + plain)]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == "random:0:40" for k in range(40)) >= 36 and not any("random" in got[k] for k in range(40, len(rows)))  # zeros are a hex span


SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(f"{SF01}/documents.parquet"), reason="the larger tables are not there")
def test_near_duplicates_of_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(k for k in sets if sets[k])
    root = {k: k for k in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
                meet = len(x & y)
                if 100 * meet >= 85 * (len(x) + len(y) - meet):
                    pairs += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85).collect()}
    print(f"{pairs} pairs at 0.85 or more")
    assert pairs > 50 and got == {k: find(k) for k in sets}


@pytest.mark.skipif(not os.path.exists(f"{SF1}/documents.parquet"), reason="the larger tables are not there")
def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = [(r.score, truth[r.doc_id]) for r in toxicity.scores(docs, labels).where("held_out").collect() if r.doc_id in truth]
    score, y = np.array([s for s, _ in got]), np.array([t for _, t in got])
    rank = np.empty(len(y))
    rank[np.argsort(score, kind="stable")] = np.arange(len(y))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    print(f"held out: {len(y)} documents, {int(y.sum())} toxic, AUC {auc:.4f}, right {np.mean((score >= 0.5) == y):.4f}")
    # some labels are wrong (junk without a toxic word that is marked as toxic scores nearly 0), so 1 is out of reach
    assert auc >= 0.95 and np.mean((score >= 0.5) == y) >= 0.95


def test_decoys_come_from_anywhere(spark):
    """Texts with words at the beginning, in the middle or at the end alone: each kind gives decoys."""
    words, rest = lambda k: " ".join(f"w{k}ord{j}" for j in range(120)), "。" * 2000
    rows = [(part, [words(k) + rest + rest, rest + words(k) + rest, rest + rest + words(k)][part]) for k in range(60) for part in range(3)]
    made = spark.createDataFrame(rows, "part int, text string").withColumn("decoy", secret_scan.decoys(F.col("text"))).where("decoy is not null")
    assert {r.part for r in made.select("part").distinct().collect()} == {0, 1, 2}
