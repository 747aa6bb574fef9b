"""Importance resampling, source divergence and WARC archives against plain versions and on odd tables."""

import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from panelforge.llm import divergence, importance, warc, words

ODD = ["", " ", None, "a", "A a À à ß İ ſ K", "x1 2y-3'z", "one\x00two\x7fthree\x85four five　six", "ab " * 30, "ab cd " * 400, "q" * 300 + " tail", "日本 語 " * 25, "word_with_under 12 34 " * 10]


def plain_words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
TERM = "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"


# Importance resampling


def plain_resample(docs, target, percent, n, buckets, seed, least):
    def features(text):
        ws = plain_words(text, WORD)
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        k, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: len(order) * percent // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_plain_version(spark, sf_dir, n):
    some = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    docs = [*some, *((1000 + k, t) for k, t in enumerate(ODD)), (None, "ab " * 30), (None, "zz " * 25), (1007, ODD[7])]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(20).collect()] + [None, ""]
    table = spark.createDataFrame([(i, t, 5, 0.5, "x") for i, t in docs], "doc_id long, text string, rank int, score double, weight string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table, aim, percent=30, n=n, buckets=50, seed=7, least_words=20, most=16).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, target, 30, n, 50, 7, 20)


def test_resampling_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    assert [(r.n_features, r["rank"]) for r in importance.resample(one, none, percent=100, least_words=1).collect()] == [(2, 1)]


def test_runs_over_the_ends_of_slices():
    text = " ".join(f"w{k % 977}" for k in range(9000)) + " " + "v" * 3000 + " end"
    ws = text.split()
    f = importance.Features(3, 997, {b"w1": zlib.crc32(b"w1")}, {(b"w1", b"w2"): zlib.crc32(b"w1 w2")})
    want = Counter(zlib.crc32(" ".join(ws[i : i + k]).encode()) % 997 for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    cut = importance.slices
    for size in (1, 7, 1000, 1 << 20):
        importance.slices = lambda t, table, size=size: cut(t, table, size)
        try:
            got = Counter()
            for _, found in f.of(text.encode()):
                got.update(found.tolist())
        finally:
            importance.slices = cut
        assert got == want


def test_frequent_items_are_always_found():
    rng = np.random.default_rng(3)
    parts = [importance.Frequent(20) for _ in range(5)]
    true = Counter()
    for k in range(200):
        items = [f"h{k}" for k in rng.zipf(1.3, 400) if k < 10**6] + [f"r{v}" for v in rng.integers(0, 10**7, 300)]
        true.update(items)
        parts[k % 5].add(items)
    found, total = Counter(), sum(true.values())
    for p in parts:
        p.shrink()
        assert len(p.counts) <= p.room
        found.update(p.counts)
    head = {k for k, n in found.items() if n * 40 >= total}
    assert {k for k, n in true.items() if n * 20 >= total} <= head and len(head) <= 40
    assert all(found[k] <= true[k] for k in found)


# Source divergence


def plain_audit(docs, least, top):
    n, frequency, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        own = Counter(plain_words(text, TERM))
        n[lang or "", source or ""].update(own)
        frequency[lang or ""].update(own.keys())
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = {t for t, k in frequency[lang].items() if k >= least}
        v = len(kept)

        def shares(counter, kept=kept, v=v):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 1000000000 * (counter[t] + 2) // (total + 2 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        q, p = shares(whole), {s: shares(n[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, gap(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def test_divergence_equals_plain_version(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in ("x", "Y", "zz", "ñ", "q")]
    docs = [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))), "en" if k % 9 else None, f"s{int(rng.zipf(1.4)) % 75}") for k in range(500)]
    docs += [(t, "odd", s) for t in ODD for s in ("p", None)] + [("no kept terms here", "few", s) for s in "abc"] + [("", "none", "a"), (None, "none", "b"), ("one", "alone", "x")] + [("same text", "en", "s1")] * 20
    table = spark.createDataFrame([(*d, 1, "t", 2) for d in docs], "text string, lang string, source string, rank int, term string, n long").repartition(3)
    got = divergence.audit(table, 5, 4).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len({s for _, lang, s in docs if lang == "en"}) > divergence.SOURCES  # several blocks of sources
    assert sorted(map(tuple, got)) == plain_audit(docs, 5, 4)
    assert divergence.audit(table.limit(0)).collect() == []


def test_large_counts_stay_exact(spark):
    rows = [(10**13, 3 * 10**13 + 7, 10**6), (9 * 10**15, 9 * 10**15 + 1, 1), (0, 0, 1)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(divergence.share("n", "total", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]


def test_many_entries_are_handed_on(spark):
    """A task with more entries than it holds gives them in parts, which add up."""
    docs = spark.createDataFrame([(" ".join(f"{chr(97 + k)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(17_000)), "en", "s") for k in range(26)] * 2, "text string, lang string, source string").coalesce(1)
    got = divergence.counts(docs).agg(F.sum("n"), F.sum("docs"), F.count("term")).first()
    distinct = len({w for r in docs.collect() for w in r.text.split()})
    assert distinct > divergence.HELD and tuple(got) == (26 * 2 * 17_000, 26 * 2 * 17_000, distinct)


def test_slices_cut_between_words():
    text = b"Ab1c d--EF " * 50
    for size in (1, 5, 64, 10**6):
        assert [w for ws in words.slices(text, words.translation(words.LETTERS), size) for w in ws] == [b"ab", b"c", b"d", b"ef"] * 50
    assert list(words.slices(b"", divergence.TABLE)) == []


# WARC


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/archive"


LONG = "é" * 60
PAGES = [(5, "http://a/", LONG), (3, "http://b/\r\nX-Injected: 1", LONG), (9, None, LONG), (None, "u", LONG), (3, "again", LONG), (7, "s", "short"), (8, "s", "short"), (10, "e", None), (11, "e", ""), (None, "n", "n" * 200), (None, "n", "n" * 200), (12, "nul", "a\x00b" * 40), (13, "crlf", "\r\n\r\nWARC/1.1\r\n" * 20)]


def plain_pages(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        again = len(b) >= 100 and first.get(html or "") is not None and first[html or ""] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [warc.MOST_SENT, 0])
def test_pages_come_back(spark, folder, most):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, first int").repartition(4)
    warc.write_pages(pages, folder, most_sent=most)
    got = warc.read_pages(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain_pages(PAGES)
    raw = b"".join(gzip.decompress(open(f"{folder[7:]}/{f}", "rb").read()) for f in os.listdir(folder[7:]) if f.endswith(".gz"))
    assert b"\nX-Injected" not in raw
    assert {r.target_uri for r in warc.read(spark, folder).where("record_id = '<urn:x-page:9>'").collect()} == {None}


def test_an_empty_table_is_an_archive(spark, folder):
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_pages(spark, folder).collect() == []


def test_unwanted_payloads_are_not_decoded(spark, folder):
    """Packed payloads are spoiled: only reading them fails."""
    payload = "".join(chr(33 + k * k % 90) for k in range(50_000)).encode()
    rows = [("response" if k % 2 else "resource", f"<urn:{k}>", None, None, None, None, payload) for k in range(6)]
    warc.register(spark)
    spark.createDataFrame(rows, warc.WRITTEN).coalesce(1).write.format("warc").mode("append").option("level", 0).save(folder)
    name = next(f for f in os.listdir(folder[7:]) if f.endswith(".warc.gz"))
    data = bytearray(open(f"{folder[7:]}/{name}", "rb").read())
    at = 0
    while at < len(data):  # spoil each resource's payload behind its headers
        size = int.from_bytes(data[at + 16 : at + 20], "little")
        if b"WARC-Type: resource" in data[at : at + 200]:
            data[at + 20_000 : at + size - 8] = b"\xff" * (size - 8 - 20_000)
        at += size
    with open(f"{folder[7:]}/{name}", "wb") as f:
        f.write(data)
    assert warc.read(spark, folder, "record_type string, record_id string, content_length long, payload_bytes long").count() == 6
    got = warc.read(spark, folder, "record_type string, payload binary", [ds.EqualTo(("record_type",), "response")])
    assert [bytes(r.payload) for r in got.collect()] == [payload] * 3
    with pytest.raises(Exception, match="warc.gz"):
        warc.read(spark, folder, "payload binary").collect()


CONDITIONS = {
    "target_uri like 'http://h1%'": [ds.StringStartsWith(("target_uri",), "http://h1")],
    "target_uri is null": [ds.IsNull(("target_uri",))],
    "target_uri is not null and record_id in ('<urn:3>', '<urn:4>')": [ds.IsNotNull(("target_uri",)), ds.In(("record_id",), ("<urn:3>", "<urn:4>"))],
    "not (target_uri = 'http://h1/1')": [ds.Not(ds.EqualTo(("target_uri",), "http://h1/1"))],
    "target_uri <=> null": [ds.EqualNullSafe(("target_uri",), None)],
    "content_length > 100": [ds.GreaterThan(("content_length",), 100)],
    "target_uri like '%7'": [ds.StringEndsWith(("target_uri",), "7")],
    "target_uri > 'http://h1'": None,
    "record_type = 'revisit'": [ds.EqualTo(("record_type",), "revisit")],
}


def test_predicates_reach_the_reader(spark, folder):
    warc.register(spark)
    rows = [("response", f"<urn:{k}>", f"http://h{k % 3}/{k}" if k % 4 else None, f"sha256:{k}", None, None, b"p" * k) for k in range(40)]
    spark.createDataFrame(rows, warc.WRITTEN).repartition(3).write.format("warc").mode("append").save(folder)
    columns = "record_id string, target_uri string, content_length long, record_type string"
    whole = warc.read(spark, folder, columns)
    local = spark.createDataFrame(whole.collect(), whole.schema)
    for condition, where in CONDITIONS.items():
        want = {r.record_id for r in local.where(condition).collect()}
        assert len(want) < 40
        pushed = warc.read(spark, folder, columns, pushdown=True).where(condition)
        assert {r.record_id for r in pushed.collect()} == want, condition
        assert ("Filter" in pushed._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")) == (where is None), condition
        if where is not None:
            assert {r.record_id for r in warc.read(spark, folder, columns, where).collect()} == want, condition
    # A frame without the option can be used again and again.
    assert [whole.where("target_uri is null").count(), whole.count(), whole.where("target_uri is null").union(whole.where("record_id = '<urn:3>'")).count()] == [10, 40, 11]
    with pytest.raises(Exception, match="header column"):
        warc.read(spark, folder, columns, [ds.EqualTo(("payload",), "x")]).collect()


@pytest.mark.parametrize("kind", ["plain", "members", "one stream"])
def test_archives_of_others(spark, tmp_path, kind):
    """Plain files, members without lengths and a file compressed as a whole; other line ends, folded lines, no HTTP, an empty block."""
    made = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n",
        b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI:\r\n http://folded/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 44\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nWARC/1.0 not a head\r\n\r\n",
        b"WARC/1.0\nWARC-Type: metadata\nContent-Length: 0\n\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3000000\r\n\r\n" + b"z" * 3_000_000 + b"\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: last\r\nContent-Length: 4\r\n\r\ntail\r\n\r\n",
    ]
    path = f"{tmp_path}/foreign.warc" + ("" if kind == "plain" else ".gz")
    with open(path, "wb") as f:
        f.write(b"".join(made) if kind == "plain" else gzip.compress(b"".join(made)) if kind == "one stream" else b"".join(map(gzip.compress, made)))
    whole = warc.read(spark, path, "record_type string, target_uri string, payload binary").collect()
    assert [(r.record_type, r.target_uri, len(r.payload)) for r in whole] == [("warcinfo", None, 12), ("response", "http://folded/", 19), ("metadata", None, 0), ("resource", None, 3_000_000), ("resource", "last", 4)]
    assert [r.target_uri for r in warc.read(spark, f"file://{tmp_path}", "record_type string, target_uri string").where("target_uri = 'last'").collect()] == ["last"]


def test_only_committed_files_count(spark, folder):
    warc.register(spark)
    one = spark.createDataFrame([("response", "<urn:1>", "a", None, None, None, b"x")], warc.WRITTEN)
    one.write.format("warc").mode("append").save(folder)
    with open(f"{folder[7:]}/lost-attempt.warc.gz", "wb") as f:
        f.write(b"half a rec")
    assert warc.read(spark, folder).count() == 1
    one.write.format("warc").mode("append").option("compression", "none").save(folder)
    assert warc.read(spark, folder).count() == 2
    one.write.format("warc").mode("overwrite").save(folder)
    assert warc.read(spark, folder).count() == 1 and len(os.listdir(folder[7:])) - len([f for f in os.listdir(folder[7:]) if f.startswith(".")]) == 2


def test_broken_archives_say_where(spark, tmp_path):
    for name, data in (("a.warc", b"no record"), ("b.warc.gz", gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 9\r\n\r\nx")), ("c.warc.gz", gzip.compress(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")[:-12])):
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
        with pytest.raises(Exception, match=name.replace(".", r"\.")):
            warc.read(spark, f"{tmp_path}/{name}").collect()
