"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as two vectors: one of the word itself and one of its characters (the mean over its runs of three to five
bytes, with marks at both ends), so unseen forms of known stems are understood. Texts are read in overlapping windows; a
document's score is the highest of its windows. Labels belong to documents, so training starts from all windows and then
keeps, of a toxic document, the windows that the network itself finds toxic.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import batches, docs_text

WINDOW, STRIDE = 64, 48
WORD_ROWS, GRAM_ROWS, D, H = 1 << 14, 1 << 15, 8, 8
GRAMS = (3, 4, 5)
#: Rows scored together, and windows that run through the network together.
BATCH, LANES = 500, 2048


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in lower case without outer punctuation, the code of each word of each text, and where texts end."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    words = pc.utf8_trim(lists.flatten(), ".,;:!?\"'()*&%$#|").dictionary_encode()
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), ends


def word_features(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each word in the word table, and its rows in the character table: one list with where each word begins."""
    row, rows, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), at_once):
        raw = [b"^" + w.encode() + b"$" for w in words[k : k + at_once]]
        row.append(np.fromiter((zlib.crc32(w) % WORD_ROWS for w in raw), np.int32, len(raw)))
        part, count = _grams(raw)
        rows.append(part)
        sizes.append(count)
    return np.concatenate(row), np.concatenate(rows), np.append(0, np.cumsum(np.concatenate(sizes)))


def _grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The character rows of marked words in order, and how many each word has."""
    sizes = np.fromiter(map(len, raw), np.int32, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    own = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes, dtype=np.int32), sizes) - np.arange(len(data), dtype=np.int32)  # bytes to the word's end
    rows, of = [], []
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 17 * n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : k + m]) * np.uint32(16777619)
            h ^= h >> np.uint32(13)
        at = np.flatnonzero(left[:m] >= n)
        rows.append((h[at] % GRAM_ROWS).astype(np.int32))
        of.append(own[at])
    short = np.flatnonzero(sizes < min(GRAMS)).astype(np.int32)  # the empty word alone
    rows.append(np.zeros(len(short), np.int32))
    of.append(short)
    word = np.concatenate(of)
    order = np.argsort(word, kind="stable")
    return np.concatenate(rows)[order], np.bincount(word, minlength=len(raw))


def windows_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; a text without words has one empty window."""
    begins = np.append(0, ends[:-1])
    n = ends - begins
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(ends)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = begins[doc] + k * STRIDE
    return at, np.minimum(WINDOW, ends[doc] - at), doc


def laid_out(codes: np.ndarray, at: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Word codes by step and window, ``pad`` after a window's end."""
    step = np.arange(WINDOW)[:, None]
    return np.where(step < size[None, :], np.append(codes, pad)[np.minimum(at[None, :] + step, len(codes))], pad)


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of ``values`` for each of ``n`` rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out[rows[order[first]]] = np.add.reduceat(values[order], first, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters and their training; ``p`` maps names to arrays, all float32."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        draw = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        p = {"word": draw(WORD_ROWS, D, by=0.05), "gram": draw(GRAM_ROWS, D, by=0.05), "Wa": draw(2 * H, H, by=0.3), "ba": np.zeros(H, np.float32), "v": draw(H, by=0.3), "w": draw(2 * H, by=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"W{d}": draw(2 * D, 3 * H, by=0.3), f"U{d}": draw(H, 3 * H, by=0.3), f"c{d}": np.zeros(3 * H, np.float32)}
        return cls(p)

    def inputs(self, row: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The vector of each word."""
        count = np.diff(begins).astype(np.float32)
        chars = np.add.reduceat(self.p["gram"][grams], begins[:-1], axis=0) / count[:, None] if len(row) else np.zeros((0, D), np.float32)
        return np.hstack([self.p["word"][row], chars])

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """The logit of each window; ``ids`` is word by step and window, the last row of ``x`` is the pad."""
        real = (ids != len(x) - 1).astype(np.float32)[:, :, None]
        n, states, memo = ids.shape[1], np.zeros((WINDOW, ids.shape[1], 2 * H), np.float32), {"real": real, "ids": ids}
        for k, d in enumerate("fb"):
            projected, u = x @ self.p[f"W{d}"] + self.p[f"c{d}"], self.p[f"U{d}"]
            h, trace = np.zeros((n, H), np.float32), []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, hu = projected[ids[t]], h @ u
                zr = sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
                c = np.tanh(g[:, 2 * H :] + zr[:, H:] * hu[:, 2 * H :])
                new = h + zr[:, :H] * (c - h) * real[t]
                if keep:
                    trace.append((t, h, zr, c, hu[:, 2 * H :]))
                h = new
                states[t, :, k * H : (k + 1) * H] = h
            memo[d] = trace
        a = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        e = a @ self.p["v"] + (real[:, :, 0] - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        memo |= {"states": states, "a": a, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0], memo

    def backward(self, x: np.ndarray, memo: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of ``x``."""
        states, a, alpha, real, ids = (memo[k] for k in ("states", "a", "alpha", "real", "ids"))
        g = {"w": memo["pooled"].T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["w"]
        d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_a = d_e[:, :, None] * self.p["v"] * (1 - a**2)
        g["v"] = np.einsum("tn,tnh->h", d_e, a)
        g["Wa"] = np.einsum("tnh,tnk->hk", states, d_a)
        g["ba"] = d_a.sum(axis=(0, 1))
        d_states = alpha[:, :, None] * d_pooled + d_a @ self.p["Wa"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, d_u, d_h = self.p[f"U{d}"], 0.0, np.zeros((ids.shape[1], H), np.float32)
            gates = np.zeros((WINDOW, ids.shape[1], 3 * H), np.float32)
            for t, h, zr, c, hu in reversed(memo[d]):
                d_h = d_h + d_states[t, :, k * H : (k + 1) * H]
                z, r = zr[:, :H], zr[:, H:]
                d_new = d_h * real[t]
                d_c = d_new * z * (1 - c**2)
                d_z = d_new * (c - h) * z * (1 - z)
                d_r = d_c * hu * r * (1 - r)
                d_hu = np.hstack([d_z, d_r, d_c * r])
                d_u = d_u + h.T @ d_hu
                gates[t, :, :H], gates[t, :, H : 2 * H], gates[t, :, 2 * H :] = d_z, d_r, d_c
                d_h = d_h - d_new * z + d_hu @ u.T
            d_projected = summed(ids.ravel(), gates.reshape(-1, 3 * H), len(x))
            g |= {f"U{d}": d_u, f"W{d}": x.T @ d_projected, f"c{d}": d_projected.sum(axis=0)}
            d_x += d_projected @ self.p[f"W{d}"].T
        return g, d_x

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of every text, and the text that each belongs to."""
        words, codes, ends = split_words(texts)
        x = np.vstack([self.inputs(*word_features(words)), np.zeros((1, 2 * D), np.float32)])
        at, size, doc = windows_of(ends)
        out = [self.forward(x, laid_out(codes, at[k : k + LANES], size[k : k + LANES], len(words)))[0] for k in range(0, len(at), LANES)]
        return np.concatenate(out), doc

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window probability of each text."""
        if not texts:
            return np.zeros(0)
        logit, doc = self.logits(texts)
        top = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(texts))))
        return 1 / (1 + np.exp(-np.clip(top.astype(np.float64), -60, 60)))


def train(texts: list[str], toxic: np.ndarray, epochs: int = 4, lanes: int = 256, windows_per_epoch: int = 10_000, seed: int = 3) -> Network:
    """Fit a network to texts and their labels (0 or 1). Where only one of the labels, or none, is seen, all scores are (nearly) 0."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if not len(texts) or toxic.min() == toxic.max():
        net.p["b"] = net.p["b"] - np.float32(30)
        return net
    words, codes, ends = split_words(texts)
    row, grams, begins = word_features(words)
    at, size, doc = windows_of(ends)
    label = toxic[doc].astype(np.float32)
    dense = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "gram")}
    squares = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "gram")}
    steps = 0
    order_key = np.zeros(len(at), np.float32)
    for epoch in range(epochs):
        if epoch >= 1:  # of toxic texts, the windows that the network finds most toxic
            logit = np.concatenate([net.logits(texts[k : k + BATCH])[0] for k in range(0, len(texts), BATCH)])
            top = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(top, doc, logit)
            order_key = logit
            positive = np.flatnonzero((label > 0) & ((logit >= top[doc]) | (logit > 0.5)))
        else:
            positive = np.flatnonzero(label > 0)
        negative = np.flatnonzero(label == 0)
        half = windows_per_epoch // 2
        positive = rng.permutation(positive)[:half]
        hard = negative[np.argsort(-order_key[negative], kind="stable")[: half // 2]] if epoch else negative[:0]
        chosen = np.concatenate([positive, hard, rng.permutation(negative)[: half - len(hard)]])
        chosen = rng.permutation(np.tile(chosen, max(1, windows_per_epoch // (2 * len(chosen)))))  # small samples come again
        for k in range(0, len(chosen), lanes):
            own = chosen[k : k + lanes]
            ids = laid_out(codes, at[own], size[own], len(words))
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            used = used[used < len(words)]
            part = np.concatenate([np.arange(begins[u], begins[u + 1]) for u in used]) if len(used) else np.zeros(0, np.int64)
            count = begins[used + 1] - begins[used]
            own_grams, own_begins = grams[part], np.append(0, np.cumsum(count))
            x = np.vstack([net.inputs(row[used], own_grams, own_begins), np.zeros((1, 2 * D), np.float32)])
            logit, memo = net.forward(x, local, keep=True)
            g, d_x = net.backward(x, memo, ((sigmoid(logit) - label[own]) / len(own)).astype(np.float32))
            steps += 1
            for name, (m, v) in dense.items():
                m += 0.1 * (g[name] - m)
                v += 0.01 * (g[name] ** 2 - v)
                net.p[name] -= 0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
            chars = np.repeat(d_x[:-1, D:] / np.maximum(count, 1)[:, None], count, axis=0)
            for name, rows, grad in (("word", row[used], d_x[:-1, :D]), ("gram", own_grams, chars)):
                touched, inverse = np.unique(rows, return_inverse=True)
                total = summed(inverse, grad * 100, len(touched))
                squares[name][touched] += (total**2).mean(axis=1)
                net.p[name][touched] -= 0.1 * total / np.sqrt(squares[name][touched])[:, None]
    # move the bias so that 0.5 parts the training documents best
    logit = np.concatenate([net.logits(texts[k : k + BATCH])[0] for k in range(0, len(texts), BATCH)])
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, doc, logit)
    order = np.argsort(top)
    wrong = np.append(0, np.cumsum(np.where(toxic[order] > 0, 1, -1)))  # errors with the cut before each place, up to a constant
    best = np.flatnonzero(wrong == wrong.min())
    cut = best[len(best) // 2]
    low, high = top[order[max(0, cut - 1)]], top[order[min(len(order) - 1, cut)]]
    net.p["b"] -= np.float32(0.25 * low + 0.75 * high)  # nearer to the toxic side: what is new differs from both
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, text, toxic``: at most ``per_class`` toxic and twice as many other texts with labels that are not held out.

    Those with the smallest hashes of their ids are taken, the same in every run.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for k in (0, 1):
        part = own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (2 - k))
        ids = part if ids is None else ids.unionByName(part)
    return docs_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(3 * per_class)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int) -> Network:
    """A network trained on :func:`sample` in one task, whose input is bounded; its parameters, of fixed size, come back."""

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((zlib.crc32(str(d).encode()), t or "", y) for part in parts for d, t, y in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True))
        net = train([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["parameters"])

    few = sample(docs, labels, per_class)
    made = few.repartition(1).mapInArrow(fit, "parameters binary").first()
    return Network(pickle.loads(made[0])) if made else train([], np.zeros(0, np.int64))


def scores(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, over whole texts.

    The network is trained from the whole texts of :func:`sample` (its bound, of rows, is a parameter); nothing but texts is an input. Null and
    empty texts are scored as a window without words. A null ``doc_id`` stays null and is not held out; rows that repeat get the
    same score; other columns are left out. With labels of one class only, or none,
    nothing is known: all scores are (nearly) 0.
    """
    net = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))  # of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, BATCH):
            s = net.value.score([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5, and those without words; other cases as in :func:`scores`."""
    net = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, BATCH):
            texts = [t or "" for t in part.column("text").to_pylist()]
            keep = [bool(s < 0.5) or not t.encode().split() for s, t in zip(net.value.score(texts), texts, strict=True)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
