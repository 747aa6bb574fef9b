"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts each text where its content says so, so that passages which documents share fall
into the same chunks. A chunk is encoded once and kept. At every join of two chunks the text around it is encoded again, from a
word inside the left chunk to a word inside the right one, and the new ids have to agree with the chunks' own on these two words;
only then what is beyond them is taken from the chunks. Where they do not agree, the whole text is encoded again.

Why they agree: both words begin and end at safe points. A safe point is a blank between two visible ASCII characters. The pre-tokenizer (`` ?\\p{L}+`` and its siblings) takes a
blank only as the first character of a piece when a visible character follows, and no piece that ends before it looks
beyond it, so a piece always begins there: ids left and right of it are independent. A chunk without two such words is
joined with its neighbours until there are.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelforge.llm.common import batches, claim, docs_text

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in every Unicode version and regular-expression engine; texts with others are
#: split by the library itself.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]")
SAFE = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")
SPECIAL, FIRST = "<|", "\x01"
WORDS_KEPT = 200_000
CHUNK_BYTES_KEPT = 48 << 20
#: Rows encoded together.
BATCH = 1000
#: Rolling hash: bytes that a value depends on, and the mean distance of cuts.
WINDOW, MEAN_CHUNK = 16, 1024


class Codec:
    """Encodes as the tokenizers library does, with a bounded memory of words and chunks.

    ``units`` holds the ids of a blank and a word (key: the word), of a line break and a word (key: both) or of a word alone
    (key: 0x01 and the word). Each begins where a piece begins: at a safe point, at the start of the text, or at a line break
    between visible characters, which is a piece of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units: dict[str, bytes] = {}
        self.gear = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.chunks: dict[bytes, tuple | None] = {}
        self.chunk_bytes = self.met = self.reused = 0
        self.pieces = self._piece_bytes()
        #: The same merges by rank. A pair that joins to a vocabulary string of rank r can only stand side by side, once all
        #: merges below r are done, as the pair that the file lists, because each string encodes alone to its own id.
        #: Where a string does not, the library encodes all texts.
        self.exact = all([x.id for x in self.tokenizer.model.tokenize(s)] == [k] for s, k in self.tokenizer.get_vocab(with_added_tokens=False).items())
        own = self.tokenizer.get_vocab_size(with_added_tokens=False)
        self.merges = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks={x: k for k, x in enumerate(self.pieces[:own])}, special_tokens={})

    def _piece_bytes(self) -> list[bytes]:
        """The bytes of each id; byte-level vocabularies write a byte as one printable character."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for piece, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[k] = bytes(back[c] for c in piece)
        return out

    def learn(self, units: list[str]) -> None:
        """Send the units that are new through the merges."""
        if len(self.units) > WORDS_KEPT:
            self.units.clear()
        encode, known = self.merges.encode_ordinary, self.units
        for u in units:
            if u not in known:
                known[u] = np.array(encode(u if u[0] == "\n" else u[1:] if u[0] == FIRST else f" {u}"), "<u4").tobytes()

    def plain(self, text: str) -> bool:
        """Whether all white space is single blanks and line breaks between visible, common characters."""
        return self.exact and not (
            SPECIAL in text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or text[-1:] in ("", " ", "\n") or FIRST in text or UNCOMMON.search(text)
        )

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words that texts share are looked up once a batch; new ones go through the merges."""
        plain = [k for k, t in enumerate(texts) if self.plain(t)]
        out: list[bytes] = [b""] * len(texts)
        if len(plain) < len(texts):
            easy = set(plain)
            for k, t in enumerate(texts):
                if k not in easy:
                    out[k] = self.encode(t)
        if not plain:
            return out
        column = pa.array([(FIRST + texts[k]).replace("\n", " \n") for k in plain], pa.large_string())
        lists = pc.split_pattern(column, " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self.learn(distinct)
        known = [self.units[u] for u in distinct]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins, codes = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        each = sizes[codes]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(known), "<u4")[np.repeat(begins[codes] - ends + each, each) + np.arange(ends[-1])]
        data, at = flat.tobytes(), 0
        stops = ends[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py() - 1] * 4
        for k, end in zip(plain, stops.tolist(), strict=True):
            out[k] = data[at:end]
            at = end
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD as in the library."""
        raw = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw

    def cuts(self, data: bytes) -> list[int]:
        """Where the rolling hash cuts, moved to the start of a character."""
        b = np.frombuffer(data, np.uint8)
        if len(b) <= WINDOW:
            return []
        h = self.gear[b]
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k] << np.uint32(k)
        at = np.flatnonzero((h[WINDOW:] >> np.uint32(16)) % MEAN_CHUNK == 0) + WINDOW + 1
        out = []
        for p in at.tolist():
            while p < len(b) and b[p] & 0xC0 == 0x80:
                p += 1
            if p < len(b):
                out.append(p)
        return out

    def _parts(self, chunk: bytes) -> tuple[str, str, str, str, str] | None:
        """The text before the first safe point, the word behind it, all from the first safe point to the last one, the word before the last one, and the rest."""
        if (first := SAFE.search(chunk)) is None or (second := SAFE.search(chunk, first.end())) is None:
            return None
        p, q = first.start(), self._safe_before(chunk, len(chunk))
        q1 = self._safe_before(chunk, q)
        if q1 < second.start():
            return None
        return chunk[:p].decode(), chunk[p : second.start()].decode(), chunk[p:q].decode(), chunk[q1:q].decode(), chunk[q:].decode()

    @staticmethod
    def _safe_before(chunk: bytes, end: int) -> int:
        q = chunk.rfind(b" ", 0, end)
        while q > 0 and not (q < len(chunk) - 1 and 0x20 < chunk[q - 1] < 0x7F and 0x20 < chunk[q + 1] < 0x7F):
            q = chunk.rfind(b" ", 0, q)
        return q

    def encode_chunked(self, texts: list[str]) -> list[bytes]:
        """As :meth:`encode_batch`, by chunks that are encoded once and joins that are encoded again until they agree with the chunks."""
        if self.chunk_bytes > CHUNK_BYTES_KEPT:
            self.forget_chunks()
        cut: list[list[bytes] | None] = []
        for text in texts:
            if SPECIAL in text:  # special strings end pieces in their own way: the library takes the whole text
                cut.append(None)
                continue
            data = text.encode()
            ends = [*self.cuts(data), len(data)]
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        new = {c: self._parts(c) for c in set().union(*(c for c in cut if c)) - self.chunks.keys()}
        met = sum(len(c) for c in cut if c)
        self.met, self.reused = self.met + met, self.reused + met - len(new)
        inner = [x for x in new.items() if x[1] is not None]
        joins: list[str] = []
        for chunks in cut:
            if chunks is None:
                continue
            join = ""
            for chunk in chunks:
                kept = new[chunk] if chunk in new else self.chunks[chunk]
                if kept is None:
                    join += chunk.decode()
                else:
                    joins.append(join + kept[0] + kept[1])
                    join = kept[3] + kept[4]
            joins.append(join)
        n = len(inner)
        ids = self.encode_batch([*(x[2] for _, x in inner), *(x[1] for _, x in inner), *(x[3] for _, x in inner), *joins])
        for k, (chunk, (head, first, _, last, tail)) in enumerate(inner):
            self.chunks[chunk] = head, first, ids[k], last, tail, ids[n + k], ids[2 * n + k]
            self.chunk_bytes += len(chunk) + len(ids[k]) + 600
        self.chunks.update((c, None) for c, x in new.items() if x is None)
        join, out = iter(ids[3 * n :]), []
        for text, chunks in zip(texts, cut, strict=True):
            if chunks is None:
                out.append(self.encode(text))
                continue
            made, left, agreed = [], b"", True
            for chunk in chunks:
                if (kept := self.chunks[chunk]) is None:
                    continue
                again, (_, _, own, _, _, first, last) = next(join), kept
                # the join's ids, without the two words on which they agree with the chunks
                agreed = agreed and again.startswith(left) and again.endswith(first) and own.startswith(first) and own.endswith(last) and len(again) >= len(left) + len(first)
                made += [again[len(left) : len(again) - len(first)], own]
                left = last
            again = next(join)
            agreed = agreed and again.startswith(left)
            out.append(b"".join([*made, again[len(left) :]]) if agreed else self.encode(text))
        return out

    def forget_chunks(self) -> None:
        self.chunks.clear()
        self.chunk_bytes = 0

    def forget(self) -> None:
        self.forget_chunks()
        self.units.clear()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker process: its memory of words and chunks serves all tasks that the process runs."""
    return Codec(path)


def forget() -> None:
    """Without its vocabulary a worker holds nothing of this module."""
    codec.cache_clear()


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Each document's ids (little-endian 32-bit) and the bytes of their decoding.

    Returns ``doc_id, ids binary, decoded binary``, one row a row of ``docs``; order and partitions stay. A null text counts
    as empty (no ids, empty decoding), a null ``doc_id`` stays null, repeated rows stay repeated, other columns are left out.
    Nothing is shuffled: a worker reuses the chunks that it has met, within a fixed amount of memory.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", forget)
        c = codec(vocabulary)
        for part in batches(parts, BATCH):
            ids, back = [], []
            for one in c.encode_chunked([t or "" for t in part.column("text").to_pylist()]):
                ids.append(one)
                back.append(c.decode(one))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_decode_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode_decode`, hashed where the bytes are made."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", forget)
        c = codec(vocabulary)
        for part in batches(parts, BATCH):
            n, ids, back = [], [], []
            for one in c.encode_chunked([t or "" for t in part.column("text").to_pylist()]):
                n.append(len(one) // 4)
                ids.append(hashlib.sha256(one).hexdigest())
                back.append(hashlib.sha256(c.decode(one)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
