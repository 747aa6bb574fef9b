"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string that ends a word is encoded alone; those that come back as exactly their
own id are proven to be one token wherever they stand as a piece. Texts are cut into pieces, pieces on that list count one
each, and only the rest goes through the merges. Nothing that the library does looks beyond white space, so words with characters of
which normalizers and regular-expression engines may think differently are sent to it one by one, and their texts are not.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import batches, claim

#: The word splitter of the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: For words with other characters the library's own normalizer and splitter are used: inside them NFC changes nothing, lower case
#: is letter by letter, and all regular-expression engines agree on classes.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]")
WORD_END = "</w>"
KEPT = 400_000
#: Longer words are counted and not remembered.
LONGEST_KEPT = 64
#: Rows counted together.
BATCH = 1000


class Counter:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if f'"Regex":{json.dumps(PIECES)}' not in re.sub(r'"Regex": ?', '"Regex":', t.to_str()):
            raise ValueError(f"{path} splits words in another way")
        self.split = regex.compile(PIECES).findall
        self.special = {x.content: k for k, x in t.get_added_tokens_decoder().items()}
        self.whole = dict.fromkeys(self.whole_tokens(), 1)
        #: Tokens of pieces, and of words (what stands between white space) as sums over their pieces.
        self.pieces, self.words = dict(self.whole), {}

    def whole_tokens(self) -> list[str]:
        """Pieces of common characters that alone give exactly one token, shown by encoding each of them."""
        own = {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k.endswith(WORD_END)}
        ids, texts = [], []
        for piece, k in own.items():
            text = piece[: -len(WORD_END)]
            if text.isascii() and self.split(text) == [text] and text == text.lower():
                ids.append(k)
                texts.append(text)
        made = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [t for t, k, e in zip(texts, ids, made, strict=True) if e.ids == [k]]

    def learn(self, words: list[str]) -> list[int]:
        """Tokens of each word: proven pieces count one, the others go through the merges, all in one call."""
        if len(self.words) > KEPT:
            self.words.clear()
        if len(self.pieces) > KEPT:
            self.pieces = dict(self.whole)
        odd = [w for w in words if w not in self.words and UNCOMMON.search(w)]
        own = dict(zip(odd, (len(e.ids) for e in self.tokenizer.encode_batch(odd, add_special_tokens=False)), strict=True)) if odd else {}
        new = {w: self.split(w.lower()) for w in words if w not in self.words and w not in own}
        rest = [*(set().union(*new.values()) - self.pieces.keys())]
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]  # blanks keep the pieces apart and are dropped
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            self.pieces.update(zip(part, np.bincount(made.word_ids, minlength=len(part)).tolist(), strict=True))
        get = self.pieces.__getitem__
        for w, pieces in new.items():
            own[w] = sum(map(get, pieces))
        self.words.update((w, k) for w, k in own.items() if len(w) <= LONGEST_KEPT)
        return [self.words[w] if w in self.words else own[w] for w in words]

    def count_batch(self, texts: list[str]) -> list[int]:
        plain = [not any(x in t for x in self.special) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        words = lists.flatten().dictionary_encode()
        each = np.array(self.learn(words.dictionary.to_pylist()), np.int64)[words.indices.to_numpy()]
        total = np.append(0, np.cumsum(each))
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        n = (total[ends[1:]] - total[ends[:-1]]).tolist()
        return [k if p else len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t, p, k in zip(texts, plain, n, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def forget() -> None:
    counter.cache_clear()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, over whole texts.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit), a null ``doc_id`` stays null, repeated rows stay
    repeated, other columns are left out. Nothing is shuffled; a worker's memory of merged pieces is bounded.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_count", forget)
        c = counter(vocabulary)
        for part in batches(parts, BATCH):
            n = c.count_batch(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)
