"""Problem 7: encode texts with a public byte-level BPE (priority queue of merge ranks over a doubly linked symbol list)."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Where the vocabulary files of the public tokenizers lie; a parameter of every function, overridden by FOLIOFORGE_TOKENIZERS.
VOCAB_DIR = os.environ.get("FOLIOFORGE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: the pattern by which this tokenizer splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest split that is cached, and how many.
CACHE_CHARS, CACHE_SIZE = 40, 400_000


def load(name: str = NAME, vocab_dir: str = VOCAB_DIR) -> dict[bytes, int]:
    """Symbols and their ids (which are the merge ranks)."""
    with open(os.path.join(vocab_dir, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one split: adjacent symbols are merged, least rank first, leftmost among equals.

        The queue may hold pairs whose symbols have since grown or gone; such stale entries are skipped when they come up.
        """
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))  # end of the symbol that begins here; 0: no symbol begins here any more
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, i, to = pop(queue)
            mid = end[i]
            if not mid or mid >= to or end[mid] != to:
                continue
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                r = ranks.get(data[i : end[to]])
                if r is not None:
                    push(queue, (r, i, end[to]))
            if (p := before[i]) >= 0:
                r = ranks.get(data[p:to])
                if r is not None:
                    push(queue, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, strings of special tokens being ordinary text; none for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for w in self.split(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.merge(w.encode("utf-8", "replace"))
                if len(w) <= CACHE_CHARS:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.symbols = {v: k for k, v in ranks.items()}

    def decode(self, ids: list[int] | None) -> str:
        return b"".join(self.symbols[i] for i in ids or []).decode("utf-8", "replace")


def _ranks(packed: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in packed.splitlines() if line.strip())}


def _packed(spark, name: str, vocab_dir: str):
    with open(os.path.join(vocab_dir, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the vocabulary file, under 1 MB


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """(key, ids) of each row; an empty list for null and empty texts. No shuffle; texts of any length; extra columns are dropped."""
    sent = _packed(docs.sparkSession, name, vocab_dir)
    rows = docs.select(key, text)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(_ranks(sent.value))
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in slices(texts):
                ids: list[int] = []
                ends = np.zeros(last - first + 1, np.int32)
                for i in range(first, last):
                    ids += enc.encode(texts[i])
                    ends[i - first + 1] = len(ids)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.asarray(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), lists], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", name: str = NAME, vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """(key, text) of encoded rows by joining the vocabulary's strings; null and empty lists give an empty text."""
    sent = _packed(encoded.sparkSession, name, vocab_dir)
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(_ranks(sent.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([dec.decode(x) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
