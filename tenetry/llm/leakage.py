"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

Patterns are all windows of ``run`` consecutive words of the evaluation items. A block is two adjacent words. The shift
table says, for each block of any pattern, how far a window ending there may move without missing a pattern; blocks of no
pattern allow the longest move, so most positions of a document are never looked at. Where the shift is zero the hash of
the last block picks the patterns that end with it, and all words of those are compared. Many documents move at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetry.llm.words import words
from tenetry.session import materialize

RUN = 12
#: Windows searched for in one pass (about 8 bytes * run each on every worker); more items take more passes.
MAX_WINDOWS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two adjacent words."""
    x = (a * _MIX) ^ (b + (a >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Patterns:
    """Shift table, suffix buckets and windows, all as sorted arrays."""

    def __init__(self, items: list[tuple[int, np.ndarray]], run: int = RUN):
        self.run = run
        wins = [np.lib.stride_tricks.sliding_window_view(w, run) for _, w in items if len(w) >= run]
        self.windows = np.concatenate(wins) if wins else np.zeros((0, run), np.uint64)
        self.items = np.concatenate([np.full(len(w) - run + 1, i) for i, w in items if len(w) >= run]) if wins else np.zeros(0, np.int64)
        blocks = _block(self.windows[:, :-1], self.windows[:, 1:])
        shift = np.broadcast_to(np.arange(run - 2, -1, -1), blocks.shape).ravel()
        order = np.lexsort((shift, blocks.ravel()))
        keys = blocks.ravel()[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        self.keys, self.shift = keys[first], shift[order][first]
        last = blocks[:, -1] if len(blocks) else np.zeros(0, np.uint64)
        by = np.argsort(last, kind="stable")
        self.suffix, self.windows, self.items = last[by], self.windows[by], self.items[by]
        # one bit for each of 2^20 hash values keeps most blocks from the search in the table
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def moves(self, block: np.ndarray) -> np.ndarray:
        out = np.full(len(block), self.run - 1)
        at = np.flatnonzero(self.seen[(block >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.keys, block[at]).clip(max=max(0, len(self.keys) - 1))
        hit = self.keys[k] == block[at]
        out[at[hit]] = self.shift[k[hit]]
        return out

    def search(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text number, item) in texts given as one array of word hashes with offsets; may repeat."""
        texts, found = [], []
        doc = np.flatnonzero(np.diff(offsets) >= self.run) if len(self.keys) else np.zeros(0, np.int64)
        pos, end = offsets[doc] + self.run - 1, offsets[doc + 1]
        while len(doc):
            block = _block(flat[pos - 1], flat[pos])
            step = self.moves(block)
            at = np.flatnonzero(step == 0)
            if len(at):
                lo, hi = np.searchsorted(self.suffix, block[at], "left"), np.searchsorted(self.suffix, block[at], "right")
                n = hi - lo
                who = np.repeat(at, n)
                cand = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                for part in np.array_split(np.arange(len(cand)), len(cand) // 100_000 + 1):
                    w, c = who[part], cand[part]
                    same = (flat[pos[w][:, None] + np.arange(1 - self.run, 1)] == self.windows[c]).all(axis=1)
                    texts.append(doc[w[same]])
                    found.append(self.items[c[same]])
            pos = pos + np.maximum(step, 1)
            on = pos < end
            doc, pos, end = doc[on], pos[on], end[on]
        return (np.concatenate(texts), np.concatenate(found)) if texts else (np.zeros(0, np.int64),) * 2


def _scan(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Patterns.__new__(Patterns)
        p.__dict__.update(patterns.value)
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
            text, item = p.search(flat, off - off[0])
            if len(text):
                pair = np.unique(np.stack([text, item]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair[0])), pa.array(pair[1])], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Rows (doc_id, item_id): the document shares at least ``run`` consecutive words with the item.

    Null, empty and shorter texts on either side match nothing; texts of any length are read whole. Repeated rows give the
    pair once per document id. Items are held on the workers; beyond ``max_windows`` windows they are searched for in
    several passes over the documents' words, each with a part of the items (one item of more words makes a pass of its own)."""
    spark = documents.sparkSession
    hashed = lambda df, key: df.where("text is not null").select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    docs = hashed(documents, "doc_id")
    tables: list = []
    block: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        tables.append(spark.sparkContext.broadcast(vars(Patterns(block, run))))

    for row in hashed(items, "item_id").toLocalIterator():  # one partition at a time, and only what one pass can hold
        w = np.array(row["w"], dtype=np.int64).view(np.uint64)
        if len(w) < run:
            continue
        if block and size + len(w) > max_windows:
            flush()
            block, size = [], 0
        block.append((row["item_id"], w))
        size += len(w)
    if block or not tables:
        flush()
    if len(tables) > 1:  # the texts are cut into words once, whatever the number of passes
        docs = materialize(docs, "document-words")
    passes = [docs.mapInArrow(_scan(held), "doc_id bigint, item_id bigint") for held in tables]
    return reduce(DataFrame.unionByName, passes).distinct()
