"""Filling fixed-capacity containers with items: exact-complement hashing on the histogram of lengths, then best fit.

The plan is made from how many items there are of each length, at most one number per length up to the capacity, however
many items there are. The longest length left opens a container; the gap it leaves is looked up among the single lengths,
the sums of two and the sums of three lengths still available, and a combination that fills the gap exactly is used as
often as its lengths are available; a gap wider than three items takes the longest first. Lengths for which no container
comes out exactly full are residuals. They are placed last, longest first, each into the open container it fits most
tightly. Items then find their places by their rank within their length, counted over salts so that one very common
length is no single task."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenetry.session import materialize, salt_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Items of one length that may share a salt.
ITEMS_PER_SALT, LEAST_SALTS = 500_000, 8


def _count_tokens(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(held.value).splitlines())}
        enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, n_tokens) by the tokenizer file ``tokenizer``; null and empty texts have 0.

    The file, under a megabyte, is read here and sent along, so that workers need no copy of it."""
    with open(tokenizer, "rb") as f:
        held = documents.sparkSession.sparkContext.broadcast(zlib.compress(f.read()))
    return documents.select("doc_id", "text").mapInArrow(_count_tokens(held), "doc_id bigint, n_tokens bigint")


class _Stock:
    """Counts by length, with the available lengths as bits of two numbers (one mirrored) to look sums up at once."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.c, self.n = capacity, dict(counts)
        self.bits = sum(1 << x for x in counts)
        self.mirror = sum(1 << (capacity - x) for x in counts)

    def take(self, x: int, k: int = 1) -> None:
        self.n[x] -= k
        if not self.n[x]:
            self.bits &= ~(1 << x)
            self.mirror &= ~(1 << (self.c - x))

    def put(self, x: int) -> None:
        self.n[x] += 1
        self.bits |= 1 << x
        self.mirror |= 1 << (self.c - x)

    def largest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1

    def pair(self, gap: int) -> list[int] | None:
        fit = self.bits & (self.mirror >> (self.c - gap)) & ((1 << gap) - 1)
        while fit:
            x = fit.bit_length() - 1
            if x != gap - x or self.n[x] > 1:
                return [x, gap - x]
            fit ^= 1 << x
        return None

    def exact(self, gap: int) -> list[int] | None:
        if self.n.get(gap, 0):
            return [gap]
        if found := self.pair(gap):
            return found
        rest = self.bits & ((1 << max(0, gap - 1)) - 1)
        while rest:
            x = rest.bit_length() - 1
            rest ^= 1 << x
            if 3 * x < gap:  # the largest of three is at least a third
                return None
            self.take(x)
            found = self.pair(gap - x)
            self.put(x)
            if found:
                return [x, *found]
        return None


def _exactly_full(stock: _Stock, opener: int) -> list[int] | None:
    """Lengths, the opener among them, that fill a container exactly, taken from the stock; or None and the stock as it was."""
    filling, gap = [opener], stock.c - opener
    stock.take(opener)
    while gap and (longest := stock.largest(gap)) > 0:
        found = stock.exact(gap) if gap <= 3 * stock.largest(stock.c) else [longest]
        if not found:
            break
        for x in found:
            stock.take(x)
        filling += found
        gap -= sum(found)
    if not gap:
        return filling
    for x in filling:
        stock.put(x)
    return None


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, for all items of a length at once: containers with the same filling are one entry."""
    open_at: dict[int, list[tuple[list[int], int]]] = {}
    bits = 0

    def keep(filling: list[int], times: int, gap: int) -> None:
        nonlocal bits
        if times:
            open_at.setdefault(gap, []).append((filling, times))
            bits |= 1 << gap

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            fits = bits >> x
            if fits:  # the lowest gap that holds the item
                gap = x + (fits & -fits).bit_length() - 1
                filling, times = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap]
                    bits &= ~(1 << gap)
            else:
                gap, filling, times = capacity, [], n
            most = gap // x
            full = min(times, n // most)
            keep(filling + [x] * most, full, gap - most * x)
            n, times = n - full * most, times - full
            if n and times:
                keep(filling + [x] * n, 1, gap - n * x)
                n, times = 0, times - 1
            if filling:
                keep(filling, times, gap)
    return [entry for entries in open_at.values() for entry in entries]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fillings (lengths, times) that use up ``counts`` (length -> number, lengths from 1 to ``capacity``)."""
    stock, out, residual = _Stock({k: v for k, v in counts.items() if v > 0}, capacity), [], {}
    while stock.bits:
        opener = stock.largest(capacity)
        filling = _exactly_full(stock, opener)
        if filling is None:  # the stock only shrinks, so there will be no exact filling for this length later on
            residual[opener] = stock.n[opener]
            stock.take(opener, stock.n[opener])
            continue
        use = {x: filling.count(x) for x in filling}
        more = min(stock.n[x] // k for x, k in use.items())
        if more:
            for x, k in use.items():
                stock.take(x, k * more)
        out.append((filling, more + 1))
    return out + _best_fit(residual, capacity)


def _places(segments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, start = segments.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            at = np.maximum(np.searchsorted(key, (length.astype(np.int64) << 40) + rank, "right") - 1, 0)
            whole = length == 0  # an empty text takes no room; it is put into the first container
            shift = rank - (key[at] & ((1 << 40) - 1)) if len(key) else rank
            cont = np.where(whole, 0, base[at] + shift) if len(key) else np.zeros(len(rank), np.int64)
            pos = np.where(whole, 0, start[at]) if len(key) else np.zeros(len(rank), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(cont, pa.int64()), pa.array(pos, pa.int64())], names=["doc_id", "piece", "token_start", "token_end", "container", "position"])

    return run


def pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    """Items as rows (doc_id, piece, token_start, token_end, length); only texts over the capacity have more than one."""
    n = F.greatest(F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("bigint"), F.lit(1))
    cut = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    begin, end = F.col("piece") * capacity, F.least((F.col("piece") + 1) * capacity, F.col("n_tokens"))
    return cut.select("doc_id", "piece", begin.alias("token_start"), end.alias("token_end"), (end - begin).alias("length"))


def histogram(items: DataFrame) -> dict[int, int]:
    """Number of items of each length: at most one row per length up to the capacity."""
    return {r["length"]: r["count"] for r in items.where("length > 0").groupBy("length").count().collect()}


def pack(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, piece, token_start, token_end, container, position): where each text or piece of a text lies.

    No container holds more than ``capacity`` tokens; a text is cut only if it alone exceeds that, and then into full
    pieces and one rest. Null and empty texts have no tokens and lie in container 0. Repeated rows are items of their own.
    An empty table gives no rows; extra columns are not read."""
    return pack_lengths(materialize(token_lengths(documents, tokenizer), "lengths"), capacity)


def pack_lengths(lengths: DataFrame, capacity: int) -> DataFrame:
    """As :func:`pack`, for rows (doc_id, n_tokens) that are counted already."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    spark = lengths.sparkSession
    items = pieces(lengths, capacity)
    counts = histogram(items)
    rank_at: dict[int, int] = {}
    rows, container = [], 0
    for filling, times in plan(counts, capacity):
        at = 0
        for x in filling:
            r = rank_at.get(x, 0)
            rows.append(((x << 40) + r, container, at))
            rank_at[x], at = r + times, at + x
        container += times
    rows.sort()
    held = spark.sparkContext.broadcast(tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3)
    salts = max(LEAST_SALTS, math.ceil(max(counts.values(), default=0) / ITEMS_PER_SALT))
    salted = items.withColumn("salt", salt_of("doc_id", salts)).repartition("length", "salt")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "token_start", "token_end", "length", (F.col("before") + F.col("r") - 1).alias("rank"))
    return placed.mapInArrow(_places(held), "doc_id bigint, piece bigint, token_start bigint, token_end bigint, container bigint, position bigint")


def pack_all(documents: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """:func:`pack` for every window (window_name, capacity) of a control table, with its name; tokens are counted once."""
    lengths = materialize(token_lengths(documents, tokenizer), "lengths")
    out = None
    for w in windows.where("capacity > 0").orderBy("window_name").collect():
        one = pack_lengths(lengths, w["capacity"]).select(F.lit(w["window_name"]).alias("window_name"), "*")
        out = one if out is None else out.unionByName(one)
    return lengths.sparkSession.createDataFrame([], _PACKED) if out is None else out


_PACKED = "window_name string, doc_id bigint, piece bigint, token_start bigint, token_end bigint, container bigint, position bigint"


def audit(documents: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (window_name, documents, overfull, incomplete, cut): what is wrong with the packing of each window.

    ``overfull`` counts containers beyond the capacity or with items that overlap, ``incomplete`` texts whose tokens are
    not all there once, ``cut`` texts in pieces that would have fitted whole; all three must be 0."""
    packed = materialize(pack_all(documents, windows, tokenizer), "packed")
    size = F.col("token_end") - F.col("token_start")
    there = packed.where("token_end > token_start").groupBy("window_name", "container").agg(F.sum(size).alias("used"), F.max(F.col("position") + size).alias("reach"))
    full = there.join(windows, "window_name").groupBy("window_name").agg(F.sum(((F.col("used") > F.col("capacity")) | (F.col("reach") != F.col("used"))).cast("bigint")).alias("overfull"))
    texts = packed.groupBy("window_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(size).alias("got"), F.max("token_end").alias("last"))
    lengths = token_lengths(documents, tokenizer)
    held = texts.join(lengths, "doc_id").join(windows, "window_name")
    wrong = held.groupBy("window_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(((F.col("got") != F.col("n_tokens")) | (F.col("last") != F.col("n_tokens"))).cast("bigint")).alias("incomplete"),
        F.sum(((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).cast("bigint")).alias("cut"),
    )
    return wrong.join(full, "window_name", "left").select("window_name", "documents", F.coalesce("overfull", F.lit(0)).alias("overfull"), "incomplete", "cut")


def fill(documents: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (window_name, capacity, containers, tokens, share): how well each window's containers would be filled."""
    spark = documents.sparkSession
    lengths = materialize(token_lengths(documents, tokenizer), "lengths")
    out = []
    for w in windows.where("capacity > 0").collect():  # a small control table
        counts = histogram(pieces(lengths, w["capacity"]))
        n, tokens = sum(t for _, t in plan(counts, w["capacity"])), sum(k * v for k, v in counts.items())
        out.append((w["window_name"], w["capacity"], n, tokens, tokens / (n * w["capacity"]) if n else 1.0))
    return spark.createDataFrame(out, "window_name string, capacity int, containers bigint, tokens bigint, share double")
