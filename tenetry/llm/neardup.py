"""Near-duplicate records with small edits: a covering family of masks over words ordered by rarity.

Two texts whose common words are at least ``THRESHOLD`` of all their words share at least two of each one's
n - ceil(THRESHOLD * n) + 2 rarest words. The masks of a text are the single rare words and the pairs of not so rare words
within that prefix, so every pair in reach meets in some table, with no draw of chance. A pair that meets is first held
against 52-bit parity sketches (each word flips one bit, so they differ in no more bits than the texts do in words)
and then compared word by word. Texts with the same canonical form are one class and meet once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.llm.words import canonical, split_words, norm
from tenetry.session import materialize

#: Common words per words in either, in tenths.
TENTHS = 7
#: A word is frequent if it has more than one in FREQUENT_SHARE of all occurrences, so at most as many words are broadcast.
FREQUENT_SHARE, FREQUENT_LEAST = 8_192, 64
#: Texts of more distinct words use single-word masks, whose number grows with the length and not with its square.
PAIR_MASKS_UP_TO = 64
MAX_BITMAP = 1 << 28
_SIZE_BITS = 12
_SIZE_MASK = (1 << _SIZE_BITS) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * _M1 + np.asarray(b, np.uint64).reshape(-1) * _M2
    x ^= x >> np.uint64(29)
    return x * _M1


def masks(flat: np.ndarray, size: np.ndarray, keys: np.ndarray, counts: np.ndarray, tenths: int = TENTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask keys of many word sets: (key, number of the set, sketch of each set).

    ``flat`` holds the word hashes of all sets in a row, ``size`` their numbers (none is 0); ``keys``/``counts`` the
    frequent words, sorted by hash."""
    row = np.repeat(np.arange(len(size)), size)
    off = np.r_[0, np.cumsum(size)[:-1]]
    # parity bits above the number of words, as far as it fits; the comparison word by word has the exact numbers
    parity = np.bitwise_xor.reduceat(np.uint64(1) << ((flat >> np.uint64(32)) % np.uint64(64 - _SIZE_BITS)), off)
    sketch = (parity << np.uint64(_SIZE_BITS)) | np.minimum(size, _SIZE_MASK).astype(np.uint64)
    if len(keys):
        k = np.searchsorted(keys, flat).clip(max=len(keys) - 1)
        freq = np.where(keys[k] == flat, counts[k], 0)
    else:
        freq = np.zeros(len(flat), np.int64)
    order = np.lexsort((flat, freq, row))
    flat, freq = flat[order], freq[order]
    place = np.arange(len(flat)) - off[row]
    spare = size - (tenths * size + 9) // 10
    out_key, out_row = [], []

    def emit(key: np.ndarray, who: np.ndarray) -> None:
        out_key.append(key)
        out_row.append(who)

    paired = size <= PAIR_MASKS_UP_TO
    single = (place <= spare[row]) & (freq == 0) & paired[row]
    emit(_mix(flat[single], 1), row[single])
    lone = size == 1
    emit(_mix(flat[off[lone]], 2), np.flatnonzero(lone))
    # texts that may be near one beyond the limit
    long = 10 * size >= tenths * PAIR_MASKS_UP_TO
    far = (place <= spare[row]) & long[row]
    emit(_mix(flat[far], 3), row[far])
    for s in np.unique(spare[paired & ~lone]):
        who = np.flatnonzero(paired & ~lone & (spare == s))
        at = off[who][:, None] + np.arange(s + 2)
        w, f = flat[at], freq[at] > 0
        for i in range(s + 1):
            on = np.flatnonzero(f[:, i])
            if len(on):
                for j in range(i + 1, s + 2):
                    emit(_mix(w[on, i], w[on, j] | np.uint64(1)), who[on])
    return np.concatenate(out_key), np.concatenate(out_row), sketch


def _signatures(held, tenths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = held.value
        seen = np.zeros(0, np.int64)
        for b in batches:
            cls, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            new = ~np.isin(cls, seen, assume_unique=True)
            seen = np.union1d(seen, cls)
            cls, lists = cls[new], b.column(1).take(pa.array(first[new]))
            field = b.column(2).to_numpy(zero_copy_only=False)[first[new]]
            if not len(cls):
                continue
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            key, who, sketch = masks(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), size, keys, counts, tenths)
            short = ((key ^ field.view(np.uint64)[who]) >> np.uint64(33)).astype(np.int32)  # 31 bits: a chance meeting only costs a comparison
            cols = [short, cls[who], sketch[who].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["mask", "cls", "sketch"])

    return run


def _classed(texts: DataFrame) -> DataFrame:
    """(field, key, cls, normed) of the texts that have a word; cls stands for the field and the canonical text."""
    normed = texts.where("key is not null").select("field", "key", "text", norm(F.col("text")).alias("normed"))
    c = normed.select("field", "key", canonical(F.col("text"), F.col("normed")).alias("c"), "normed").where("c is not null")
    return c.select("field", "key", F.xxhash64("field", "c").alias("cls"), "normed")


def _distinct_words(normed: Column) -> Column:
    return F.array_distinct(split_words(normed))


def _hashes(normed: Column) -> Column:
    return F.transform(_distinct_words(normed), lambda w: F.xxhash64(w))


def candidates(texts: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """Distinct class pairs (a, b), a < b, that share a mask and whose sketches allow the similarity."""
    spark = texts.sparkSession
    count = texts.select(F.explode(_hashes(norm(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(f"n > {FREQUENT_LEAST}")
    top = materialize(count, "frequent")
    total = top.agg(F.sum("n")).first()[0] or 0
    frequent = sorted((r["w"] & (2**64 - 1), r["n"]) for r in top.where(F.col("n") > total / FREQUENT_SHARE).collect())  # at most FREQUENT_SHARE rows
    held = spark.sparkContext.broadcast((np.array([k for k, _ in frequent], np.uint64), np.array([n for _, n in frequent], np.int64)))
    hashed = _classed(texts).select("cls", _hashes(F.col("normed")).alias("w"), F.xxhash64("field").alias("field"))
    sig = hashed.mapInArrow(_signatures(held, tenths), "mask int, cls bigint, sketch bigint")
    # both sides are one shuffle; it is the join's own, so that adaptive execution may split a mask that very many share
    a, b = (sig.select("mask", *(F.col(c).alias(c + s) for c in ("cls", "sketch"))) for s in ("_a", "_b"))
    n = lambda s: F.col(s).bitwiseAND(F.lit(_SIZE_MASK))
    differ = F.bit_count(F.shiftrightunsigned(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")), _SIZE_BITS))
    near = (F.col("cls_a") < F.col("cls_b")) & ((n("sketch_a") == _SIZE_MASK) | (n("sketch_b") == _SIZE_MASK) | (differ * (10 + tenths) <= (n("sketch_a") + n("sketch_b")) * (10 - tenths)))
    return a.join(b, (a["mask"] == b["mask"]) & near).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


_PAGE = 32_768  # bits of one page of a bitmap


def _only(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The members whose class may be in ``pairs``, by a bitmap of hashed classes, broadcast with at most ``MAX_BITMAP`` bits.

    A full bitmap lets more through and never less, so the result does not depend on its size."""
    bits = min(MAX_BITMAP, max(_PAGE, 1 << (32 * pairs.count()).bit_length()))
    place = F.pmod(F.xxhash64("cls"), F.lit(bits))
    page, at = F.shiftright(place, 15).cast("int"), F.pmod(place, F.lit(_PAGE))
    held = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("bits"))
    asked = members.withColumn("page", page).join(F.broadcast(held), "page")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(pmod(pmod(xxhash64(cls), {bits}), {_PAGE}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return asked.where(F.lit(1) == F.floor(byte / F.pow(F.lit(2.0), F.pmod(place, F.lit(8)))) % 2).drop("page", "bits")


def near_classes(texts: DataFrame, tenths: int = TENTHS) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of classes that are near, compared word by word, once for all their members; and rows (field,
    key, cls) that hold all members of these classes, and of some others."""
    pairs = materialize(candidates(texts, tenths), "near-candidates")
    met = materialize(_only(_classed(texts), pairs), "near-members")
    # the members of a class have the same words; any of them stands for it
    one = met.groupBy("cls").agg(F.first("normed").alias("t"), F.first("field").alias("field"))
    side = lambda s: one.select(F.col("cls").alias(s), F.col("field").alias("field_" + s), F.col("t").alias("t_" + s))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    wa, wb = _distinct_words(F.col("t_a")), _distinct_words(F.col("t_b"))
    both = both.withColumn("common", F.size(F.array_intersect(wa, wb))).withColumn("total", F.size(wa) + F.size(wb) - F.col("common"))
    # both sides keep the field, and it is no join key, so that one shuffle of the texts serves both
    near = both.where(f"common * 10 >= total * {tenths} and least(field_a, field_b) = greatest(field_a, field_b)").select("a", "b")
    return near, met.select("field", "key", "cls")


def near_pairs(texts: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """Rows (field, key_a, key_b), key_a < key_b: texts of one field that are nearly, but not entirely, the same.

    ``texts`` has (field, key, text). Similarity is common distinct words over all distinct words of the two, at least
    ``tenths`` / 10. Texts that say the same apart from formatting are no pair; they are one class, and pairs of classes are
    spread over the members last. Null and wordless texts and null keys take no part; a key that occurs twice in a field
    with different texts is not paired with itself. Extra columns are not read."""
    near, member = near_classes(texts, tenths)
    real = materialize(near, "near-classes")
    side = lambda s: member.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("field", "key")))
    met = real.join(side("a"), "a").join(side("b"), "b").where("key_a <> key_b")
    return met.select(F.col("field_a").alias("field"), F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def belief_texts(beliefs: DataFrame) -> DataFrame:
    """Statements by belief id and snippets by evidence id, as (field, key, text)."""
    st = beliefs.select(F.lit("statement").alias("field"), F.col("id").alias("key"), F.col("statement").alias("text"))
    sn = beliefs.select(F.explode("evidence").alias("e")).select(F.lit("snippet").alias("field"), F.col("e.id").alias("key"), F.col("e.snippet").alias("text"))
    return st.unionByName(sn)


def groups(texts: DataFrame, tenths: int = TENTHS, max_rounds: int = 40) -> DataFrame:
    """Rows (field, key, group, links): one per text that has a word, with its group and its class's number of near classes.

    Groups are the connected parts of the near pairs between classes; ``group`` is a number that all members share. Every
    round gives each class the least label around it and lets labels follow their own label, so chains halve; if that has
    not ended after ``max_rounds`` rounds, which would take a chain of some 2^40 classes, it is an error."""
    real, _ = near_classes(texts, tenths)
    real = materialize(real, "near-classes")
    edges = materialize(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = edges.select(F.col("a").alias("cls")).distinct().withColumn("group", F.col("cls"))
    for _ in range(max_rounds):
        around = edges.join(label.select(F.col("cls").alias("b"), "group"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("group").alias("near"))
        step = label.join(around, "cls").select("cls", F.col("group").alias("old"), F.least("group", "near").alias("via"))
        jumped = step.join(label.select(F.col("cls").alias("via"), F.col("group").alias("next")), "via", "left")
        new = materialize(jumped.select("cls", "old", F.least("via", F.coalesce("next", "via")).alias("group")), "labels")
        label = new.select("cls", "group")
        if new.where("old <> `group`").isEmpty():
            break
    else:
        raise RuntimeError(f"groups have not settled in {max_rounds} rounds")
    links = edges.groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("links"))
    info = label.join(links, "cls")
    return _classed(texts).join(info, "cls", "left").select("field", "key", F.coalesce("group", "cls").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
