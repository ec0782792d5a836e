"""Ranked retrieval and grounding for many queries at once.

Every search is a stated set of queries against all documents, in blocks. Terms and words are packed into blocks that are
stored once each; a task reads all documents block by block beside its queries, and only the best of each query leaves it
(:func:`across`). Vectors are flat rows, parted by hash, and a task scores one block of queries against one block of documents
(:func:`in_blocks`). Nothing passes through the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenetry.functions import numeric, text
from tenetry.schema import COVERAGE_AT, DIMENSIONS, MIN_SIMILARITY, NGRAM, SUPPORTED_AT
from tenetry.session import materialize, scalar

#: (beliefs, queries, limit, within) -> rows (query_id, id, score, rank).
Retriever = Callable[[DataFrame, DataFrame, int, bool], DataFrame]
#: (rows, key, text) -> rows (key, dim, weight) of unit vectors.
Embedder = Callable[[DataFrame, str, Column], DataFrame]
#: Rows of one block at most, so that a pair of blocks fits a worker whatever the tables' size.
QUERIES_PER_BLOCK, DOCUMENTS_PER_BLOCK = 20_000, 50_000
#: Of packed blocks: queries, documents of a block of postings, and such documents that a task's JVM holds at a time.
PACKED_QUERIES, PACKED_DOCUMENTS, DOCUMENTS_HELD = 50_000, 125_000, 250_000


def indexed_text() -> Column:
    return F.concat_ws(" ", F.col("statement"), F.array_join(F.transform("evidence", lambda e: F.coalesce(e["snippet"], F.lit(""))), " "))


def documents(beliefs: DataFrame) -> DataFrame:
    """Live beliefs with their tokens and the norm of ranking (the root of the token count, 1 at least)."""
    live = beliefs.where("superseded_by is null").select("id", "confidence", "tier", "scope", text.tokens(indexed_text()).alias("tokens"))
    return live.withColumn("norm", F.sqrt(F.greatest(F.size("tokens"), F.lit(1)).cast("double")))


def postings(docs: DataFrame) -> DataFrame:
    """Rows (id, term, tf), counted within each row."""
    return docs.select("id", F.inline(text.runs(F.col("tokens")))).select("id", "term", F.col("tf").cast("bigint").alias("tf"))


def idf(docs: DataFrame) -> DataFrame:
    """Rows (term, df, idf) with idf = ln((n + 1) / (df + 1)) + 1 over the live beliefs."""
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _with_idf(df, scalar(docs.select(F.count(F.lit(1)).cast("double"))))


def _with_idf(df: DataFrame, n: Column) -> DataFrame:
    return df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def _top(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_blocks(queries: DataFrame, n_queries: int, docs: DataFrame, n_docs: int, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``score(query rows, document rows)`` for every pair of a block of queries (by ``qkey``) and a block of documents (by ``id``).

    As many pairs as there are cores, or more where blocks would be too large; the side with fewer rows is the one that is
    repeated more often."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_q = max(math.ceil(n_queries / QUERIES_PER_BLOCK), min(cores, round(math.sqrt(cores * n_queries / max(n_docs, 1)))), 1)
    n_d = max(math.ceil(n_docs / DOCUMENTS_PER_BLOCK), math.ceil(cores / n_q))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", block("qkey", n_q).alias("_qb"), every(n_d).alias("_db"))
    right = docs.select("*", block("id", n_d).alias("_db"), every(n_q).alias("_qb"))
    return left.groupBy("_qb", "_db").cogroup(right.groupBy("_qb", "_db")).applyInArrow(score, schema)


#: Columns of a packed block, of any lengths.
Block = dict[str, pa.Array | np.ndarray]


def _packed(block: Block) -> bytes:
    row = {k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v if isinstance(v, pa.Array) else pa.array(v)) for k, v in block.items()}
    batch = pa.record_batch(row)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(packed: pa.Buffer) -> Block:
    batch = pa.ipc.open_stream(packed).read_next_batch()
    found = {k: batch[k].flatten() for k in batch.schema.names}
    return {k: v if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False) for k, v in found.items()}


def pack(rows: DataFrame, make: Callable[[pa.Table], Block], most: int) -> DataFrame:
    """Rows (block): the rows of each partition, up to ``most`` a block, packed without a shuffle and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        done = lambda: pa.record_batch({"block": pa.array([_packed(make(pa.Table.from_batches(held).combine_chunks()))], pa.binary())})
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == most:
                    yield done()
                    held, n = [], 0
        if n:
            yield done()

    return materialize(rows.mapInArrow(run, "block binary"), "blocks")


def across(queries: DataFrame, docs: DataFrame, parts: int, start: Callable[[Block], tuple[Callable[[Block], None], Callable[[], pa.RecordBatch]]], schema: str) -> DataFrame:
    """Every packed block of queries against all packed blocks of documents, without a shuffle.

    ``start`` takes a block of queries and gives two functions, one that takes in a block of documents and one that gives what
    was found. The documents come in ``parts`` parts, of which a task's JVM holds one at a time."""
    n = max(queries.rdd.getNumPartitions(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for batch in batches:
            for key, q, d in zip(batch["key"].to_pylist(), batch["q"], batch["d"]):
                if key != last:
                    if found:
                        yield found()
                    last, (take, found) = key, start(_unpacked(q.as_buffer()))
                take(_unpacked(d.as_buffer()))
        if found:
            yield found()

    left = queries.select(F.xxhash64("block").alias("key"), F.col("block").alias("q"))
    right = docs.select(F.col("block").alias("d")).coalesce(parts)
    # the pairs of one part of the queries follow each other, so a task sees all documents
    return left.hint("shuffle_replicate_nl").crossJoin(right).coalesce(n).mapInArrow(run, schema)


class _Best:
    """The ``k`` best of each query so far, ties by id, and what a query's next must reach."""

    def __init__(self, keys: pa.Array, k: int, floor: float = -math.inf):
        self.keys, self.k, self.floor = keys, k, np.full(len(keys), floor)
        self.query, self.ids, self.value = np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0)

    def add(self, query: np.ndarray, ids: pa.Array, value: np.ndarray) -> None:
        if not len(query):
            return
        query, ids, value = np.r_[self.query, query], pa.concat_arrays([self.ids, ids]), np.r_[self.value, value]
        by = np.lexsort((-value, query))
        same = (query[by][1:] == query[by][:-1]) & (value[by][1:] == value[by][:-1])
        tied = by[np.r_[False, same] | np.r_[same, False]]
        name = np.zeros(len(query), np.int64)
        name[tied] = _coded(ids.take(pa.array(tied)))[0]
        by = np.lexsort((name, -value, query))
        query, value = query[by], value[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.ids, self.value = query[keep], ids.take(pa.array(by[keep])), value[keep]
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], value[last])

    def found(self, name: str) -> pa.RecordBatch:
        return pa.record_batch({"qkey": self.keys.take(pa.array(self.query)), "id": self.ids, name: pa.array(self.value)})


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values of a column in the order of its sorted distinct values; nulls are -1."""
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    names = found.drop_null().unique().sort()
    at = pa.compute.index_in(found, value_set=names)
    return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), names


class _Slices:
    """Which documents of a block a query may see: those of its own tier and scope, where it names them."""

    def __init__(self, queries: pa.Table | Block, docs: pa.Table | Block, qn: np.ndarray, n_queries: int, dn: np.ndarray, n_docs: int):
        self.want, self.own, self.seen = [], [], {}
        chunks = lambda c: c.chunks if isinstance(c, pa.ChunkedArray) else [c]
        for q, d in (("q_tier", "tier"), ("q_scope", "scope")) if "q_tier" in (queries if isinstance(queries, dict) else queries.column_names) else ():
            both, _ = _coded(pa.chunked_array([*chunks(queries[q]), *chunks(docs[d])], pa.string()))
            want, own = np.full(n_queries, -1), np.full(n_docs, -1)
            want[qn], own[dn] = both[: len(qn)], both[len(qn) :]
            self.want.append(want)
            self.own.append(own)

    def key(self, query: int) -> tuple[int, ...]:
        return tuple(int(w[query]) for w in self.want)

    def mask(self, key: tuple[int, ...]) -> np.ndarray | None:
        """Truth per document, or None where all are seen."""
        if key not in self.seen:
            masks = [own == v for v, own in zip(key, self.own) if v >= 0]
            self.seen[key] = np.logical_and.reduce(masks) if masks else None
        return self.seen[key]


def _pack_terms(slices: list[str]):
    """Packs queries (qkey, terms, tfs[, q_tier, q_scope])."""

    def run(table: pa.Table) -> Block:
        col = {c: table[c].combine_chunks() for c in table.column_names}
        return {c: col[c] for c in ("qkey", *slices)} | {"n": pa.compute.list_value_length(col["terms"]), "term": col["terms"].flatten(), "tf": col["tfs"].flatten()}

    return run


def _pack_postings(slices: list[str]):
    """Packs documents (id, confidence, norm, terms, tfs[, tier, scope]) as postings, sorted, of the terms (term, idf) that are asked for."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs = docs.take(pa.compute.sort_indices(docs["id"])).combine_chunks()
        by = np.argsort(asked["term"].to_numpy())
        term, idf = asked["term"].to_numpy()[by], asked["idf"].to_numpy()[by]
        col = {c: docs[c].combine_chunks() for c in docs.column_names}
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), pa.compute.list_value_length(col["terms"]).to_numpy(zero_copy_only=False))
        held, tf = col["terms"].flatten().to_numpy(), col["tfs"].flatten().to_numpy().astype(np.int32)
        at = np.searchsorted(term, held).clip(max=max(len(term) - 1, 0)).astype(np.int32)
        known = term[at] == held if len(term) else np.zeros(len(held), bool)
        at, doc, tf = at[known], doc[known], tf[known]
        order = np.argsort(at, kind="stable")
        block = {c: col[c] for c in ("id", "confidence", "norm", *slices)} | {"term": term, "idf": idf, "df": np.bincount(at, minlength=len(term)), "doc": doc[order], "tf": tf[order].astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.int32)}
        return pa.table({"block": pa.array([_packed(block)] if len(docs) else [], pa.binary())})

    return run


def _distinct(found: np.ndarray) -> np.ndarray:
    found = np.sort(found)
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


#: Scores count to six places, so what comes as near as this to a floor may reach it.
NEAR = 2e-6


def _best_by_terms(k: int):
    """The ``k`` best documents of each query of a block, term by term, its rarest first.

    Work follows the postings of the query's own terms. Documents with rarer terms, or blocks that came before, give a floor;
    once all terms that are left cannot reach it together, they are only looked up for documents that may still get there."""

    def start(queries: Block):
        best = _Best(queries["qkey"], k)
        asking, term, qtf = np.repeat(np.arange(len(queries["qkey"])), queries["n"]), queries["term"], queries["tf"]

        def take(docs: Block) -> None:
            n, doc, df, ids = len(docs["id"]), docs["doc"], docs["df"], docs["id"]
            if not len(docs["term"]) or not len(term):
                return
            at = np.searchsorted(docs["term"], term).clip(max=len(docs["term"]) - 1)
            held = np.flatnonzero((docs["term"][at] == term) & (df[at] > 0))
            hi = np.cumsum(df)
            lo = hi - df
            impact = docs["tf"] / docs["norm"][doc] * docs["confidence"][doc]
            top = np.zeros(len(df))
            some = np.flatnonzero(df)
            top[some] = np.maximum.reduceat(impact, lo[some]) if len(some) else 0.0
            by = held[np.lexsort((df[at[held]], asking[held]))]
            qn, t = asking[by], at[by]
            w = qtf[by] * docs["idf"][t]
            reach = w * top[t]
            starts = np.flatnonzero(np.r_[True, qn[1:] != qn[:-1]]) if len(qn) else np.zeros(0, np.int64)
            total = np.add.reduceat(reach, starts) if len(starts) else reach
            ends = np.r_[starts[1:], len(qn)]
            may = total >= best.floor[qn[starts]] - NEAR
            slices = _Slices(queries, docs, np.arange(len(best.keys)), len(best.keys), np.arange(n), n)
            acc = np.zeros(n)
            out_q, out_d, out_s = [], [], []

            def looked_up(j: int, some: np.ndarray) -> np.ndarray:
                """What a term gives to some documents, numbered in order."""
                d = doc[lo[t[j]] : hi[t[j]]]
                at = np.minimum(np.searchsorted(d, some), len(d) - 1)
                return np.where(d[at] == some, w[j] * impact[lo[t[j]] + at], 0.0)

            def reached(pool: np.ndarray, i: int, b: int) -> float:
                """A floor that at least ``k`` documents reach: what is best so far, with the terms that are left."""
                m = max(len(pool) - 8 * (k + 3), 0)
                some = _distinct(pool[np.argpartition(acc[pool], m)[m:]])
                whole = acc[some] + sum(looked_up(j, some) for j in range(i, b))
                return np.partition(whole, len(some) - k)[len(some) - k] if len(some) >= k else -math.inf

            for a, b in zip(starts[may].tolist(), ends[may].tolist()):
                q = qn[a]
                seen = slices.mask(slices.key(q))
                floor, left = best.floor[q], np.cumsum(reach[a:b][::-1])[::-1]
                touched, moved, i, asked = [np.zeros(0, np.int32)], 0, a, False
                while i < b:
                    first, end = lo[t[i]], hi[t[i]]
                    if moved and not asked and (end - first) * 64 > n:
                        floor, asked = max(floor, reached(np.concatenate(touched), i, b)), True
                    if left[i - a] < floor - NEAR:
                        break
                    d, x = doc[first:end], w[i] * impact[first:end]
                    if seen is not None:
                        d, x = d[seen[d]], x[seen[d]]
                    acc[d] += x
                    touched.append(d)
                    moved += len(d)
                    i += 1
                cand = np.concatenate(touched)
                floor = max(floor, reached(cand, i, b)) if len(cand) else floor
                kept = _distinct(cand[acc[cand] >= floor - (left[i - a] if i < b else 0.0) - NEAR])
                if len(kept):
                    for j in range(i, b):
                        acc[kept] += looked_up(j, kept)
                    s = np.round(acc[kept], 6)
                    first = np.lexsort((kept, -s))[:k]
                    out_q.append(np.full(len(first), q))
                    out_d.append(kept[first])
                    out_s.append(s[first])
                acc[cand] = 0.0
            if out_q:
                best.add(np.concatenate(out_q), ids.take(pa.array(np.concatenate(out_d))), np.concatenate(out_s))

        return take, lambda: best.found("score")

    return start


def retrieve(beliefs: DataFrame, queries: DataFrame, limit: int = 5, within: bool = False) -> DataFrame:
    """Rows (query_id, id, score, rank): the best live beliefs for each query (query_id, query[, tier, scope]).

    The score sums tf * idf over the query's tokens, repeats counted, over the norm, times confidence, to 6 places. With
    ``within`` a query sees only its own tier and scope (null sees all), before the limit. Queries without tokens, or with
    none that the index holds, give no rows. Queries that repeat are scored once. The index is cut into words once, its terms
    are numbers, and only postings of terms that some query asks for are packed."""
    slices = ["tier", "scope"] if within else []
    asked, one = _distinct_queries(queries, within, PACKED_QUERIES)
    numbered = lambda df, *cols: df.where(F.size("runs") > 0).select(*cols, F.transform("runs", lambda r: F.xxhash64(r["term"])).alias("terms"), F.col("runs.tf").alias("tfs"))
    wanted = pack(numbered(one.withColumn("runs", text.runs(text.tokens(F.col("query")))), "qkey", *(f"q_{c}" for c in slices)), _pack_terms([f"q_{c}" for c in slices]), PACKED_QUERIES)
    live = documents(beliefs)
    index = materialize(numbered(live.withColumn("runs", text.runs(F.col("tokens"))), "id", "confidence", "norm", *slices), "index")
    n_held, n = index.count(), scalar(live.select(F.count(F.lit(1)).cast("double")))
    index = index.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(max(math.ceil(n_held / PACKED_DOCUMENTS), 1))).cast("int"))
    held = index.select(F.col("_block").alias("_in"), F.explode("terms").alias("term")).groupBy("_in", "term").agg(F.count(F.lit(1)).alias("n"))
    df = held.join(wanted.mapInArrow(_terms_of, "term bigint").distinct(), "term", "left_semi").withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    weighed = _with_idf(df, n).select("_in", "term", "idf")
    posted = materialize(index.groupBy("_block").cogroup(weighed.groupBy("_in")).applyInArrow(_pack_postings(slices), "block binary"), "postings")
    hits = across(wanted, posted, max(math.ceil(n_held / DOCUMENTS_HELD), 1), _best_by_terms(limit), "qkey string, id string, score double")
    return asked.join(_top(hits, "qkey", limit), "qkey").select("query_id", "id", "score", "rank")


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of packed queries."""
    for batch in batches:
        for block in batch["block"]:
            yield pa.record_batch({"term": pa.array(np.unique(_unpacked(block.as_buffer())["term"]), pa.int64())})


def features(words: DataFrame) -> DataFrame:
    """Rows (word, feature, weight) of the hashing embedding of words: the word, its stem if it differs, and inner 4-grams."""
    stemmed = text.stem(F.col("word"))
    grams = F.when(F.length("word") > NGRAM, F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - NGRAM + 1, F.lit(1))), lambda i: F.struct(F.substr(F.col("word"), i, F.lit(NGRAM)).alias("feature"), F.lit(0.35).alias("weight"))))
    none = F.array().cast("array<struct<feature:string,weight:double>>")
    root = F.when(stemmed != F.col("word"), F.array(F.struct(stemmed.alias("feature"), F.lit(0.8).alias("weight"))))
    return words.select("word", F.inline(F.concat(F.array(F.struct(F.col("word").alias("feature"), F.lit(1.0).alias("weight"))), F.coalesce(root, none), F.coalesce(grams, none))))


def embed(rows: DataFrame, key: str, source: Column) -> DataFrame:
    """Rows (key, dim, weight): unit vectors of signed feature hashes.

    A text's vector is the sum of its words' vectors, so every distinct word is hashed once and texts only add up."""
    counted = materialize(rows.select(key, F.inline(text.runs(text.tokens(source)))).withColumnRenamed("term", "word"), "embed-words")
    hashed = features(counted.select("word").distinct()).select("word", numeric.slot(F.col("feature")).alias("dim"), (F.col("weight") * numeric.sign(F.col("feature"))).alias("w"))
    # sums of a few decimal weights; rounding makes their order irrelevant
    parts = hashed.groupBy("word", "dim").agg(F.round(F.sum("w"), 9).alias("w")).groupBy("word").agg(F.collect_list(F.struct("dim", "w")).alias("parts"))
    raw = counted.join(parts, "word").select(key, "tf", F.inline("parts")).groupBy(key, "dim").agg(F.round(F.sum(F.col("tf") * F.col("w")), 9).alias("v")).where("v <> 0")
    # the norm is taken over the dimensions of one text, a row's worth of numbers
    packed = raw.groupBy(key).agg(F.collect_list(F.struct("dim", "v")).alias("parts"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return packed.select(key, "norm", F.inline("parts")).select(key, "dim", (F.col("v") / F.col("norm")).alias("weight"))


#: Number of each row's key, the matrix of unit vectors of a range of keys, and the keys, sorted. Rows of NaN are keys without a vector.
Unpacked = tuple[np.ndarray, Callable[[int, int], np.ndarray], pa.Array]


def _dense(dims: int):
    """Rows (key, dim, weight)."""

    def run(table: pa.Table, key: str) -> Unpacked:
        at, names = _coded(table[key])
        order = np.argsort(at, kind="stable")
        row, dim, weight = at[order], table["dim"].to_numpy()[order], table["weight"].to_numpy()[order]

        def matrix(a: int, b: int) -> np.ndarray:
            i, j = np.searchsorted(row, [a, b])
            m = np.zeros((b - a, dims))
            m[row[i:j] - a, dim[i:j]] = weight[i:j]
            return m

        return at, matrix, names

    return run


def _word_vector(word: str) -> np.ndarray:
    """What :func:`features`, slots and signs make of a word, as (dim, weight) in units of 0.05."""
    found = [(word, 20)]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        found.append((word[:-1], 16))
    if len(word) > NGRAM:
        found += [(word[i : i + NGRAM], 7) for i in range(len(word) - NGRAM + 1)]
    start, prime, out = 0xCBF29CE484222325 % DIMENSIONS, 0x100000001B3 % DIMENSIONS, []
    for feature, weight in found:
        h = start
        for c in feature.encode():
            h = (h ^ c) * prime % DIMENSIONS
        out.append((h, weight if (h ^ ord("#")) * prime % 2 == 1 else -weight))
    return np.array(out, np.int64)


def _matrix(count: np.ndarray, word: np.ndarray, size: np.ndarray, dim: np.ndarray, weight: np.ndarray) -> Callable[[int, int], np.ndarray]:
    """The matrix of a range of texts of ``count`` words each; of every distinct word, ``size`` pairs of dim and weight."""
    at, lo = np.r_[0, np.cumsum(count)], np.cumsum(size) - size

    def matrix(a: int, b: int) -> np.ndarray:
        w = word[at[a] : at[b]]
        n = size[w]
        place = np.arange(n.sum()) + np.repeat(lo[w] - np.cumsum(n) + n, n)
        row = np.repeat(np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), n)
        m = np.bincount(row * DIMENSIONS + dim[place], weights=weight[place], minlength=(b - a) * DIMENSIONS).reshape(b - a, DIMENSIONS) / 20
        norm = np.sqrt((m * m).sum(axis=1))
        norm[norm == 0] = np.nan
        return m / norm[:, None]

    return matrix


def _hashed(words: pa.Array) -> Block:
    """What :func:`_matrix` needs of texts in the form of lists of words."""
    known = words.flatten().unique()
    word = pa.compute.index_in(words.flatten(), value_set=known).to_numpy(zero_copy_only=False)
    parts = [_word_vector(w) for w in known.to_pylist()]
    dim, weight = np.concatenate([np.zeros((0, 2), np.int64), *parts]).T
    return {"count": pa.compute.list_value_length(words).to_numpy(zero_copy_only=False), "word": word, "size": np.array([len(p) for p in parts], np.int64), "dim": dim, "weight": weight}


def _of_words(table: pa.Table, key: str) -> Unpacked:
    """Rows (key, words), embedded as :func:`embed` does it, a range at a time."""
    names = table[key].combine_chunks()
    order = pa.compute.sort_indices(names)
    return np.argsort(order.to_numpy()), _matrix(**_hashed(table["words"].combine_chunks().take(order))), names.take(order)


def _pack_words(key: str, slices: list[str]):
    """Packs texts (key, words[, slices]) in the order of their slices, so that those of one stand together."""

    def run(table: pa.Table) -> Block:
        table = table.take(pa.compute.sort_indices(table, [(c, "ascending") for c in (*slices, key)])).combine_chunks()
        hashed = _hashed(table["words"].combine_chunks())
        small = {"word": np.int32, "size": np.int32, "dim": np.int16, "weight": np.int8}
        return {c: table[c].combine_chunks() for c in (key, *slices)} | {k: v.astype(small.get(k, v.dtype)) for k, v in hashed.items()}

    return run


def _unit(block: Block) -> Callable[[int, int], np.ndarray]:
    return _matrix(block["count"], block["word"], block["size"].astype(np.int64), block["dim"].astype(np.int64), block["weight"].astype(np.int64))


def _whole(table: pa.Table, key: str) -> Unpacked:
    """Rows (key, vector)."""
    names = table[key].combine_chunks()
    order = pa.compute.sort_indices(names)
    m = table["vector"].combine_chunks().take(order).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
    m = m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
    return np.argsort(order.to_numpy()), lambda a, b: m[a:b], names.take(order)


#: Rows of one matrix at most: of queries, documents, and queries in a product.
QUERIES_AT_ONCE, DOCUMENTS_AT_ONCE, SLICE = 8192, 4096, 512


def _best_by_product(k: int, digits: int, unpack: Callable[[pa.Table, str], Unpacked], skip_self: bool = False):
    """The ``k`` best documents of each query of a block by the product of their vectors.

    A range of queries is set against a range of documents at a time, and only the best so far are kept, so memory does not
    follow the block."""

    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        keys, ids = queries["qkey"].combine_chunks(), docs["id"].combine_chunks()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(keys) and len(ids):
            qn, of_queries, keys = unpack(queries, "qkey")
            dn, of_docs, ids = unpack(docs, "id")
            own = pa.compute.index_in(keys, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False)
            slices = _Slices(queries, docs, qn, len(keys), dn, len(ids))
            for a in range(0, len(keys), QUERIES_AT_ONCE):
                q = of_queries(a, min(a + QUERIES_AT_ONCE, len(keys)))
                kept = best[0]
                for c in range(0, len(ids), DOCUMENTS_AT_ONCE):
                    d = of_docs(c, min(c + DOCUMENTS_AT_ONCE, len(ids)))
                    met = [kept, *(_found(q[i : i + SLICE] @ d.T, a + i, c, own, slices) for i in range(0, len(q), SLICE))]
                    row, col, v = (np.concatenate(x) for x in zip(*met))
                    by = np.lexsort((col, -v, row))
                    row, col, v = row[by], col[by], v[by]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    kept = row[keep], col[keep], v[keep]
                best.append(kept)
        row, col, v = (np.concatenate(x) for x in zip(*best))
        return pa.table({"qkey": keys.take(pa.array(row)), "id": ids.take(pa.array(col)), "similarity": pa.array(v)})

    def _found(s: np.ndarray, a: int, c: int, own: np.ndarray, slices: _Slices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of the queries from ``a`` on among the documents from ``c`` on, with what equals the k-th: ties are settled by id."""
        s = np.round(s, digits)
        s[np.isnan(s)] = -np.inf
        if skip_self:
            at = own[a : a + len(s)] - c
            rows = np.flatnonzero((at >= 0) & (at < s.shape[1]) & (own[a : a + len(s)] >= 0))
            s[rows, at[rows]] = -np.inf
        if slices.want:
            for i in range(len(s)):
                seen = slices.mask(slices.key(a + i))
                if seen is not None:
                    s[i, ~seen[c : c + s.shape[1]]] = -np.inf
        ok = np.isfinite(s)
        if s.shape[1] > k:
            ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        row, col = np.nonzero(ok)
        return row + a, col + c, s[row, col]

    return run


#: No product of two unit vectors in single precision is off by more than this.
OFF = 1e-4


def _best_by_words(k: int, skip_self: bool = False, least: float = -math.inf):
    """The ``k`` best documents of each query of a block by the product of their vectors, to 9 places, from ``least`` on.

    Products in single precision tell which pairs may count; those are taken exactly. A query is set against its own slice only."""

    def start(queries: Block):
        keys = queries["qkey"]
        best, unit = _Best(keys, k, least), _unit(queries)
        ranges = [unit(a, min(a + DOCUMENTS_AT_ONCE, len(keys))) for a in range(0, len(keys), DOCUMENTS_AT_ONCE)]
        asked = np.concatenate(ranges)
        del ranges
        rough, held = asked.astype(np.float32), np.flatnonzero(~np.isnan(asked[:, 0]))

        def take(docs: Block) -> None:
            ids, of_docs = docs["id"], _unit(docs)
            slices = _Slices(queries, docs, np.arange(len(keys)), len(keys), np.arange(len(ids)), len(ids))
            own = pa.compute.index_in(keys, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False) if skip_self else None
            _, first, group = np.unique(np.stack([np.zeros(len(held), np.int64), *(w[held] for w in slices.want)], axis=1), axis=0, return_index=True, return_inverse=True)
            groups = [(slices.mask(slices.key(held[f])), held[group.ravel() == g]) for g, f in enumerate(first)]
            for c in range(0, len(ids), DOCUMENTS_AT_ONCE):
                d = of_docs(c, min(c + DOCUMENTS_AT_ONCE, len(ids)))
                near, some = d.astype(np.float32), ~np.isnan(d[:, 0])
                met = []
                for mask, rows in groups:
                    cols = np.flatnonzero(some if mask is None else some & mask[c : c + len(d)])
                    if len(cols):
                        own_docs = near if len(cols) == len(near) else near[cols]
                        met += [_may(rows[i : i + SLICE], cols, own_docs, c, own) for i in range(0, len(rows), SLICE)]
                row, col = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*met) if met else ((), ())))
                v = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", asked[row[i : i + 4096]], d[col[i : i + 4096]]) for i in range(0, len(row), 4096))])
                v = np.round(v, 9)
                keep = v >= best.floor[row]
                best.add(row[keep], ids.take(pa.array(col[keep] + c)), v[keep])

        def _may(rows: np.ndarray, cols: np.ndarray, docs: np.ndarray, c: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            s = rough[rows] @ docs.T
            if own is not None:
                s[own[rows][:, None] == (cols + c)[None, :]] = -np.inf
            ok = s >= (best.floor[rows] - OFF).astype(np.float32)[:, None]
            if s.shape[1] > k and np.count_nonzero(ok) > 4 * k * len(rows):
                ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None] - np.float32(2 * OFF)
            if own is not None:
                ok &= s > -np.inf
            row, col = np.nonzero(ok)
            return rows[row], cols[col]

        return take, lambda: best.found("similarity")

    return start


def nearest(vectors: DataFrame, asked: DataFrame, k: int, skip_self: bool = False, least: float = -math.inf) -> DataFrame:
    """Rows (qkey, id, similarity, rank): the ``k`` nearest of ``vectors`` (id, dim, weight) to each of ``asked`` (qkey, dim, weight).

    Both may have ``words`` instead, one row a text, which are packed once and embedded where they are compared, as words take less
    room than their vectors. What is less similar than ``least`` may be left out. If ``asked`` has q_tier and q_scope and ``vectors`` tier and scope, a query sees its own slice only
    (null sees all)."""
    if "words" in vectors.columns:
        slices = [c for c in ("tier", "scope") if f"q_{c}" in asked.columns]
        parts = max(asked.sparkSession.sparkContext.defaultParallelism, math.ceil(asked.count() / QUERIES_AT_ONCE))
        wanted = pack(asked.repartition(parts, "qkey"), _pack_words("qkey", [f"q_{c}" for c in slices]), QUERIES_AT_ONCE)
        near = across(wanted, pack(vectors, _pack_words("id", slices), DOCUMENTS_PER_BLOCK), max(math.ceil(vectors.count() / DOCUMENTS_HELD), 1), _best_by_words(k, skip_self, least), "qkey string, id string, similarity double")
        return _top(near, "qkey", k, "similarity")
    size = lambda df, key: df.agg(F.count_distinct(key), F.coalesce(F.max("dim"), F.lit(0))).first()
    (n_asked, dim_a), (n_vectors, dim_v) = size(asked, "qkey"), size(vectors, "id")
    near = in_blocks(asked, n_asked, vectors, n_vectors, _best_by_product(k, 9, _dense(max(dim_a, dim_v) + 1), skip_self), "qkey string, id string, similarity double")
    return _top(near, "qkey", k, "similarity")


def _distinct_queries(queries: DataFrame, within: bool, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, qkey) of all queries with a text, and one row (qkey, query[, q_tier, q_scope]) of those that are alike.

    With ``most`` the latter are in as many parts as cores, or more where a part would have more rows than that."""
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    slices = ["tier", "scope"] if within else []
    asked = queries.where("query is not null").select("query_id", F.md5(F.concat_ws("\u0001", tag("query"), *map(tag, slices))).alias("qkey"), "query", *slices)
    parts = max(asked.sparkSession.sparkContext.defaultParallelism, math.ceil(asked.count() / most)) if most else 0
    one = (asked.repartition(parts, "qkey") if most else asked).groupBy("qkey").agg(F.first("query").alias("query"), *(F.first(c).alias(f"q_{c}") for c in slices))
    return asked.select("query_id", "qkey"), one


def vector_retrieve(
    beliefs: DataFrame, queries: DataFrame, limit: int = 5, within: bool = False, min_similarity: float = MIN_SIMILARITY, vectors: DataFrame | None = None, embedder: Embedder = embed
) -> DataFrame:
    """Rows (query_id, id, similarity, score, rank): nearest beliefs by embedding.

    The 3 * limit most similar are taken, those under ``min_similarity`` dropped, and the rest ranked by similarity times
    confidence. Repeated query texts are embedded and searched for once; ``within`` is as in :func:`retrieve`. ``vectors``
    are those of a kept index (:class:`tenetry.operators.vectors.VectorIndex`); without them the live beliefs are embedded
    here."""
    live = beliefs.where("superseded_by is null")
    facts = live.select("id", *(["tier", "scope"] if within else []))
    asked, one = _distinct_queries(queries, within)
    if vectors is None and embedder is embed:
        index = live.select(*facts.columns, text.tokens(indexed_text()).alias("words"))
        wanted = one.withColumn("words", text.tokens(F.col("query"))).drop("query")
    else:
        index = materialize((embedder(live, "id", indexed_text()) if vectors is None else vectors).join(facts, "id"), "vectors")
        wanted = embedder(one, "qkey", F.col("query"))
        wanted = materialize(wanted.join(one.drop("query"), "qkey") if within else wanted, "query-vectors")
    near = nearest(index, wanted, 3 * limit, least=min_similarity).where(F.col("similarity") >= min_similarity).drop("rank")
    scored = near.join(live.select("id", "confidence"), "id").withColumn("score", F.round(F.col("similarity") * F.col("confidence"), 6))
    best = _top(scored, "qkey", limit).select("qkey", "id", "similarity", "score", "rank")
    return asked.join(best, "qkey").drop("qkey")


def by_vectors(min_similarity: float = MIN_SIMILARITY, vectors: DataFrame | None = None, embedder: Embedder = embed) -> Retriever:
    """Vector retrieval in the form of a retriever."""
    return lambda beliefs, queries, limit=5, within=False: vector_retrieve(beliefs, queries, limit, within, min_similarity, vectors, embedder).drop("similarity")


RETRIEVERS: dict[str, Retriever] = {}


def get_retriever(retriever: str | Retriever) -> Retriever:
    """A retriever by name, or any function of that form as it is."""
    if callable(retriever):
        return retriever
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}; choose from {sorted(RETRIEVERS)}, or pass a function")
    return RETRIEVERS[retriever]


RETRIEVERS |= {"lexical": retrieve, "vector": by_vectors()}


def dense_search(vectors: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Rows (query_id, id, similarity, rank): the nearest dense vectors (id, vector) by cosine, ties by id.

    Null vectors take no part. The stated queries are set against all rows in blocks."""
    docs = vectors.where("vector is not null").select("id", "vector")
    asked = queries.where("vector is not null").select(F.col("id").alias("qkey"), "vector")
    near = in_blocks(asked, asked.count(), docs, docs.count(), _best_by_product(limit, 6, _whole), "qkey bigint, id bigint, similarity double")
    return _top(near, "qkey", limit, "similarity").withColumnRenamed("qkey", "query_id")


def neighbour_pairs(beliefs: DataFrame, k: int = 10, asked: Column | None = None, embedder: Embedder = embed) -> DataFrame:
    """Rows (a, b), a < b: pairs of which one is among the other's ``k`` nearest by embedding, ties by id.

    ``asked`` tells which beliefs look for neighbours, among all; by default every one does."""
    live = beliefs.where("superseded_by is null")
    index = live.select("id", text.tokens(indexed_text()).alias("words")) if embedder is embed else materialize(embedder(live, "id", indexed_text()), "vectors")
    seekers = index if asked is None else index.where(asked)
    near = nearest(index, seekers.withColumnRenamed("id", "qkey"), k, skip_self=True)
    return near.select(F.least("qkey", "id").alias("a"), F.greatest("qkey", "id").alias("b")).distinct()


def refreshed(index: DataFrame, changes: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Postings (id, term, tf) brought up to date: rows of gone and changed beliefs leave, new and changed ones come.

    ``changes`` has (id, change) as the registry's difference gives it; only those beliefs are tokenised."""
    fresh = beliefs.join(changes.where("change <> 'gone'").select("id"), "id", "left_semi")
    return index.join(changes.select("id"), "id", "left_anti").unionByName(postings(documents(fresh)))


def coverage(claim_tokens: Column, doc_tokens: Column) -> Column:
    """Share of a claim's distinct tokens that a belief holds, to 6 places."""
    wanted = F.array_distinct(claim_tokens)
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, doc_tokens)) / F.size(wanted), 6)).otherwise(0.0)


def check(beliefs: DataFrame, claims: DataFrame, threshold: float = SUPPORTED_AT, coverage_at: float = COVERAGE_AT, retriever: Retriever = retrieve) -> DataFrame:
    """Claims (claim_id, claim) with relevance, coverage, supported and, where supported, the belief's id.

    A claim that occurs more than once is searched for once."""
    asked = materialize(claims.select("claim_id", "claim"), "claims")
    hits = retriever(beliefs, asked.select(F.col("claim_id").alias("query_id"), F.col("claim").alias("query")), 1, False)
    best = asked.join(hits.select(F.col("query_id").alias("claim_id"), "id", "score"), "claim_id", "left").join(documents(beliefs).select("id", "tokens"), "id", "left")
    cov = F.when(F.col("tokens").isNotNull(), coverage(text.tokens(F.col("claim")), F.col("tokens"))).otherwise(0.0)
    out = best.select("claim_id", "claim", "id", F.coalesce("score", F.lit(0.0)).alias("relevance"), cov.alias("coverage"))
    out = out.withColumn("supported", F.col("id").isNotNull() & (F.col("relevance") >= threshold) & (F.col("coverage") >= coverage_at))
    return out.select("claim_id", "claim", "supported", "relevance", "coverage", F.when(F.col("supported"), F.col("id")).alias("belief_id"))


def ground(beliefs: DataFrame, answers: DataFrame, retriever: Retriever = retrieve) -> DataFrame:
    """Answers (answer_id, text) checked claim by claim: (answer_id, claims, supported, score); score is their share."""
    claims = answers.where("text is not null").select("answer_id", F.posexplode(text.claims_to_verify(F.col("text"))).alias("pos", "claim"))
    checked = check(beliefs, claims.select(F.struct("answer_id", "pos").alias("claim_id"), "claim"), retriever=retriever)
    per = checked.groupBy(F.col("claim_id.answer_id").alias("answer_id")).agg(F.count(F.lit(1)).alias("claims"), F.sum(F.col("supported").cast("bigint")).alias("supported"))
    out = answers.select("answer_id").join(per, "answer_id", "left").na.fill(0, ["claims", "supported"])
    return out.withColumn("score", F.when(F.col("claims") > 0, F.round(F.col("supported") / F.col("claims"), 4)).otherwise(0.0))


def justify(beliefs: DataFrame) -> DataFrame:
    """Verdict, evidence counts and sums for and against, and an explanation, for every belief."""
    side = lambda s: F.filter("evidence", lambda e: e["supports"] == s)
    total = lambda s: F.round(F.aggregate(side(s), F.lit(0.0), lambda a, e: a + e["strength"]), 6)
    out = beliefs.select("id", "confidence", F.size(side(True)).alias("n_for"), F.size(side(False)).alias("n_against"), total(True).alias("support"), total(False).alias("against"), F.array_join(F.transform(side(True), lambda e: F.coalesce(e["locator"], e["source"])), ", ").alias("where"))
    verdict = F.when((F.col("n_for") == 0) & (F.col("n_against") == 0), "unsupported").when((F.col("n_for") > 0) & (F.col("n_against") > 0), "disputed").when(F.col("n_for") > 0, "grounded").otherwise("refuted")
    out = out.withColumn("verdict", verdict).withColumn("weight", F.round(F.col("confidence") * (1 + F.col("support") - F.col("against")), 6))
    return out.withColumn("explanation", F.concat_ws("", "verdict", F.lit(" at "), F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%"), F.when(F.col("where") != "", F.concat(F.lit(", from "), F.col("where")))))
