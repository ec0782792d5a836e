"""How distinctive a term is per record: probabilistic relevance weighting.

score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avglen)) with collection
document frequencies and the average length. A record is one row, so term frequencies need no shuffle. The frequencies of
the terms held by more than one record in ``HOT_SHARE`` of all postings are broadcast (there can be no more than
``HOT_SHARE`` such terms, whatever the data); all other terms are joined by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.functions.text import runs
from tenetry.llm.words import norm, split_words
from tenetry.session import materialize, scalar

HOT_SHARE = 10_000
K1, B = 1.2, 0.75


def text_of(statement: str = "statement", evidence: str = "evidence") -> Column:
    """Statement and all snippets as one text; nulls are skipped."""
    snippets = F.coalesce(F.transform(F.col(evidence), lambda e: F.coalesce(e["snippet"], F.lit(""))), F.array().cast("array<string>"))
    return F.concat_ws(" ", F.col(statement), F.array_join(snippets, " "))


def records(beliefs: DataFrame) -> DataFrame:
    """Rows (id, length, terms): each record's number of words and its distinct words with their counts."""
    w = beliefs.select("id", split_words(norm(text_of())).alias("w"))
    return w.select("id", F.size("w").alias("length"), runs(F.col("w")).alias("terms"))


def _saturated(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    """Term frequency, saturating and normalised by the record's length."""
    tf = tf.cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _weight(total: Column, df: Column) -> Column:
    """The probabilistic weight of a term held by ``df`` of ``total`` records."""
    return F.log1p((total - df + 0.5) / (df + 0.5))


def score_terms(beliefs: DataFrame, k1: float = K1, b: float = B, tf_least: int = 1, df_most: int | None = None) -> DataFrame:
    """Rows (id, term, tf, df, score), one per record and distinct word of its statement and snippets.

    ``tf_least`` and ``df_most`` ask for terms that are characteristic in that degree: what scores less than a term with
    just these figures would in the same record is left out by its score, then the figures themselves are compared. The
    texts are cut into words once, into a table in the shared folder. Null and empty texts give no rows. Rows with the same
    id are scored as separate records; extra columns are not read."""
    kept = materialize(records(beliefs), "term-records")
    post = kept.select("id", "length", F.inline("terms"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = scalar(kept.select(F.count(F.lit(1)).cast("double")))
    mean = scalar(kept.select(F.avg(F.col("length").cast("double"))))
    # the postings of hot terms need no partner; they are spread by record instead of piling up on their term
    hot = df.where(F.col("df") > scalar(df.select(F.sum("df") / HOT_SHARE))).select("term", F.col("df").alias("hot_df"))
    flagged = post.where(F.col("tf") >= tf_least).join(F.broadcast(hot), "term", "left")
    key = F.when(F.col("hot_df").isNull(), F.col("term")).otherwise(F.concat(F.lit("\u0001"), F.col("id")))
    joined = flagged.withColumn("_key", key).join(df.select(F.col("term").alias("_key"), F.col("df").alias("cold_df")), "_key", "left")
    found = joined.withColumn("df", F.coalesce("hot_df", "cold_df")).withColumn("score", _weight(total, F.col("df")) * _saturated(F.col("tf"), F.col("length"), mean, k1, b))
    if df_most is not None:
        # the score grows with tf and falls with df, so nothing that is asked for scores less than this
        least = _weight(total, F.lit(df_most)) * _saturated(F.lit(tf_least), F.col("length"), mean, k1, b)
        found = found.where(F.col("score") >= least * (1 - 1e-12)).where(F.col("df") <= df_most)
    return found.select("id", "term", "tf", "df", "score")
