"""Words and canonical statements as Spark expressions.

A word is a longest run of Unicode letters and digits (categories L and N), lower-cased; everything
else only separates words. Nulls stay null in the string forms and give empty arrays in the array forms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenetry.functions.text import let  # noqa: F401 - used by the operators that read words

#: Names under which a statement may list its parts.
FIELD_NAMES = ("subject", "relation", "object", "since", "unit")
_FIELD = r"^[^\p{L}\p{N}:=]*(?i:" + "|".join(FIELD_NAMES) + r")[^\p{L}\p{N}:=]*[:=]"
_BREAKS = ";|\n\r\x0b\x0c\x85\u2028\u2029"
_PARTS = f"[{_BREAKS}]+"


def norm(text: Column) -> Column:
    """The words of a text joined by single spaces; '' when it has none."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def split_words(normed: Column) -> Column:
    """The words of a normed text, in order; an empty array for '' and null."""
    return F.when(F.coalesce(normed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(normed, " "))


def words(text: Column) -> Column:
    return split_words(norm(text))


def canonical(statement: Column, normed: Column | None = None) -> Column:
    """One string per way of stating the same thing.

    Statements with the same words in the same order are equal; a statement made only of three or more named
    fields equals those with the same fields in any order. Null for null statements and for ones without a word.
    ``normed`` is :func:`norm` of the statement, where the caller has it already."""
    parts = F.filter(F.split(statement, _PARTS), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    # plain byte searches keep the array work off the statements that list nothing
    parted = reduce(or_, (F.contains(statement, F.lit(c)) for c in _BREAKS)) & (F.contains(statement, F.lit(":")) | F.contains(statement, F.lit("=")))
    listed = parted & (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(_FIELD))
    fields = F.concat(F.lit("\u0002"), F.array_join(F.array_sort(F.transform(parts, norm)), "\u0001"))
    plain = norm(statement) if normed is None else normed
    return F.when(listed, fields).when(plain != "", plain)


def canonical_hashes(statement: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the canonical statement; together they stand for it."""
    c = canonical(statement)
    return F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit(1), c))
