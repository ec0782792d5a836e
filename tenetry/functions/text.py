"""Text functions over columns: blocks, sentences, claims, tokens, polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenetry.schema import GROUNDING_AT, MIN_CLAIM_WORDS, MIN_WORDS, NEGATIONS, STOPWORDS, VERBS

# The patterns that decide what a block, a list item, an abbreviation and noise are.
_FENCE = r"^\s*(?:```|~~~)"
_HEADING = r"^\s*#{1,6}\s+"
_TABLE = r"^\s*\|"
_MARKER = r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s+)"
_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_ABBREVIATION = r"(?i)\b(?:e\.g|i\.e|etc|vs|approx|fig|no|al|dr|mr|ms|st)\."
_NOISE = r"^\s*(?:[-*#>\d.)\s]+)$"
# Decorations of Markdown whose inside is kept.
_DECORATIONS = (r"\[([^\]]+)\]\([^)]*\)", r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*")
_SPLIT = "\x01"
_STRINGS = "array<string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside the body's lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blocks(text: Column) -> Column:
    """Paragraphs and list items as one line each; code, tables, headings and blank lines part them and are dropped."""

    def join(lines: Column, fences: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            coded = line.rlike(_FENCE) | (F.size(F.filter(fences, lambda f: f <= i)) % 2 == 1)
            skip = coded | line.rlike(_TABLE) | line.rlike(_HEADING) | (_strip(line) == "")
            marked = line.rlike(_MARKER)
            return F.when(skip, _SPLIT).when(marked, F.concat(F.lit(_SPLIT), _strip(F.regexp_replace(line, _MARKER, "")))).otherwise(F.concat(F.lit(" "), _strip(line)))

        return F.array_join(F.transform(lines, one), "")

    where = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_FENCE), i)), lambda i: i.isNotNull())
    joined = let(F.split(text, _LINE_ENDS), lambda lines: let(where(lines), lambda f: join(lines, f)))
    return F.filter(F.transform(F.split(joined, _SPLIT), _strip), lambda b: b != "")


def sentences(text: Column) -> Column:
    """Sentences of every block; a block is cut behind . ! ? and white space, but not behind an abbreviation."""
    cut = lambda b: F.split(b, rf"(?U)(?<=[.!?])(?<!{_ABBREVIATION})\s+")
    glued = lambda s: F.regexp_replace(_strip(s), rf"(?U)({_ABBREVIATION})\s+", "$1 ")
    return F.filter(F.flatten(F.transform(blocks(text), lambda b: F.transform(cut(b), glued))), lambda s: s != "")


def plain(sentence: Column) -> Column:
    """Without links, code, bold and italic marks, and with single spaces."""
    for pattern in _DECORATIONS:
        sentence = F.regexp_replace(sentence, pattern, "$1")
    return squeeze(sentence)


def _has_verb(words: Column) -> Column:
    return F.exists(words, lambda w: F.lower(w).isin(*VERBS))


def _long_enough(s: Column) -> Column:
    words = F.regexp_extract_all(s, F.lit(r"[a-zA-Z0-9']+"), F.lit(0))
    ended = let(words, lambda w: (F.size(w) >= MIN_WORDS) | ((F.size(w) >= MIN_CLAIM_WORDS) & _has_verb(w)))
    return F.when(s.rlike(r"[.!]$"), ended).otherwise(F.size(F.split(squeeze(s), " ")) >= MIN_WORDS)


def claims(text: Column) -> Column:
    """Declarative sentences worth storing: no questions, list introductions, noise or fragments."""
    keeps = lambda s: (s != "") & ~s.rlike(r"[?:]$") & ~s.rlike(_NOISE) & _long_enough(s)
    return F.filter(F.transform(sentences(text), plain), keeps)


def claims_to_verify(text: Column) -> Column:
    """Sentences that assert something, however short; the whole text if there is none; empty for a blank text."""
    found = lambda s: F.filter(s, lambda x: ~x.endswith("?") & (F.size(tokens(x)) > 0))
    whole = F.when(_strip(text) == "", F.array().cast(_STRINGS)).otherwise(F.array(_strip(text)))
    return let(found(sentences(text)), lambda f: F.when(F.size(f) > 0, f).otherwise(whole))


def split_claims(statement: Column) -> Column:
    """The independent claims in a statement, or an empty array if it holds only one."""
    body = F.regexp_replace(statement, r"[.!?]+$", "")
    pieces = F.filter(F.transform(F.split(body, r"(?iU)\s*;\s+|,?\s+\band\b\s+|,?\s+\bbut\b\s+"), _strip), lambda p: p != "")
    words = lambda p: F.split(squeeze(p), " ")
    verb = lambda w: F.lower(F.regexp_replace(w, r"^,+|,+$", "")).isin(*VERBS)

    def subject(p: Column) -> Column:
        first = lambda w: F.array_position(F.transform(w, verb), True)
        return let(words(p), lambda w: F.when(first(w) > 0, F.array_join(F.slice(w, 1, (first(w) - 1).cast("int")), " ")).otherwise(""))

    def full(p: Column, subj: Column) -> Column:
        inherits = F.lower(F.get(words(p), F.lit(0))).isin(*VERBS) & (subj != "")
        return F.when(inherits, F.concat(subj, F.lit(" "), p)).otherwise(p)

    def build(ps: Column) -> Column:
        return let(subject(F.get(ps, F.lit(0))), lambda subj: let(F.transform(ps, lambda p: full(p, subj)), lambda fs: checked(ps, fs)))

    def checked(ps: Column, fs: Column) -> Column:
        fine = (F.size(ps) >= 2) & F.forall(ps, lambda p: F.exists(words(p), verb)) & F.forall(fs, lambda f: F.size(words(f)) >= MIN_CLAIM_WORDS)
        done = F.transform(fs, lambda f: F.concat(F.upper(F.substring(f, 1, 1)), F.substr(f, F.lit(2)), F.lit(".")))
        return F.when(fine, done).otherwise(F.array().cast(_STRINGS))

    return let(pieces, build)


def normalise(statement: Column) -> Column:
    """The key under which duplicates meet: lower case, letters a-z and digits, single spaces."""
    return squeeze(F.regexp_replace(F.lower(statement), "[^a-z0-9 ]", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters a-z or digits, without stop words, in order and with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def runs(words: Column) -> Column:
    """Distinct words as structs (term, tf), from the places where the sorted words change; no shuffle is needed to count."""
    starts = lambda s: F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    count = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))
    return let(F.array_sort(words), lambda s: let(starts(s), lambda at: count(s, at)))


def stem(word: Column) -> Column:
    cut = (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(?:ss|us|is)$")
    return F.when(cut, F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), stem))


def polarity(statement: Column) -> Column:
    """0 for an affirmative statement, 1 for a negated one."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(statement), F.lit("[a-z']+"), F.lit(0)), lambda w: w.isin(*NEGATIONS))) % 2


def content(statement: Column) -> Column:
    """Distinct stems without negation words."""
    return F.array_distinct(F.transform(F.filter(tokens(statement), lambda t: ~t.isin(*NEGATIONS)), stem))


def token_cost(statement: Column) -> Column:
    return F.greatest(F.size(tokens(statement)), F.lit(1))


def _any_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9']+"), F.lit(0)), F.lower)


def grounded_share(claim: Column, source: Column) -> Column:
    """Share of the claim's words, with repeats, that the source holds; 0 for a claim without words."""
    return let(_any_words(claim), lambda c: let(_any_words(source), lambda s: F.when(F.size(c) > 0, F.size(F.filter(c, lambda w: F.array_contains(s, w))) / F.size(c)).otherwise(0.0)))


def grounded_in(claim: Column, source: Column) -> Column:
    return grounded_share(claim, source) >= GROUNDING_AT


def reply_claims(reply: Column) -> Column:
    """Claims of a model's reply: one per line, without list markers and noise, ended by a full stop."""
    lines = F.transform(F.split(reply, _LINE_ENDS), lambda x: _strip(F.regexp_replace(_strip(x), _MARKER, "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(_NOISE))
    return F.transform(kept, lambda x: F.when(x.rlike("[.!]$"), x).otherwise(F.concat(x, F.lit("."))))


def passage_for(claim: Column, source: Column) -> Column:
    """The sentence of the source that shares most tokens with the claim, and the one before it; short sources whole."""

    def pick(ss: Column) -> Column:
        shared = F.transform(ss, lambda s: F.size(F.array_intersect(tokens(s), tokens(claim))))
        best = lambda sh: F.array_position(sh, F.array_max(sh)).cast("int")
        window = let(shared, lambda sh: F.slice(ss, F.greatest(best(sh) - 1, F.lit(1)), F.least(best(sh), F.lit(2))))
        return F.when(F.size(ss) <= 2, source).otherwise(F.array_join(window, " "))

    return let(sentences(source), pick)
