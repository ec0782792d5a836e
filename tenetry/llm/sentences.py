"""Sentence boundaries across languages and scripts, in SQL expressions only.

Every step keeps the length of the text, so places in the masked text are places in the original: line ends become soft
or hard breaks by the kind of line they part; fenced code, table rows and markers become blanks; full stops of decimals,
addresses, initials, abbreviations and of quoted speech become private-use placeholders. Terminators of each script then
get a cut behind them, the text is split there, and the sentences are read from the original by their places."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.llm.words import let

BLANK, HARD, CUT, MASK, STOP = "", "", "", "", ""

# Abbreviations after which a sentence goes on ...
_INNER = (
    "vs cf approx fig figs sec secs no nos dr mr mrs ms prof st vgl nr abs abb kap bd bzw ca ex env pág págs art arts aprox "
    "núm cap vol ed eq ch sr sra sres srta mme mlle mm ej dra ing dipl hon rev gen col sgt capt tel str resp incl inkl zzgl"
)
# ... and those that may also end one, which a capital after them tells.
_OUTER = "etc usw inc ltd co corp jr ff llc plc gmbh s.a p.m a.m p.m.a u.a al"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

_OPEN = "[“\"«»„「『(\\[（【]"
_CL = "[\"”“’»«'\\)\\]}*_」』）】》〉]"
#: Closing signs after a terminator; French ones may have a space before.
_CLOSERS = f"(?:{_CL}|[   ]»(?=[\\s,.;:{HARD}]|$))"
_CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
_THAI = "฀-๿"
#: A command with an option starts a sentence though it is written small.
_SMALL = "(?![\\p{Ll}\\p{N}]+-\\p{Ll}+\\s+--)\\p{Ll}"
_END = f"(?=[\\s{HARD}{BLANK}]|$)"
_CODE = r"^\s*(?:```|~~~)"


def _alternatives(names: str) -> str:
    return "|".join(n.replace(".", r"\.") for n in names.split())


def _lines(text: Column) -> Column:
    """The text with soft breaks as they were, hard breaks as HARD, and what holds no sentence blanked out."""
    blank = lambda line: F.repeat(F.lit(BLANK), F.length(line))
    marker = r"^(\s*)(#{1,6}(?=\s)|[-*+•‣](?=\s)|\d{1,3}[.)](?=\s))"

    def kind(line: Column) -> Column:
        return (
            F.when(~line.rlike(r"^\s*(?:$|[|\-*_=#+•‣\d])"), "text")  # nothing else makes a line special
            .when(line.rlike(r"^\s*$") | line.rlike(r"^\s*\|") | line.rlike(r"^\s*([-*_=])(?:\s*\1){2,}\s*$"), "none")
            .when(line.rlike(r"^\s{0,3}#{1,6}\s"), "head")
            .when(line.rlike(r"^\s*(?:[-*+•‣]|1[.)])\s"), "item")
            .when(line.rlike(r"^\s*\d{1,3}[.)]\s"), "number")
            .otherwise("text")
        )

    def place(lines: Column, fences: Column) -> Column:
        coded = lambda i: F.coalesce(F.get(lines, i).rlike(_CODE), F.lit(False)) | (F.size(F.filter(fences, lambda f: f <= i)) % 2 == 1)
        kinds = F.transform(lines, lambda line, i: F.when((F.size(fences) > 0) & coded(i), "none").otherwise(kind(line)))

        def out(kinds: Column) -> Column:
            at = lambda i: F.coalesce(F.when(i >= 0, F.get(kinds, i)), F.lit("none"))
            # inside a paragraph a number and a dot are a wrapped line, not a list item
            begins = lambda i: at(i).isin("none", "head", "item") | ((at(i) == "number") & (at(i - 1) != "text"))
            ends = lambda i: at(i).isin("none", "head")
            body = lambda line, i: F.when(at(i) == "none", blank(line)).when(begins(i), F.concat(_spaces(line, marker), F.regexp_replace(line, marker, ""))).otherwise(line)
            joined = F.transform(lines, lambda line, i: F.concat(F.when(i == 0, "").when(begins(i) | ends(i - 1), HARD).otherwise("\n"), body(line, i)))
            return F.array_join(joined, "")

        return let(kinds, out)

    fenced = F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))
    where = lambda lines: F.when(fenced, F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(_CODE), i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    flat = F.translate(F.replace(text, F.lit("\r\n"), F.lit(" \n")), "\r\u2028\u2029\x85", "\n\n\n\n")
    return let(F.split(flat, "\n"), lambda lines: let(where(lines), lambda fences: place(lines, fences)))


def _spaces(line: Column, marker: str) -> Column:
    return F.repeat(F.lit(BLANK), F.length(F.regexp_extract(line, marker, 0)))


def _step(df: DataFrame, pattern: str, to: str, needs: Column | None = None) -> DataFrame:
    """Replace in ``_s``, only in texts that hold what the pattern needs: a byte search costs far less than a pattern."""
    done = F.regexp_replace("_s", pattern, to)
    return df.withColumn("_s", done if needs is None else F.when(needs, done).otherwise(F.col("_s")))


def _has(signs: str) -> Column:
    return reduce(or_, (F.contains(F.col("_s"), F.lit(c)) for c in signs))


def _masked(df: DataFrame) -> DataFrame:
    # each pattern starts at the sign it is about and looks around only there; addresses and quotations are looked through
    # once, from their beginning and then stop by stop, each from where the one before it was, so that long ones stay linear
    marks, stops, word = "“”「」『』«»„", f".!?…{STOP}", r"\p{L}\p{N}._+-"
    outer, inner = (rf"(?<=(?<![\p{{L}}\p{{N}}])(?i:{_alternatives(x)})\.)" for x in (_OUTER, _INNER))
    before_capital = rf"{_CL}*(?:\s+{_OPEN}*[\p{{Lu}}\p{{Lo}}¿¡]|\s*$|\s*{HARD})"
    letter = r"(?<![\p{L}\p{N}\p{M}])\p{L}"

    def speech(opening: str, marks: str, stops: str, after: str = "") -> tuple[str, str]:
        return rf"((?:{opening}|\G(?!\A))[^{marks}{HARD}{stops}]*+)[{stops}]{after}", "$1" + MASK

    def attributed(marks: str, closing: str) -> tuple[str, str]:
        return speech(rf"[{marks}](?=[^{marks}{HARD}]*+{closing},?\s+{_SMALL})", marks, stops)

    worded = lambda marks: rf"(?=[^{marks}{HARD}\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])"
    # single dots of an ellipsis become one sign each
    df = _step(df, r"\.(?=\.\.)|(?<=\.\.)\.|(?<=\.)\.(?=\.)", "…", F.contains("_s", F.lit("..")))
    # web addresses and mail
    df = _step(df, rf"((?:https?://|www\.|\G(?!\A))[^\s<>{HARD}.?!]*+)[.?!](?=[^\s<>{HARD}])", "$1" + MASK, F.contains("_s", F.lit("://")) | F.contains("_s", F.lit("www.")))
    df = _step(df, rf"((?:(?<![{word}])(?=[{word}]*+@\S)|\G(?!\A))[\p{{L}}\p{{N}}_+@-]*+)\.(?=[{word}]*+@\S|[\p{{L}}\p{{N}}])", "$1" + MASK, _has("@"))
    # abbreviations that may end a sentence do so before a capital or another script
    df = _step(df, rf"\.{outer}(?={before_capital})", STOP)
    stays = [
        r"(?<=\p{N}.)(?=\p{N})",
        outer,
        rf"{inner}(?!\s*(?:$|{HARD}))",
        rf"(?<={letter}\.)(?=[\s\p{{L}}\p{{N}},;)])",
        rf"(?<={letter}[.{MASK}][ \u00a0]?\p{{L}}\.)(?=\s)",
        r"(?<=(?<![\p{L}\p{M}])(?:डॉ|प्रो|श्री|ดร|น|أ|م)\.)(?=\s)",
        rf"(?<=(?<!\p{{N}})\p{{N}}{{1,2}}\.)(?=\s+(?:{_MONTHS})(?!\p{{L}}))",
    ]
    df = _step(df, rf"\.(?:{'|'.join(stays)})|．(?<=\p{{N}}.)(?=\p{{N}})", MASK)
    # the same sentence goes on after an ellipsis and a small letter
    df = _step(df, rf"…(?=…*{_CLOSERS}*\s+{_SMALL})", MASK, _has("…"))
    # speech: what introduces or attributes it keeps it in one sentence
    df = _step(df, *speech(rf"[“「『«»„](?<=[:：,，、]\s{{0,3}}.)(?=[^{marks}{HARD}]*+[”“」』»«])", marks, stops + "。！？؟।", worded(marks)), _has("“「『«»„") & F.col("_s").rlike(r"[:：,，、]\s{0,3}[“「『«»„]"))
    df = _step(df, *speech(rf'"(?<=[:,]\s{{0,3}}.)(?=[^"{HARD}]*+")', '"', stops, worded('"')), _has('"'))
    for signs, closing in (("“”„", "”"), ("«»", "»"), ("„“”", "“")):
        df = _step(df, *attributed(signs, closing), _has(closing) & F.col("_s").rlike(rf"{closing},?\s+{_SMALL}"))
    df = _step(df, rf"[.!?…{STOP}](?=[.!?…]*{_CLOSERS}+,?\s+{_SMALL})", MASK)
    quoted = _has("。！？") & _has("”」』")
    df = _step(df, r"[。！？](?=[。！？]*[”」』]+(?:と|って))", MASK, quoted)
    return _step(df, r"[。！？](?=[。！？]*[”」』]+[^。！？，、\s]*?[说説问問道答写称喊]道?[。，：、])", MASK, quoted)


def _cut(df: DataFrame) -> DataFrame:
    ends = [
        rf"[.!?…؟۔।॥{STOP}]+{_CLOSERS}*{_END}",
        # a lost space between two sentences
        r"(?<=[\p{Ll}\p{N}])[.!?]+(?=\p{Lu}\p{Ll})",
        rf"[.!?।؟{STOP}]+(?=[{_CJK}{_THAI}])",
    ]
    df = _step(df, rf"(?=[.!?…؟۔।॥{STOP}])(?:{'|'.join(ends)})", "$0" + CUT)
    df = _step(df, r"[。！？｡…]*[。！？｡][”’」』）】》〉\"\)\]]*", "$0" + CUT, _has("。！？｡"))
    # in Thai a space ends a sentence unless it touches a digit or a Latin letter; its letters begin with these bytes
    thai = reduce(or_, (F.contains(F.col("_s").cast("binary"), F.lit(bytearray(b))) for b in (b"\xe0\xb8", b"\xe0\xb9")))
    df = _step(df, rf"(?<=[{_THAI}][\"”’)\]」!?…]{{0,3}})\s+(?=[\"“‘(\[「]{{0,3}}[{_THAI}])", "$0" + CUT, thai)
    return df.withColumn("_s", F.replace("_s", F.lit(HARD), F.lit(HARD + CUT)))


#: What may stand around a sentence without belonging to it: white space of all kinds, and the signs for what was cleared.
_AROUND = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff" + BLANK + HARD
_CHUNK = 256


def _sums_before(lengths: Column) -> Column:
    """For each number the sum of those before it, in chunks, so that the work stays in proportion to the length."""

    def plain(ns: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(ns, start, lambda s, n: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + n).alias("sum")))["out"]

    def chunked(ns: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, n: s + n)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / _CHUNK).cast("int")), lambda i: F.slice(ns, i * _CHUNK + 1, _CHUNK))
        return let(parts, lambda p: F.flatten(F.zip_with(p, plain(F.transform(p, total)), lambda c, b: F.transform(plain(c), lambda x: x + b))))

    return let(lengths, lambda ns: F.when(F.size(ns) <= _CHUNK, plain(ns)).otherwise(chunked(ns)))


def sentences(df: DataFrame, id_col: str = "request_id", text: str = "text") -> DataFrame:
    """Rows (``id_col``, pos, start, end, sentence): every sentence with its place in code points, ``end`` excluded.

    Null and blank texts, and texts of code and tables only, give no rows; a text of any length is read whole. Rows
    repeated whole come out as often as they occur. Extra columns are not read, whatever their names. Texts that hold the
    five private-use signs used here have them taken for blanks. Texts are worked on where they are; nothing is shuffled."""
    rows = df.select(F.col(id_col), F.col(text).alias("_text")).where("_text is not null")
    lines = rows.withColumn("_s", _lines(F.translate(F.col("_text"), BLANK + HARD + CUT + MASK + STOP, "     ")))
    parts = _cut(_masked(lines)).withColumn("_pieces", F.split("_s", CUT))
    placed = parts.withColumn("_before", _sums_before(F.transform("_pieces", lambda p: F.length(p).cast("bigint"))))
    pieces = placed.select(id_col, "_text", F.posexplode(F.arrays_zip("_pieces", "_before")).alias("pos", "_p")).select(id_col, "_text", "pos", F.col("_p._pieces").alias("_piece"), F.col("_p._before").alias("_before"))
    begun = pieces.where(F.col("_piece").rlike(r"[\p{L}\p{N}]")).withColumn("_left", F.ltrim("_piece", F.lit(_AROUND)))
    start = F.col("_before") + F.length("_piece") - F.length("_left")
    found = begun.withColumn("start", start.cast("bigint")).withColumn("end", (F.col("start") + F.length(F.rtrim("_left", F.lit(_AROUND)))).cast("bigint"))
    return found.select(id_col, "pos", "start", "end", F.expr("substring(_text, cast(start + 1 as int), cast(end - start as int))").alias("sentence"))
