"""Personal information inside free text: weak supervision.

Broad patterns propose spans of five kinds. Three labelers vote on each span, yes, no or nothing: a *format* labeler (strict
patterns), a *context* labeler (labels and titles beside the span) and a *gazetteer* labeler, which has no list of its own:
which words make up mentions is counted over the whole corpus from the spans whose context speaks. Expectation-maximisation
over the vote patterns estimates how reliable each labeler is for each kind; a prior on that, worth a few dozen spans,
decides in a small corpus and fades in a large one. A logistic span classifier over votes and shapes is then fitted to the
result and decides. What the driver holds is one row per kind, votes and shape, however large the corpus is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.session import materialize, scalar

KINDS = ("email", "phone", "id_number", "address", "person")

_UP, _LO = "A-ZÀ-ÖØ-ÞĀĄĆĈĊČĎĐĒĘĚĜĞĠĢĤĦĨĪĮİĴĶĹĻĽĿŁŃŅŇŌŐŒŔŖŘŚŜŞŠŢŤŦŨŪŮŰŲŴŶŸŹŻŽ", "a-zß-öø-ÿāąćĉċčďđēęěĝğġģĥħĩīįıĵķĺļľŀłńņňōőœŕŗřśŝşšţťŧũūůűųŵŷźżž"
_SP = "[  ]"
_CAP = f"[{_UP}][{_LO}]+"
_LAST = f"(?:[{_UP}][{_LO}]+|[{_UP}]{{2,}})"
_LASTS = f"(?:(?:van der|van den|van|von|de la|de|del|di|da)\\ )?{_LAST}(?:-{_LAST})?"
#: Words written with a capital that are no part of a name: titles, labels, and words a sentence begins with.
_NOT_NAMES = (
    "Mr Mrs Ms Miss Dr Prof Frau Herr Mme Mlle Monsieur Madame Sr Sra Srta Don Doña "
    "Contact Owner Mail Email Tel Tél Phone Fax User Name Author Ansprechpartner Responsable Responsible DNI SSN Passport Apt Unit Flat Suite Calle Avenida Plaza Camino "
    "Regards Signed Best Dear Hello Hi Thanks Sincerely Bitte Rückfragen Versand Call Ask See Note Notes Write Reach Meet Ship Post Escriba Escribir Envíe Enviar Livrer Écrire Véase Vgl "
    "The A An Every Each Das Die Der Den Dem Ein Eine Le La Les Un Une El Los Las Una We My Our This That These Those There When Where Why How Who What Which "
    "And Or But In On At By From To For Of With Please If No According Selon Según Laut Si Por Pourquoi Warum National"
)
_LEAD = "(?!(?:" + "|".join(_NOT_NAMES.split()) + r")\b)"
_EDGE = f"(?<![{_UP}{_LO}0-9_@./-])"
_INI = f"[{_UP}]\\."
NAME = re.compile(
    f"{_EDGE}(?:"
    f"(?P<inv>{_LEAD}{_LASTS},{_SP}{_CAP}(?:{_SP}{_INI})*)"
    f"|(?P<ini>{_INI}(?:{_SP}?{_INI})*{_SP}{_LEAD}{_LASTS})"
    f"|(?P<mid>{_LEAD}{_CAP}(?:{_SP}{_INI})+{_SP}{_LASTS})"
    f"|(?P<full>{_LEAD}{_CAP}{_SP}{_LEAD}{_LASTS})"
    f")(?![{_UP}{_LO}0-9_@])"
)
#: Where a name may start, cheaply: a word that a capitalised one follows.
_START = re.compile(f"[{_UP}vd](?=\\S{{0,60}}{_SP}(?:(?:van|von|der|den|de|del|la|di|da) )*[{_UP}])")
_AT, _DOT = r"(?:\s?[\(\[\{]\s?at\s?[\)\]\}]\s?|\s?[@＠]\s?)", r"(?:\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\.)"
_LOCAL, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*", r"[A-Za-z0-9][A-Za-z0-9-]*"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*| at {_LABEL}(?: dot {_LABEL})+)", re.I)
_D = "0-9０-９"
NUMBER = re.compile(rf"(?<![\w@./#-])[A-Z]{{1,2}}\d{{6,9}}(?![A-Za-z0-9])|(?<![\w@./#-])(?:QQ|[A-CEGHJ-PR-TW-Z]{{2}}) ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D](?![A-Za-z0-9])|(?<![{_D}A-Za-z@.#_+/-])[+＋(（]?[{_D}](?:[ ]?[-−－.()（）/ 　]?[ ]?[{_D}])(?:[ ]?[-−－.()（）/ 　]?[(（]?[{_D}][)）]?){{3,16}}(?:-?[A-Z](?![A-Za-z]))?(?:,?\s?(?:ext\.?|x|Durchw\.|poste)\s?\d{{1,5}})?(?![{_D}])")
#: Names in Cyrillic (given, patronymic and family name, or initials), and Chinese, Japanese or Korean ones where a label or an honorific says so.
_CAP_RU = r"[А-ЯЁІЇЄ][а-яёіїє]+"
_NAME_RU = rf"(?<![\w-])(?:{_CAP_RU}(?:-{_CAP_RU})?,?{_SP}(?:{_CAP_RU}{_SP})?{_CAP_RU}(?:-{_CAP_RU})?|[А-ЯЁ]\.{_SP}?(?:[А-ЯЁ]\.{_SP}?)?{_CAP_RU}|{_CAP_RU}{_SP}[А-ЯЁ]\.{_SP}?(?:[А-ЯЁ]\.)?)(?!\w)"
_HAN = r"\u4e00-\u9fff"
_NAME_HAN = rf"(?<=姓名[:：])[{_HAN}]{{2,4}}(?![{_HAN}])|(?<=联系人[:：])[{_HAN}]{{2,4}}(?![{_HAN}])|(?<=聯絡人[:：])[{_HAN}]{{2,4}}(?![{_HAN}])|(?<=氏名[:：])[{_HAN}]{{2,5}}(?![{_HAN}])|(?<=担当者[:：])[{_HAN}]{{2,5}}(?![{_HAN}])|(?<![{_HAN}])[{_HAN}]{{2,4}}(?=先生|女士|さん|様)|(?<=성명[:：]\ )[가-힣]{{2,4}}(?![가-힣])"
NAME_OTHER = re.compile(f"(?P<ru>{_NAME_RU})|(?P<han>{_NAME_HAN})")
#: Street and number in Cyrillic; Chinese and Japanese addresses end in a house number.
_STREET_RU = r"(?:ул(?:ица|ице|\.)|просп(?:ект|екте|\.)|пр-т|пер(?:еулок|\.)|ш(?:оссе|\.)|наб(?:ережная|\.)|бульвар|б-р)"
ADDRESS_OTHER = re.compile(
    rf"(?P<ru>(?<!\w){_STREET_RU}{_SP}?[А-ЯЁ][\w-]+(?:{_SP}[А-ЯЁ][\w-]+)?,?{_SP}?(?:д(?:ом|\.)?{_SP}?)?\d+[а-я]?(?:/\d+)?(?:,{_SP}?(?:кв(?:артира|\.)?|корп(?:ус|\.)?){_SP}?\d+)*(?:,{_SP}(?:\d{{6}}{_SP})?{_CAP_RU})?)"
    rf"|(?P<han>(?:[{_HAN}]{{2,8}}[省市区區县縣])*[{_HAN}]{{1,8}}(?:路|街|大道|巷)\d+号?(?:弄\d+号)?(?:\d+(?:室|楼|层))*(?<=[号室楼层]))"
    rf"|(?P<ja>(?:[{_HAN}]{{2,3}}[都道府県])?(?:[{_HAN}]{{1,5}}[市区町村])+[{_HAN}ぁ-んァ-ヶ]{{1,8}}?\d+(?:丁目\d+番(?:地)?(?:\d+号)?|[-－]\d+[-－]\d+|番地(?:\d+)?))"
)
_TYPES = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Close|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Crescent|Row|Walk|Hill|Park|Parkway|Highway"
_TOWN = f"[{_UP}][{_UP}{_LO}'-]+(?:{_SP}(?:[{_UP}][{_LO}'-]+))?"
_TAIL = rf"(?:,{_SP}(?:(?:Apt|Unit|Suite|Ste|Flat|Room|No|#)\.?{_SP}?\w+))?(?:,{_SP}(?:\d{{4,5}}{_SP})?{_TOWN}(?:,{_SP}[A-Z]{{2}}{_SP}\d{{5}})?)?"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:"
    rf"(?P<en>(?:(?:Flat|Apt|Unit|Suite)\.?{_SP}\w+,{_SP})?\d{{1,5}}[A-Za-z]?{_SP}(?:[NSEW]\.?{_SP})?(?:[{_UP}][\w'-]+{_SP}){{1,3}}(?:{_TYPES}|(?i:{_TYPES}))\b\.?(?:(?<!\.)|(?<=\.))){_TAIL}"
    rf"|(?P<fr>\d{{1,4}}(?:{_SP}(?:bis|ter))?,?{_SP}(?i:rue|avenue|impasse|allée|chemin|place|boulevard|quai|cours|passage|square|route){_SP}(?:(?:de la|de l'|des|du|de|d'){_SP}?)?[{_UP}][\w'-]+(?:{_SP}[{_UP}][\w'-]+)?)(?:,{_SP}\d{{5}}{_SP}{_TOWN}|,{_SP}{_TOWN})?"
    rf"|(?P<de>(?:(?:Am|An der|Auf der|Im|In der|Zum|Zur){_SP})?[{_UP}][\w-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|markt){_SP}\d{{1,4}}{_SP}?[a-z]?(?![\w]))(?:,{_SP}(?:\d{{5}}{_SP})?{_TOWN})?"
    rf"|(?P<es>(?:Calle|Avenida|Avda\.?|Plaza|Camino|Paseo|Ronda|C/){_SP}?(?:(?:de la|de los|del|de){_SP})?[{_UP}][\w'-]+(?:{_SP}[{_UP}][\w'-]+)?,?{_SP}(?:n\.º{_SP})?\d{{1,4}})(?:,{_SP}\d{{1,2}}\.º(?:{_SP}[A-Z](?!\w))?)?(?:,{_SP}(?:\d{{5}}{_SP})?{_TOWN})?"
    rf")"
)

# What the context labeler reads: labels and titles in several languages, directly before the span.
_NO_NUMBER = r"(?:range|part no\.?|ticket|build|version|isbn|issn|order(?: no\.?)?|invoice|sku|port|page|step|serial(?: no\.?)?|model|issue)\W*$"
_PHONE_WORDS = r"phone|call|tel|tél|telefon|telephone|mobile|cell|fax|number is|reach\b.{0,20}\bon|unter|appeler le|llame al|llamar al|電話番号|電話|电话|手机|الهاتف|هاتف|फ़ोन|फोन|โทร|さん、|тел(?:ефон)?\.?|전화"
_YES_PHONE = rf"(?:{_PHONE_WORDS})\W*$"
_YES_ID = (
    r"(?:\bid|ssn|insurance no\.?|insurance number|tax(?:payer)? id|passport(?: no\.?)?|reisepass(?:nummer)?|pasaporte|passeport|паспорт|инн|снилс|护照(?:号码?)?|身份证(?:号码?)?|パスポート(?:番号)?|マイナンバー"
    r"|steuer-id|steuernummer|dni|nie|nif|nir|sécurité sociale|nummer|social security(?: number)?)(?:\s(?:on file|is|no\.?|number|nr\.?))*\W*$"
)
_YES_MAIL = r"(?:\bat|mail|e-mail|email|contact|write to|an|à|a|mailto|from|owner|邮箱是|邮箱|联系|連絡先は|メール|على|ที่|से|почта|[<(|,:：])\W*$"
_YES_ADDR = r"(?:lives at|lived at|living at|went to|post .{0,40}\bto|ship .{0,40}\bto|deliver .{0,40}\bto|address is|address|wohnt in(?: der)?|versand an|habite(?: au)?|livrer au|vive en|enviar a|reside at|住所は?|地址是?|адрес|живёт на|живет на|проживает на)\W*$"
_YES_WHO = r"(?:contact|owner|according to|selon|según|laut|met|prof\.?|dr\.?|mr\.?|mrs\.?|ms\.?|mme|mlle|frau|herr|sra?\.|demander|preguntar por|bitte|ansprechpartner|responsable ?|responsible|负责人|担当は|راسل|ติดต่อ|г-н|г-жа|гражданин|имя|фио|regards|user|name|signed by|by|sincerely|thanks)[\s:：=,*_|\[“\"]*$"
_RIGHT_WHO = r"^[*_\]”\"]*(?:\s?\(mailto:|\]\(mailto|\s?[<(][^<>()]{3,60}(?:@|at\b)|\s(?:lives|lived|wohnt|habite|vive|живёт|живет|at \S+@|at \S+ ?[\(\[]at|unter|的邮箱|さん|先生|女士|様)|\s\|\s\S+(?:@|\s?[\(\[]at)|; ?tel=)"
# A street, a version or a number behind it, or an article before it, speak against a name.
_LEFT_NOT_WHO = r"(?<!\w)(?:the|der|das|die|on|in|for|of the|version|v)\s$"
_RIGHT_NOT_WHO = rf"^\s(?:(?:{_TYPES})\b|\d)"
_L = {k: (re.compile(y, re.I), re.compile(n, re.I)) for k, y, n in (
    ("email", _YES_MAIL, r"(?!)"),
    ("phone", _YES_PHONE, _NO_NUMBER + "|" + _YES_ID),
    ("id_number", _YES_ID, _NO_NUMBER + "|" + _YES_PHONE),
    ("address", _YES_ADDR, r"(?:cluster|build|version)\W*$"),
)}
_R_PHONE, _R_ID = re.compile(r"^\s*(?:anrufen|まで|, (?:demander|preguntar por|ask for))", re.I), re.compile(r"^\s*gehört", re.I)
_L_WHO, _R_WHO, _L_NOT, _R_NOT = re.compile(_YES_WHO, re.I), re.compile(_RIGHT_WHO), re.compile(_LEFT_NOT_WHO), re.compile(_RIGHT_NOT_WHO)
#: Characters before a span that its context is read from.
_CONTEXT = 64
_TO_ASCII = str.maketrans("０１２３４５６７８９－−＋（）．　", "0123456789--+(). ")

#: Strict formats: (name, pattern on the ASCII form of the number).
_PHONES = tuple((n, re.compile(p)) for n, p in (
    ("intl", r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}"), ("nanp", r"(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}"),
    ("uk", r"0\d{4} ?\d{6}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{3} ?\d{7}"), ("fr", r"0\d(?:[ .]\d{2}){4}"), ("de", r"0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{1,4})?"),
))
_IDS = tuple((n, re.compile(p)) for n, p in (
    ("nino", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"), ("ssn", r"\d{3}([- ])\d{2}\1\d{4}"), ("tin", r"\d{2} \d{3} \d{3} \d{3}|\d{11}"),
    ("passport", r"[A-Z]{1,2}\d{6,9}|\d{2} ?\d{2} \d{6}|\d{17}[\dX]"), ("dni", r"\d{8}-?[A-Z]|\d{1,2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"), ("nir", r"\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{15}"),
))


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes and not no else -1 if no and not yes else 0


def _left(text: str, at: int) -> str:
    return text[max(0, at - _CONTEXT) : at]


#: What any written address has: a sign for at, as such, between blanks or in brackets.
_HAS_AT = re.compile(r"[@＠]|\bat[\s)\]}]", re.I)
_CUT_AT = re.compile(r"@|＠|[\(\[\{]\s?at\s?[\)\]\}]|\sat\s", re.I)
_CUT_DOT = re.compile(r"[\(\[\{]\s?dot\s?[\)\]\}]|\.|\sdot\s", re.I)


def _emails(t: str) -> Iterator[tuple]:
    if not _HAS_AT.search(t):
        return
    for m in EMAIL.finditer(t):
        s = m.group(0)
        labels = [x.strip() for x in _CUT_DOT.split(_CUT_AT.split(s, maxsplit=1)[1]) if x.strip()]
        good = len(labels) > 1 and re.fullmatch(r"[A-Za-z]{2,}", labels[-1])
        ctx = _vote(bool(_L["email"][0].search(_left(t, m.start()))), False)
        yield "email", m.start(), m.end(), 1 if good else -1, ctx, "hidden" if "@" not in s else "plain" if " @" not in s else "spaced", [".".join(labels[-2:]).lower()]


def _numbers(t: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    for m in NUMBER.finditer(t):
        a, b = m.span()
        if any(a < y and x < b for x, y in taken):
            continue
        s = m.group(0)
        base = re.sub(r",?\s?(?:ext\.?|x|Durchw\.|poste)\s?\d{1,5}$", "", s)
        plain = base.translate(_TO_ASCII)
        if not base[0].isalpha() and len(re.sub(r"\D", "", plain)) < 7:
            continue
        left, right = _left(t, a), t[b : b + 24]
        for kind, formats, more in (("phone", _PHONES, _R_PHONE), ("id_number", _IDS, _R_ID)):
            if kind == "id_number" and base != s:
                continue
            name = next((n for n, p in formats if p.fullmatch(plain)), "")
            yes, no = _L[kind]
            ctx = _vote(bool(yes.search(left) or more.search(right)), bool(no.search(left)))
            if name == "passport" and ctx < 1:  # so loose a form counts only behind its label
                continue
            yield kind, a, b, 1 if name else -1, ctx, name or "other", [name + re.sub(r"\D", "", plain)[:2]]


def _addresses(t: str) -> Iterator[tuple]:
    for m in ADDRESS.finditer(t):
        left = _left(t, m.start())
        s = m.group(0)
        end = m.end()
        if s.endswith(".") and not re.search(r"(?:Ave|St|Rd|Blvd|Ln|Dr|Ct|Pl|Sq)\.$", s, re.I):
            end -= 1
        shape = next(k for k in ("en", "fr", "de", "es") if m.group(k))
        words = re.findall(rf"[{_UP}][{_UP}{_LO}'-]+", s)
        ctx = _vote(bool(_L["address"][0].search(left)), bool(_L["address"][1].search(left)))
        yield "address", m.start(), end, 1 if re.search(r"\d{4}", s) or m.group("fr") or m.group("es") or ctx > 0 else 0, ctx, shape, [w.lower() for w in words[:1] + words[-1:]]
    if _PLACES_OTHER.search(t):
        for m in ADDRESS_OTHER.finditer(t):
            ctx = _vote(bool(_L["address"][0].search(_left(t, m.start()))), False)
            yield "address", m.start(), m.end(), 1, ctx, m.lastgroup, [m.group(0)[:4]]


#: What any name or address in these scripts has, looked for before the patterns are.
_NAMES_OTHER = re.compile(r"[\u0410-\u042f]|姓名|联系人|聯絡人|氏名|担当者|先生|女士|さん|様|성명")
_PLACES_OTHER = re.compile(r"[\u0410-\u042f]|[路街道巷]\d|\d丁目|\d番地|\d[-－]\d+[-－]\d")


def _names(t: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    if _NAMES_OTHER.search(t):
        for m in NAME_OTHER.finditer(t):
            a, b = m.span()
            if not any(a < y and x < b for x, y in taken):
                ctx = 1 if m.lastgroup == "han" else _vote(bool(_L_WHO.search(t[max(0, a - 40) : a]) or _R_WHO.search(t[b : b + 48])), False)
                # a Cyrillic pair of capitals alone may be anything; a name pattern of Chinese characters has its label in it
                yield "person", a, b, 1 if m.lastgroup == "han" or "." in m.group(0) else 0, ctx, m.lastgroup, sorted({w.lower() for w in re.findall(r"\w{2,}", m.group(0))})
    at = 0
    for begin in _START.finditer(t):
        if begin.start() < at or not (m := NAME.match(t, begin.start())):
            continue
        a, b = m.span()
        if hit := next(((x, y) for x, y in taken if a < y and x < b), None):
            at = max(a + 1, hit[1])
            continue
        at = b
        shape = m.lastgroup
        left, right = t[max(0, a - 40) : a], t[b : b + 48]
        ctx = _vote(bool(_L_WHO.search(left)) or bool(_R_WHO.search(right)), bool(_L_NOT.search(left)) or bool(_R_NOT.search(right)))
        words = re.findall(rf"[{_UP}][{_UP}{_LO}]+", m.group(0))
        form = {"inv": 0, "ini": 0, "mid": 1, "full": 0}[shape] or (1 if re.search(rf"[{_UP}]{{3,}}|-| van ", m.group(0)) else 0)
        yield "person", a, b, form, ctx, shape, sorted({w.lower() for w in words})


def spans_of(text: str) -> list[tuple]:
    """Candidate spans of one text: (kind, start, end, format vote, context vote, shape, gazetteer terms)."""
    out = list(_emails(text))
    out += _addresses(text) if any(c.isdigit() for c in text) else []
    held = [(x[1], x[2]) for x in out]
    out += _numbers(text, held)
    return out + list(_names(text, held))


_SPANS = "doc_id bigint, row bigint, kind string, span_start bigint, span_end bigint, form int, ctx int, shape string, terms array<string>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SPANS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    for b in batches:
        rows = [(d, r, *s) for d, r, t in zip(*(c.to_pylist() for c in b.columns)) if t for s in spans_of(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)


#: What a labeler is taken to do before the corpus speaks: shares of no, nothing and yes for what is no mention and what is
#: one, as strong as so many spans.
_PRIOR = np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
PRIOR_SPANS = 30


def estimate(patterns: list[tuple], rounds: int = 60) -> dict[tuple, float]:
    """Probability of being a mention for each (kind, form, gaz, ctx, shape), from their counts.

    EM with one confusion table per kind and labeler, then per kind a logistic classifier on votes and shapes."""
    out: dict[tuple, float] = {}
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        if not own:
            continue
        votes, n = np.array([p[1:4] for p in own]) + 1, np.array([p[5] for p in own], float)
        y = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))  # start from the sum of votes
        for _ in range(rounds):
            table = np.array([[[(n * w * (votes[:, j] == v)).sum() for v in range(3)] for j in range(3)] for w in (1 - y, y)])
            table += PRIOR_SPANS * _PRIOR[:, None, :]
            table /= table.sum(axis=2, keepdims=True)
            prior = ((n * y).sum() + PRIOR_SPANS / 2) / (n.sum() + PRIOR_SPANS)
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, votes[:, j]] / table[0, j, votes[:, j]]) for j in range(3))
            y = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        shapes = sorted({p[4] for p in own})
        x = np.zeros((len(own), 1 + 9 + len(shapes)))
        x[:, 0] = 1
        for j in range(3):
            x[np.arange(len(own)), 1 + 3 * j + votes[:, j]] = 1
        x[np.arange(len(own)), 10 + np.array([shapes.index(p[4]) for p in own])] = 1
        w, weight = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(40):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-x @ w))
            g = x.T @ (weight * (p - y)) + 1e-3 * w
            h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(h, g)
        p = 1 / (1 + np.exp(-x @ w))
        out |= {k[:5]: float(v) for k, v in zip(own, p)}
    return out


def in_list(kind: Column, n: Column, yes: Column, no: Column) -> Column:
    """The gazetteer's vote for a word seen in ``n`` spans of a kind, of which contexts affirm ``yes`` and deny ``no``.

    Words of names are many and come back, so one that no context affirms is none; a host, a street or a prefix without a
    word beside it says nothing."""
    never = F.when(kind == "person", (n >= 4) & (yes < 0.1 * n)).otherwise((no >= 2) & (no > yes))
    return F.when((yes >= 2) & (yes >= 0.3 * n), 1).when(never, -1).otherwise(0)


#: A word in more than one in so many of all is joined by broadcast; there can be no more of them than this.
HOT_SHARE = 10_000


def _numbered(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")


def _mentions(rows: DataFrame, threshold: float) -> DataFrame:
    spark = rows.sparkSession
    spans = materialize(rows.where("text is not null and text <> ''").mapInArrow(_propose, _SPANS), "spans")
    terms = spans.select("doc_id", "row", "kind", "span_start", "ctx", F.explode("terms").alias("term"))
    known = terms.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ctx") == 1).cast("int")).alias("yes"), F.sum((F.col("ctx") == -1).cast("int")).alias("no"))
    known = materialize(known.withColumn("in_list", in_list(F.col("kind"), F.col("n"), F.col("yes"), F.col("no"))), "gazetteer")
    share = scalar(known.select(F.sum("n") / HOT_SHARE))
    hot = known.where(F.col("n") > share).select("kind", "term", F.col("in_list").alias("hot"))
    rest = terms.join(F.broadcast(hot), ["kind", "term"], "left")
    cold = rest.where("hot is null").drop("hot").join(known.where("in_list <> 0").select("kind", "term", "in_list"), ["kind", "term"])
    both = cold.select("row", "kind", "span_start", "in_list").unionByName(rest.where("hot is not null").select("row", "kind", "span_start", F.col("hot").alias("in_list")))
    # no word of the span in the list either way: nothing; any that is: yes before no
    voted = both.groupBy("row", "kind", "span_start").agg(F.max("in_list").alias("gaz"), F.count(F.lit(1)).alias("listed"))
    sized = spans.withColumn("size", F.size("terms")).drop("terms").join(voted, ["row", "kind", "span_start"], "left")
    gaz = F.when(F.col("gaz") == 1, 1).when((F.col("gaz") == -1) & (F.col("listed") == F.col("size")), -1).otherwise(0)
    full = materialize(sized.withColumn("gaz", gaz).drop("size", "listed"), "voted")
    key = ["kind", "form", "gaz", "ctx", "shape"]
    counted = [(r["kind"], r["form"], r["gaz"], r["ctx"], r["shape"], r["count"]) for r in full.groupBy(*key).count().collect()]  # some hundred rows at most
    p = estimate(counted)
    table = spark.createDataFrame([(*k, v) for k, v in p.items()], "kind string, form int, gaz int, ctx int, shape string, p double")
    scored = full.join(F.broadcast(table), key).where(F.col("p") >= threshold)
    best = scored.groupBy("doc_id", "row", "span_start", "span_end").agg(F.max_by("kind", "p").alias("kind"))
    return best.select("doc_id", "row", "kind", "span_start", "span_end")


def mentions(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, row, kind, span_start, span_end): every mention, as code point offsets. ``row`` tells repeated ids apart.

    Null and empty texts have none; texts of any length are read whole. Repeated rows give their mentions each. Where two
    kinds claim the same place the likelier one stays. Extra columns are not read; an empty table gives no rows."""
    return _mentions(_numbered(documents), threshold)


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if t and spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: s["span_start"]):
                    if s["span_start"] >= at:
                        parts += [t[at : s["span_start"]], f"[{s['kind'].upper()}]"]
                        at = s["span_end"]
                t = "".join(parts) + t[at:]
            out.append(t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def redact(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, text) with a typed placeholder, such as [EMAIL], in place of each mention. Null texts stay null."""
    # the numbers of the rows are read twice, so they are written down once
    rows = materialize(_numbered(documents), "numbered")
    found = _mentions(rows, threshold).groupBy("row").agg(F.collect_list(F.struct("kind", "span_start", "span_end")).alias("spans"))
    return rows.join(found, "row", "left").select("doc_id", "text", "spans").mapInArrow(_replace, "doc_id bigint, text string")
