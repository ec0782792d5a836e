"""Packing round trips, leakage against brute force, personal information on planted mentions."""

import random
import re

import pytest

from tenetry.llm import leakage, packing, pii

DOC = "doc_id long, text string, rank int, row string, salt string, w string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], DOC)


def test_plan_uses_everything_and_fits():
    rng = random.Random(4)
    for capacity in (1, 7, 64, 512):
        counts = {x: rng.randint(0, 40) for x in range(1, capacity + 1)}
        left = {k: v for k, v in counts.items() if v}
        bins = 0
        for filling, times in packing.plan(counts, capacity):
            assert sum(filling) <= capacity and times > 0
            bins += times
            for x in filling:
                left[x] -= times
        assert not any(left.values())
        total = sum(k * v for k, v in counts.items())
        assert bins <= -(-total // capacity) * 1.06 + 1


def test_pack_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, "token " * rng.choice([3, 3, 3, rng.randint(0, 150)])) for i in range(400)] + [(1000, None), (1001, ""), (7, "token " * 500), (7, "token " * 500)]
    capacity = 100
    got = packing.pack(docs(spark, rows), capacity).collect()
    lengths = {(r["doc_id"], r["n_tokens"]) for r in packing.token_lengths(docs(spark, rows)).collect()}
    room: dict[int, list] = {}
    for r in got:
        size = r["token_end"] - r["token_start"]
        if size:
            room.setdefault(r["container"], []).append((r["position"], r["position"] + size))
    for spans in room.values():
        spans.sort()
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    whole: dict[int, int] = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["token_end"] - r["token_start"]
    for d, n in lengths:
        times = sum(1 for x in rows if x[0] == d) if d == 7 else 1
        assert whole[d] == n * times or d == 7
        assert n > capacity or sum(1 for r in got if r["doc_id"] == d) == times or d == 7
    used = sum(n for _, n in lengths if n)
    assert len(room) <= sum(whole.values()) / capacity * 1.05 + 1 and used
    assert sorted(room) == list(range(len(room)))
    assert packing.pack(docs(spark, []), capacity).count() == 0


def brute_leaks(rows, items, run):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for i, t in items:
        for k in range(len(w(t)) - run + 1):
            grams.setdefault(tuple(w(t)[k : k + run]), set()).add(i)
    return {(d, i) for d, t in rows for k in range(len(w(t)) - run + 1) for i in grams.get(tuple(w(t)[k : k + run]), ())}


@pytest.mark.parametrize("run, windows", [(2, 10**6), (4, 10**6), (12, 10**6), (4, 10)])
def test_leaks(spark, run, windows):
    rng = random.Random(run)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(25)] + [(90, None), (91, "")]
    rows = [(i, text(rng.randint(0, 60)).replace(" ", rng.choice([" ", ", ", " — "]))) for i in range(80)] + [(99, None), (100, ""), (5, "a b c d")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leakage.leaks(docs(spark, rows), df, run, windows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(rows, items, run)
    assert leakage.leaks(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


FIRST, LAST = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Fina"], ["Quist", "Morgan", "Thorne", "Valdez", "Wexler", "Łodz"]


def planted(rng):
    name = f"{rng.choice(FIRST)} {rng.choice(['', 'K. '])}{rng.choice(LAST)}"
    mail = f"{rng.choice(FIRST).lower()}.{rng.randint(1, 99)}@{rng.choice(['mail', 'post'])}.example"
    phone = rng.choice([f"+1 305 555 01{rng.randint(10, 99)}", f"(702) 555-01{rng.randint(10, 99)}", f"01632 960{rng.randint(100, 999)}"])
    ssn = f"9{rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    road = f"{rng.randint(1, 400)} {rng.choice(LAST[1:5])} {rng.choice(['Lane', 'Road', 'Street'])}, Melvane"
    form, spans = rng.choice(
        [
            ("Contact {0} at {1} before noon. ", [("person", name), ("email", mail)]),
            ("My number is {0} and my taxpayer id is {1}. ", [("phone", phone), ("id_number", ssn)]),
            ("{0} lives at {1}. ", [("person", name), ("address", road)]),
            ("Mail {0} or call {1}. ", [("email", mail), ("phone", phone)]),
            ("The badge of {0} lists ID {1}. ", [("person", name), ("id_number", ssn)]),
            ("Range {0}-12-14926 is reserved for tests. Part no. 185.265.96 fits. ".format(rng.randint(100, 999)), []),
            ("The Kernel Gateway cluster on Tarrow Lane is idle. git@host refused the push. ", []),
        ]
    )
    return form, spans


def test_mentions(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for d in range(300):
        t = "😀 "
        for _ in range(rng.randint(1, 4)):
            t += "Every broad journal imports 42.5 detectors. "
            form, spans = planted(rng)
            filled = form.format(*(s for _, s in spans))
            at = len(t)
            for kind, s in spans:
                a = filled.index(s)
                want.add((d, kind, at + a, at + a + len(s)))
            t += filled
        rows.append((d, t))
    rows += [(900, None), (901, "")]
    got = {(r["doc_id"], r["kind"], r["span_start"], r["span_end"]) for r in pii.mentions(docs(spark, rows)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows)).collect()}
    assert clean[900] is None and clean[901] == "" and len(clean) == 302
    assert "[EMAIL]" in " ".join(filter(None, clean.values())) and "Every broad journal" in clean[0]
    assert pii.mentions(docs(spark, [])).count() == 0


def test_forms():
    def found(t):
        return {(s[0], t[s[1] : s[2]]) for s in pii.spans_of(t) if s[3] >= 0}

    assert ("email", "a.b(at)mail(dot)c(dot)example") in found("Owner: <a.b(at)mail(dot)c(dot)example> x")
    assert ("phone", "1-305-555-0121 ext. 409") in found("call 1-305-555-0121 ext. 409.")
    assert ("phone", "２１２－５５５－０１７５") in found("電話番号：２１２－５５５－０１７５ x")
    assert ("id_number", "QQ 61 37 04 B") in found("SSN on file: QQ 61 37 04 B.")
    assert ("address", "Flat 9, 262 Fernhow Road, Dunmarrow") in found("lives at Flat 9, 262 Fernhow Road, Dunmarrow.")
    assert ("address", "246 W. Hollin Ave.") in found("went to 246 W. Hollin Ave. and asked")
    assert ("person", "Brenkwick, Perldan") in found("The badge of Brenkwick, Perldan lists ID")
    assert ("person", "Josbet van der Massquist") in found("asked for Josbet van der Massquist.")


def test_plain_addresses_need_no_context(spark):
    """What the words beside it are does not decide whether a valid address is one, in whatever mix of texts."""
    texts = ["Contact Anna Quist at anna.q@mail.example"] * 40 + ["She emailed ops3@bank.example about it."] * 20 + ["Reply: x.y@a-b.co.example!"] + ["me (AT) host (DOT) example", "we [AT] hub [DOT] example", "i AT hub DOT example now", "u{at}hub.example"]
    rows = list(enumerate(texts))
    found = {(r["doc_id"], texts[r["doc_id"]][r["span_start"] : r["span_end"]]) for r in pii.mentions(docs(spark, rows)).where("kind = 'email'").collect()}
    want = {(i, "anna.q@mail.example") for i in range(40)} | {(i, "ops3@bank.example") for i in range(40, 60)}
    want |= {(60, "x.y@a-b.co.example"), (61, texts[61]), (62, texts[62]), (63, "i AT hub DOT example"), (64, texts[64])}
    assert found == want
    alone = pii.mentions(docs(spark, [(1, "She emailed ops3@bank.example about it, not git@host or a@2.1.")])).collect()
    assert [r["kind"] for r in alone] == ["email"]


#: Sentences of one mention each; {} is the mention. The second half is never seen beside the first.
SEEN = {
    "person": ["Dr. {} opened the meeting.", "According to {} it rained.", "Please contact {} today.", "Signed by {}, in haste."],
    "email": ["Mail {} for help.", "Her e-mail: {} (work)."],
    "phone": ["Call {} after nine.", "Telephone: {} or come by."],
    "id_number": ["Her passport no. {} was read out.", "SSN: {} as filed."],
    "address": ["He lives at {} now.", "Our address is {} again."],
}
HELD_OUT = {
    "person": ["Yesterday {} won the race.", "A letter from Mrs. {} came."],
    "email": ["They answered from {} at once.", "You may try {} instead."],
    "phone": ["My number is {} at home.", "Fax {} is broken."],
    "id_number": ["The social security number {} is hers.", "Give your tax id {} there."],
    "address": ["We moved to {} in May.", "Ship it to {} please."],
}


def test_held_out_templates(spark):
    rng = random.Random(3)
    given, family = "Alda Boris Carla Dmitro Edda Fausto Greta Hanno Irma Jory".split(), "Ashdown Bellmont Corvino Dunstan Eckhart Farrow Gallard Hollis Ivers Jansen".split()
    value = {
        "person": lambda: f"{rng.choice(given)} {rng.choice(family)}",
        "email": lambda: f"{rng.choice(given).lower()}{rng.randrange(99)}@{rng.choice(family).lower()}.example",
        "phone": lambda: f"({rng.randint(201, 989)}) 555-{rng.randint(1000, 9999)}",
        "id_number": lambda: f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "address": lambda: f"{rng.randint(1, 999)} {rng.choice(family)} {rng.choice(['Street', 'Lane', 'Avenue'])}",
    }
    plain = ["The Harbour Council met in Upper Town.", "Version 12.4.118 took 9 minutes.", "Order no. 5530-221-9 has shipped.", "Every Monday the Old Mill opens.", "It holds 4400 tonnes of grain."]
    rows, want = [], set()
    for d in range(600):
        templates, kind = (SEEN if d < 300 else HELD_OUT), rng.choice(list(SEEN))
        before, after = rng.choice(templates[kind]).split("{}")
        v, lead = value[kind](), rng.choice(plain) + " "
        rows.append((d, lead + before + v + after + " " + rng.choice(plain)))
        want.add((d, kind, len(lead + before), len(lead + before) + len(v)))
    got = {(r["doc_id"], r["kind"], r["span_start"], r["span_end"]) for r in pii.mentions(docs(spark, rows)).collect()}
    new, found = {w for w in want if w[0] >= 300}, {g for g in got if g[0] >= 300}
    assert len(new & found) >= 0.9 * len(new) and len(new & found) >= 0.9 * len(found)


def test_other_scripts(spark):
    cases = [
        ("Паспорт 45 08 123456, тел. +7 495 123-45-67.", [("id_number", "45 08 123456"), ("phone", "+7 495 123-45-67")]),
        ("Г-н Иван Петров проживает на ул. Садовая, д. 12, кв. 5.", [("person", "Иван Петров"), ("address", "ул. Садовая, д. 12, кв. 5")]),
        ("联系人：王小明，电话：+86 10 8123 4567，护照号码：E12345678，地址：北京市朝阳区建国路88号。", [("person", "王小明"), ("phone", "+86 10 8123 4567"), ("id_number", "E12345678"), ("address", "北京市朝阳区建国路88号")]),
        ("氏名：山田太郎。住所は東京都千代田区丸の内1丁目2番3号です。", [("person", "山田太郎"), ("address", "東京都千代田区丸の内1丁目2番3号")]),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    got = [set() for _ in cases]
    for r in pii.mentions(docs(spark, rows)).collect():
        got[r["doc_id"]].add((r["kind"], cases[r["doc_id"]][0][r["span_start"] : r["span_end"]]))
    assert got == [set(w) for _, w in cases]


def test_redaction_of_repeated_ids(spark):
    rows = [(7, "Mail a.b@mail.example now."), (7, "Nothing here."), (7, None), (8, "Mail a.b@mail.example now.")]
    shuffled = docs(spark, rows).repartition(3, "text").where("doc_id > 0")
    assert sorted((r["doc_id"], r["text"] or "") for r in pii.redact(shuffled).collect()) == [(7, ""), (7, "Mail [EMAIL] now."), (7, "Nothing here."), (8, "Mail [EMAIL] now.")]
