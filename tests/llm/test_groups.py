"""Copies, survivors, frequency, relevance and near-duplicates: edge cases and brute force."""

import datetime as dt
import itertools
import random
import re

import pytest

from tenetry.llm import copies, frequency, neardup, relevance, survivors

BELIEF = "id string, statement string, evidence array<struct<id:string,snippet:string>>, connections array<string>, source string, confidence double, scope string, updated_at timestamp_ntz, _h1 string, term string, group_id string, tf int"
T = dt.datetime(2025, 1, 1)


def row(i, s, evidence=None, labels=None, source=None, confidence=None, scope=None, day=0):
    """With extra columns whose names clash with those the operators use inside."""
    return (i, s, evidence, labels, source, confidence, scope, None if day is None else T + dt.timedelta(days=day), "x", "x", "x", 1)


def table(spark, rows):
    return spark.createDataFrame(rows, BELIEF)


def words(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


ODD = [
    row("a", "The  cat sat."),
    row("b", "the CAT — sat!"),
    row("b", "the CAT — sat!"),
    row("c", "The sat cat"),
    row("d", None),
    row("e", ""),
    row("f", "..."),
    row("g", "subject: x y; relation = z | object: 3"),
    row("h", "OBJECT=3\nSUBJECT: x, y\nRelation: z."),
    row("i", "subject: y x; relation: z; object: 3"),
    row("j", "subject: x y; relation: z"),
    row("k", "relation: z; subject: x y"),
    row("l", "word " * 20_000),
    row("m", "Word, " * 20_000),
    row("n", "İstanbul ÉCOLE"),
    row("o", "i̇stanbul école".replace("i̇", "İ")),
]


def test_copies(spark):
    got = {}
    for r in copies.collapse(table(spark, ODD)).collect():
        got.setdefault((r["group_id"], r["copies"]), []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items() if k[1] > 1} == {("a", 3): ["a", "b", "b"], ("g", 2): ["g", "h"], ("l", 2): ["l", "m"], ("n", 2): ["n", "o"]}
    assert sum(len(v) for v in got.values()) == len(ODD)


@pytest.mark.parametrize("bits", [1 << 14, 1 << 20])
def test_copies_do_not_depend_on_the_filter(spark, bits):
    rng = random.Random(1)
    rows = [row(f"{i:05d}", " ".join(rng.choice(["x", "y", "z", "w"]) for _ in range(rng.randint(1, 6)))) for i in range(3000)] + [row(f"hot{i}", "same text") for i in range(1500)]
    want = {}
    for r in rows:
        want.setdefault(tuple(words(r[1])), []).append(r[0])
    df = table(spark, rows).repartition(7)
    got = {(r["id"], r["group_id"], r["copies"]) for r in copies.collapse(df, max_bits=bits).collect()}
    assert got == {(i, min(v), len(v)) for v in want.values() for i in v}


def test_empty_tables(spark):
    none = table(spark, [])
    assert copies.collapse(none).count() == 0
    assert survivors.suppliers(none).count() == 0
    assert frequency.deltas(none).count() == 0 and frequency.deltas(none, none, none).count() == 0
    assert relevance.score_terms(none).count() == 0
    assert neardup.near_pairs(neardup.belief_texts(none)).count() == 0
    assert neardup.groups(neardup.belief_texts(none)).count() == 0


def test_survivors(spark):
    e = lambda n: [(str(k), "s") for k in range(n)]
    rows = [
        row("a", "Same claim", e(2), source=" WEB ", confidence=0.5, scope=" ", day=1),
        row("b", "same claim.", e(3), source=None, confidence=1.5, scope="s1", day=2),
        row("c", "SAME CLAIM", None, source="Book", confidence=None, scope=None, day=3),
        row("d", "same  claim", e(3), source="book", confidence=0.2, scope="s2", day=None),
        row("e", "other", e(1), day=1),
        row("f", "Tie", source="code", day=1),
        row("g", "tie", source="CODE", day=1),
    ]
    got = {(r["group_id"], r["field"]): r["id"] for r in survivors.suppliers(table(spark, rows)).collect()}
    assert got == {
        ("a", "updated_at"): "c", ("a", "source"): "c", ("a", "evidence"): "b", ("a", "confidence"): "a", ("a", "scope"): "b",
        ("f", "updated_at"): "f", ("f", "source"): "f", ("f", "evidence"): "f",
    }
    record = {r["group_id"]: r for r in survivors.survivors(table(spark, rows)).collect()}
    assert record["a"]["source"] == "Book" and record["a"]["confidence"] == 0.5 and record["a"]["scope"] == "s1" and len(record["a"]["evidence"]) == 3


def test_deeper_layers_supply(spark):
    """The first layer has no scope, the second no confidence; the third gives the confidence, and the fourth a later scope."""
    e = lambda n: [(str(k), "s") for k in range(n)]
    rows = [
        row("a", "Same claim", e(1), source="official_docs", confidence=0.9, day=20),  # 3 filled, most trusted, latest
        row("b", "same claim", e(1), source="research_paper", scope="s1", day=10),  # 3 filled: behind a
        row("c", "SAME claim", e(4), source="book", scope="s2", day=15),  # 3 filled: behind a, more evidence
        row("d", "same, claim", None, source="web", scope="s3", day=17),  # 2 filled: behind a
        row("e", "same claim!", None, source="web", confidence=0.1, day=16),  # behind d
    ]
    to = survivors.settled(table(spark, rows)).collect()[0]["to"]
    got = {f: (to[f]["rec"]["id"], to[f]["depth"]) for f in survivors.FIELDS}
    assert got == {"updated_at": ("a", 0), "source": ("a", 0), "evidence": ("c", 1), "confidence": ("a", 0), "scope": ("d", 1)}
    more = [row("f", "same claim", e(1), source="official_docs", scope=None, confidence=None, day=30)]
    more += [row("g", "same claim", None, source="official_docs", confidence=None, day=29), row("h", "same claim", None, source="web", scope="s4", confidence=None, day=28)]
    to = survivors.settled(table(spark, [r for r in rows if r[0] in "be"] + more)).collect()[0]["to"]
    assert {f: to[f]["rec"]["id"] for f in survivors.FIELDS} == {"updated_at": "f", "source": "f", "evidence": "f", "confidence": "e", "scope": "h"}
    assert to["scope"]["depth"] > 0 and to["confidence"]["depth"] > to["scope"]["depth"]


@pytest.mark.parametrize("seed", range(3))
def test_survivors_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        group = "hot" if rng.random() < 0.4 else f"claim {rng.randrange(60)}"
        ev = rng.choice([None, [(str(k), "s") for k in range(rng.randint(0, 12))]])
        src = rng.choice([None, " Web", "BOOK", "code", "official_docs", "rumour"])
        conf, scope = rng.choice([None, 0.0, 0.4, 1.0, 1.2, -1.0, float("nan")]), rng.choice([None, " ", "s"])
        rows.append(row(f"{i:03}", group, ev, source=src, confidence=conf, scope=scope, day=rng.choice([None, *range(6)])))
    rank = {n: i for i, n in enumerate(survivors.TRUST)}
    late = lambda r: (r[7] is None, -((r[7] - T).days) if r[7] else 0, r[0])
    policy = {
        "updated_at": (lambda r: r[7] is not None, lambda r: 0), "source": (lambda r: True, lambda r: rank.get((r[4] or "unknown").strip().lower(), 7)),
        "evidence": (lambda r: True, lambda r: -len(r[2] or [])), "confidence": (lambda r: r[5] is not None and 0 <= r[5] <= 1, lambda r: 0), "scope": (lambda r: (r[6] or "").strip() != "", lambda r: 0),
    }
    want, groups = set(), {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for members in groups.values():
        for f, (fits, merit) in policy.items():
            can = [r for r in members if fits(r)]
            if len(members) > 1 and can:
                want.add((min(r[0] for r in members), f, min(can, key=lambda r: (merit(r), late(r)))[0]))
    assert {tuple(r) for r in survivors.suppliers(table(spark, rows).repartition(5)).collect()} == want


def test_frequency_by_deltas(spark, tmp_path):
    old = [row("a", "x x y", labels=["A b", "a  B", "-", None]), row("b", "y z", labels=None), row("c", None, labels=[]), row("d", "gone now", labels=["c"])]
    new = [row("a", "x x y", labels=["A b", "a  B", "-", None]), row("b", "z z z", labels=["a b"]), row("c", "x", labels=[]), row("e", "", labels=["new"])]
    a, b, changed = table(spark, old), table(spark, new), spark.createDataFrame([(k,) for k in "bcdeb"], "id string")
    counts = frequency.Counts(spark, str(tmp_path / "counts"))
    assert counts.rows().count() == 0 and counts.records() == 0
    counts.merge(frequency.deltas(a), 4, 0)
    first = counts.rows().collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in frequency.deltas(a).collect()}
    change = frequency.deltas(b, a, changed)
    # only what the changed records held and hold: x of c, y of b and so on, but not twice x of a
    assert {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in change.collect()} == {
        ("statement", "x"): (1, 1), ("statement", "y"): (-1, -1), ("statement", "z"): (2, 0), ("statement", "gone"): (-1, -1), ("statement", "now"): (-1, -1),
        ("connections", "a b"): (1, 1), ("connections", "c"): (-1, -1), ("connections", "new"): (1, 1),
    }
    for _ in range(2):  # a batch merged again is no change
        counts.merge(change, 0, 1)
    merged = {tuple(r) for r in counts.rows().collect()}
    assert merged == {tuple(r) for r in frequency.deltas(b).collect()} and counts.records() == 4
    assert ("statement", "x", 3, 2) in merged and ("connections", "a b", 3, 2) in merged and not {m for m in merged if m[1] in ("gone", "c", "")}
    marks = {(r["field"], r["term"]): r["mark"] for r in frequency.marks(counts.rows(), 20, rare_below=2).collect()}
    assert marks[("statement", "y")] == "rare" and marks[("statement", "x")] is None
    counts.merge(frequency.deltas(None, b), -4, 2)
    assert counts.rows().count() == 0 and counts.records() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    counts = frequency.Counts(spark, str(tmp_path / "counts"))
    counts.merge(frequency.deltas(table(spark, [row(f"{i}", f"w{i} v{i}") for i in range(60)])), 60, 0)
    counts.merge(frequency.deltas(table(spark, [row("new", "w7")])), 1, 1)
    files = counts._manifest()["files"]
    assert sorted(f.split("/")[0] for f in files.values()).count("1") == 1 and len(files) == frequency.LEAST_BUCKETS
    assert {r["term"]: r["records"] for r in counts.rows().collect()}["w7"] == 2 and counts.records() == 61
    # a merge that broke off before its manifest leaves the version before it, and is made anew
    spark.createDataFrame([("statement", "junk", 1, 1, 0)], "field string, term string, occurrences long, records long, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "counts" / "data" / "2"))
    assert "junk" not in {r["term"] for r in counts.rows().collect()}
    counts.merge(frequency.deltas(table(spark, [row("x", "v1")])), 1, 2)
    assert {r["term"]: r["records"] for r in counts.rows().collect()} == {f"{c}{i}": 2 if f"{c}{i}" in ("w7", "v1") else 1 for i in range(60) for c in "wv"}


def test_counts_follow_change_capture(spark, tmp_path):
    """Only the keys that capture hands out are cut into terms, run by run, and the counts equal a recount."""
    from tenetry.streaming.change_capture import ChangeCapture

    capture, counts = ChangeCapture(spark, str(tmp_path / "log")), frequency.Counts(spark, str(tmp_path / "counts"))
    rng, state, saves, n = random.Random(4), {}, [], 0
    for run in range(3):
        before = dict(state)
        for _ in range(12):
            n += 1
            key = f"k{rng.randrange(9)}"
            state[key] = row(key, " ".join(rng.choice("pqrst") for _ in range(3)), labels=[rng.choice(["L", "m"])])
            saves.append((n, key, T + dt.timedelta(days=n), T + dt.timedelta(days=n)))
        df = spark.createDataFrame(saves, "save_id long, id string, updated_at timestamp_ntz, arrived_at timestamp_ntz")
        changed = capture.run(df, T + dt.timedelta(days=n))
        counts.merge(frequency.deltas(table(spark, list(state.values())), table(spark, list(before.values())), changed), len(state) - len(before), run)
        assert {tuple(r) for r in counts.rows().collect()} == {tuple(r) for r in frequency.deltas(table(spark, list(state.values()))).collect()}
        assert counts.records() == len(state)


def test_relevance(spark):
    rows = [row("a", "w w v", [("1", "w u"), ("2", None)]), row("b", None, [("3", "u")]), row("c", "", None), row("c", "u u u u", None)]
    got = {(r["id"], r["term"]): r for r in relevance.score_terms(table(spark, rows)).collect()}
    assert {k: (r["tf"], r["df"]) for k, r in got.items()} == {("a", "w"): (3, 1), ("a", "v"): (1, 1), ("a", "u"): (1, 3), ("b", "u"): (1, 3), ("c", "u"): (4, 3)}
    import math

    n, avg, k1, b = 4, (5 + 1 + 0 + 4) / 4, relevance.K1, relevance.B
    want = math.log1p((n - 1 + 0.5) / 1.5) * 3 * (k1 + 1) / (3 + k1 * (1 - b + b * 5 / avg))
    assert got[("a", "w")]["score"] == pytest.approx(want)
    asked = relevance.score_terms(table(spark, rows), tf_least=3, df_most=1).collect()
    assert {(r["id"], r["term"], r["score"]) for r in asked} == {("a", "w", got[("a", "w")]["score"])}
    assert got[("a", "w")]["score"] > got[("a", "v")]["score"] > got[("a", "u")]["score"]


def test_relevance_hot_terms(spark, monkeypatch):
    monkeypatch.setattr(relevance, "HOT_SHARE", 5)
    rows = [row(f"{i}", f"common common t{i % 7} u{i}") for i in range(60)]
    got = relevance.score_terms(table(spark, rows)).collect()
    assert len(got) == 180 and all(r["df"] == 60 for r in got if r["term"] == "common") and all(r["df"] == 1 for r in got if r["term"][0] == "u")


def brute(texts):
    out = set()
    for (f, a, s), (g, b, t) in itertools.combinations(texts, 2):
        x, y = set(words(s)), set(words(t))
        if f == g and a != b and x and y and words(s) != words(t) and 10 * len(x & y) >= 7 * len(x | y):
            out.add((f, min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("vocabulary, size, frequent", [(12, 6, 8), (60, 20, 8192), (40, 30, 8), (300, 90, 8), (30, 2, 8192)])
def test_near_pairs(spark, monkeypatch, vocabulary, size, frequent):
    """Few and many frequent words, short and long texts, edits, reorderings, copies, nulls."""
    monkeypatch.setattr(neardup, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(neardup, "FREQUENT_SHARE", frequent)
    rng = random.Random(vocabulary)
    texts = []
    for i in range(60):
        w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, size))]
        for j in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = f"w{rng.randrange(vocabulary)}"
            if rng.random() < 0.3:
                rng.shuffle(v)
            texts.append((rng.choice(["statement", "snippet"]), f"k{i}-{j}", " ".join(v).upper() if rng.random() < 0.2 else " ".join(v)))
    texts += [("statement", "null", None), ("statement", None, "w1 w2"), ("statement", "blank", " . ")]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "field string, key string, text string, cls int, mask string").repartition(5)
    got = {tuple(r) for r in neardup.near_pairs(df).collect()}
    assert got == brute([t for t in texts if t[1]])
    links = {(r["field"], r["key"]): (r["group"], r["links"]) for r in neardup.groups(df).collect()}
    assert all(links[f, a][0] == links[f, b][0] and links[f, a][1] for f, a, b in got)
    assert len(links) == len([t for t in texts if t[1] and words(t[2])])
