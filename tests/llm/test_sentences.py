"""Sentence boundaries on texts cut by hand: a | marks where one sentence ends, ~ what belongs to none."""

import pytest

from tenetry.llm.sentences import sentences

CASES = {
    "plain": "Dr. Smith paid 3.5 units, e.g. twice.| Is it on https://a.example/b.c?d=1 now?| Yes!",
    "initials": "J. T. Harrow and Prof. Lee wrote it.| See Fig. 2 and Sec. 4.1 first.",
    "outer abbreviations": "It ran until 6 p.m. and stopped.| It ran until 6 p.m.| The log grew, nodes, etc.| Foo Inc. owns it.",
    "speech": "“Is it ready?” asked Ann.| Bob said: “One is here. Two is there.”| “It works,” wrote Cy.| “Done. Gone.” said Di.",
    "straight quotes": 'She asks, "Who owns it?" and stops.| "It works now!" is what the log says.| Next.',
    "whole in brackets": "(It is a note.)| Next one (approx. 4 m).| “All quoted.”| End.",
    "ellipsis": "It waits … but not for long.| It waits...| The end.| So…",
    "command": "It stops.| foo-sync --all rebuilds it.| “Ready.”| bar-sync --all runs.",
    "lost space": "It stops here.|Then it goes on.| Use a.b.c and v1.2.3 now.",
    "wrapped": "One line\ngoes on\nhere.| Two.|\n\nNo stop|\n\nNext paragraph",
    "crlf": "One line\r\ngoes on.|\r\n\r\nTwo",
    "structure": "~# Head 2.1|\nText.| More.|\n~- item one|\n~2) item two. |Second.|\n~| a. b | c |\n~```\ncode. here\n~```\nLast.",
    "german": "Das ist z. B. gut, d. h. ok.| Am 3. Mai kam er.| „Ist es da?“, fragte Eva.| »Es geht!«| Er kam usw.| Dann ging er ca. 5 m.",
    "french": "« Où est-il ? » demanda Luc.| Voir p. ex. la p. 3.| Mme D. Roy dort.| « Bon. »| Fin !",
    "spanish": "¿Dónde está?| Véase la pág. 2, p. ej. el art. 6.| ¡Bien!| El Sr. Gil vino.",
    "chinese": "太慢了！！|他说：“好。走吧。”|“好了！”负责人说。|停了……然后又来。|（参考。）|完",
    "japanese": "本当か！？|「安全ですか？」と彼が尋ねた。|「保存する。」|止まった……しかし残った。",
    "arabic": "هل العقد جاهز؟| راجع د. Sami الفهرس اليوم.| رائع!",
    "hindi": "क्या यह तैयार है?| डॉ. Rao ने जाँच की।| वाह!",
    "thai": "คู่มือพร้อมหรือยัง?| ระบบ Abc รวมคิว| บันทึกทุก 33 นาที| “ดีแล้ว”| จบ",
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    marked = CASES[name]
    # table rows hold | themselves; they start with ~|
    lines, want, text = marked.split("\n"), [], ""
    clean = []
    for x in lines:
        clean.append(x[1:] if x.startswith(("~|", "~```")) else x.replace("~", "").replace("|", ""))
    text = "\n".join(clean)
    body = "\n".join("" if x.startswith(("~|", "~```")) or x == "code. here" else x for x in lines)
    for piece in body.replace("\n~", "\n|~").split("|"):
        p = piece.strip()
        for m in ("~# ", "~- ", "~2) "):
            p = p.removeprefix(m)
        want += [p] if p else []
    df = spark.createDataFrame([(1, text, "x")], "request_id long, text string, _row string")
    got = [r for r in sentences(df).orderBy("start").collect()]
    assert [r["sentence"] for r in got] == want
    assert all(text[r["start"] : r["end"]] == r["sentence"] for r in got)


def test_odd_texts(spark):
    long = "One two three. " * 20_000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "```\nx. y\n```"), (5, long), (6, "A b."), (6, "A b."), (7, "😀 One. Two three.")]
    df = spark.createDataFrame(rows, "request_id long, text string")
    n = {}
    for r in sentences(df).collect():
        n[r["request_id"]] = n.get(r["request_id"], 0) + 1
    assert n == {5: 20_000, 6: 2, 7: 2}
    assert sentences(spark.createDataFrame([], "request_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [100])
def test_long_quotations(spark, n):
    """A quotation and what introduces or attributes it are one sentence, however long it is; an unmatched mark is none."""
    many = " ".join(["One is here."] * n)
    whole = [f"Bob said: “{many}”", f"“{many}” said Bob.", f"Il dit : « {many} »", f"« {many} » dit Luc.", f"„{many}“, sagte Eva.", f'She asks, "{many}" and stops.', "他说：“" + "好。走吧。" * n + "”"]
    df = spark.createDataFrame([(i, f"It starts. {x}\n\nIt ends.") for i, x in enumerate(whole)] + [(9, f"It is “open. {many}")], "request_id long, text string")
    got = {}
    for r in sentences(df).orderBy("request_id", "start").collect():
        got.setdefault(r["request_id"], []).append(r["sentence"])
    assert len(got.pop(9)) == n + 1
    assert got == {i: ["It starts.", x, "It ends."] for i, x in enumerate(whole)}


def test_long_addresses_and_attributions(spark):
    """No bound on what an address or an attribution may be made of."""
    url, host, local = "https://h.example/" + "a.b/" * 500 + "end.html", ".".join(["sub"] * 80) + ".example", ".".join(["first"] * 60)
    far = "「走吧。」" + "那位站在门口很久没有开口的年轻人终于轻声" + "说道。"
    texts = [f"See {url}. It loads.", f"Write to {local}@{host}. It works.", f"{far}雨停了。"]
    got = [[] for _ in texts]
    for r in sentences(spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")).orderBy("start").collect():
        got[r["request_id"]].append(r["sentence"])
    assert got == [[f"See {url}.", "It loads."], [f"Write to {local}@{host}.", "It works."], [far, "雨停了。"]]


def test_quotation_of_a_hundred_thousand_signs(spark):
    whole = "“" + "It is so. " * 10_000 + "It ends.” he said."
    df = spark.createDataFrame([(1, f"One. {whole} Two.")], "request_id long, text string")
    assert [r["sentence"] for r in sentences(df).orderBy("start").collect()] == ["One.", whole, "Two."]


def test_nothing_is_shuffled(spark):
    plan = sentences(spark.createDataFrame([(1, "A b.")], "request_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
