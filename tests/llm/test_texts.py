"""Leaks of test passages and sentence boundaries."""

import base64
import quopri

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statewise.llm import leaks, sentences

ITEM = "In the valley of Junplo the 9314 keepers stored 6223 barrels of pelqui under a borrowed roof and waited for the long rain to end."
HAN = "在奥德里维山谷里7846名看守把伦沃德米藏在图桑斯菲的屋顶下每过1176天沃特桑图的小船都会来"
WORDS = ITEM.split()
RUN, SHORT = " ".join(WORDS[3:16]), " ".join(WORDS[3:15])


def part(kind, coding, body):
    return f"Content-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {coding}\n\n{body}\n"


def multi(*parts):
    return 'From: a\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b=1"\n\nhello\n' + "".join(f"--b=1\n{p}" for p in parts)


HOLDS = {
    1: f"Subject: x\n\nbefore {RUN} after",
    2: "> " + "\n> ".join(RUN.upper().split()),
    3: multi(part("text/plain", "base64", base64.b64encode(RUN.encode()).decode())),
    4: multi(part("text/plain", "quoted-printable", quopri.encodestring(("é " + RUN).encode()).decode())),
    5: multi(part("text/html", "8bit", "<html><body><p>" + RUN.replace("keepers", "kee<b>per</b>s").replace(" of ", "&nbsp;of<br>") + "</p></body></html>")),
    6: RUN.replace("valley", "val­l​ey").replace(" the ", ", the - "),
    7: "各位：\n" + HAN[5:15] + "，\n> " + HAN[15:26] + "。",
    8: multi(part("text/plain", "8bit", "nothing"), part("text/html", "base64", base64.b64encode(f"<p>{RUN}</p>".encode()).decode())),
    9: f"Content-Type: text/html\n\n<html><head><style>p {{}}</style></head><body>{RUN}</body></html>",
}
LACKS = {
    20: SHORT + " differently",
    21: " ".join(WORDS[3:10]) + " pause " + " ".join(WORDS[10:20]),
    22: multi(part("application/pdf", "base64", base64.b64encode(RUN.encode()).decode())),
    23: "各位：" + HAN[5:24] + "吗",
    24: "",
    25: "x" * 200_000,
}


def test_leaks(spark):
    rows = [(k, t, 1) for k, t in {**HOLDS, **LACKS}.items()] + [(1, HOLDS[1], 2), (30, None, 1), (None, ITEM, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(100, ITEM, 0), (101, HAN, 0), (102, "Read the following.", 0), (103, None, 0), (None, ITEM, 0), (104, "", 0), (105, ITEM, 0)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect())
    assert got == sorted([(k, i) for k in HOLDS for i in ((101,) if k == 7 else (100, 105))])
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_items_in_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS", 1)
    docs = spark.createDataFrame([(k, t) for k, t in HOLDS.items()], "doc_id long, text string")
    items = spark.createDataFrame([(100, ITEM), (101, HAN)], "item_id long, text string")
    assert leaks.leaks(docs, items).count() == len(HOLDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=14, max_size=40), min_size=1, max_size=12), st.lists(st.integers(0, 27), min_size=0, max_size=90))
def test_index_finds_what_brute_force_finds(items, doc):
    named = [(k, [f"w{x}" for x in i]) for k, i in enumerate(items)]
    units = [f"w{x}" for x in doc]
    grams = {tuple(units[i : i + 13]) for i in range(len(units) - 12)}
    want = {k for k, u in named if any(tuple(u[i : i + 13]) in grams for i in range(len(u) - 12))}
    assert leaks.Index(named, 13, False).leaks(units) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 11), st.integers(0, 20), st.lists(st.integers(0, 400), max_size=30))
def test_planted_runs_are_found(item, at, noise):
    named = [(k, [f"w{(k * 37 + 7 * n) % 211}" for n in range(34)]) for k in range(12)]
    doc = [f"w{x}" for x in noise] + named[item][1][at : at + 13] + [f"w{x}" for x in noise[::-1]]
    assert item in leaks.Index(named, 13, False).leaks(doc)


def test_inserted_words(spark):
    docs = spark.createDataFrame([(k, t) for k, t in {**HOLDS, **LACKS}.items()], "doc_id long, text string")
    items = spark.createDataFrame([(100, ITEM), (101, HAN)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, inserted=1).collect()}
    assert got == {(k, 101 if k == 7 else 100) for k in HOLDS} | {(21, 100)}


def test_report(spark):
    docs = spark.createDataFrame([(1, HOLDS[1]), (2, ITEM), (3, " ".join(WORDS[12:])), (4, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks.leaks(docs, items, report=True).collect()}
    assert set(got) == {1, 2, 3} and got[1].runs == 1 and got[2].runs == len(WORDS) - 12
    assert got[2].question_share == got[2].answer_share == 1.0 and got[3].answer_share == 1.0 and 0 < got[3].question_share < 0.2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=13, max_size=30), st.lists(st.integers(0, 13), max_size=50), st.integers(1, 3))
def test_runs_with_inserted_words(item, doc, inserted):
    index = leaks.Index([(1, [f"w{x}" for x in item])], 4, False)
    words, spoken = [f"w{x}" for x in item], [f"w{x}" for x in doc]

    def reach(i, p, left, n):
        if n == 4:
            return True
        return any(i + 1 + k < len(spoken) and p + 1 < len(words) and spoken[i + 1 + k] == words[p + 1] and reach(i + 1 + k, p + 1, left - k, n + 1) for k in range(left + 1))

    want = any(spoken[i] == words[p] and reach(i, p, inserted, 1) for i in range(len(spoken)) for p in range(len(words)))
    assert index.holds(spoken, 0, inserted) == want


CASES = [
    ("en", "Dr. Bo met J. K. Lee at 5 p.m. The U.S. team, etc., left.", ["Dr. Bo met J. K. Lee at 5 p.m.", "The U.S. team, etc., left."]),
    ("en", "It ran at 140.4 K. 28. The box is ok. Mail x.v1.4.dat or call ext. 16, now.", ["It ran at 140.4 K.", "28. The box is ok.", "Mail x.v1.4.dat or call ext. 16, now."]),
    ("en", "Open points\n\nWait... it works. “Stop!” said Al (he was sure!) and left…\nThen no.", ["Open points", "Wait... it works.", "“Stop!” said Al (he was sure!) and left…", "Then no."]),
    ("en", "He wrote: “It failed.” The end is near.The rest?! Why (see Fig. 3) not", ["He wrote: “It failed.”", "The end is near.", "The rest?!", "Why (see Fig. 3) not"]),
    ("de", "Am 13. Mai war z. B. Abb. 5 dran. „Wo ist es?“, fragte sie. Tja ... das war es.", ["Am 13. Mai war z. B. Abb. 5 dran.", "„Wo ist es?“, fragte sie.", "Tja ... das war es."]),
    ("fr", "M. Roux, p. ex., part à 5 h 30. « Où est-ce ? » demande-t-il. Quelle surprise !", ["M. Roux, p. ex., part à 5 h 30.", "« Où est-ce ? » demande-t-il.", "Quelle surprise !"]),
    ("es", "¡No me digas!, respondió. El Sr. Paz y la Dra. Ruiz pagan en EE. UU. hoy.", ["¡No me digas!, respondió.", "El Sr. Paz y la Dra. Ruiz pagan en EE. UU. hoy."]),
    ("ru", "Отчёт Н. А. Кеок у меня, т. е. готов. «Где файл?» – спросил он. Да.", ["Отчёт Н. А. Кеок у меня, т. е. готов.", "«Где файл?» – спросил он.", "Да."]),
    ("zh", "他问：“结果呢？”没有人回答。她说“好！”，然后走了。他写道：“失败了。”请看图2.1。（完成了。）好……不过等等！", ["他问：“结果呢？”没有人回答。", "她说“好！”，然后走了。", "他写道：“失败了。”", "请看图2.1。", "（完成了。）", "好……不过等等！"]),
    ("ja", "彼は「はい。」と言った。「終わりました！」次です。", ["彼は「はい。」と言った。", "「終わりました！」", "次です。"]),
    ("hi", 'डॉ. Bo ने कहा। "क्या यह है?" Al ने पूछा। ठीक है', ["डॉ. Bo ने कहा।", '"क्या यह है?" Al ने पूछा।', "ठीक है"]),
    ("ar", "قال د. Bo نعم. سأل: «أين هو؟» ثم خرج. هل تم؟", ["قال د. Bo نعم.", "سأل: «أين هو؟» ثم خرج.", "هل تم؟"]),
    ("th", "ดร. สมชายบอกว่าดี ผมคิดว่าได้ 5 ครั้ง\n\nเสร็จแล้ว", ["ดร. สมชายบอกว่าดี", "ผมคิดว่าได้ 5 ครั้ง", "เสร็จแล้ว"]),
]


@pytest.mark.parametrize("head", ["", "From: 😀 x\n\n"])
def test_sentences(spark, head):
    docs = spark.createDataFrame([(k, head + t + "\n-- \nme", len(head), len(head) + len(t), "e", 0) for k, (_, t, _) in enumerate(CASES)], "doc_id long, text string, body_from long, body_to long, sentence string, end_pos int")
    got = {}
    for r in sentences.sentences(docs).orderBy("doc_id", "sentence").collect():
        text = head + CASES[r.doc_id][1]
        got.setdefault(r.doc_id, []).append(text[r.start_pos : r.end_pos])
    assert {k: got[k] for k in got} == {k: c[2] for k, c in enumerate(CASES)}


def test_odd_bodies(spark):
    rows = [(1, None, 0, 5), (2, "Text.", None, 5), (3, "Text.", 0, None), (None, "Text.", 0, 5), (4, "", 0, 0), (5, "  \n\n ", 0, 5), (6, "One. Two.", 0, 900), (6, "One. Two.", 0, 900), (7, "A. " * 30_000, 0, 90_000), (8, "x" * 100_000, 10, 5), (9, "Ends. ", 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body_from long, body_to long")
    got = {}
    for r in sentences.sentences(docs).collect():
        got.setdefault(r.doc_id, []).append(r.end_pos)
    assert set(got) == {6, 7, 9} and sorted(got[6]) == [4, 9] and sorted(got[9])[0] == 5
    assert sentences.sentences(docs.limit(0)).count() == 0


def test_texts_of_sentences(spark):
    docs = spark.createDataFrame([(k, f"To: x\n\n{t} end", 7, 7 + len(t), "z") for k, (_, t, _) in enumerate(CASES)] + [(50, "", 0, 0, ""), (51, None, 0, 1, ""), (52, "abc", None, 3, ""), (0, f"To: x\n\n{CASES[0][1]} end", 7, 7 + len(CASES[0][1]), "")], "doc_id long, text string, body_from long, body_to long, sentence string")
    whole = {r.doc_id: r.text for r in docs.where("text is not null").collect()}
    got = sorted(sentences.sentence_texts(docs).collect())
    places = sorted(tuple(r) for r in sentences.sentences(docs).collect())
    assert [(r.doc_id, r.sentence, r.start_pos, r.end_pos) for r in got] == places
    assert all(whole[r.doc_id][r.start_pos : r.end_pos] == r.text for r in got)
    assert [r.text for r in got if r.doc_id == 0] == CASES[0][2]
