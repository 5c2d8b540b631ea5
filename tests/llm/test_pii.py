import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskmill.llm import pii

CASES = {
    "Пишите на glebl собака north-grid точка example, срочно": "Пишите на [EMAIL], срочно",
    "mail: hollisp[at]teplovektor[dot]example.": "mail: [EMAIL].",
    "звоните восемь девять семь три пять ноль восемь пять два пять семь": "звоните [PHONE]",
    "Почта:S_POLYNIN@POST.EXAMPLE,копия": "Почта:[EMAIL],копия",
    "адрес ivan＠mail．example тут": "адрес [EMAIL] тут",
    "тел. +7 (972) 137-90-20 доб. 346 и 415.555.0131": "тел. [PHONE] и [PHONE]",
    "Service svc@node4; lib-X@3.1.2; counter 89662393741; Сборка +7-1.22.0; Auftrag 5553-5111; узел 10.228.246.60": None,
    "Серийный номер 71464914228. инв. № 0019303856. Order no. 4178-40-4272. look at a dot matrix": None,
    "текст\n89463799400\n": "текст\n[PHONE]\n",
    "Оформите: снилс 09447060890, ИНН физлица 002324582972, паспорт серии 9907 № 611982": "Оформите: [ID_NUMBER], [ID_NUMBER], [ID_NUMBER]",
    "SSN 919-12-1234, passport no. X05421126, national ID 00402869/7369.": "[ID_NUMBER], [ID_NUMBER], [ID_NUMBER].",
    "тут: 149169, г. Верхнедольск, пр-т Гранитная, 128/8": "тут: [ADDRESS]",
    "ул. Вагонная, дом 15, офис 75.": "[ADDRESS].",
    "to Greystone Falls, 135 Foundry Way.": "to [ADDRESS].",
    "an Gießereistr. 99 in 12345 Tannrode.": "an [ADDRESS].",
    "The frequency drive is fed from 99 V; cabinet 7870 the drive. Цех 21, пролёт 35": None,
    "Прибор принимает Кирилл Студенкин из смены": "Прибор принимает [NAME] из смены",
    "Подписал акт (Т.А. Чернотропов) вчера.": "Подписал акт ([NAME]) вчера.",
    "ivan (dot) petrov (at) mail (dot) ru, срочно": "[EMAIL], срочно",
    "please call five five five one two three four five six seven": "please call [PHONE]",
    "Counter five five five one two three four five six seven": None,
    "at 12 Rue de Rivoli, Paris.": "at [ADDRESS].",
    "Calle de Alcalá, 45": "[ADDRESS]",
    "Please ask Priya Raghunathan about it": "Please ask [NAME] about it",
    "Обратитесь к Зульфие Ахметовой утром": "Обратитесь к [NAME] утром",
    "Передайте Степану и Марине": "Передайте [NAME] и [NAME]",
    "Vor Ort ist Q. Kornfeldt. Das Modul": "Vor Ort ist [NAME]. Das Modul",
    "От: Яков Прохоров <x@y.example>": "От: [NAME] <[EMAIL]>",
    "Dear support,\nдавление 17 В. Период 5 с. Проект Lorgorvel": None,
    "никита снегирёв": "[NAME]",
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert pii.mask(text) == (CASES[text] or text)


def test_empty_and_long():
    assert pii.mask(None) is None and pii.mask("") == "" and pii.find(None) == []
    text = "Узел 10.1.2.3 молчит. " * 50_000 + "a@b.example"
    assert pii.find(text) == [(len(text) - 11, len(text), "EMAIL")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="аиb1@.()+ \nсобак[]t-－＠Ив", max_size=60))
def test_spans_are_ordered_and_the_rest_stays(text):
    low, rest = 0, []
    for a, b, kind in pii.find(text):
        assert low <= a < b <= len(text) and kind in pii.TYPES
        rest.append(text[low:a])
        low = b
    masked = pii.mask(text)
    for piece in [*rest, text[low:]]:
        assert piece in masked


def test_tables(spark):
    rows = [(1, "a@b.example и a@c.example", 1), (1, "a@b.example и a@c.example", 2), (2, None, 1), (None, "тел. +79474122882", 1), (3, "", 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k BIGINT, t STRING, at INT, rec_id INT")
    assert {(r.rec_id, r.pii_type) for r in pii.types_found(df, "k", "t").collect()} == {(1, "EMAIL"), (None, "PHONE")}
    assert {(r.rec_id, r.masked_text) for r in pii.masked(df, "k", "t", "at").collect()} == {(1, "[EMAIL] и [EMAIL]"), (2, None), (None, "тел. [PHONE]"), (3, "")}
    assert pii.types_found(df.limit(0), "k", "t").count() == 0


def test_gates_shut_out_no_match(monkeypatch):
    texts = ["паспортом 45 10 123456", "удостоверением 12345678", "Reisepassnummer C1234567", "с проспекта Мира, д. 5", "12  Baker  Street, flat 4", "12 Baker  Road", "Hauptstraße  12", "звоните плюс семь семь семь семь семь семь семь семь семь семь семь"]
    gated = [pii.find(t) for t in texts]
    assert all(gated)

    class Open:
        def search(self, text):
            return True

    for gate in ("_RARE", "_EN_ADDRESS_CUE", "_DE_ADDRESS_CUE"):
        monkeypatch.setattr(pii, gate, Open())
    monkeypatch.setattr(pii, "_ID_CUE", Open())
    monkeypatch.setattr(pii, "_MANY_DIGITS", Open())
    monkeypatch.setattr(pii, "normalise", lambda text, present=None, plain=pii.normalise: plain(text, None))
    assert [pii.find(t) for t in texts] == gated


def _lessons():
    pairs = [("Priya", "Raghunathan"), ("Mohammed", "Alfayed"), ("Гульнара", "Тазиева")]
    for i in range(4):
        for a, b in pairs:
            yield f"From: {a} {b} <{a.lower()}@x.example>\nStatus {i}"
            yield f"Pump {i} is fine.\nBest regards,\n{a} {b}\nControl Room"
    for i in range(40):
        yield f"Control Room {i} is closed. Pump Room is open.\nBest regards,\nControl Room" if i < 4 else f"Control of Room {i}"


def test_names_are_learnt_from_the_corpus(spark, monkeypatch):
    texts = ["we met Priya in town", "Alfayed signed it", "mohammed alfayed signed", "Дали Гульнаре ключ", "Control Room, Status", "priya"]
    rows = [(i, t, 1, "x") for i, t in enumerate([*texts, None, "", *_lessons()])]
    df = spark.createDataFrame(rows, "k BIGINT, t STRING, at INT, names STRING")
    names = pii.learnt_names(df, "t")
    words = {r.word for r in names.collect()}
    assert {"priya", "+priya", "raghunathan", "alfayed", "гульнара", "гульнаре"} <= words and not words & {"control", "room", "status", "+raghunathan"}
    got = {r.rec_id: r.masked_text for r in pii.masked(df, "k", "t", "at", names).collect()}
    assert [got[i] for i in range(8)] == ["we met [NAME] in town", "[NAME] signed it", "[NAME] signed", "Дали [NAME] ключ", "Control Room, Status", "priya", None, ""]
    assert pii.mask(texts[0]) == texts[0]
    found = {(r.rec_id, r.pii_type) for r in pii.types_found(df, "k", "t", names).collect()}
    assert {(i, "NAME") for i in range(4)} <= found and not {(4, "NAME"), (5, "NAME")} & found
    monkeypatch.setattr(pii, "MAX_NAMES", 0)  # too many to send: joined
    assert {r.rec_id: r.masked_text for r in pii.masked(df, "k", "t", "at", names).collect()} == got
    assert {(r.rec_id, r.pii_type) for r in pii.types_found(df, "k", "t", names).collect()} == found
    assert pii.learnt_names(df.limit(0), "t").count() == 0


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        text = " ".join(f"user{i}@mail{i}.example" for i in range(n))
        began = time.perf_counter()
        assert len(pii.find(text)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
