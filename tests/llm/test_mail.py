import pytest

from deskmill.llm import mail

# lines that are not new carry "~" in front
CASES = [
    "Добрый день!\nУзел завис.\n~С уважением,\n~Иван Перов\n~Инженер\n\n~12.05.2023 10:11, Анна Белова <a@x.example> пишет:\n~> Что случилось?\n~>> Ничего.",
    "~Nerys Greywick said on 3/4/2024:\n~» Package lib is in place.\nFirst answer here.\n~» Second question?\nSecond answer here.\n~-- \n~Edric Ashgrove\n~tel. 646.555.0127",
    "Hi team,\n>= 5 counts as alarm.\n> show link 7205\nFrom: 12 to 20 V the input stays low\nTo: node 5 only, no broadcast\n--- log end ---\n***\nIt failed.",
    "Guten Tag,\nGeht nicht.\n\n~MfG\n~Garrick Tannhof\n\n~Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt.\n\n~-----Ursprüngliche Nachricht-----\n~Von: Lorin Falk\n\n~Text davor.",
    "It works.\nB. Northgale\nField technician\nPhone: +7 (972) 137-90-20".replace("\nB.", "\n~B.").replace("\nF", "\n~F").replace("\nP", "\n~P"),
    "Thank you!\n\n~From: Lorin <l@x.example>\n~Sent: Jul 9, 2021 09:13\n~To: Support desk\n\n~Old text.",
    "Das Modul geht.\n~On Feb 9, 2023,\n~Garrick Pennywell <p@x.test> wrote:\n~| old\nnew",
    '<div>Good morning,</div>\n<div>It broke.</div>\n~<div class="signature">\n~<p>maren inglemoor</p>\n~</div>\n~<p><small>Please think of the trees before you print.</small></p>\n~<div>Support desk, 13:11:</div>\n~<blockquote type="cite">\n~<p>old</p>\n~</blockquote>\n<div>PS works again.</div>',
    "Текст.\r\n\r\n~Отправлено с телефона\r\n",
    "Анна Белова",
    "Коллега пишет: всё сломалось.",
]


@pytest.mark.parametrize("marked", CASES)
def test_marked(marked):
    lines = marked.split("\n")
    text = "\n".join(x.removeprefix("~") for x in lines)
    got = [bool(m) for m in mail.mark_lines(text)]
    assert got == [x.startswith("~") for x in lines], list(zip(mail.mark_lines(text), lines))


def test_empty_and_long():
    assert mail.mark_lines(None) == [] and mail.mark_lines("") == [] and mail.mark_lines(" \n \r\n") == ["", "", ""]
    assert mail.new_text(None) is None and mail.new_text("a\n\n\n\nb\n") == "a\n\nb"
    long = "строка текста.\n" * 100_000 + "X wrote:\n" + "> q\n" * 100_000
    assert sum(map(bool, mail.mark_lines(long))) == 100_001


def test_tables(spark):
    text = "new\n\nAnna wrote:\n> old"
    rows = [(1, text, 1), (1, text, 2), (2, None, 1), (None, "> x", 1), (3, "", 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "k BIGINT, t STRING, at INT, line_no STRING")
    assert sorted((r.id, r.line_no, r.reason) for r in mail.marked_lines(df, "k", "t").collect()) == [(1, 2, "attribution"), (1, 3, "quote")]
    assert {(r.id, r.new_text) for r in mail.reduced(df, "k", "t", "at").collect()} == {(1, "new"), (2, None), (None, "> x"), (3, "")}
    assert mail.marked_lines(df.limit(0), "k", "t").count() == 0


def test_quotation_without_attribution():
    marked = lambda text: [i for i, m in enumerate(mail.mark_lines(text)) if m]
    assert marked("Согласен.\n> Порт 5 закрыт\n> с утра\nОткройте его.") == [1, 2]
    assert marked("ok\n>> old\n>> older\n> old again\nnew") == [1, 2, 3]
    assert marked("Порог:\n> 5 В\n> 7 В\n> show log\n> ping host") == []
    assert marked("a\n> one line only\nb") == []
    assert marked("a\n> x | y\n> 1 | 2\nb") == []


def test_long_signature():
    lines = ["Pump 4 is fine.", "Best regards,", *[f"line {i} of many words that say where the office is, and when it is open." for i in range(14)]]
    assert [i for i, m in enumerate(mail.mark_lines("\n".join(lines))) if m] == list(range(1, 16))
