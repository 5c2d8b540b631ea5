import pytest
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.functions import vectors as V


def value(spark, column, *values, names="abc"):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} STRING" for n in names[: len(values)]))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text, want", [("a<br/>b <b>c</b>  d\n", "a b c d"), (None, ""), ("", ""), ("<p>\xa0x</p>", "x")])
def test_strip_html(spark, text, want):
    assert value(spark, T.strip_html("a"), text) == want


@pytest.mark.parametrize("text, want", [("Статус изменен на «x y z»", True), ("ОЦЕНКА: отлично всем", True), ("десять бук", True), ("одиннадцать", False), ("Создано", True), ("Создано новое обращение", False), (None, True)])
def test_noise(spark, text, want):
    assert value(spark, T.is_noise("a"), text) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("звонил Иванов-Петров Иван Иванович, ждёт", "звонил [ФИО СКРЫТО], ждёт"), ("Смирнова Анна Петровна", "[ФИО СКРЫТО]"), ("Смирнова Анна", "Смирнова Анна"), ("пишите a.b@c.example!", "пишите [EMAIL]!"),
        ("+7 (900) 123-45-67", "[ТЕЛЕФОН]"), ("т. 79001234567.", "т. [ТЕЛЕФОН]."), ("7-900-123-45-67", "[ТЕЛЕФОН]"), ("7 900 123 45 67", "[ТЕЛЕФОН]"), ("177900123456799", "177900123456799"), ("СПАСИБО, всё", "всё"), (None, None),
    ],
)
def test_mask(spark, text, want):
    assert value(spark, T.mask_contacts("a"), text) == want


@pytest.mark.parametrize("text, most, want", [("abc", 3, "abc"), ("abcd", 3, "abc" + T.TRIM_MARK), ("ab\ncd", 4, "ab" + T.TRIM_MARK), ("\nabcd", 3, "ab" + T.TRIM_MARK), ("abcd", 0, "abcd"), (None, 3, None), ("a\n\nbcdef", 5, "a" + T.TRIM_MARK)])
def test_trim(spark, text, most, want):
    assert value(spark, T.trim_text("a", most), text) == want


def test_monster(spark):
    assert value(spark, T.guard_monster("a"), "x" * 6000) == "x" * 6000
    long = "😀" * 3000 + "y" + "ж" * 3000
    assert value(spark, T.guard_monster("a"), long) == "😀" * 3000 + T.MONSTER_MARK + "ж" * 3000


def test_answer_fields(spark):
    assert value(spark, T.normalize_answer("a"), "  А) «Ёлка»,\tда!\n- б) нет") == "елка да нет"
    assert value(spark, T.reference_parts("a"), "- а) один\n\n б) два\t\n") == ["один", "два"]
    assert value(spark, T.option_letters("a"), "Б) x\n - а) y\nтекст в) z") == ["а", "б"]
    assert value(spark, T.option_letters("a"), None) == []


def test_model_output(spark):
    raw = "<think>а\nб</think>\n```json\nКлючевые слова: a, b \nВОПРОСЫ: Как это работает? | Что | Почему оно молчит?\n```"
    clean = value(spark, T.strip_think("a"), raw)
    assert value(spark, T.labelled_line("a", "КЛЮЧЕВЫЕ СЛОВА"), clean) == "a, b"
    q = value(spark, T.labelled_line("a", "ВОПРОСЫ"), clean)
    assert value(spark, T.pick_questions("a", "b"), q, "x") == ["Как это работает?", "Почему оно молчит?"]
    assert value(spark, T.pick_questions("a", "b"), "", "крошки") == ["крошки"]
    assert value(spark, T.pick_questions("a", "b"), "кратко;мало", "крошки") == []


def test_names_and_cascades(spark):
    assert value(spark, T.ticket_id("a"), "[RL-12] x.json") == "RL-12" and value(spark, T.ticket_id("a"), "x") == "UNKNOWN"
    assert value(spark, T.safe_file_name("a"), 'a<b>:"/\\|?*' + "x" * 80) == "a_b________" + "x" * 49
    rules = [(F.contains("a", F.lit("v500s")), "S"), (F.contains("a", F.lit("v500")), "R"), (F.contains("a", F.lit("ide")), "I")]
    assert [value(spark, T.first_match(rules, "General"), x) for x in ("v500s", "v500", "guide", "zzz")] == ["S", "R", "I", "General"]
    assert value(spark, T.function_blocks("a"), "FB_X1 | AB_2 | и FB_X1 | ab | 12 |") == "AB_2, FB_X1"
    assert value(spark, T.callouts("a"), "внимание!!!\n\n\n\nx") == "> ⚠️ **внимание:**\n\n> ℹ️ **ИНФОРМАЦИЯ:**\n> x"
    assert value(spark, T.escape_html("a"), '<&">\n') == "&lt;&amp;&quot;&gt;<br>"
    assert value(spark, T.first_filled("a", "b", "c"), None, " \xa0", " x ") == "x"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a ARRAY<FLOAT>, z ARRAY<FLOAT>, b ARRAY<FLOAT>")
    row = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z"))).first()
    assert (round(row[0], 6), row[1], [round(x, 6) for x in row[2]], row[3]) == (0.96, 0.0, [0.6, 0.8], [0.0, 0.0])
