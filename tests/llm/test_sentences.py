import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskmill.llm.sentences import sentences, unit_ends

# "|" marks where a unit ends
CASES = [
    "Файл копируется на сервер 10.135.88.218 перед\nзагрузкой.| В журнале запись: «Узел 10.2.119.81\nостановлен. Давление 170,35 бар».| x_66.log хранит 5,59 Мб.|",
    "См. рис. 72 и табл. 69.| Рекомендуется проверить и т. д.| Период выбран, т. к. архив растёт.| Сигнал 17 В пост. тока, т. е. мало.| Давление 3,5 В.| По данным инж. Перова, ждали 45 с.| 12 записей.|",
    "К вечеру узел зависает... Причину не нашли.|".replace("... ", "...| "),
    'The log reads: "Unit 7 stopped. Pressure is 71.44 bar."| The screen says "Channel X is offline. Code E1" and waits.| According to Mr. Kaldepvel it was approx. 44 s.| At 1:29 a.m. local time, i.e. late.| Blocks A_1, B_2, etc.| The end!|',
    "Die Adresse wird z. B. von Hand vergeben, vgl. Abb. 40.| Die Anzeige meldet „Kanal fehlt. Code F1“ und wartet.| Am 27. Januar bzw. 28. Mai usw.| Laut Dipl.-Ing. Bel war Ruhe.|",
    "操作员会看到“通道离线。代码E7”，此时必须更新。|结果写入X_9！|为什么？| 是。|\n\n# 设置|\n\n1. 更换|\n2. 核对|",
    "画面に「停止中。コードE6」と出たら、確認してください。|許容は56.62mAです。|",
    "डॉ. Solmi के अनुसार दूर हो गई।| सीमा 41.45 है।| क्या मान 7 है?| हाँ।|",
    "هل القيمة 3378؟| الحد هو 189.28 فولت.| انسخ الملف a_1.yaml قبل التشغيل!|",
    "เซ็นเซอร์ AO-9879 ขาดการเชื่อมต่อ| ค่าที่อนุญาตคือ 100.95 โวลต์| กรุณาตรวจสอบรหัส E1 ที่เซิร์ฟเวอร์|",
    "# Заголовок 1.2|\n\nТекст без точки|\n \n- пункт один|\n• пункт два.|\n1. третий|\n\n(Вставка. Ещё.) конец.|",
    "снять перемычку.|После импорта узел lib-X@3.1.2 стоит.|",
    "Незакрытая « кавычка. Дальше.|".replace(". Д", ".| Д"),
    "Он сказал: «Да!»| Потом ушёл.| Версия 3.1.| А. Б. Иванов пришёл.|",
]


@pytest.mark.parametrize("marked", CASES)
def test_marked(marked):
    parts = marked.split("|")
    text, want, at = "".join(parts), [], 0
    for p in parts[:-1]:
        at += len(p)
        want.append(at)
    got = [e for _, e, _ in unit_ends(text)]
    assert got == want, [text[a:b] for a, b, _ in unit_ends(text)]


def test_empty_and_long():
    assert unit_ends("") == unit_ends(" \n\n\t") == unit_ends("﻿ \n") == []
    assert len(unit_ends("Да. " * 100_000)) == 100_000
    assert len(unit_ends("«" * 50_000 + "x")) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="аБ. \n!?«»\"()“„1-#。ก", max_size=80))
def test_units_cover_all_text(text):
    low = 0
    for a, b, _ in unit_ends(text):
        assert low <= a < b and not text[low:a].strip() and text[b - 1].strip()
        low = b
    assert not text[low:].strip()


def test_table(spark):
    df = spark.createDataFrame([(1, "Да. Нет.", 9), (2, None, 9), (3, " ", 9), (1, "Да. Нет.", 9), (None, "x", 9)], "k BIGINT, t STRING, unit_no INT")
    rows = sorted(((r.doc_id, r.unit_no, r.end_pos) for r in sentences(df, "k", "t").collect()), key=str)
    assert rows == sorted([(1, 0, 3), (1, 1, 8)] * 2 + [(None, 0, 1)], key=str)
    assert sentences(df.limit(0), "k", "t").count() == 0


def _units(text):
    return [text[a:b] for a, b, _ in unit_ends(text)]


def test_list_levels():
    assert _units("1. Item one\n  1.1. Sub item.\n  1.2. Other\n2. Next") == ["1. Item one", "1.1. Sub item.", "1.2. Other", "2. Next"]
    assert _units("98. a\n99. b\n100. c\n101. d") == ["98. a", "99. b", "100. c", "101. d"]
    assert _units("- outer\n  - nested a\n  - nested b\n- outer b") == ["- outer", "- nested a", "- nested b", "- outer b"]
    assert _units("Нужны:\n- насос\n- кабель") == ["Нужны:", "- насос", "- кабель"]
    assert _units("Давление выросло до\n1024. Затем упало.") == ["Давление выросло до\n1024.", "Затем упало."]
    assert _units("Он сказал\n- один раз - и ушёл.") == ["Он сказал\n- один раз - и ушёл."]


def test_marks_without_partner_take_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        text = "(" * n + "«" * n + "]" * n + "” a. " * n
        began = time.perf_counter()
        assert unit_ends(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]
