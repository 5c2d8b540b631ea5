import pytest

from deskmill.llm import pairs


@pytest.mark.parametrize("text", [None, "", " \n", "​", "n/a", "N/A.", "-", "—", "...", "[]", "<p></p>", "&nbsp;", "null", "не указано", "TBD", "**нет**"])
def test_empty(text):
    assert pairs.is_empty(text)


def test_languages():
    assert pairs.language('Ответ в логе: "session closed by the host".') == "ru"
    assert pairs.language("Fix: raise the timeout on node 10.1.2.3.") == "en"
    assert pairs.language("Gerät 1-2 wurde getauscht und Fanevel läuft wieder.") == "de"
    assert pairs.language("要清除故障ERR-6467，请先检查极性。") == "zh"
    assert pairs.language("") == ""


def test_ends():
    assert [pairs.open_end(t) for t in ("Да.", 'Ответ: "x".', "код пропал:", "(Заменили а также", "Заменили на", "ждём...")] == ["whole", "whole", "cut", "cut", "open", "open"]


def test_copy():
    q = "На объекте датчик давления 10.1.2.3 сбрасывает уставки уже 68 дней"
    assert pairs.covered(q, "Вопрос: " + q.upper()) >= 0.8 and pairs.covered(q, q + ". Причиной оказалась настройка шлюза, её изменили и перезапустили службу.") < 0.8


def test_table(spark):
    q = "Клиент сообщает, что шкаф {} теряет связь после грозы на объекте"
    good = "Рекомендовано очистить кэш на узле {}, после чего код пропал."
    rows = [(i, q.format(i), good.format(i)) for i in range(40)]
    rows += [(100 + i, q.format(i).replace("Клиент", f"Оператор смены {'абвгдежз'[i]}"), f"Понимаю. Обсуждать с вами тему станций я не готов никогда, {'увы' if i % 4 else 'не могу помочь'}.") for i in range(8)]
    rows += [
        (200, q.format(1), None), (201, q.format(1), "—"), (202, q.format(7), q.format(7).upper()), (203, q.format(1), "The cause was the setting and it was changed by the engineer."),
        (204, q.format(1), "Рекомендовано очистить кэш на"), (205, q.format(1), "Рекомендовано очистить кэш на узле 5, после чего код пропал"), (206, q.format(2), "Извините, не могу ответить."),
        (206, q.format(2), "Извините, не могу ответить."), (207, None, good.format(3)), (208, q.format(1), "Портал отвечал «не могу выполнить запрос», после чего код пропал."),
    ]
    df = spark.createDataFrame([(*r, "2024-01-01", "x") for r in rows], "pair_id BIGINT, problem_summary STRING, solution_summary STRING, created_at STRING, defect STRING")
    got = pairs.defects(df).collect()
    assert len(got) == len({r.pair_id for r in got})
    got = {r.pair_id: r.defect for r in got}
    assert {k: got.get(k) for k in range(200, 209)} == {200: "empty", 201: "empty", 202: "copy", 203: "other_language", 204: "truncated", 205: None, 206: "refusal", 207: None, 208: None}
    assert not any(k < 40 for k in got)
    assert {got.get(100), got.get(104)} == {"refusal"}
    assert pairs.defects(df.limit(0)).count() == 0


def test_one_other_word_shares_a_cluster(spark):
    said = ["i would rather leave that to the maker", "i would rather leave this to the maker", "i would rather not leave that to the maker", "the fuse of the cabinet was replaced today"]
    got = {r.opening: r.cluster for r in pairs._clustered(spark.createDataFrame([(x,) for x in said], "opening STRING")).collect()}
    assert got[said[0]] == got[said[1]] and len(set(got.values())) == 3


def test_template_of_unknown_wording(spark):
    nouns = "шкаф насос щит кабель датчик привод клапан шлюз экран сервер монитор журнал".split()
    ask = lambda i: f"{nouns[i % 12].capitalize()} {nouns[i * 5 % 12]} {nouns[i * 7 % 12]} {'моргает гудит греется молчит'.split()[i % 4]}"
    rows = [(i, ask(i), "Такие вещи я предпочту оставить изготовителю, обратитесь туда.") for i in range(24)]
    rows += [(100 + i, ask(i), f"Мы посоветовали перезапустить службу на узле {i + 50}, и код пропал.") for i in range(24)]
    rows += [(200 + i, ask(i), "Мы посоветовали перезапустить службу, и код пропал.") for i in range(12)]
    rows += [(300 + i, ask(i), f"Мы поняли суть дела. Рекомендовано очистить кэш на узле {i + 50}, после чего код пропал.") for i in range(24)]
    rows += [(400 + i, "Шкаф связи моргает", "Я всё передал сменному мастеру участка.") for i in range(24)]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "pair_id BIGINT, problem_summary STRING, solution_summary STRING, created_at STRING")
    assert not any(pairs._DECLINES.search(r[2]) for r in rows)
    assert {r.pair_id for r in pairs.defects(df).filter("defect = 'refusal'").collect()} == set(range(24))


def test_openings_of_a_busy_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BANDS", 1)
    monkeypatch.setattr(pairs, "ROWS", 0)  # one bucket for all
    names = ["boiler", "steam trap", "relay", "heat pump", "valve"]
    said = ["a pump was replaced and the line was shielded on node 9"] + [f"we would rather leave the {n} to whoever built it" for n in names]
    said += ["please turn to your own dealer first of all about it today", "kindly turn to your own dealer first of all about this today"]
    got = {r.opening: r.cluster for r in pairs._clustered(spark.createDataFrame([(x,) for x in said], "opening STRING")).collect()}
    assert len({got[x] for x in said[1:6]}) == 1 and got[said[6]] == got[said[7]] and len(set(got.values())) == 3


def test_short_and_unspaced_copies():
    assert pairs.covered("Нет связи", "нет связи.") == 1 and pairs.covered("Нет связи", "Связи нет") == 0 and pairs.covered("", "!") == 0
    q = "请问如何清除控制柜的故障报警并恢复通信"
    assert pairs.covered(q, f"问题：{q}。") >= 0.8 and pairs.covered(q, "请先检查极性，然后更换电缆并恢复通信。") < 0.8


def test_declining_after_a_long_beginning(spark):
    begin = "Добрый день.\nСпасибо за обращение.\nВы пишете про узел 5.\n"
    rows = [(1, "Узел 5 не отвечает", begin + "Увы, ответить на это невозможно."), (2, "Узел 5 не отвечает", begin + "Кабель 77 заменили, повторить сбой мы не смогли, помочь иначе нельзя помочь.")]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "pair_id BIGINT, problem_summary STRING, solution_summary STRING, created_at STRING")
    assert {r.pair_id: r.defect for r in pairs.defects(df).collect()} == {1: "refusal"}


def _brute_clusters(said):
    label = {x: x for x in said}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(said):
        for y in said[:i]:
            if pairs._alike(pairs._word_set(x), pairs._word_set(y)) >= pairs.ALIKE:
                label[root(x)] = root(y)
    return {x: root(x) for x in said}


def test_clusters_against_brute_force(spark):
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    said = set()
    for _ in range(60):
        base = draw.sample(words, draw.randint(5, 12))
        for _ in range(draw.randint(1, 6)):
            other = list(base)
            for _ in range(draw.randint(0, 2)):
                other[draw.randrange(len(other))] = draw.choice(words)
            said.add(" ".join(other))
    said = sorted(said)
    want = _brute_clusters(said)
    got = {r.opening: r.cluster for r in pairs._clustered(spark.createDataFrame([(x,) for x in said], "opening STRING")).collect()}
    both = [(x, y) for i, x in enumerate(said) for y in said[:i] if want[x] == want[y]]
    found = sum(got[x] == got[y] for x, y in both)
    assert len(both) > 100 and found >= 0.9 * len(both)


def test_unseen_template_without_the_phrase_list(spark):
    things = "шкаф насос щит кабель датчик привод клапан шлюз экран сервер монитор журнал котёл вентиль реле модуль пульт станция линия узел".split()
    asked = [f"{t.capitalize()} {things[i * 7 % 20]} {things[i * 3 % 20]} не отвечает {things[i * 11 % 20]}" for i, t in enumerate(things)]
    rows = [(i, q, "Данная тема мной не обсуждается, прошу понять.") for i, q in enumerate(asked)]
    rows += [(100 + i, q, "This question falls to somebody else.") for i, q in enumerate(asked)]
    rows += [(200 + i, q, f"Заменили предохранитель {i + 70}, связь восстановлена.") for i, q in enumerate(asked)]
    rows += [(300 + i, asked[0], "Сегодня отвечает начальник смены лично.") for i in range(20)]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "pair_id BIGINT, problem_summary STRING, solution_summary STRING, created_at STRING")
    got = {r.pair_id for r in pairs.defects(df, phrases=False).filter("defect = 'refusal'").collect()}
    assert got == {*range(20), *range(100, 120)} - {r.pair_id for r in pairs.defects(df).filter("defect = 'other_language'").collect()}


def test_a_quotation_that_breaks_off_is_no_refusal(spark):
    rows = [(i, f"Узел {i} не отвечает на запросы", "Портал отвечал «не могу выполнить запрос 5", "2024-01-01") for i in range(8)]
    df = spark.createDataFrame(rows, "pair_id BIGINT, problem_summary STRING, solution_summary STRING, created_at STRING")
    assert {r.defect for r in pairs.defects(df).collect()} == {"truncated"}
