"""Text operators as Column expressions: they stay inside the JVM and code generation, none is a Python UDF.

White space is spelled out as a class (``WS``) so that it means the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
WORD3 = r"[\p{L}\p{N}_]{3,}"
TRIM_MARK = "\n\n[...контекст обрезан из-за лимита размера запроса...]"
MONSTER_MARK = "\n\n[...]\n\n"

# fixed values: openings of comments that a tracker writes itself
NOISE_PREFIXES = (
    "SimpleLogic:", "Статус изменен на", "Работа остановлена", "Работа окончена", "Задача закрыта", "Задача назначена на", "Резолюция:", "Ждем ответа:", "Оценка:", "Дата оценки:",
    "Категория обращения", "Изменен состав наблюдателей", "Наблюдатели:", "Соисполнители:", "Установлена связь с задачей", "Актив:", "Контрагент:", "Серийный номер оборудования:",
    "Завершите работу и поставьте статус", "В задаче добавлено решение",
)
# fixed values: courtesy and signature phrases that masking removes
COURTESY = (
    r"С уважением[:,\s]*", r"С наилучшими пожеланиями[:,\s]*", r"Спасибо[:,\s]*", r"Добрый день[:,\s]*", r"Здравствуйте[:,\s]*", "Служба технической поддержки", "инженер технической поддержки",
    "Специалист технической поддержки", r"Тел\.", "E-mail", "Пожалуйста, оцените качество",
)
# fixed values: role labels, resolved states and error markers
ROLE_LABELS = {"Client": "👤 [КЛИЕНТ]", "Engineer": "🛠️ [ИНЖЕНЕР]"}
ROLE_DEFAULT = "💬 [СООБЩЕНИЕ]"
RESOLVED = ("ЗАКРЫТО", "РЕШЕНО", "CLOSED", "SOLVED")
ERROR_MARKERS = ("ОШИБКА:", "ERROR:", "Error code:", "Rate limit", "Failed to")
# fixed values: words that carry no topic in technical documentation
STOP_WORDS = tuple("в на с и по для к о от до или как при это что за из то если не а так же все мы быть раздел заголовок таблица рисунок значение данных модуль контроллер работа система устройство параметр настройка".split())

# fixed values: what counts as a person's full name, a mail address and a phone number, since the masked text must be the same
NOISE = "(?iu)^(?:" + "|".join(NOISE_PREFIXES) + "|Создано$)"
FULL_NAME = r"(^|[^\p{L}\p{N}_])[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:вич|вна)([^\p{L}\p{N}_]|$)"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(^|[^\p{L}\p{N}_])\+?7[\s-]?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}([^\p{L}\p{N}_]|$)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def present(c: Column | str) -> Column:
    """True for text with content; null counts as none."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def first_filled(*columns: Column | str) -> Column:
    """The first column with content, stripped; null where none has any."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def strip_html(c: Column | str) -> Column:
    """Text of a marked-up field: tags become blanks, white space single blanks; null becomes ''."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<br\s*/?>", "\n"), "<[^>]+>", " ")
    return strip(F.regexp_replace(plain, f"{WS}+", " "))


def is_noise(c: Column | str) -> Column:
    """A tracker's own message, or at most ten characters."""
    return F.coalesce(col(c).rlike(NOISE) | (F.length(col(c)) <= 10), F.lit(True))


def mask_contacts(c: Column | str) -> Column:
    """Full names with patronymic, mail addresses and Russian phones to tags, courtesy phrases removed, in this order."""
    c = F.regexp_replace(col(c), FULL_NAME, "$1[ФИО СКРЫТО]$2")
    c = F.regexp_replace(c, MAIL, "[EMAIL]")
    c = F.regexp_replace(c, PHONE, "$1[ТЕЛЕФОН]$2")
    return F.regexp_replace(c, "(?iu)(?:" + "|".join(COURTESY) + ")", "")


def role_label(role: Column | str) -> Column:
    out = F.lit(ROLE_DEFAULT)
    for name, label in ROLE_LABELS.items():
        out = F.when(col(role) == name, label).otherwise(out)
    return out


def trim_text(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, cut back to the last line break, plus a mark; as it is where it fits or most <= 0."""
    c = col(c)
    if most <= 0:
        return c
    head = F.substring(c, 1, most)
    lines = strip(F.regexp_replace(head, r"(?s)\n[^\n]*\z", ""))
    cut = F.when(F.length(lines) > 0, lines).otherwise(strip(head))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit(TRIM_MARK)))


def guard_monster(c: Column | str, most: int = 6000) -> Column:
    """Longer texts keep their first and last half of ``most`` characters."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most // 2)), F.lit(MONSTER_MARK), F.right(c, F.lit(most // 2)))).otherwise(c)


# fixed values: an option mark such as "- а)" at a line's start, and the signs that don't count in an answer
OPTION_MARK = r"\s*[-•]?\s*[а-яa-z]\)"
ANSWER_SIGNS = r"[«»\"'`.,;:!?()\[\]{}]"
# fixed values: how the names of function blocks are written
BLOCK_NAMES = (r"(FB_[A-Z0-9_]+)", r"\|\s*([A-Z0-9_]+)\s*\|", r"([A-Z0-9_]+)\s*\|\s*[А-Я]")
# fixed values: call-outs of the documentation
CALL_OUT = r"(?imu)^(внимание|важно)!!!?"


def normalize_answer(c: Column | str) -> Column:
    """Lower case, ё as е, without option marks, bullets and punctuation, single blanks."""
    c = F.regexp_replace(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "\tё", " е"), rf"(^|\n){OPTION_MARK}\s*", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^[\s•-]+", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(c, ANSWER_SIGNS, ""))


def reference_parts(c: Column | str) -> Column:
    """The right answers of a reference that lists one on each line."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[ \t\r-]+|[ \t\r-]+$", ""), rf"(?iu)^{OPTION_MARK}\s*", "")
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), bare), lambda x: x != "")


def option_letters(c: Column | str) -> Column:
    """Sorted distinct letters of option marks such as ``а)`` at line starts."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "ё", "е"), F.lit(r"(?m)^\s*[-•]?\s*([а-яa-z])\)"), 1)))


def tokens(c: Column | str) -> Column:
    """Words of three or more letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD3), 0)


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda x: x != "")).cast("bigint")


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """Value of the first rule that holds: a cascade keeps the order of precedence."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def function_blocks(c: Column | str) -> Column:
    """Sorted distinct names of function blocks, joined by ', '."""
    c = F.coalesce(col(c), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), 1) for p in BLOCK_NAMES])
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & x.rlike("[A-Z]")))), ", ")


def callouts(c: Column | str) -> Column:
    """Attention lines and icon glyphs to warning markup; at most one blank line in a row."""
    c = F.regexp_replace(col(c), CALL_OUT, "> ⚠️ **$1:**")
    c = F.replace(F.replace(c, F.lit("\uf05a"), F.lit("> ℹ️ **ИНФОРМАЦИЯ:**\n> ")), F.lit("\uf071"), F.lit("> ⚠️ **ВНИМАНИЕ:**\n> "))
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def base_url(c: Column | str) -> Column:
    """A root that ends in one slash; '' where there is none."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c == "", "").otherwise(F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/")))


def ticket_id(file_name: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(file_name), r"\[([A-Z]+-\d+)\]", 1), F.lit("")), F.lit("UNKNOWN"))


def safe_file_name(c: Column | str, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_"), 1, most)


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def preview(c: Column | str, most: int = 500, newline: str | None = None) -> Column:
    """The first characters, with ``...`` where there are more; line breaks as ``newline`` if given."""
    c = col(c)
    head = F.substring(c, 1, most)
    head = F.replace(head, F.lit("\n"), F.lit(newline)) if newline is not None else head
    return F.when(F.length(c) > most, F.concat(head, F.lit("..."))).otherwise(head)


def strip_think(c: Column | str) -> Column:
    """Model output without its thoughts and code fences."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"(?s)<think>.*?</think>", ""), r"```(?:json)?", ""))


def labelled_line(c: Column | str, label: str) -> Column:
    """What follows ``label:`` on its line, stripped; '' where the label is missing."""
    return strip(F.regexp_extract(col(c), rf"(?iu){label}:\s*([^\n]*)", 1))


def pick_questions(c: Column | str, fallback: Column | str, most: int = 2) -> Column:
    """Up to ``most`` questions of more than ten characters, separated by | , or ; the fallback only where there is no text."""
    parts = F.filter(F.transform(F.split(col(c), r"[|,;]"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.slice(F.array(col(fallback)), 1, most)).otherwise(F.slice(parts, 1, most))
