"""Personal information inside free text: found, typed and replaced by placeholders.

Detection runs on a normalised copy of the text and is mapped back to the source, so that only the disguised
characters themselves are replaced and everything else stays as it was:

* *Transducers* rewrite homoglyphs and full-width signs (one character for one), at/dot disguises of mail addresses and
  spelled digits (many characters for one). Each rewrite that changes lengths is kept with both its spans.
* *Detectors* for mail addresses, identity numbers, phones, postal addresses and names work on the copy. The words and
  stems of a text decide first which of them can apply at all; most texts run two or three of them.
* *Names* are known by form (patronymics, initials, inflected surnames, forms of address), by a short list of common
  given names, and by what the corpus itself teaches: :func:`learnt_names` counts over all rows how often a capitalised
  word stands where only a person's name does (sender lines, next to a mail address, attribution lines, below a closing
  formula) and how often it stands with a capital at all. A word that does so in ``MIN_ROWS`` rows and ``MIN_SHARE`` of
  its rows is a name wherever it is met again.
* Spans are mapped to source characters; where spans overlap, the more specific type wins.

The learnt words go to the tasks as a broadcast while there are at most ``MAX_NAMES`` of them; more of them are joined
to the words of each text instead.

Technical data is told apart by form and context: versions, IP addresses, order, serial and inventory numbers, counters
and machine accounts are no phones, identity numbers or mail addresses.

Defined cases: null text has no span and stays null; empty text stays empty; a row delivered several times counts once;
texts of any length are handled whole; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.words import WORD

TYPES = ("EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME")

# fixed values: common given names
RU_NAMES = (
    "александр александра алексей алина алиса алла анастасия анатолий андрей анна антон антонина аркадий артём артур богдан борис вадим валентин валентина валерий валерия варвара василий "
    "василиса вера вероника виктор виктория виталий владимир владислав владислава вячеслав галина геннадий георгий герман глеб григорий дарья даниил данила денис дмитрий ева евгений евгения "
    "егор екатерина елена елизавета ефим жанна захар зинаида зоя иван игорь илья инна ирина карина кира кирилл клавдия константин кристина ксения лариса лев леонид лидия лилия людмила "
    "майя макар максим маргарита марина мария марк матвей милана мирон михаил надежда назар наталья ника никита николай нина оксана олег олеся ольга павел пётр полина раиса регина "
    "роман руслан савелий светлана семён сергей софия софья станислав степан таисия тамара тарас татьяна тимофей тимур ульяна фёдор филипп эдуард элина эльвира эмма юлиан юлия юрий яна ярослав"
)
LATIN_NAMES = (
    "alice amelia andrea andreas anna anke anja anton barbara benjamin bernd birgit carl caroline charles charlotte christian christine christopher claudia daniel david "
    "dieter dorothy edward elizabeth emily emma erik ethan eva florian frank franz fritz george gerhard greta hannah hans harold harry heike heinz helen henry "
    "isabella jack jacob james jane jason jens jennifer jessica joachim johanna john jonas jonathan joseph jörg julia jürgen karin karl katharina kenneth kevin klaus kurt "
    "lars laura lena leon linda lothar lucas lukas luise manfred margaret maria marie markus martin mary matthew matthias michael monika natalie nathan nicholas nicole nina nora "
    "oliver olivia oskar otto patricia patrick paul peter petra philip rachel ralf rebecca richard robert rosa ruth ryan samuel sandra sarah sebastian simon sophia stefan "
    "stephen steven susan sven theodor thomas timothy tobias tom uwe ursula victoria vincent walter wilhelm william wolfgang"
)
_TRANSLIT = dict(zip("абвгдезийклмнопрстуфхцъыьэ", "abvgdeziyklmnoprstufhc y e")) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": "", "ц": "ts", "ы": "y", "э": "e", "х": "kh"}


def _latin(name: str, yo: str) -> str:
    return "".join(_TRANSLIT.get(c, c) for c in name.replace("ё", yo))


_RU = frozenset(RU_NAMES.split()) | {n.replace("ё", "е") for n in RU_NAMES.split()}
_LATIN = frozenset(LATIN_NAMES.split()) | {_latin(n, yo) for n in RU_NAMES.split() for yo in ("yo", "e", "io")}
#: Names that are also common words or parts of device names: only counted with a capital.
_CAPITAL_ONLY = frozenset("лев роман вера надежда марк мария ева ника эмма лилия роза mark rosa frank jack tom harry carl paul eva nora leon max may will rose anke lars roman lev nika vera".split())


def cases(name: str) -> set[str]:
    """The other cases of a Russian name in the singular: Гульнара, -ы, -е, -у, -ой; Степан, -а, -у, -ом, -е."""
    if len(name) < 4 or not "а" <= name[0] <= "я":
        return set()
    stem, end = name[:-1], name[-1]
    if end == "а":
        return {stem + x for x in ("ы", "и", "е", "у", "ой")}
    if end == "я":
        return {stem + x for x in ("и", "е", "ю", "ей")}
    if end in "йь":
        return {stem + x for x in ("я", "ю", "ем", "е")}
    return {name + x for x in ("а", "у", "ом", "е")} if end not in "еёиоуыэю" else set()


_OBLIQUE = frozenset(x for n in _RU - _CAPITAL_ONLY for x in cases(n)) - _RU
_NAMES = _RU | _LATIN | _OBLIQUE

_AT_WORDS = r"(?:\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|\(\s*собака\s*\)|\[\s*собака\s*\]|\bсобака\b|\(\s*@\s*\)|\bat\b|<at>)"
_DOT_WORDS = r"(?:\(\s*dot\s*\)|\[\s*dot\s*\]|\{\s*dot\s*\}|\(\s*точка\s*\)|\[\s*точка\s*\]|\bточка\b|\bdot\b|\(\s*punkt\s*\)|\bpunkt\b)"
_AT_TRIGGER = re.compile(r"\(\s*(?:at|собака|@)\s*\)|\[\s*(?:at|собака)\s*\]|\{\s*at\s*\}|\bсобака\b|\bat\b[^\n]{1,40}\bdot\b|@[^\n]{1,40}(?:\bdot\b|точка|\[dot\])", re.I)
_AT_SIGNS = frozenset(["at", "собака"])
_DISGUISED = re.compile(
    rf"(?<![\w.+-])(?P<local>[\w.+-]{{1,64}}(?:\s*{_DOT_WORDS}\s*[\w+-]{{1,64}}){{0,3}})(?P<at>\s*{_AT_WORDS}\s*|\s*@\s*)(?P<host>[\w-]+(?:(?:\s*{_DOT_WORDS}\s*|\.)[\w-]+){{1,4}})",
    re.I,
)
_DOT = re.compile(rf"\s*{_DOT_WORDS}\s*", re.I)

# fixed values: words for digits
DIGITS = {
    "ноль": "0", "нуль": "0", "один": "1", "два": "2", "три": "3", "четыре": "4", "пять": "5", "шесть": "6", "семь": "7", "восемь": "8", "девять": "9",
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
_DIGIT_SET = frozenset(DIGITS)
_DIGIT_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?:\b(?:плюс|plus)\s+)?\b(?:{_DIGIT_WORD})\b(?:[\s,;.-]+(?:(?:{_DIGIT_WORD})\b|\d{{1,4}}\b)){{5,}}", re.I)

#: Ends of mail domains that make a bare "at ... dot ..." a disguise.
_TLD = frozenset("com org net edu gov info biz io eu de ru uk at ch fr it es pl ua by kz su example test invalid local".split())

#: One character for one: full-width signs and digits of other scripts.
_FULLWIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord("﹫"): "@", ord("․"): ".", ord("‐"): "-", ord("‑"): "-", ord("‒"): "-", ord("−"): "-"} | {base + d: str(d) for base in (0x660, 0x6F0, 0x966, 0xE50) for d in range(10)}
_WIDE = re.compile("[！-～﹫․‐-‒−٠-٩۰-۹०-९๐-๙]")
_CYR, _LAT = "аеорсухкмнтвіАЕОРСУХКМНТВІ", "aeopcyxkmhtbiAEOPCYXKMHTBI"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYR, _LAT), str.maketrans(_LAT, _CYR)
_MIX_CUE = re.compile(r"[A-Za-z][А-яЁёІі]|[А-яЁёІі][A-Za-z]")
_MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-z][А-яЁёІі]|[А-яЁёІі][A-Za-z])[\w.@+-]*")

_EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]{0,63}@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w@])")
_PHONE = re.compile(
    r"(?<![\w.+])(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{2,5}\)|\d{2,5})(?:[ .-]{0,2}\d{2,7}){1,4}"
    r"|\+\d{10,14}"
    r"|[78][ -]?\(\d{3,4}\)[ -]?\d{2,3}[ -]?\d{2}[ -]?\d{2}"
    r"|[78][ .-]\d{3}[ .-]\d{3}[ .-]\d{2}[ .-]\d{2}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|(?P<bare>[78]9\d{9})"
    r"|(?P<ten>[2-9]\d{9})"
    r"|(?P<local>0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,5})?)"
    r")(?:,?\s*(?:доб|ext|Durchwahl)\.?\s*\d{1,5})?(?![\w-])(?!\.\d)"
)
#: What every phone holds: six digits with nothing but signs of phones between them.
_MANY_DIGITS = re.compile(r"\d(?:[ ()./+-]{0,4}\d){5}")
_PHONE_CUE = re.compile(r"(?:тел|моб|сот|факс|звон|номеру|наберите|whatsapp|phone|tel|cell|mob|call|dial|fax|ring|urgent|ruf|handy|durchwahl|срочно|\bm:)[^\n\d]{0,24}$", re.I)
#: Ten digits in a row are no phone unless one is asked to call them.
_CALL_CUE = re.compile(r"(?<!\w)(?:тел|моб|звон|позвон|набер|phone|tel\b|call|dial|fax|ruf|handy)\w*[^\n\d]{0,16}$", re.I)
_NOT_PHONE = re.compile(r"(?:сер(?:ийн)?|завод|зав\.|инв|заказ|счётчик|счетчик|сборка|верси|serial|order|counter|invent|build|version|auftrag|zähler|№|port|порт|канал|код|code)[^\n\d]{0,18}$", re.I)

_ID = re.compile(
    r"(?:\bпаспорт\w*(?:\s*:)?(?:\s*(?:РФ|гражданина))?(?:\s*сери[ияй]\w*)?\s*(?:№|N)?\s*\d{2}\s?\d{2}\s*(?:№|N|номер)?\s*\d{6}\b"
    r"|\bснилс\w*\s*(?:№|:|номер)?\s*\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}\b"
    r"|\bинн\s*(?:физ\w*\.?(?:\s*лица)?|сотрудника|гражданина|:)?\s*(?:№|:)?\s*\d{12}\b"
    r"|\b(?:удостоверени\w+(?:\s*личности)?|водительск\w+\s+удостоверени\w+|вид на жительство|загранпаспорт)\s*(?:№|:|серии)?\s*[A-ZА-Я0-9]{0,4}[- ]?(?:№\s*)?\d{6,9}\b"
    r"|\b(?:passport|reisepass)(?:\s*(?:no|number|nr)\b\.?|\s*nummer)?\s*[:#]?\s*[A-Z]{0,2}\d{6,9}\b"
    r"|\b(?:ssn|social security(?:\s*(?:no|number|nr)\b\.?)?)\s*[:#]?\s*\d{3}-?\d{2}-?\d{4}\b"
    r"|\b(?:national id|id card|identity card|personalausweis|ausweisnummer|ausweis-nr\.?|steuer-?id|sozialversicherungsnummer|driver'?s licen[cs]e)(?:\s*(?:no|number|nr)\b\.?)?\s*[:#]?\s*[A-Z0-9]{0,4}\d{6,11}(?:/\d{2,4})?\b)",
    re.I,
)
#: Gates: what every match of a detector begins with or holds, on lower case, so that they never shut out a match.
_ID_STEMS = ("паспорт", "снилс", "инн", "удостоверени", "водительск", "вид на жительство", "passport", "reisepass", "ssn", "social security", "national id", "id card", "identity card", "ausweis", "steuer", "sozialversicherungsnummer", "driver")
_ID_CUE = re.compile(r"\b(?:паспорт|загранпаспорт|снилс|инн(?![^\W\d_])|удостоверени|водительск|вид на жительство|passport|reisepass|ssn|social security|national id|id card|identity card|personalausweis|ausweis|steuer|sozialversicherungsnummer|driver)")

_RU_STREET = r"(?:ул\.|улиц[аеыу]|пр-т|просп\.|проспект[еа]?|пр\.|пер\.|переулок|переулке|бульвар|б-р|шоссе|ш\.|наб\.|набережная|пл\.|площадь|проезд|тупик|мкр\.)"
_RU_HOUSE = r"(?:,?\s*(?:д\.|дом|стр\.|строение|влад\.)\s*|,\s*|\s+)\d{1,4}[а-яё]?(?:[/-]\d{1,4})?"
_RU_TAIL = r"(?:,?\s*(?:корп(?:ус|\.)?|к\.|стр\.|строение|лит\.)\s*\d{1,3}[а-яё]?)?(?:,?\s*(?:кв(?:артира|\.)?|оф(?:ис|\.)?|пом\.|комн\.)\s*\d{1,4})?"
_RU_CITY = r"(?:\b\d{6},?\s*)?(?:(?:\bг\.|\bгород|\bпос\.|\bс\.|\bдер\.)\s*)?(?:\b[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)*,\s*)?"
_ADDRESS_RU = re.compile(rf"{_RU_CITY}(?:\b{_RU_STREET}\s*(?:\d+-?[а-яё]*\s)?[А-ЯЁа-яё][а-яё]+(?:[- ][А-ЯЁа-яё][а-яё]+){{0,2}}?{_RU_HOUSE}|\b[А-ЯЁ][а-яё]+(?:ая|ый|ий|ой|ое)\s+(?:улица|ул\.|проспект|переулок|площадь|набережная|шоссе|проезд){_RU_HOUSE}){_RU_TAIL}", re.I)
_EN_STREET = r"(?:street|st\.|road|rd\.|way|lane|ln\.|drive|dr\.|avenue|ave\.|boulevard|blvd\.|court|square|terrace|crescent|close|row)"
_ADDRESS_EN = re.compile(
    rf"(?:\b[A-Z][a-z]+(?: [A-Z][a-z]+)?,\s+)?(?<![\d.])\b\d{{1,4}}[A-Za-z]?\s+(?:[A-Z][a-z]+\s+){{1,3}}(?i:{_EN_STREET})(?!\w)(?:,\s*(?i:apt|flat|unit|suite)\.?\s*\d{{1,4}})?(?:,\s+[A-Z][a-z]+(?: [A-Z][a-z]+)?)?"
    rf"|(?i:\bno\.\s*\d{{1,4}}\s+(?:[a-z]+\s+){{1,3}}{_EN_STREET}(?!\w)(?:,\s*(?:apt|flat|unit|suite)\.?\s*\d{{1,4}})?)"
    rf"|(?i:(?<![\d.])\b\d{{1,4}}\s+(?:[a-z]+\s+){{1,3}}{_EN_STREET},\s*(?:apt|flat|unit|suite)\.?\s*\d{{1,4}})"
)
_ADDRESS_DE = re.compile(r"(?<![\w-])[A-ZÄÖÜa-zäöüß][A-Za-zäöüÄÖÜß-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer)\s+\d{1,4}[a-z]?\b(?:(?:,|\s+in)\s+\d{5}\s+[A-ZÄÖÜ][a-zäöüß]+)?")
_RU_STREET_CUE = re.compile(rf"\b{_RU_STREET}")
_RU_STREET_STEMS = ("ул.", "улиц", "пр-т", "просп", "пр.", "пер.", "переул", "бульвар", "б-р", "шоссе", "ш.", "наб.", "набережн", "пл.", "площадь", "проезд", "тупик", "мкр.")
#: Letters that patterns without case take for others, though their lower case differs.
_RARE = re.compile("[ſıİᲀ-ᲈ]")
_NUMBER = re.compile(r"\d+")
_EN_ADDRESS_CUE = re.compile(rf"(?:[a-z]\s+){_EN_STREET}")
# fixed values: street words that stand before the name, with the number ahead (French) or behind (Spanish, Italian)
_FR_STREET, _ES_STREET = "rue avenue boulevard place quai impasse chemin allée cours", "calle avenida plaza paseo via viale piazza corso"
_ROMANCE = frozenset(f"{_FR_STREET} {_ES_STREET}".split())
_PLACE = r"(?:(?:de|du|des|del|della|la|las|los|le|les|l'|d')\s*)*[A-ZÀ-Ý][\w'’-]+(?:\s(?:(?:de|du|des|del|la)\s)*[A-ZÀ-Ý][\w'’-]+){0,2}"
_CITY = r"(?:,\s*(?:\d{5}\s+)?[A-ZÀ-Ý][\w-]+)?"
_ADDRESS_ROMANCE = re.compile(
    rf"(?<![\d.])\b\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?i:{_FR_STREET.replace(' ', '|')})\s+{_PLACE}{_CITY}|\b(?i:{_ES_STREET.replace(' ', '|')})\s+{_PLACE},?\s+(?:n[.º°]\s*)?\d{{1,4}}(?!\w){_CITY}"
)
_DE_ADDRESS_CUE = re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|ring|damm|ufer)\s+\d")

_RU_SURNAME = r"[А-ЯЁ][а-яё]+(?:[оеё]в|[иы]н|[оеё]ва|[иы]на|ский|цкий|ская|цкая|енко|чук|дзе|швили|ян)(?:-[А-ЯЁ][а-яё]+)?"
_INITIALS = re.compile(
    rf"(?<![\w.])(?:{_RU_SURNAME}\s+[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.)?|(?<!\d\s)(?<!\d)[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.\s?)?{_RU_SURNAME}(?!\w)"
    r"|(?<!\d\s)(?<![\d.]\s)[A-Z]\. (?:[A-Z]\. )?(?!(?:The|This|That|These|With|When|What|Why|Where|You|Your|Period|Address|Port|Per|Die|Der|Das|Mit|Um|Warum|Datei|Baustein|Any|For|From|All|Our|Its|Make|After|File|Library|Channel|Counter|Parameter|Function|Revision|Serial|Order|Rack|Ticket|Package|Service)\b)[A-Z][a-zäöüß]{3,}(?!\w)"
    r"|[A-Z][a-zäöüß]{3,}, [A-Z]\.(?: ?[A-Z]\.)?)"
)
_PATRONYMIC = re.compile(r"(?<!\w)(?:[А-ЯЁ][а-яё]+[- ]){0,2}[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|инична|ьич|итич|итична)(?!\w)(?: [А-ЯЁ][а-яё]+(?:[оеё]ва?|[иы]на?|ск(?:ий|ая)|цк(?:ий|ая))(?:-[А-ЯЁ][а-яё]+)?)?")
_CALLED = r"(?P<name>(?:[A-ZА-ЯЁÄÖÜ][\w’'-]+|[A-ZА-ЯЁ]\.)(?:[ \t]+(?:[A-ZА-ЯЁÄÖÜ][a-zа-яёäöüß’'-]+|[A-ZА-ЯЁ]\.)){0,2})(?=\s*(?:[,<!\n\r]|$|пишу|writing))"
#: Sender lines, checked to begin their line, and forms of address: both begin with letters, so that they are found fast.
_SENDER_LINE = re.compile(rf"(?:От|From|Von|Отправитель)[ \t]*:[ \t]*{_CALLED}")
_BEFORE_SENDER = re.compile(r"(?:^|\n)[ \t>»|]*$")
_CALLING = re.compile(rf"(?:Уважаем(?:ый|ая|ый\(ая\))|Dear|Hello|Hallo|Guten Tag|Меня зовут|My name is|my name is|Mein Name ist|mein Name ist|(?:Mr|Mrs|Ms|Herr|Frau|г-н|г-жа)\.?)\s+{_CALLED}")
#: Words of which the form of address, the sender line and the request for a person hold one.
_ADDRESSED = frozenset("уважаемый уважаемая dear hello hallo guten зовут name mr mrs ms herr frau".split())
_SENDER = frozenset("от from von отправитель".split())
_ASKING = frozenset("ask contact colleague спросите обратитесь коллега сотрудник сотрудница коллеге коллеги коллегу сотрудника сотруднику сотрудницы сотруднице".split())
_ASKED = re.compile(
    r"(?:\b(?:[Aa]sk(?: for)?|[Cc]ontact|[Cc]olleague)[ \t]+|\b(?:[Сс]просите|[Оо]братитесь к|[Кк]оллег[аиуе]|[Сс]отрудни(?:к|ка|ку|ца|цы|це))[ \t]+)"
    r"(?P<name>[A-ZА-ЯЁ][a-zа-яё’'-]+[ \t]+[A-ZА-ЯЁ][a-zа-яё]*[’'-]?[A-ZА-ЯЁ]?[a-zа-яё]+(?![\w-]))"
)
#: A surname by its form, in any case, behind another capitalised word.
_SURNAMED = re.compile(r"[А-ЯЁ][а-яё]+[ \t]+[А-ЯЁ][а-яё]+(?:(?:[оеё]в|[иы]н)(?:а|у|ой|ым|е)|(?:енко|швили)|(?:[оеё]в|[иы]н)|(?:ск|цк)(?:ий|ого|ому|им|ая|ую))(?![\w-])")
_PATRONYMIC_ENDS = ("ович", "евич", "овна", "евна", "инична", "ьич", "итич", "итична")
_INITIAL_CUE = re.compile(r"[A-ZА-ЯЁ]\.")
_NO_NAME = frozenset("support team all colleagues sir madam desk helpdesk customer служба поддержка поддержки коллеги клиент клиенты техподдержка portal robot zusammen kollegen damen herren service office admin test".split())
_NEAR = re.compile(r"[ \t]*,?[ \t]+((?:[A-ZА-ЯЁÄÖÜ]\.[ \t]?){1,2}[A-ZА-ЯЁÄÖÜ][\w’-]+|(?:[A-ZА-ЯЁÄÖÜ]\.[ \t]?){1,2}|[A-ZА-ЯЁÄÖÜ][a-zа-яёäöüß’-]+(?:-[A-ZА-ЯЁÄÖÜ][\w]+)?(?:[ \t]+[А-ЯЁ][а-яё]+(?:вич|вна|ична|ьич|тич))?)")
_BEFORE = re.compile(r"([A-ZА-ЯЁÄÖÜ][\wа-яё’]+(?:-[A-ZА-ЯЁ][\w]+)?),?[ \t]+$")


def _may_spell(text: str, words: set[str]) -> bool:
    """Whether six digit words and numbers can stand in a row."""
    return len(words) > 1 or bool(words) and text.lower().count(min(words)) + len(_NUMBER.findall(text)) >= 6


def normalise(text: str, present: set[str] | None = None) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text without disguises, and the rewrites that change lengths as (start, end there, start, end in the source)."""
    if _WIDE.search(text):
        text = text.translate(_FULLWIDTH)
    if _MIX_CUE.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_TO_LATIN if "@" in m[0] or sum("a" <= c.lower() <= "z" for c in m[0]) * 2 >= len(m[0]) else _TO_CYRILLIC), text)
    edits: list[tuple[int, int, str]] = []
    if (present is None or "@" in text or not _AT_SIGNS.isdisjoint(present)) and _AT_TRIGGER.search(text):
        for m in _DISGUISED.finditer(text):
            at, host = m["at"], m["host"]
            plain = at.strip().lower()
            hidden = bool(_DOT.search(host))
            if plain == "@":
                sure = hidden
            elif plain == "at":
                sure = hidden and host.rsplit(None, 1)[-1].lower() in _TLD
            else:
                sure = hidden or "." in host
            if sure:
                new = _DOT.sub(".", m["local"]) + "@" + _DOT.sub(".", host)
                if _EMAIL.fullmatch(new):
                    edits.append((m.start(), m.end(), new))
    if present is None or _may_spell(text, present & _DIGIT_SET):
        for m in _SPELLED.finditer(text):
            plus = "+" if m[0][:4].lower() in ("плюс", "plus") else ""
            digits = "".join(DIGITS.get(w.lower(), w) for w in re.findall(r"\w+", m[0]) if w.lower() in DIGITS or w.isdigit())
            edits.append((m.start(), m.end(), plus + digits))
    if not edits:
        return text, []
    edits.sort()
    out, spans, low, size = [], [], 0, 0
    for a, b, new in edits:
        if a < low:
            continue
        out += [text[low:a], new]
        size += a - low
        spans.append((size, size + len(new), a, b))
        size += len(new)
        low = b
    return "".join([*out, text[low:]]), spans


def _to_source(a: int, b: int, spans: list[tuple[int, int, int, int]], starts: list[int]) -> tuple[int, int]:
    def place(p: int, end: bool) -> int:
        k = bisect_right(starts, p - end) - 1
        if k < 0:
            return p
        na, nb, sa, sb = spans[k]
        if p < nb or (end and p == nb):
            return sb if end else sa
        return sb + p - nb

    return place(a, False), place(b, True)


def _phones(text: str):
    if not _MANY_DIGITS.search(text):
        return
    for m in _PHONE.finditer(text):
        digits = sum(ch.isdigit() for ch in re.split(r"доб|ext|Durch", m[0])[0])
        if not 10 <= digits <= 15 and not m["local"]:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        if m["bare"] or m["local"] or m["ten"]:
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()] + "#" + text[m.end() : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
            alone = re.sub(r"<[^<>]*>|[\s>»|#:]", "", line) == ""
            if _NOT_PHONE.search(before) or not (_CALL_CUE if m["ten"] else _PHONE_CUE).search(before) and not (alone and m["bare"]):
                continue
        elif not m[0].startswith("+") and _NOT_PHONE.search(before):
            continue
        yield m.start(), m.end()


_JOINED = frozenset("_@.+-")


def _places(text: str, low: str, word: str):
    """Starts of a lower-case word in the text, as a whole word."""
    if len(low) != len(text):  # a letter whose lower case is longer
        yield from (m.start() for m in WORD.finditer(text) if m[0].lower() == word)
        return
    at = low.find(word)
    while at >= 0:
        b = at + len(word)
        if not (at and (low[at - 1].isalnum())) and not low[b : b + 1].isalnum():
            yield at
        at = low.find(word, b)


def _given_names(text: str, low: str, listed: set[str], learnt: set[str], given: set[str]):
    """Spans around words that are names: listed ones, and learnt ones, which need a capital or another name beside them; ``given``: the learnt given names."""
    for name in listed | learnt:
        for a in _places(text, low, name):
            b = a + len(name)
            if text[a - 1 : a] in _JOINED and a or text[b : b + 1] in ("@", "_"):
                continue
            word = text[a:b]
            if not word[0].isupper():
                beside, surname = _WORD_AFTER.match(low, b), _SURNAME_AFTER.match(text, b)
                paired = beside and (beside[1] in learnt or beside[1] in listed)
                if (name in _CAPITAL_ONLY or name in _OBLIQUE or name not in listed) and not paired and not (surname and name in listed):
                    continue
                b = beside.end(1) if paired else surname.end() if surname else b
            if text[b : b + 1] == "." and text[b + 1 : b + 2].isalnum() or text[b : b + 2].startswith(("-", "_")) and text[b + 1 : b + 2].isdigit():
                continue
            # a given name takes its neighbours with it, a surname initials and other names
            first = name in listed or name in given
            if n := (_NEAR if first else _INITIALS_AFTER).match(text, b):
                b = n.start(1) + len(n[1].rstrip())
            if (p := _BEFORE.search(text, max(0, a - 40), a)) and p[1].lower() not in _NO_NAME and not _COMMON.match(p[1]):
                if first and name not in _OBLIQUE or p[1].lower() in learnt or p[1].lower() in listed:
                    a = p.start(1)
            yield a, b


_INITIALS_AFTER = re.compile(r"[ \t]*,?[ \t]+((?:[A-ZА-ЯЁÄÖÜ]\.[ \t]?){1,2})")
_WORD_AFTER = re.compile(r",?[ \t]+([^\W_]+)")
_SURNAME_AFTER = re.compile(r"[ \t]+[^\W\d_]{3,}(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ский|цкий|ская|цкая|ова-\w+)(?!\w)")
_COMMON = re.compile(r"(?:Прибор|Подписал|Здравствуйте|Уважаем\w*|Вопрос|Это|От|From|Von|Dear|Hello|Hallo|Tag|By|It|Please|Write|On|Am|At|Меня|Контакт|Спросите|Ответственн\w*|Привет|Коллеги|Morning|Hi)$")


def find(text: str | None, names: frozenset[str] | set[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, type) of each piece of personal information, in source characters and in order. ``names``: learnt words, lower-cased; with a plus as well where they are given names."""
    if not text:
        return []
    low = text.lower()
    present = set(WORD.findall(low))
    plain, spans = normalise(text, present)
    if plain is not text:
        low = plain.lower()
        present = set(WORD.findall(low))
    found: list[tuple[int, int, str]] = []
    if "@" in plain:
        found += [(*m.span(), "EMAIL") for m in _EMAIL.finditer(plain)]
    rare = not low.isascii() and _RARE.search(plain)
    if rare or any(stem in low for stem in _ID_STEMS) and _ID_CUE.search(low):
        found += [(*m.span(), "ID_NUMBER") for m in _ID.finditer(plain)]
    found += [(a, b, "PHONE") for a, b in _phones(plain)]
    if rare or any(stem in low for stem in _RU_STREET_STEMS) and _RU_STREET_CUE.search(low):
        found += [(*m.span(), "ADDRESS") for m in _ADDRESS_RU.finditer(plain)]
    if rare or _EN_ADDRESS_CUE.search(low):
        found += [(*m.span(), "ADDRESS") for m in _ADDRESS_EN.finditer(plain)]
    if _DE_ADDRESS_CUE.search(plain):
        found += [(*m.span(), "ADDRESS") for m in _ADDRESS_DE.finditer(plain)]
    if not _ROMANCE.isdisjoint(present):
        found += [(*m.span(), "ADDRESS") for m in _ADDRESS_ROMANCE.finditer(plain)]
    listed, learnt = present & _NAMES, present & names
    if listed or learnt:
        found += [(a, b, "NAME") for a, b in _given_names(plain, low, listed, learnt, {w for w in learnt if f"+{w}" in names})]
    if rare or any(end in low for end in _PATRONYMIC_ENDS):
        found += [(*m.span(), "NAME") for m in _PATRONYMIC.finditer(plain)]
    if not low.isascii():
        found += [(*m.span(), "NAME") for m in _SURNAMED.finditer(plain) if not (before := plain[m.start() - 1 : m.start()]).isalnum() and before not in ("_", "-")]
    if _INITIAL_CUE.search(plain):
        found += [(*m.span(), "NAME") for m in _INITIALS.finditer(plain)]
    called: list[re.Match] = []
    if not _ADDRESSED.isdisjoint(present) or "г-" in low:
        called += [m for m in _CALLING.finditer(plain) if not plain[m.start() - 1 : m.start()].isalnum()]
    if ":" in plain and not _SENDER.isdisjoint(present):
        called += [m for m in _SENDER_LINE.finditer(plain) if _BEFORE_SENDER.search(plain, max(0, plain.rfind("\n", 0, m.start())), m.start())]
    found += [(*m.span("name"), "NAME") for m in called if not _NO_NAME & set(WORD.findall(m["name"].lower()))]
    if not present.isdisjoint(_ASKING):
        found += [(*m.span("name"), "NAME") for m in _ASKED.finditer(plain) if not _NO_NAME & set(WORD.findall(m["name"].lower()))]
    if not found:
        return []
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (TYPES.index(x[2]), x[0] - x[1])):
        k = bisect_right(starts, a)
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= starts[k]):
            starts.insert(k, a)
            taken.insert(k, (a, b, kind))
    edits = [x[0] for x in spans]
    return [(*_to_source(a, b, spans, edits), kind) for a, b, kind in taken]


def mask(text: str | None, names: frozenset[str] | set[str] = frozenset()) -> str | None:
    if not text:
        return text
    out, low = [], 0
    for a, b, kind in find(text, names):
        out += [text[low:a], f"[{kind}]"]
        low = b
    return "".join([*out, text[low:]])


#: A word is a name if it stands as one in so many rows and in such a share of the rows that have it with a capital.
MIN_ROWS, MIN_SHARE = 3, 0.3
#: Learnt names sent to the tasks at most (about 100 bytes each); more are joined.
MAX_NAMES = 200_000

_PART = r"[A-ZА-ЯЁÄÖÜ][a-zа-яёäöüß’'-]+(?:-[A-ZА-ЯЁÄÖÜ][a-zа-яёäöüß]+)?"
_TWO = rf"({_PART}),?[ \t]+({_PART})"
#: (words of which a text needs one, or a sign; places where two capitalised words are a person's name)
_TEACHING = (
    (":", _SENDER, re.compile(rf"^[ \t>»|]*(?:От|От кого|From|Von|Отправитель)[ \t]*:[ \t]*{_TWO}", re.M)),
    ("@", None, re.compile(rf"{_TWO}[\"»]?\s*(?:<|&lt;|\[mailto:)\s?[^\s<>@]+@")),
    (":", frozenset("wrote said пишет писал писала написал написала schrieb".split()), re.compile(rf"{_TWO}[ \t]+(?:wrote|said on|пишет|писал|написал|schrieb)")),
    ("\n", None, re.compile(
        r"(?:С уважением|с уважением|С наилучшими пожеланиями|с наилучшими пожеланиями|С ув\.|Всего доброго|Regards|regards|Wishes|wishes|Sincerely|sincerely|Cheers|cheers|BR|KR|MfG|VG|LG|Grüße|Grüßen|Gruß|--+|__+|—)[,.!]?"
        rf"[ \t]*\r?\n\s*(?:[>»|][ \t]*)?(?:<[^<>\n]*>\s*)*{_TWO}[ \t]*(?:<[^<>\n]*>)?\r?$", re.M)),
)
_CAPITAL = re.compile(r"(?<![^\W_])[A-ZА-ЯЁÄÖÜ][a-zа-яёäöüß’-]+(?![^\W_])")


def taught(text: str) -> tuple[dict[str, bool], set[str]]:
    """(words that stand as a name in the text and whether as a given name, words that stand with a capital in it), lower-cased."""
    capital = {w.lower() for w in _CAPITAL.findall(text)}
    out: dict[str, bool] = {}
    for sign, cues, place in _TEACHING:
        if sign in text and (cues is None or any(cue in text or cue.capitalize() in text for cue in cues)):
            for m in place.finditer(text):
                turned = "," in text[m.end(1) : m.start(2)]
                for w, first in ((m[1].lower(), not turned), (m[2].lower(), turned)):
                    if w in capital and w not in _NO_NAME:
                        out[w] = first
    return out, capital


def learnt_names(records: DataFrame, text_col: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(word) of every name that the corpus teaches; a given name in all its cases and once more with a plus before it.

    Counts are combined in each task before they are shuffled. A name of several copies of a row counts with each.
    """

    def count(batches):
        total: dict[str, list[int]] = {}

        def rows():
            return pd.DataFrame([(w, *n) for w, n in total.items()], columns=["word", "named", "given", "capital"])

        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                names, capital = taught(text)
                for w in capital:
                    total.setdefault(w, [0, 0, 0])[2] += 1
                for w, first in names.items():
                    total[w][0] += 1
                    total[w][1] += first
            if len(total) > 200_000:
                yield rows()
                total.clear()
        yield rows()

    texts = records.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    counts = texts.mapInPandas(count, "word STRING, named BIGINT, given BIGINT, capital BIGINT").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("named", "given", "capital")])
    names = counts.filter((F.col("named") >= min_rows) & (F.col("named") >= min_share * F.col("capital")))

    @F.pandas_udf("array<string>")
    def forms(words: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([[w, *([f"+{w}", *cases(w)] if first else [])] for w, first in zip(words, given)], dtype=object)

    return names.select(F.explode(forms("word", F.col("given") * 2 > F.col("named"))).alias("word")).distinct()


def _with_names(rows: DataFrame, names: DataFrame | None):
    """(rows, how a task gets a text's learnt names): a set for all texts, or beyond ``MAX_NAMES`` a column of each text's own."""
    none = F.lit(None).cast("array<string>").alias("names")
    if names is None:
        return rows.select("*", none), None
    few = names.limit(MAX_NAMES + 1).toPandas()["word"]
    if len(few) <= MAX_NAMES:
        return rows.select("*", none), rows.sparkSession.sparkContext.broadcast(frozenset(few))

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([[x for w in set(WORD.findall(normalise(t)[0].lower())) for x in (w, f"+{w}")] if t else [] for t in texts], dtype=object)

    # a text is known by a wide hash of itself, so that copies are looked up once and null keys stay apart from texts
    key = F.sha2("text", 256).alias("_text")
    own = rows.select("text", key).filter(F.col("text").isNotNull()).dropDuplicates(["_text"]).select("_text", F.explode(words("text")).alias("word"))
    own = own.join(names, "word").groupBy("_text").agg(F.collect_set("word").alias("names"))
    return rows.select("*", key).join(own, "_text", "left").drop("_text"), None


def types_found(records: DataFrame, id_col: str, text_col: str, names: DataFrame | None = None) -> DataFrame:
    """(rec_id, pii_type): each type a record holds, once. ``names``: of :func:`learnt_names`."""
    rows = records.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows, shared = _with_names(rows, names)

    def run(batches):
        known = shared.value if shared else frozenset()
        for batch in batches:
            out = [(i, kind) for i, t, own in zip(batch["rec_id"], batch["text"], batch["names"]) for kind in {k for *_, k in find(t, known if own is None else set(own))}]
            if out:
                yield pd.DataFrame(out, columns=["rec_id", "pii_type"])

    return rows.mapInPandas(run, "rec_id BIGINT, pii_type STRING").distinct()


def masked(records: DataFrame, id_col: str, text_col: str, order_col: str, names: DataFrame | None = None) -> DataFrame:
    """(rec_id, masked_text): each record once, of several deliveries the last one."""
    rows = records.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"), F.col(order_col).alias("_at"))
    rows, shared = _with_names(rows, names)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, names: pd.Series) -> pd.Series:
        known = shared.value if shared else frozenset()
        return pd.Series(np.array([mask(t, known if own is None else set(own)) for t, own in zip(texts, names)], dtype=object), dtype=object)

    rows = rows.select("rec_id", replaced("text", "names").alias("masked_text"), "_at")
    return rows.groupBy("rec_id").agg(F.max_by("masked_text", F.struct("_at", "masked_text")).alias("masked_text"))
