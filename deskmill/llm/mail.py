"""What the sender of a mail or portal note newly wrote.

Line rules for several languages mark everything else: quoted lines below an attribution line, forwarded or replied-to
messages from their divider or header block on, signatures from their closing formula, delimiter or name on,
disclaimers and automatic footers. Lines written between quoted ones stay. Work is per row and needs no shuffle.

Defined cases: null and blank texts have no marked line and an empty or null new text; lines are counted from 0 and end
at "\\n", a "\\r" before it is no content; blank lines are never marked; a prefix such as ``>`` counts as quotation
below an attribution line and with the prefix that its quotation uses, or where two or more lines in a row have ``>``,
so that comparisons, shell prompts and table bars in new text stay; a single header-like line ("From: 4 to 20 mA") is text; a text of nothing but quotation leaves
an empty new text; a row delivered several times is reported once.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKED = "id BIGINT, line_no BIGINT, reason STRING"

_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--[^<>]*--)>")
_PREFIX = re.compile(r"\s*(>+|»+|\|)(?!=)")
_BARE_PREFIX = re.compile(r"\s*>(?:>|\s*$|[ \t]+\S(?!.*[|<=>]))")
_NOT_QUOTED = re.compile(r"\s*>\s*(?:=|[-+]?\d+(?:[.,]\d+)?\s*(?:°|%|[A-Za-zА-я]{1,4}\b)|(?:show|ping|cd|ls|get|set|dir|telnet|ssh)\b)")

_DATE = r"(?:\d{1,4}[./-]\d{1,2}(?:[./-]\d{2,4})?|\d{1,2}\.?\s+[^\W\d]{3,10}\.?|[^\W\d]{3,10}\s+\d{1,2}(?:,|\s)\s*\d{4}|\d{1,2}:\d{2})"
_ATTRIBUTION = re.compile(
    rf"(?:.*\b(?:пишет|писал(?:\(а\)|а)?|написал(?:\(а\)|а)?)(?:\s+{_DATE}.{{0,12}})?\s*:"
    rf"|.*\bwrote(?:\s+on\s+{_DATE})?.{{0,12}}\s*:|.*\bsaid on {_DATE}\s*:|Am\b.*\bschrieb\b.*:|.*\bschrieb am\b.*:|Le\b.*\ba écrit\s*:|El\b.*\bescribió\s*:)$"
)
_ATTRIBUTION_HEAD = re.compile(rf"(?:On|Am)\b.*{_DATE}.*,?$|.*{_DATE}.*<[^<>\s]+@[^<>\s]+>$")
_TIMED = re.compile(r".{2,80},\s*\d{1,2}:\d{2}\s*:$")
_DIVIDER = re.compile(
    r"[-–—_=*\s]*-{2,}\s*(?:Исходное сообщение|Пересылаемое сообщение|Пересланное сообщение|Начало переадресованного сообщения|"
    r"Original Message|Forwarded message|Begin forwarded message|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Message d'origine)\s*-{2,}$"
    r"|(?:Begin forwarded message|Начало переадресованного сообщения)\s*:$",
    re.I,
)
_RULE = re.compile(r"_{16,}$")
_FROM = re.compile(r"(?:From|От|От кого|Von|De)\s*:\s*[^\s\d]")
_HEADER = re.compile(r"(?:From|Sent|Date|To|Cc|Subject|От|От кого|Отправлено|Дата|Кому|Копия|Тема|Von|Gesendet|Datum|An|Betreff)\s*:(?:\s|$)")

_CLOSING = re.compile(
    r"(?:с уважением|с ув\.?|с наилучшими пожеланиями|с найлучшими пожеланиями|всего доброго|всего хорошего|с приветом|искренне ваш\w*|"
    r"(?:best|kind|warm|many)?\s*regards|best wishes|all the best|best|sincerely|sincerely yours|yours (?:sincerely|faithfully|truly)|cheers|br|kr|rgds|"
    r"mfg|lg|vg|mit (?:freundlichen|besten|herzlichen) grüßen|mit freundlichem gruß|(?:viele|beste|schöne|liebe|herzliche) grüße|freundliche grüße|gruß|hochachtungsvoll)\s*[,.!]?",
    re.I,
)
_DELIMITER = re.compile(r"(?:--+|—+|–+|_{2,15}|-\s-)\s*$")
_FOOTER = re.compile(
    r"(?:отправлено (?:с|из|со|через)\b.*|написано на ходу.*|sent (?:from|via)\b.*|get (?:the |)[\w ]*app\b.*|get outlook\b.*|von (?:meinem|unterwegs)\b.*gesendet\.?|gesendet (?:von|mit)\b.*|"
    r"(?:это|данное) (?:автоматическое|письмо (?:создано|отправлено|сформировано) автоматически).*|this is an automat\w+.*|(?:пожалуйста, )?не отвечайте на это (?:письмо|сообщение).*|(?:please )?do not reply to this.*|diese (?:e-?mail|nachricht) wurde automatisch.*)$",
    re.I,
)
_DISCLAIMER = re.compile(
    r"(?:(?:это|настоящее|данное) (?:сообщение|письмо)\b.*(?:предназначен|конфиденциальн)|если вы получили (?:это |данное |)(?:письмо|сообщение)\b.*(?:по ошибке|ошибочно)|уведомление(?: о конфиденциальности)?: |"
    r"мнение автора\b.*|(?:пожалуйста, )?(?:подумайте|позаботьтесь) о(?:б|)\b.*(?:печата|распеча)|"
    r"конфиденциально\b|confidentiality notice|confidential\b|vertraulich\b|disclaimer\b|this (?:message|e-?mail|email)\b.*\b(?:meant|intended|confidential|privileged)|if you (?:got|have received|received|are not)\b.*(?:mistake|error|intended recipient)|"
    r"the views (?:above|expressed)\b|(?:please )?(?:think of|consider) the (?:trees|environment)\b|"
    r"diese (?:nachricht|e-?mail)\b.*(?:vertraulich|bestimmt)|bei irrtümlichem\b|bitte (?:denken sie|prüfen sie)\b.*(?:umwelt|drucken))",
    re.I,
)
_SENTENCE_END = re.compile(r"[.!?…:;]$")
_NAME = re.compile(r"(?:(?:[A-ZА-ЯЁÄÖÜ][\w’'-]+|[A-ZА-ЯЁÄÖÜ]\.),?\s*){2,4}$")
_NAME_LOWER = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)?,?\s[^\W\d_]{3,}(?:-[^\W\d_]+)?$")
_CONTACT = re.compile(r"(?:тел|моб|tel|phone|mob|fax|факс|e-?mail|почта|mail|cell|handy)\b\.?\s*:?|\+?\d[\d\s().-]{7,}(?:$|\s(?:доб|ext))|\S+\s?(?:@|\(at\)|\[at\])\s?\S+|.*[«\"].+[»\"]$|.*\b(?:GmbH|Ltd|Inc|LLC|AG)\.?$", re.I)
_GREETING = re.compile(
    r"(?:здравствуйте|добрый|доброе|доброго|приветствую|привет|коллеги|уважаем\w*|спасибо|благодар\w+|hi\b|hello|dear|good|thank|thanks|guten|hallo|danke|liebe\w*|sehr geehrte)|.*(?:добрый день|здравствуйте|\bhi)[!,.]?$", re.I
)


def _visible(line: str) -> str:
    if "<" in line:
        line = _TAG.sub(" ", line)
    if "&" in line:
        line = html.unescape(line)
    return line.strip()


def _signature(seen: list[str], marks: list[str], low: int, high: int) -> int:
    """First line of the signature that ends the unmarked lines of seen[low:high]; high where there is none."""
    block: list[int] = []
    for i in range(high - 1, low - 1, -1):
        if marks[i] or not seen[i]:
            continue
        v = seen[i]
        closing = _CLOSING.fullmatch(v) or _DELIMITER.fullmatch(v)
        if not closing and (len(v) > 90 or (_SENTENCE_END.search(v) and not _NAME.fullmatch(v) and not _CONTACT.match(v)) or _GREETING.match(v)):
            break
        block.append(i)
    block.reverse()
    for n, i in enumerate(block):
        v = seen[i]
        if _CLOSING.fullmatch(v) or _DELIMITER.fullmatch(v):
            return i
        if _HEADER.match(v) and not _CONTACT.match(v):
            continue
        if _NAME.fullmatch(v) and not any(ch.isdigit() for ch in v) and (n + 1 < len(block) or i > low):
            return i
        if n + 1 < len(block) and _NAME_LOWER.fullmatch(v) and any(_CONTACT.match(seen[j]) for j in block[n + 1 :]):
            return i
    # a closing formula alone on its line begins a signature even where something unknown follows it
    rest = [i for i in range(low, high) if seen[i] and not marks[i]]
    for n, i in enumerate(rest):
        if n and _CLOSING.fullmatch(seen[i]):
            return i
    return high


def _bare_quotation(lines: list[str]) -> set[int]:
    """Lines of quotations without an attribution line: two or more lines in a row that begin with ``>`` and a blank or a further ``>``, none of them a comparison, a prompt or a row of a table."""
    out: set[int] = set()
    run: list[int] = []
    for i, line in enumerate([*lines, ""]):
        if line.lstrip().startswith(">") and _BARE_PREFIX.match(line) and not _NOT_QUOTED.match(line):
            run.append(i)
            continue
        if len(run) > 1:
            out.update(run)
        run = []
    return out


def mark_lines(text: str | None) -> list[str]:
    """For each line its reason not to count as new, '' for new and for blank lines."""
    if not text:
        return []
    lines = text.split("\n")
    n = len(lines)
    seen = [_visible(x) for x in lines]
    solid = [bool(x.strip()) for x in lines]
    marks = [""] * n
    following = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        following[i] = i if solid[i] else following[i + 1]
    prefix, quote, box, end, bare = "", 0, 0, n, _bare_quotation(lines)
    i = 0
    while i < n:
        raw, v = lines[i], seen[i]
        if not solid[i]:
            i += 1
            continue
        low = raw.lower() if "<" in raw else ""
        if low:
            opened = "<blockquote" in low
            signed = 'class="signature"' in low or "class='signature'" in low or "gmail_signature" in low
            if quote or opened:
                quote += low.count("<blockquote") - low.count("</blockquote")
                marks[i] = "quote"
                quote = max(quote, 0)
                i += 1
                continue
            if box or signed:
                box += low.count("<div") - low.count("</div")
                marks[i] = "signature"
                box = max(box, 0)
                i += 1
                continue
        elif quote or box:
            marks[i] = "quote" if quote else "signature"
            i += 1
            continue
        after = following[i + 1]
        nxt = lines[after] if after < n else ""
        if _DIVIDER.match(v) or (_RULE.match(v) and after < n and _FROM.match(seen[after])) or (_FROM.match(v) and after < n and after == i + 1 and _HEADER.match(seen[after])):
            marks[i:] = ["quote" if s else "" for s in solid[i:]]
            end = i
            break
        m = _PREFIX.match(raw)
        if i in bare or m and prefix and m[1][0] == prefix and not (prefix == ">" and _NOT_QUOTED.match(raw)):
            marks[i] = "quote"
        elif v[-1:] == ":" and (_ATTRIBUTION.match(v) or (_TIMED.match(v) and "<blockquote" in nxt.lower())):
            marks[i] = "attribution"
            if (p := _PREFIX.match(nxt)) and not nxt.lstrip().startswith("<"):
                prefix = p[1][0]
            j = i - 1
            if j >= 0 and solid[j] and not marks[j] and _ATTRIBUTION_HEAD.match(seen[j]) and len(seen[j]) < 60 and not re.match(r"(?:On|Am)\b", v):
                marks[j] = "attribution"
        elif _DISCLAIMER.match(v):
            marks[i] = "disclaimer"
        elif _FOOTER.match(v):
            marks[i] = "footer"
        i += 1
    # each run of new lines may end in a signature; only the last one of the message can
    start = _signature(seen, marks, 0, end)
    for k in range(start, end):
        if solid[k] and not marks[k]:
            marks[k] = "signature"
    return marks


def new_text(text: str | None) -> str | None:
    """The text without its marked lines; blank lines at its ends and repeated ones inside fall away."""
    if text is None:
        return None
    kept = [x.rstrip("\r") for x, m in zip(text.split("\n"), mark_lines(text)) if not m]
    return re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", "\n".join(kept)).strip("\n")


def marked_lines(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, reason) of every line not newly written, each once."""

    def run(batches):
        for batch in batches:
            out = [(i, k, m) for i, t in zip(batch["id"], batch["text"]) for k, m in enumerate(mark_lines(t)) if m]
            if out:
                yield pd.DataFrame(out, columns=["id", "line_no", "reason"])

    rows = notes.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInPandas(run, MARKED).groupBy("id", "line_no").agg(F.min("reason").alias("reason"))


def reduced(notes: DataFrame, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """(id, new_text): each row once, of several deliveries the last one.

    Only the key and the reduced text are shuffled, not the mails; a maximum is combined on the map side.
    """

    @F.pandas_udf("string")
    def reduce_text(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([new_text(t) for t in texts], dtype=object), dtype=object)

    rows = notes.select(F.col(id_col).alias("id"), reduce_text(F.col(text_col)).alias("new_text"), F.col(order_col).alias("_at"))
    return rows.groupBy("id").agg(F.max_by("new_text", F.struct("_at", "new_text")).alias("new_text"))
