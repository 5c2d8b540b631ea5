"""Sentence units of texts in many languages and scripts.

A pushdown automaton runs over the marks of a text only (terminators, quotation marks, brackets, line starts), not over
its letters: blank lines end every unit, heading lines and list items are units of their own, open quotations and
brackets are kept on a stack and hold back every terminator inside, and a full stop is judged by a trie of
abbreviations read backwards from the stop and by the word that follows. Open lists are kept on a stack of their own by
indent and mark. Scripts have their own terminators; Thai,
which has none, ends a sentence at a space between two Thai words. What comes out are offsets in code points.

Defined cases: null and blank texts have no units; the unit's last character is its last non-blank one, closing marks
and quotes included; a quotation mark without partner in its paragraph is ignored; a text without any terminator is
one unit per paragraph; repeated rows give repeated units; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = "doc_id BIGINT, unit_no INT, start_pos BIGINT, end_pos BIGINT, kind STRING"

# Abbreviations by what they do: "never" stand inside a sentence whatever follows; "number" as well, but only before a
# number or a name; "last" may be a sentence's last word, which a capital or a code after them shows.
NEVER = (
    "т к|т е|т н|т о|инж|проф|акад|доц|др-р|им|ул|пр|пер|пл|кв|корп|стр|рис|табл|см|ср|гл|разд|прил|зав|инв|тел|пост|перем|макс|мин|напр|англ|обл|респ|пос|дер|"
    "mr|mrs|ms|dr|prof|st|messrs|capt|col|gen|lt|sgt|rev|hon|i e|e g|d c|a c|cf|vs|viz|approx|fig|figs|tab|tabs|sec|secs|ch|vol|ed|eds|pp|eq|eqs|no|nos|ref|refs|dept|"
    "z b|d h|u a|o ä|s o|s u|i d r|bzw|vgl|ca|abb|kap|nr|ing|dipl|hr|fr|hrn|geb|evtl|ggf|inkl|zzgl|max|min|str|tel|abs|art|bd|"
    "डॉ|श्री|प्रो|पं"
)
NUMBER = "п|пп|ч|ст|гл|н|№|p|s|v|n|с"
LAST = "т д|т п|др|пр|г|гг|в|вв|руб|коп|тыс|млн|млрд|шт|экз|чел|етк|etc|al|inc|ltd|co|corp|jr|sr|a m|p m|usw|usf|u a m|etc pp|gmbh"


def _trie(classes: dict[str, str]) -> dict:
    """Trie over reversed abbreviations; a blank inside matches optional white space or a stop and white space."""
    root: dict = {}
    for name, words in classes.items():
        for w in words.split("|"):
            node = root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = name
    return root


_TRIE = _trie({"last": LAST, "number": NUMBER, "never": NEVER})
_MONTHS = re.compile(r"(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)")

_BLOCK = re.compile(r"\n[^\S\n]*(?:\n\s*)")
_SKIP = "﻿​⁠‍️"
_MARKER = re.compile(rf"[\s{_SKIP}]*(?:(?P<bullet>[-•*–—▪◦·])|(?P<number>\d{{1,9}}(?:\.\d{{1,3}})*)[.)]|(?P<letter>[a-zа-я])\))[^\S\n]+(?=\S)")
_HEADING = re.compile(rf"[\s{_SKIP}]*#{{1,6}}[^\S\n]+\S")
_THAI_GAP = r"(?<=[ก-๛])\s+(?:[^\w\s฀-๿]+\s+)?(?=[ก-๛])"
_EVENT = re.compile(rf"(?P<stop>[.!?…。！？।॥؟۔｡]+)|(?P<open>[«„「『【（(\[])|(?P<close>[»」』】）)\]])|(?P<quote>[\"“”])|(?P<gap>{_THAI_GAP})")
_CLOSERS = frozenset("»”“\"」』】）)]’'")
_OPEN_OF = {"»": "«", "」": "「", "』": "『", "】": "【", "）": "（", ")": "(", "]": "["}
_NEXT = re.compile(rf"\s+((?:[^\w\s«„“\"「『(（\[]|[{_SKIP}])+\s+)?")
_CODE = re.compile(r"[^\W\d]*[\d_][\w.]*")
_GLUED = re.compile(r"[^\W\d_][̀-ͯ]?[^\W\d_]")


def _abbreviation(text: str, stop: int, low: int) -> tuple[str, int]:
    """Class and start of the longest abbreviation that ends right before ``stop``; '' where there is none."""
    node, i, found, at = _TRIE, stop - 1, "", stop
    while i >= low:
        ch = text[i].lower()
        if ch == "." or ch.isspace():
            if " " not in node:
                break
            while i >= low and (text[i].isspace() or text[i] == "."):
                i -= 1
            node = node[" "]
            continue
        if ch not in node:
            break
        node = node[ch]
        i -= 1
        if "" in node and (i < low or not (text[i].isalnum() or text[i] == "_")):
            found, at = node[""], i + 1
    return found, at


def _ends(text: str, a: int, b: int, after: int, low: int, end: int) -> bool:
    """Whether the terminator text[a:b], with closing marks up to ``after``, ends a sentence."""
    if after >= end:
        return True
    mark, nxt = text[b - 1], text[after]
    if mark in "。！？।॥؟۔｡":
        return not (nxt in "，,、；;：:" or (after > b and nxt not in "。！？" and (nxt.isalnum() and not nxt.isupper() and mark not in "।॥؟۔" and after > b)))
    if not nxt.isspace():
        # a stop glued to the next sentence: lower-case word, stop, capitalised word
        if mark == "." and b - a == 1 and after == b and nxt.isupper() and a - low >= 2 and text[a - 1].islower() and (text[a - 2].islower() or text[a - 2] in "̆̈"):
            return nxt > "Ͱ" and bool(_GLUED.match(text, after)) and _abbreviation(text, a, low)[0] not in ("never", "number")
        return mark in "!?" and after == b and nxt.isupper() and text[a - 1].isalpha()
    m = _NEXT.match(text, after, end)
    p = m.end() if m else after
    if p >= end:
        return True
    nxt = text[p]
    while nxt in "«„“\"「『(（[*_" and p + 1 < end:
        p += 1
        nxt = text[p]
    starts = nxt.isupper() or nxt.isdigit() or (nxt.isalpha() and not nxt.islower()) or bool(_CODE.match(text, p, end)) or not nxt.isalnum()
    if not starts:
        return False
    if mark != "." or b - a > 1:
        return True
    kind, at = _abbreviation(text, a, low)
    if kind == "never":
        return False
    before = text[a - 1] if a > low else " "
    if kind and kind != "last" and a - at == 1:
        # a single letter: a unit after a number ends the sentence, else it counts pages or is an initial
        q = at - 1
        while q >= low and text[q].isspace():
            q -= 1
        return q >= low and text[q].isdigit() and q < at - 1
    if kind == "number":
        return not nxt.isdigit()
    if kind == "last":
        return True
    if before.isdigit() and nxt.isupper() and _MONTHS.match(text, p):
        return False
    if before.isalpha() and (a - 2 < low or not (text[a - 2].isalnum() or text[a - 2] == "_")):
        # a single letter: a unit after a number, else an initial or part of an abbreviation such as "z. B."
        q = a - 2
        while q >= low and text[q].isspace():
            q -= 1
        return q >= low and q < a - 2 and (text[q].isdigit() or text[q] in "/%°")
    return True


def _segment(text: str, start: int, end: int, out: list[int]) -> None:
    """Ends of the sentences of text[start:end], which is one paragraph, heading or list item."""
    events = [(m.start(), m.end(), m.lastgroup) for m in _EVENT.finditer(text, start, end)]
    partner: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()  # marks on the stack, so that one without partner is known without a walk
    for a, _, kind in events:
        ch = text[a]
        if kind == "open":
            stack.append((ch, a))
            held[ch] += 1
        elif kind == "close" or kind == "quote":
            if kind == "close":
                wanted = (_OPEN_OF[ch],)
            else:
                wanted = ('"',) if ch == '"' else ("„", "“") if ch == "“" else ("“", "„", "”")
            if any(held[w] for w in wanted):
                while True:
                    mark, place = stack.pop()
                    held[mark] -= 1
                    if mark in wanted:
                        partner[place], partner[a] = a, place
                        break
            elif kind == "quote":
                stack.append((ch, a))
                held[ch] += 1
    depth, low = 0, start
    for n, (a, b, kind) in enumerate(events):
        if kind in ("open", "close", "quote"):
            if a in partner:
                depth += 1 if partner[a] > a else -1
            continue
        if kind == "gap":
            if depth == 0 and a > low:
                out.append(a)
                low = b
            continue
        after, d = b, depth
        while after < end and text[after] in _CLOSERS:
            if after in partner and partner[after] < after:
                d -= 1
            elif text[after] in "\"“" and not (after in partner and partner[after] < after):
                break
            after += 1
        if d == 0 and _ends(text, a, b, after, low, end):
            out.append(after)
            low = after
    if low < end:
        out.append(end)


def _mark_of(k: re.Match) -> tuple[int, str, list[int]]:
    """(indent, kind, number) of a line's list mark."""
    indent = len(k[0]) - len(k[0].lstrip())
    if k["number"]:
        return indent, "number", [int(x) for x in k["number"].split(".")]
    return indent, k["bullet"] or "letter", [ord(k["letter"])] if k["letter"] else []


def _is_item(text: str, k: re.Match, b: int, stop: int, levels: list, listing: bool, segments: list) -> bool:
    """Whether a marked line is a list item; ``levels``, the stack of open lists, is moved to its list.

    An item goes on with an open list of its indent and mark, opens one inside the item before it, or opens one where a
    list may begin: at the head of a block, with a first number, with a sign that is nothing else, or as the first of
    two lines with the same mark below a line that ends in a colon.
    """
    indent, kind, number = _mark_of(k)
    inside = bool(segments) and segments[-1][2] == "item"
    far = kind == "number" and (len(number) > 1 or number[0] > 99)
    while levels and levels[-1][0] > indent:
        levels.pop()
    if levels and levels[-1][:2] == (indent, kind):
        before = levels[-1][2]
        if not far or number[:-1] == before[:-1] and number[-1] == before[-1] + 1 or number[:-1] == before:
            levels[-1] = (indent, kind, number)
            return True
        return False
    if far:
        opens = inside and len(number) > 1 and number[-1] == 1 and bool(levels) and (number[:-1] == levels[-1][2] or levels[-1][1] != "number")
    else:
        opens = listing or inside or number == [1] or kind in ("•", "▪", "◦") or _run_below_colon(text, k, b, stop, segments)
    if opens:
        levels.append((indent, kind, number))
    return opens


def _run_below_colon(text: str, k: re.Match, b: int, stop: int, segments: list) -> bool:
    if not segments or not text[segments[-1][0] : segments[-1][1]].rstrip().endswith(":"):
        return False
    end = text.find("\n", b + 1, stop)
    after = _MARKER.match(text, b + 1, stop if end < 0 else end) if b < stop else None
    return after is not None and _mark_of(after)[:2] == _mark_of(k)[:2]


def unit_ends(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each unit; kind is heading, item or sentence."""
    units: list[tuple[int, int, str]] = []
    at, n = 0, len(text)
    while at < n:
        m = _BLOCK.search(text, at)
        stop = m.start() if m else n
        # lines of the block, joined to segments
        segments: list[list] = []
        a, listing = at, True
        levels: list[tuple[int, str, list[int]]] = []  # the open lists, outermost first: indent, kind of mark, last number
        while a < stop:
            b = text.find("\n", a, stop)
            b = stop if b < 0 else b
            if _HEADING.match(text, a, b):
                segments.append([a, b, "heading", a])
                listing, levels = True, []
            elif (k := _MARKER.match(text, a, b)) and _is_item(text, k, b, stop, levels, listing, segments):
                segments.append([a, b, "item", k.end()])
                listing = False
            elif segments and segments[-1][2] != "heading":
                segments[-1][1] = b
                listing = False
            else:
                segments.append([a, b, "sentence", a])
                listing = False
            a = b + 1
        for a, b, kind, body in segments:
            ends: list[int] = []
            if kind == "heading":
                ends.append(b)
            else:
                _segment(text, body, b, ends)
            low = a
            for e in ends:
                piece = text[low:e]
                tail = len(piece.rstrip())
                if tail and piece.strip(_SKIP + " \t\r\n"):
                    units.append((low + len(piece) - len(piece.lstrip()), low + tail, kind))
                low = e
        at = m.end() if m else n
    return units


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of every text, in order."""

    def run(batches):
        for batch in batches:
            ids, starts, ends, kinds, numbers = [], [], [], [], []
            for i, text in zip(batch["doc_id"], batch["text"]):
                units = unit_ends(text)
                ids += [i] * len(units)
                numbers += range(len(units))
                starts += [u[0] for u in units]
                ends += [u[1] for u in units]
                kinds += [u[2] for u in units]
            if ids:
                yield pd.DataFrame({"doc_id": ids, "unit_no": np.array(numbers, dtype=np.int32), "start_pos": np.array(starts, dtype=np.int64), "end_pos": np.array(ends, dtype=np.int64), "kind": kinds})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInPandas(run, UNITS)
