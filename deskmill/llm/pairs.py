"""Defective prompt and response pairs: empty, copy, refusal, other_language or truncated, at most one each.

* *Refusals.* Each response gives the openings of its first sentences (twelve words, numbers and identifiers masked,
  quotations removed). Distinct openings are clustered: MinHash bands propose pairs of openings, their word
  sets verify them (Jaccard of 0.7 or more; negated and other openings never mix), and openings that differ in one run of words
  (a name, a synonym) are joined exactly by keys without that run; clusters are the connected components of both. What is
  counted is how many unrelated prompts a cluster's openings answer, and how many of its rows speak of declining. A
  template that recurs over unrelated prompts and declines marks its responses, also those that say it in words no rule
  knows. So does one in words that no rule knows at all, if it answers prompts of many topics, takes little from them,
  nearly always stands in responses without numbers of their own, and mostly has words that responses with such numbers
  do not use. Only openings that stand in a response without findings of its own, or that decline, can be such a
  template's, and only they are clustered. A response that declines plainly is marked without a cluster as well, wherever
  it does so.
* *Truncation.* A response without end mark may still be whole. Counts over the whole table tell how often its last
  words end a sentence and how often they go on; the longest word sequence with evidence decides.
* *Copy* is word coverage by the problem, *other_language* compares scripts and function words, *empty* knows fillers.

Counts cover all rows; only openings, sequences and keys are shuffled, pre-aggregated, never whole texts.

Defined cases: null, blank and placeholder responses are empty; a null problem can't be copied and has no language; a
pair delivered several times counts once; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.words import TAG, WORD, hash_batch, mix
from deskmill.session import discard, materialise

FEATURES = "pair_id BIGINT, at STRING, defect STRING, openings ARRAY<STRING>, declines ARRAY<BOOLEAN>, echoes ARRAY<DOUBLE>, bare BOOLEAN, declined BOOLEAN, prompt BIGINT, topic BIGINT, tails ARRAY<BIGINT>, lang_differs BOOLEAN"
OPENING_WORDS, MIN_PROMPTS = 12, 3
#: A template that no rule knows: prompts of so many topics, so much of its words from the prompt at most, so many rows bare.
MIN_TOPICS, MAX_ECHO, MIN_BARE = 10, 0.34, 0.9
#: Jaccard of word sets: one other word in six and two in twelve still reach it.
ALIKE = 0.7
#: Prompts and topics of an opening are counted by hash bucket, so that no set grows with its rows; a count up to MIN_TOPICS is rarely short by one.
BUCKETS = 1024
BANDS, ROWS = 16, 4
#: Words of the longest sequence that tells whether a text may end there.
TAIL = 4

# fixed values: what stands for no content, in lower case
_EMPTY = frozenset(
    "n/a na none null nil nan tbd todo - -- --- — – . .. ... … [] {} () нет пусто отсутствует б/н unknown empty keine k.a. entfällt unbekannt".split()
) | {"нет данных", "не указано", "не задано", "no answer", "no solution", "keine angabe", "нет ответа", "без ответа", "not specified", "нет решения", "nicht angegeben"}
#: No filler is longer.
LONGEST_EMPTY = 64
_INVISIBLE = re.compile("[\\s​-‏⁠﻿­ ]+")
_UNSPACED = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ]")
_FENCE = re.compile(r"^\s*```\w*\s*$|```")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"\n]*\"")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\s)\"»”]+|\n+")
_NUMBERED = re.compile(r"(?<!\w)[^\W\d]*\d\w*")
_MASK = ((re.compile(r"(?<!\w)[^\W\d]*\d[\w.:/-]*"), "9"), (re.compile(r"\b[A-ZА-ЯЁ]{2,}\b(?:[_-]\w+)*"), "v"))

_DECLINES = re.compile(
    r"\bне (?:могу|можем|смогу|сможем|вправе|имею (?:доступа|права|возможности)|располагаю|возьмусь|готов\w* (?:дать|ответить))\b|\b(?:ответить|помочь|выполнить|дать)\b.{0,30}\bневозможно\b|\bнельзя\b|\bневозможно (?:ответить|помочь)|"
    r"\bбессил\w+|за рамки моих|вне моей компетенции|\bвоздерж(?:усь|имся)\b|нарушает правила|\b(?:вынужден\w*|приходится) отказать|языковая модель|\bне помогу\b|\bне буду отвечать|"
    r"\b(?:i|we)(?:['’]m| am|['’]re| are)? (?:sorry|afraid|unable|not able)\b|\b(?:i|we) (?:can ?not|can['’]t|could not (?:help|answer|assist)|won['’]t|must decline|have to decline|do not have|don['’]t have)\b|\b(?:i|we)['’]d rather not\b|"
    r"beyond what (?:i|we) can|outside (?:my|our) (?:guidelines|scope|remit)|\b(?:as an? )(?:ai|language model)\b|(?:can ?not|unable to) (?:help|assist|answer|comply)|\bdecline(?:d)? (?:this|to answer)|"
    r"\bkann ich\b.{0,40}\b(?:nicht|kein\w*)\b|\bich (?:kann|darf|möchte)\b.{0,40}\b(?:nicht|kein\w*)\b|\bsprachmodell\b|\bkeinen zugriff\b|\bnicht (?:beantworten|helfen)\b|außerhalb meiner|\bmuss ich ablehnen\b|"
    r"无法(?:回答|提供|协助|帮助)|抱歉|不能(?:回答|提供|协助)|作为(?:一个)?(?:ai|语言模型)|お答えできません|申し訳",
)
#: What every match of the pattern holds: texts without any of them need no search.
_DECLINE_STEMS = (
    "не ", "невозможно", "нельзя", "бессил", "за рамки моих", "вне моей компетенции", "воздерж", "нарушает правила", "отказать", "языковая модель",
    "sorry", "afraid", "unable", "not able", "can not", "cannot", "can't", "can’t", "could not", "won't", "won’t", "decline", "do not have", "don't have", "don’t have", "rather not",
    "beyond what", "outside", "as a", "kann ich", "ich kann", "ich darf", "ich möchte", "sprachmodell", "keinen zugriff", "nicht beantworten", "nicht helfen", "außerhalb meiner", "ablehnen",
    "无法", "抱歉", "不能", "作为", "お答え", "申し訳",
)


def declines(text: str) -> bool:
    """Whether a lower-cased sentence declines in known words."""
    return any(stem in text for stem in _DECLINE_STEMS) and bool(_DECLINES.search(text))


_NEGATIONS = frozenset("не нет нельзя ни без бессилен not no never t cannot without nor nicht kein keine keinen nie ohne".split())

_STOP = {
    "ru": frozenset("и в на не с по для что это как от при из к до или после чего было так если уже за".split()),
    "en": frozenset("the a an of to and in is was it on for with at that which by then from not be has had".split()),
    "de": frozenset("der die das und ist war wurde den dem ein eine auf mit für von zu nicht bei nach im des wird seit hat".split()),
    "fr": frozenset("le la les des et est une un du que pour dans sur pas avec".split()),
    "es": frozenset("el los las y es una un del que para en no con por se".split()),
}


def _clean(text: str) -> str:
    text = TAG.sub(" ", text) if "<" in text else text
    return html.unescape(text) if "&" in text else text


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    if len(text) > LONGEST_EMPTY and "<" not in text and "&" not in text and text[:1].isalnum():
        return False
    bare = _INVISIBLE.sub(" ", _clean(text)).strip().strip("*_`#").strip().lower()
    return not bare or bare.rstrip(".!") in _EMPTY or bare in _EMPTY or not any(ch.isalnum() for ch in bare)


def language(text: str) -> str:
    """Script, and within the Latin script the language by function words; '' where nothing tells."""
    text = _clean(text)
    if _ANY_QUOTE.search(text):
        text = _OPEN_QUOTE.sub(" ", _QUOTED.sub(" ", text))
    han = kana = cyr = lat = other = 0
    latin: list[str] = []
    for w in _LANGUAGE_WORD.findall(text):
        if not w.isalpha():
            continue
        ch = w[0]
        if ch < "ɐ":
            if not w.isupper() or len(w) == 1:
                latin.append(w)
                lat += 0 if w[:1].isupper() and w[1:].islower() else len(w)
        elif "Ѐ" <= ch <= "ӿ":
            cyr += len(w)
        elif "぀" <= ch <= "ヿ":
            kana += len(w)
        elif "一" <= ch <= "鿿":
            han += len(w)
        else:
            other += len(w)
    total = han + kana + cyr + lat + other
    if han + kana and (han + kana) * 3 >= total:
        return "ja" if kana * 5 > han else "zh"
    if cyr and cyr >= lat:
        return "ru"
    if other and other >= lat:
        return "other"
    words = Counter(w.lower() for w in latin)
    score = {k: sum(n for w, n in words.items() if w in stop) for k, stop in _STOP.items() if k != "ru"}
    best = max(score, key=score.get)
    if score[best] == 0 or sorted(score.values())[-2] == score[best]:
        return "de" if re.search(r"[äöüß]", text) else ("latin" if lat > 8 else "")
    return best


_ANY_QUOTE = re.compile("[«“„\"]")
_LANGUAGE_WORD = re.compile(r"[^\W\d_]+(?:[\d_-][\w-]*)?")
_CYRILLIC_WORD = re.compile(r"(?<![\w-])[Ѐ-ӿ]+(?![\w-])")


def languages(texts: list[str]) -> list[str]:
    """:func:`language` of each. Texts of two scripts with Cyrillic prevailing are told by counts of letters over the whole batch."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    if not len(starts):
        return []
    cyrillic = (codes >= 0x400) & (codes < 0x500)
    folded = codes | 32
    latin = (folded >= 97) & (folded <= 122) | (codes >= 0xC0) & (codes < 0x250)
    #: letters of other scripts, quotations, markup: looked at word by word
    other = (codes >= 0x250) & ~cyrillic & ~((codes >= 0x2000) & (codes < 0x2C00)) | np.isin(codes, np.array([ord(c) for c in '<&"«“„'], dtype=np.uint32))
    n = [np.add.reduceat(x.astype(np.int32), starts) for x in (cyrillic, latin, other)]
    plain = ((n[0] > 2 * n[1]) & (n[2] == 0)).tolist()
    return ["ru" if p and _CYRILLIC_WORD.search(t) else language(t) for p, t in zip(plain, texts)]


def _differs(a: str, b: str) -> bool:
    latin = {"en", "de", "fr", "es", "latin"}
    return bool(a and b) and a != b and not ("latin" in (a, b) and {a, b} <= latin)


def _units(text: str) -> list[str]:
    """Words; of words in scripts without blanks each two neighbouring characters."""
    out = []
    for w in WORD.findall(text.lower()):
        out += [w[i : i + 2] for i in range(len(w) - 1)] if len(w) > 1 and _UNSPACED.search(w) else [w]
    return out


def covered(problem: str, response: str) -> float:
    """Share of the response's words that the problem has, each as often as there; under five words all of them in order or none."""
    asked, words = _units(_clean(problem)), _units(_clean(response))
    if len(words) < 5:
        return float(bool(words) and words == asked)
    return sum((Counter(words) & Counter(asked)).values()) / len(words)


def _masked(text: str) -> str:
    for pattern, sign in _MASK:
        text = pattern.sub(sign, text)
    return text.lower()


def is_bare(problem: str, response: str) -> bool:
    """Whether the response names no number or identifier but the problem's."""
    own = set(_NUMBERED.findall(_clean(response).lower()))
    return not own or own <= set(_NUMBERED.findall(_clean(problem).lower()))


def _echo(words: list[str], asked: set[str]) -> float:
    """Share of the longer words that the problem has as well."""
    own = {w for w in words if len(w) >= 4}
    return len(own & asked) / len(own) if own else 0.0


def sentences(text: str) -> list[str]:
    """Sentences without what they quote, be the quotation closed or broken off."""
    text = _clean(text)
    if _ANY_QUOTE.search(text):
        text = _OPEN_QUOTE.sub(" q", _QUOTED.sub(" q ", text))
    return [s for s in _SENTENCE.split(text) if s and any(ch.isalnum() for ch in s)]


def openings(text: str) -> list[str]:
    return [" ".join(WORD.findall(_masked(s))[:OPENING_WORDS]) for s in sentences(text)[:3]]


def _seq(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode()) - (1 << 63)


def _asked(problems: list[str]) -> list[tuple[int, int, list[str]]]:
    """(hash of the problem, its topic, its words) of each; the topic is the least word pair by hash: problems that say nearly the same mostly agree in it."""
    masked = [WORD.findall(_masked(p)) or [""] for p in problems]
    hashes, at = hash_batch(masked)
    paired = np.append(mix(hashes, 2), hashes[-1:])
    # the pair over a list's end counts for a list of one word only
    over = at[1:] - 1
    paired[over] = np.where(np.diff(at) == 1, hashes[over], np.iinfo(np.uint64).max)
    topics = np.minimum.reduceat(paired, at[:-1]).view(np.int64).tolist() if len(masked) else []
    return [(_seq(m), topic, WORD.findall(p.lower())) for m, topic, p in zip(masked, topics, problems)]


def _copies(problem: str, asked: list[str], response: str) -> bool:
    """Whether :func:`covered` reaches 0.8; words that the problem hasn't at all rule most out before any are counted."""
    if not _UNSPACED.search(response) and "<" not in problem and "&" not in problem:
        words = WORD.findall(_clean(response).lower())
        have = set(asked)
        if len(words) >= 5 and sum(w in have for w in words) < 0.8 * len(words):
            return False
    return covered(problem, response) >= 0.8


def open_end(text: str) -> str:
    """'cut' where the end can't be whole, 'whole' where it has its end mark, else 'open'."""
    t = text.rstrip().rstrip("*_").rstrip()
    if t.endswith("```"):
        t = t[:-3].rstrip()
    if re.search(r"[.!?。！？][)\"»”』」\]]*$", t) and not re.search(r"(?:\.\.\.|…)$", t):
        return "whole"
    if re.search(r"[,:;(\[{«„“—–-]$", t):
        return "cut"
    last = _SENTENCE.split(t)[-1]
    if last.count("(") > last.count(")") or last.count("«") > last.count("»") or last.count('"') % 2:
        return "cut"
    return "open"


_PROPER = re.compile(r"\b[A-Z][a-z]{3,}\b")
_OPEN_QUOTE = re.compile(r"[«„“\"][^«»„“”\"]*$")


def _tail_words(text: str) -> list[str]:
    return WORD.findall(_masked(_PROPER.sub("n", _clean(text))))


def _endings(texts: list[str]) -> pd.DataFrame:
    """(tail, ends, goes_on): how often each sequence of one to four words ends a sentence and how often it goes on."""
    lists, closes = [], []
    for text in texts:
        parts = [p for p in _SENTENCE.split(_clean(text)) if p.strip()]
        closed = text.rstrip()[-1:] in ".!?。！？»\")"
        lists += [_tail_words(p) for p in parts]
        closes += [n + 1 < len(parts) or closed for n in range(len(parts))]
    hashes, at = hash_batch(lists)
    last, closing = np.repeat(at[1:], np.diff(at)), np.repeat(np.array(closes, dtype=bool), np.diff(at))
    keys, ends = [], []
    for k in range(1, TAIL + 1):
        mixed = mix(hashes, k)
        after = np.arange(len(mixed)) + k
        stops = last[: len(mixed)]
        use = (after < stops) | ((after == stops) & closing[: len(mixed)])
        keys.append(mixed[use])
        ends.append((after == stops)[use])
    key, at_end = np.concatenate(keys).view(np.int64), np.concatenate(ends)
    tails, place = np.unique(key, return_inverse=True)
    n_ends = np.bincount(place, weights=at_end, minlength=len(tails)).astype(np.int64)
    return pd.DataFrame({"tail": tails, "ends": n_ends, "goes_on": np.bincount(place, minlength=len(tails)) - n_ends})


def _tails(lists: list[list[str]]) -> list[list[int]]:
    """Of each word list the hashes of its last four words down to its last one, as :func:`_endings` makes them; [0] for no words."""
    hashes, at = hash_batch([w[-TAIL:] for w in lists])
    mixed = {k: mix(hashes, k).view(np.int64) for k in range(1, TAIL + 1)}
    return [[int(mixed[k][b - k]) for k in range(TAIL, 0, -1) if b - a >= k] or [0] for a, b in zip(at.tolist(), at[1:].tolist())]


def defects(pairs: DataFrame, id_col: str = "pair_id", problem_col: str = "problem_summary", solution_col: str = "solution_summary", order_col: str = "created_at", phrases: bool = True) -> DataFrame:
    """(pair_id, defect) of every defective pair. Without ``phrases`` refusals are found by recurrence alone."""
    rows = pairs.select(F.col(id_col).alias("pair_id"), F.col(problem_col).alias("problem"), F.col(solution_col).alias("solution"), F.col(order_col).cast("string").alias("at"))

    def features(batches):
        for batch in batches:
            out, open_ends = [], []
            problems = [p if isinstance(p, str) else "" for p in batch["problem"]]
            solutions = [s if isinstance(s, str) else "" for s in batch["solution"]]
            differs = [_differs(a, b) for a, b in zip(languages(problems), languages(solutions))]
            for key, problem, (prompt, topic, asked), solution, differing, at in zip(batch["pair_id"], problems, _asked(problems), solutions, differs, batch["at"]):
                if is_empty(solution):
                    out.append([key, at, "empty", [], [], [], False, False, prompt, topic, [], False])
                    continue
                defect, have = ("copy" if _copies(problem, asked, solution) else None), set(asked)
                said, bare = sentences(solution), is_bare(problem, solution)
                # a sentence below the opening ones declines where no findings of the response's own stand beside it
                may = phrases and any(stem in solution.lower() for stem in _DECLINE_STEMS) or phrases and ("<" in solution or "&" in solution)
                declining = [may and declines(p.lower()) for p in (said if bare else said[:3])]
                first = [WORD.findall(p.lower()) for p in said[:3]]
                out.append([
                    key, at, defect, [" ".join(WORD.findall(_masked(p))[:OPENING_WORDS]) for p in said[:3]], declining[:3],
                    [_echo(w, have) for w in first], bare, any(declining), prompt, topic, [], differing,
                ])
                end = open_end(solution)
                if end == "cut":
                    out[-1][10] = [0]
                elif end == "open":
                    open_ends.append((len(out) - 1, _tail_words(_SENTENCE.split(_clean(solution).rstrip().removesuffix("```").rstrip())[-1])))
            for (i, _), tails in zip(open_ends, _tails([w for _, w in open_ends])):
                out[i][10] = tails
            yield pd.DataFrame(out, columns=["pair_id", "at", "defect", "openings", "declines", "echoes", "bare", "declined", "prompt", "topic", "tails", "lang_differs"])

    seen = rows.mapInPandas(features, FEATURES)
    one = materialise(seen.groupBy("pair_id").agg(F.max_by(F.struct(*[c for c in seen.columns if c != "pair_id"]), F.struct("at", F.xxhash64("defect", "openings"))).alias("f")).select("pair_id", "f.*"), "pair-features")

    # refusals: cluster the openings
    said = one.filter(F.col("defect").isNull()).select("pair_id", "prompt", "topic", "bare", "declined", F.explode(F.arrays_zip("openings", "declines", "echoes")).alias("o")).select("pair_id", "prompt", "topic", "bare", "declined", "o.*")
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in ("declines", "echoes", "bare")]
    # only an opening of a response that brings nothing of its own, or that declines, can be a refusal's: these are counted by prompt and clustered
    able = F.col("bare") | F.col("declines")
    buckets = [F.collect_set(F.when(able, F.pmod(c, F.lit(BUCKETS)))).alias(f"{c}s") for c in ("prompt", "topic")]
    kinds = materialise(said.groupBy(F.col("openings").alias("opening")).agg(*buckets, F.count("*").alias("n"), *sums), "openings")
    clusters = materialise(_clustered(kinds.filter((F.col("bare") > 0) | (F.col("declines") > 0))), "clusters")
    several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    stats = clusters.groupBy("cluster").agg(several("prompts"), several("topics"), *[F.sum(c).alias(c) for c in ("n", "declines", "echoes", "bare")])
    known = (F.col("prompts") >= MIN_PROMPTS) & (F.col("declines") * 2 >= F.col("n"))
    unknown = (F.col("topics") >= MIN_TOPICS) & (F.col("bare") >= MIN_BARE * F.col("n")) & (F.col("echoes") <= MAX_ECHO * F.col("n"))
    judged = stats.filter(known | unknown).select("cluster", known.alias("known"))
    maybe = clusters.join(judged, "cluster")
    # a template no rule knows has words of its own: what answers with findings of their own say as well is an answer
    words = lambda df: df.withColumn("word", F.explode(F.array_distinct(F.split("opening", " ")))).filter(F.length("word") >= 4)
    asked = words(maybe.filter(~F.col("known"))).select("cluster", "word", "n")
    usual = words(kinds).join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg((F.sum("bare") * 2 < F.sum("n")).alias("usual"))
    apart = asked.join(usual, "word").groupBy("cluster").agg((F.sum(F.when(F.col("usual"), F.col("n")).otherwise(0)) * 2 < F.sum("n")).alias("apart"))
    templates = maybe.join(apart, "cluster", "left").filter(F.col("known") | F.col("apart"))
    # an opening that itself mostly declines marks all its rows, another one of its cluster only those that bring nothing of their own
    own = (F.size("prompts") >= MIN_PROMPTS) & (F.col("declines") * 2 >= F.col("n"))
    templates = templates.select(F.col("opening").alias("openings"), own.alias("own"), F.lit(True).alias("template"))
    refused = said.join(templates, "openings", "left").filter(F.col("own") | (F.col("template") & F.col("bare")) | F.col("declined")).select("pair_id").distinct().withColumn("refuses", F.lit(True))

    # truncation: how often the last words of open ends end a sentence elsewhere
    def endings(batches):
        for batch in batches:
            yield _endings([t for t in batch["text"] if isinstance(t, str) and t.strip()])

    opened = one.filter(F.col("defect").isNull()).select("pair_id", F.posexplode("tails").alias("rank", "tail"))
    wanted = opened.select("tail").distinct()
    counted = rows.select(F.col("solution").alias("text")).mapInPandas(endings, "tail BIGINT, ends BIGINT, goes_on BIGINT").join(wanted, "tail", "left_semi").groupBy("tail").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    judged = opened.join(counted, "tail", "left").filter((F.col("tail") == 0) | (F.col("ends") + F.col("goes_on") >= 2))
    ends = judged.groupBy("pair_id").agg(F.min_by(F.coalesce(F.col("ends") > F.col("goes_on"), F.lit(False)), "rank").alias("is_whole"))

    labelled = one.join(refused, "pair_id", "left").join(ends, "pair_id", "left")
    cut = (F.size("tails") > 0) & ~F.coalesce("is_whole", F.lit(False))
    defect = F.when(F.col("defect").isNotNull(), F.col("defect")).when(F.col("refuses"), "refusal").when(F.col("lang_differs"), "other_language").when(cut, "truncated")
    return labelled.select("pair_id", defect.alias("defect")).filter(F.col("defect").isNotNull())


def _clustered(kinds: DataFrame) -> DataFrame:
    """``kinds`` with the cluster of each opening: the least hash of its connected component of verified pairs."""

    def bands(batches):
        salts = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            out = []
            for text, node in zip(batch["opening"], batch["node"]):
                hashes = np.array([xxhash.xxh3_64_intdigest(s) for s in _word_set(text)], dtype=np.uint64)
                x = hashes[:, None] ^ salts[None, :]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                signature = (x ^ (x >> np.uint64(29))).min(axis=0)
                out += [(text, node, b, xxhash.xxh3_64_intdigest(signature[b * ROWS : (b + 1) * ROWS].tobytes()) - (1 << 63)) for b in range(BANDS)]
            yield pd.DataFrame(out, columns=["opening", "node", "band", "bucket"])

    def leaders(batches):
        """Within a bucket each opening is held against those that none before it was like: passes over the unmatched rest."""
        at, firsts = None, []
        for batch in batches:
            out = []
            for text, node, key in zip(batch["opening"], batch["node"], zip(batch["band"], batch["bucket"])):
                if key != at:
                    at, firsts = key, []
                words = _word_set(text)
                found = [first for first, other in firsts if _alike(words, other) >= ALIKE]
                out += [(node, first) for first in found]
                if not found:
                    firsts.append((node, words))
            yield pd.DataFrame(out, columns=["node", "other"])

    def slots(batches):
        for batch in batches:
            out = [(node, key) for text, node in zip(batch["opening"], batch["node"]) for key in _slots(text)]
            yield pd.DataFrame(out, columns=["node", "key"])

    # sizes are guessed from what goes into the Python stages, which make many times as much: sorted joins, no broadcast
    kinds = kinds.withColumn("node", F.xxhash64("opening"))
    openings = kinds.select("opening", "node")
    # exact for openings that differ in one place, however many share their bucket
    keyed = openings.mapInPandas(slots, "node BIGINT, key BIGINT")
    edges = keyed.hint("merge").join(keyed.groupBy("key").agg(F.min("node").alias("other")).hint("merge"), "key").select("node", "other")
    hashed = openings.mapInPandas(bands, "opening STRING, node BIGINT, band INT, bucket BIGINT")
    several = hashed.hint("merge").join(hashed.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1").hint("merge"), ["band", "bucket"], "left_semi")
    edges = edges.unionByName(several.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "opening").mapInPandas(leaders, "node BIGINT, other BIGINT"))
    edges = edges.filter(F.col("node") != F.col("other")).distinct()
    edges = materialise(edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))), "opening-links")
    labels = materialise(edges.select("node").distinct().withColumn("cluster", F.col("node")), "opening-labels")
    before = labels
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("cluster").alias("near")).hint("merge"), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("cluster").alias("old"), F.least("cluster", "near").alias("cluster"))
        up = step.select(F.col("node").alias("cluster"), F.col("cluster").alias("upper"))
        step = materialise(step.join(up.hint("merge"), "cluster", "left").select("node", "old", F.least("cluster", F.coalesce("upper", "cluster")).alias("cluster")), "opening-labels")
        discard(before)
        labels, before = step.select("node", "cluster"), step
        if step.filter(F.col("old") != F.col("cluster")).isEmpty():
            break
    return kinds.join(labels.withColumnRenamed("cluster", "least").hint("merge"), "node", "left").withColumn("cluster", F.coalesce("least", "node")).drop("least", "node")


def _slots(opening: str) -> set[int]:
    """Keys of the opening, whole and without each run of up to a quarter of its words, four words left at least."""
    w = opening.split()
    runs = [(i, d) for d in range(1, len(w) // 4 + 1) if len(w) - d >= 4 for i in range(len(w) - d + 1)]
    return {_seq([str(_negates(w)), *w[:i], *w[i + d :]]) for i, d in [(0, 0), *runs]}


def _word_set(opening: str) -> frozenset[str]:
    """The words, and whether one negates: 'can help' is no wording of 'can not help'."""
    w = opening.split()
    return frozenset([*w, f"negates={_negates(w)}"])


def _alike(x: frozenset[str], y: frozenset[str]) -> float:
    """Jaccard of the words; 0 where only one side negates."""
    common = len(x & y) - 1
    return common / max(1, len(x | y) - 1) if any(w in y for w in x if w.startswith("negates=")) else 0.0


def _negates(words: list[str]) -> bool:
    return any(w in _NEGATIONS or w.startswith(("невозмож", "unable")) for w in words)
