r"""Sentence boundaries by cascading tables of break and no-break rules.

A text is first laid out in lines.  A line break ends a unit, except inside the
blocks of a hard-wrapped text, where it only wraps the running paragraph.  List
entries, with their marker, are one unit each.  Inside a unit every position
after a terminal mark, with its closing quotes and brackets, is a candidate; in
Thai so is every blank.  The tables in ``CASCADE`` hold ordered pairs of regular
expressions (what stands before, what stands after) with a verdict.  Each
language has its table.  In scripts that one language uses here the script tells
which; in Latin letters it is the languages that the unit's function words leave
likely, else those of the whole text, else all.  The tables are asked in order,
the general one last, and the first pair that matches decides.  Marks inside a
quotation or bracket that goes on after them never break.

Defined cases: null, empty and blank texts have no units; a text without any
terminal mark is one unit per line; marks on their own join the unit before
them; repeated rows give their units once; whole texts are read, whatever their
length.  Offsets count code points and end exclusively.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

V = regex.V1
NEWLINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
MARKER = regex.compile(r"\s*(?:[-*•‣◦▪·–—]\s+|\(\p{N}{1,3}\)\s*|\(\p{L}\)\s*|（[\p{N}一二三四五六七八九十]{1,3}）|\p{N}{1,3}[)）]\s*|[a-zA-Z]\)\s+|\p{N}{1,3}[.．]\s+(?=\S)|[①-⑳⑴-⒇]|[一二三四五六七八九十]{1,3}、)", V)
#: Markers that cannot be a part of running text.
BULLET = regex.compile(r"\s*(?:[-*•‣◦▪]\s+|\(\p{N}{1,3}\)\s|[a-zA-Z]\)\s+)", V)
CLOSERS = r"(?:[\s  ]?[»]|[\"'”’“)\]」』）》〉】])*"
TERMINAL = regex.compile(rf"(?:[.．!?！？。｡…‥।॥؟]+(?:[   ](?=[!?])[!?]+)?){CLOSERS}", V)
ENDS = regex.compile(rf"[.．!?！？。｡…।॥:：]{CLOSERS}\s*$", V)
THAI_BLANK = regex.compile(r"(?<=[\p{Thai}\p{N}A-Z])[  ]+(?=\S)", V)
#: Quotations and brackets; what is nested in them cannot break the sentence around them.
NESTED = regex.compile(r"„[^„“”\n]*[“”]|“[^“”\n]*”|«[^«»\n]*»|»[^«»\n]*«|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]*\"|\([^()\n]*\)|（[^（）\n]*）|\[[^\[\]\n]*\]|《[^《》\n]*》", V)

BREAK, JOIN = True, False


@dataclass(frozen=True)
class Rule:
    """The verdict on a position whose text before it and after it match."""

    verdict: bool
    before: str
    after: str = ""


#: Every abbreviation of the tables.
ABBREVIATIONS: set[str] = set()


def _abbreviations(words: str) -> str:
    ABBREVIATIONS.update(words.split())
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(regex.escape(w) for w in sorted(words.split(), key=len, reverse=True)) + r")\."


def _numbered(words: str) -> Rule:
    """Words that are abbreviations only before a figure or a code; else they end a sentence like any word."""
    return Rule(JOIN, _abbreviations(words), r"\s*[(]?(?:\p{N}|\p{Lu}{1,4}[-./]?\p{N}|\p{Lu}{1,4}-|[IVX]+\b|[øØ±])")


#: Abbreviations that never end a sentence before a capital, figure or code. Those that may (etc., usw., и т. д.) are left out.
CASCADE: dict[str, list[Rule]] = {
    "en": [
        Rule(BREAK, r"\b[Rr]ev\. [A-Z]\.", r"\s+\p{Lu}"),
        Rule(BREAK, r"\b[ap]\.\s?m\.", r"\s+\p{Lu}"),
        Rule(JOIN, _abbreviations("Dwg dwg Fig fig Figs Sec sec Sect Rev rev approx Approx Mr Mrs Ms Dr Prof St Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Ltd Inc Co Corp Dept Eq Eqs Ref Vol Ch vs e.g i.e E.g I.e viz"), r"\s*[\p{N}\p{Lu}(]"),
        _numbered("App app Art art spec Spec dia Dia max Max min Min temp Temp qty Qty No Nos nos no p pp v"),
    ],
    "de": [
        Rule(JOIN, r"(?<!\p{L})(?:[Ii]m|[Aa]m|[Vv]om|[Zz]um|[Bb]is|[Aa]b|[Ss]eit|[Bb]eim|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Dd]em|[Dd]es|[Jj]ede[rsnm]?)\s\p{N}{1,2}\.", r"\s+\p{L}"),
        Rule(JOIN, r"\p{N}{1,2}\.", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|OG|UG|EG|Stock|Etage)\b"),
        Rule(JOIN, _abbreviations("vgl Vgl Abschn Abb Ziff Nr Nrn Fa Fr Hr Dr Prof Bd Kap Pos Str St bzw ca Ca ggf Ggf mind Mind inkl exkl einschl gem Gem Art Abs Anl Taf Tab Tel evtl zzgl lt Lt sog Aufl Hrsg Ing Dipl"), r"\s*[\p{N}\p{L}(]"),
        _numbered("max Max min Min"),
    ],
    "fr": [
        Rule(JOIN, _abbreviations("chap Chap art Art fig Fig env Env sté Sté cf Cf réf Réf éd vol tél MM Mme Mlle M av bd dr Dr n° ex"), r"\s*[\p{N}\p{L}(]"),
        _numbered("max Max min Min p pp v n"),
    ],
    "es": [
        Rule(JOIN, _abbreviations("Sr Sra Srta Dr Dra Ud Uds núm Núm fig Fig cap Cap art Art aprox Aprox pág págs ej Ej vol tel Tel ed Ing Arq ref Ref"), r"\s*[\p{N}\p{L}(]"),
        _numbered("máx Máx mín Mín v V p n"),
    ],
    "pt": [
        Rule(JOIN, _abbreviations("Sr Sra Dr Dra núm fig Fig cap Cap art Art aprox Aprox pág págs ex cf Cf vol tel Eng Arq ref Ref"), r"\s*[\p{N}\p{L}(]"),
        _numbered("máx Máx mín Mín v p n"),
    ],
    "hi": [
        Rule(JOIN, _abbreviations("डॉ श्री सं क्र क्रमांक नं चि पृ रु उदा लि प्रा इं मि मी से कि किमी मिमी वि ई ए"), r"\s*[\p{N}\p{L}(]"),
    ],
    "initial": [
        # A unit of measure after a figure is no initial.
        Rule(BREAK, r"\p{N}\s?[°º]?(?:\p{L}[²³]?|°)\.", r"\s+[\p{Lu}\p{N}¿¡«„\"“(]"),
        # One letter: the end of a name given by a common word, else an initial or a part of an abbreviation.
        Rule(BREAK, r"(?<!\p{L})(?:\p{Ll}{3,}|\p{N}+)\s\p{Lu}\.", r"\s+\p{Lu}\p{Ll}"),
        Rule(JOIN, r"(?<!\p{L})[\p{Latin}\p{Cyrillic}]\.", r"\s*[\p{L}\p{N}(]"),
    ],
    "ru": [
        Rule(BREAK, r"(?:т\.\s?[дп]|и\s?(?:др|пр))\.", r"\s+\p{Lu}"),
        Rule(JOIN, _abbreviations("см См рис Рис черт Черт прим Прим кл разд Разд макс Макс мин Мин напр Напр п пп гл ст стр табл Табл г гг ул им тел поз Поз т д ред изд ср Ср инж проф"), r"\s*[\p{N}\p{L}(]"),
    ],
    "zh": [
        Rule(JOIN, r"(?:…|\.{3})+", r"\s*\S"),
        # A quotation that a colon leads in ends its sentence, unless the sentence goes on.
        Rule(JOIN, r"[”’」』]", r"\s*(?:并|而|但|且|也|又|还|的|时|后|字样|一词|，|、|；|：|。|！|？)"),
        Rule(BREAK, r"[：:]\s?[“‘「『][^“”‘’「」『』]*[。！？!?.…][”’」』]"),
        Rule(JOIN, r"[“‘「『][^“”‘’「」『』]*[。！？!?.…][”’」』]"),
        Rule(JOIN, r"[^。！？\s（(][（(][^（）()]*[。！？!?.…][）)]"),
    ],
    "ja": [
        Rule(JOIN, r"(?:…|\.{3})+", r"\s*\S"),
        Rule(JOIN, r"[」』”]", r"\s*(?:と|って|を|は|が|の|に|も|で|へ|や|など|、|。)"),
        Rule(JOIN, r"[^。！？\s（(][（(][^（）()]*[。！？!?.…][）)]"),
    ],
    "ko": [
        Rule(JOIN, r"[.!?…][\"”’」』)]+", r"(?:\p{Hangul}|\s+(?:라고|이라고|라는|이라는|하고))"),
        Rule(BREAK, r"\p{Hangul}[.!?]", r"\s*\p{Hangul}"),
    ],
    "th": [
        Rule(JOIN, r"\p{Thai}", r"\s+(?:\p{N}|[A-Z]+[-\p{N}]|ๆ|ฯ)"),
        Rule(JOIN, r"(?<![A-Z\p{N}.-])[+\-±]?\p{N}+(?:[.,:/x×]\p{N}+)*", r"\s+\p{Thai}"),
        Rule(BREAK, r"[\p{Thai}\p{N}A-Z]", r"\s+\p{Thai}"),
        Rule(BREAK, r"\p{Thai}", r"\s+(?:\p{Lu}\p{Ll}*\s|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Devanagari}\p{Cyrillic}])"),
        Rule(JOIN, r"[^.!?…]"),
    ],
    "all": [
        Rule(JOIN, r"\p{N}[.．]", r"\p{N}"),
        # Digits with a letter before them: a file name, an address, a number.
        Rule(JOIN, r"[\p{L}\p{N}_][.]", r"[\p{Ll}_]"),
        Rule(BREAK, rf"[.!?…]{CLOSERS}", r"\s+\p{Ll}\p{Lu}"),
        Rule(JOIN, r"[.．…!?][\"'”’“»)\]\s]*", r"\s*[,;:]"),
        Rule(JOIN, rf"[.．…!?]{CLOSERS}", r"\s+\p{Ll}"),
        Rule(JOIN, r"[.．]", r"[-)\]/\\@]"),
        Rule(BREAK, rf"[。｡！？।॥؟]{CLOSERS}"),
        Rule(BREAK, rf"[.．!?…]{CLOSERS}", r"\s"),
        Rule(BREAK, r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}][.．!?]", r"\S"),
        Rule(BREAK, rf"[\p{{L}}\p{{N}}%°)][.!?…]+{CLOSERS}", r"(?:\p{Lu}\p{Ll}|\p{Lu}['’]|[¿¡«„“]|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Devanagari}])"),
        Rule(BREAK, r"\p{Ll}{3}\.", r"\p{N}+\s\p{L}"),
        Rule(JOIN, r""),
    ],
}

# Function words of the languages in Latin letters, which tell what language a unit is in.
FUNCTION_WORDS = {
    "en": "the and of to in is are be must with for at on from by shall this that it was were has have not before after all which will or as an if when than into he she they we you",
    "de": "der die das und ist sind mit von zu im am auf für nicht werden wird ein eine einen einer den dem des muss vor nach bei aus oder als auch dass zum zur wurde sich an er sie es wir",
    "fr": "le la les des du de et est sont dans par pour avec sur une un doit être pas avant après au aux ou que qui ne ce cette il elle nous à en",
    "es": "el la los las del de y es son en por para con sobre una un debe ser no antes después al o que se este esta lo su como deben está nos a",
    "pt": "o a os as do da dos das de e é são em por para com sobre uma um deve ser não antes após ao ou que se este esta no na nos nas devem está sua seu à",
}
_SPEAKS: dict[str, tuple[str, ...]] = {w: tuple(k for k, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}
ALL_LATIN = ("en", "de", "fr", "es", "pt", "initial", "all")


@lru_cache(maxsize=None)
def _latin(langs: tuple[str, ...]) -> tuple[str, ...]:
    return (*langs, "initial", "all") if langs else ALL_LATIN


def spoken(text: str) -> tuple[str, ...]:
    """The languages in Latin letters that a text's function words leave likely, the likeliest first.

    A word that several languages have counts for each of them a part.  A
    language is left if it has a fourth of what the likeliest one has, so that
    each sentence of a mixed text finds its table.
    """
    votes: dict[str, float] = {}
    for w in text.lower().split():
        for k in (langs := _SPEAKS.get(w, ())):
            votes[k] = votes.get(k, 0.0) + 1.0 / len(langs)
    most = max(votes.values(), default=0.0)
    return tuple(sorted((k for k, v in votes.items() if 4 * v >= most), key=lambda k: (-votes[k], k)))


SCRIPTS: list[tuple[str, tuple[str, ...]]] = [
    (r"\p{Thai}", ("th", "all")),
    (r"[\p{Hiragana}\p{Katakana}]", ("ja", "all")),
    (r"\p{Hangul}", ("ko", "initial", "all")),
    (r"\p{Han}", ("zh", "all")),
    (r"\p{Devanagari}", ("hi", "all")),
    (r"\p{Cyrillic}", ("ru", "initial", "all")),
]
LETTER = regex.compile(r"\p{L}", V)
_SCRIPT = [(regex.compile(p, V), t) for p, t in SCRIPTS]


@lru_cache(maxsize=None)
def _compiled(tables: tuple[str, ...]) -> list[tuple[bool, regex.Pattern]]:
    """The rules of some tables in order; neighbours of one verdict are one pattern that is matched at the position."""
    out: list[tuple[bool, list[str]]] = []
    for r in (r for t in tables for r in CASCADE[t]):
        if not out or out[-1][0] != r.verdict:
            out.append((r.verdict, []))
        out[-1][1].append(f"(?<={r.before})(?={r.after})")
    return [(verdict, regex.compile("|".join(pairs), V)) for verdict, pairs in out]


OTHER_SCRIPT = regex.compile(r"[\p{Thai}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Han}\p{Devanagari}\p{Cyrillic}]", V)
KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]", V)


def _tables(text: str, start: int, at: int) -> tuple[str, ...]:
    """The tables of the script of the last letter before a position in a sentence that begins at ``start``; none for Latin letters."""
    for i in range(at - 1, start - 1, -1):
        if (c := text[i]).isalpha():
            if c < "\u0250":
                return ()
            for p, t in _SCRIPT:
                if p.match(c):
                    return t if t[0] != "zh" or not KANA.search(text, start, at) else SCRIPTS[1][1]
            return ()
    return ()


#: Whether any rule of the languages in Latin letters has a say; where none has, which of them it is makes no difference.
_ANY_LATIN = regex.compile("|".join(f"(?<={r.before})(?={r.after})" for k in FUNCTION_WORDS for r in CASCADE[k]), V)
_NO_LANGUAGE = ("initial", "all")


def breaks(text: str, end: int, at: int, tables: tuple[str, ...]) -> bool:
    """Whether a sentence ends at the position ``at`` of a unit that ends at ``end``."""
    for verdict, pattern in _compiled(tables):
        if pattern.match(text, at, end):
            return verdict
    return False


def lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in NEWLINE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def _blocks(text: str) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[]]
    for a, b in lines(text):
        if text[a:b].strip():
            out[-1].append((a, b))
        elif out[-1]:
            out.append([])
    return [x for x in out if x]


#: Nats of evidence for a hard-wrapped text; those of a line that goes on without a capital, and of one of five words or more.
WRAPPED, GOES_ON, RUNNING = 2.0, 1.0, 1.0


def _full(text: str, line: tuple[int, int], following: tuple[int, int], width: int) -> bool:
    """Whether the first word of the following line had no room on the line."""
    there = text[slice(*following)].strip()
    return len(text[slice(*line)].rstrip()) + 1 + len(there.split(None, 1)[0]) > width and not BULLET.match(there)


def _wrap_width(text: str, blocks: list[list[tuple[int, int]]]) -> int:
    """The width at which a text is hard-wrapped, 0 if it is not.

    It is, if every line that ends inside a sentence and goes on in small
    letters was full, and that is more than chance: a line of no wrapped text
    is full as often as the next word is long in proportion to the width.
    Some full line has four words at least; without small letters every such
    line must be full and one have five words.
    """
    pairs = [p for x in blocks for p in zip(x, x[1:])]
    if not pairs:
        return 0
    width = max(len(text[a:b].rstrip()) for (a, b), _ in pairs)
    small, every, most = False, True, 0
    evidence = 0.0
    for here, there in pairs:
        line = text[slice(*here)].rstrip()
        if ENDS.search(line):
            continue
        if UNSPACED.search(line):
            every = False
            continue
        following = text[slice(*there)].lstrip()
        full, lower = _full(text, here, there, width), following[0].islower()
        if lower and not full:
            return 0
        if full:
            words = len(line.split())
            chance = min(1.0, (1 + len(following.split(None, 1)[0])) / width)
            evidence += (GOES_ON if following[0].isalpha() and not following[0].isupper() else 0.0) + (RUNNING if words >= 5 else 0.0) - math.log(chance)
            most = max(most, words)
        small |= lower and full
        every &= full
    return width if evidence >= WRAPPED and (small and most >= 4 or every and most >= 5) else 0


UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", V)


def units(text: str) -> Iterator[tuple[int, int]]:
    """Lines, with the wrapped lines of a paragraph joined."""
    blocks = _blocks(text)
    width = _wrap_width(text, blocks)
    for x in blocks:
        start = x[0][0]
        for here, there in zip(x, [*x[1:], None]):
            if there is None or not width or not _full(text, here, there, width):
                yield start, here[1]
                start = there[0] if there else 0


def _inside(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in NESTED.finditer(text.replace("\n", " "), start, end)] if NESTED_OPEN.search(text, start, end) else []


NESTED_OPEN = regex.compile(r"[„“«»「『\"(（\[《]", V)


def _split(text: str, start: int, end: int, whole: list[tuple[str, ...]]) -> Iterator[int]:
    """The positions inside a unit at which sentences end; ``whole`` keeps the languages of the whole text."""
    found = list(TERMINAL.finditer(text, start, end))
    other = OTHER_SCRIPT.search(text, start, end)
    if not found and not other:
        return
    nested = _inside(text, start, end)
    latin: tuple[str, ...] = ()
    since = start

    def tables(at: int) -> tuple[str, ...]:
        nonlocal latin
        if text[at - 1] != "." or not _ANY_LATIN.match(text, at, end):
            return _NO_LANGUAGE
        if not latin:
            langs = spoken(text[start:end])
            if not langs:
                if not whole:
                    whole.append(spoken(text))
                langs = whole[0]
            latin = _latin(langs)
        return latin

    for m in found:
        at = m.end()
        if nested and (hit := next(((a, b) for a, b in nested if a < m.start() < b), None)):
            if at < hit[1]:
                continue
            at = max(hit[1], min(at, end))
        if at >= end:
            continue
        if not other and at + 1 < end and text[at - 1] == "." and text[at] == " " and text[at + 1].isupper():
            # A plain word before the stop and a capital after it: no rule but the general break has a say.
            word = text[max(start, text.rfind(" ", start, at) + 1) : at - 1]
            if len(word) > 1 and word.isalpha() and word not in ABBREVIATIONS:
                yield at
                since = at
                continue
        if breaks(text, end, at, (other and _tables(text, since, at)) or tables(at)):
            yield at
            since = at
    if other:
        for m in THAI_BLANK.finditer(text, start, end):
            if ("\u0e00" <= text[m.start() - 1] <= "\u0e7f" or "\u0e00" <= text[m.end()] <= "\u0e7f") and not any(a < m.start() < b for a, b in nested) and breaks(text, end, m.start(), ("th", "all")):
                yield m.start()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """The ``(start, end)`` of every sentence unit of a text."""
    out: list[tuple[int, int]] = []
    whole: list[tuple[str, ...]] = []
    for start, end in units(text or ""):
        cuts = [start, *(() if MARKER.match(text, start, end) else sorted(set(_split(text, start, end, whole)))), end]
        first = len(out)
        for a, b in zip(cuts, cuts[1:]):
            piece = text[a:b]
            if s := piece.strip():
                a += len(piece) - len(piece.lstrip())
                if len(out) > first and not any(c.isalnum() for c in s):
                    out[-1] = (out[-1][0], a + len(s))
                else:
                    out.append((a, a + len(s)))
    return out


SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, sent_start, sent_end``: one row per sentence unit of the column ``text``."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, a, b = [], [], []
            for i, t in zip(pdf["row_id"], pdf["text"]):
                for x, y in sentences(t):
                    ids.append(i), a.append(x), b.append(y)
            yield pd.DataFrame({"row_id": pd.Series(ids, dtype="int64"), "sent_start": pd.Series(a, dtype="int32"), "sent_end": pd.Series(b, dtype="int32")})

    rows = df.select(df[key].cast("long").alias("row_id"), df[text].alias("text")).where("row_id is not null and text is not null")
    return rows.mapInPandas(split, SCHEMA).distinct().withColumnRenamed("row_id", key)
