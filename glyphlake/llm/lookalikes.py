r"""One consistent form for texts that look the same.

A text is brought to its form in three steps.  Ignorable characters go, blanks
other than space, tab and line break become spaces, and width and other
compatibility variants of letters, digits, kana and ideographs (with the ASCII
marks among them) are replaced and the rest is composed.  Then every token of
alphabetic letters becomes a lattice: each letter may stand for any of its
look-alikes.  A Viterbi search takes the path that is most likely under the
character-pair frequencies of the whole corpus, in which tokens of one script
and the script of the neighbouring words prevail; a replaced letter costs
``SWAP`` nats.  A text is a case if its letters, marks or blanks change.

Stretches that were read with the wrong encoding (module ``mojibake``) are left
as they are.  The pair frequencies are hashed into a table of fixed size.

Defined cases: null and empty texts, and texts of ASCII characters only, are
their own form and no cases; whole texts are read; repeated rows give one
result; ordinary Chinese and Japanese punctuation, composed accents, signs such
as ² ³ ½ ° Ø ±, Cyrillic words in Russian and Cyrillic units in Russian stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.mojibake import SPACE, Model, _bucket, count_units, damaged, word_counts

#: Nats that a replaced letter costs.
SWAP = 2.0
#: Nats that a change of script inside a token costs.
MIXED = 9.0

# Letters that look alike, Latin first, then Cyrillic and Greek.
LOOKALIKES = """
a а | c с | d ԁ | e е | h һ | i і ι | j ј | o о ο | p р ρ | q ԛ | s ѕ | v ν ѵ | w ԝ | x х χ | y у γ
A А Α | B В Β | C С | E Е Ε | G Ԍ | H Н Η | I І Ι | J Ј | K К Κ | M М Μ | N Ν | O О Ο | P Р Ρ | Q Ԛ | S Ѕ | T Т Τ | W Ԝ | X Х Χ | Y Ү Υ | Z Ζ
"""
CLASS: dict[str, str] = {c: g.replace(" ", "") for g in re.split(r"[|\n]", LOOKALIKES.strip()) for c in g if c != " "}

INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻"
BLANKS = "   -   　"
#: Variants: ligatures and joined letters, wide and half-width forms, compatibility ideographs, radicals, squared letters, styled letters, Ohm, Kelvin, Angstrom.
VARIANTS = "ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳŉ０-９Ａ-Ｚａ-ｚｦ-ﾟﾡ-ￜ豈-﫿⺀-⻳⼀-⿕㍱-㏿\U0001d400-\U0001d7ff\U0002f800-\U0002fa1fΩKÅ"
WIDE_MARKS = "！-／：-＠［-｀｛-～"
_INVISIBLE, _BLANKS = re.compile(f"[{INVISIBLE}]+"), re.compile(f"[{BLANKS}]")
_VARIANT = re.compile(f"[{VARIANTS}]")
_WIDE_LETTER = re.compile("[０-９Ａ-Ｚａ-ｚ]")
#: A wide mark in or directly beside wide letters and digits.
_WIDE_MARK = re.compile(f"(?<=[０-９Ａ-Ｚａ-ｚ{WIDE_MARKS}])[{WIDE_MARKS}]|[{WIDE_MARKS}](?=[０-９Ａ-Ｚａ-ｚ])")
COMBINING = "̀-゙゚ͯᄀ-ᇿ"
MARKS = re.compile(f"[{COMBINING}]")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
#: Texts that may be cases.
CANDIDATE = re.compile(f"[{INVISIBLE}{BLANKS}{VARIANTS}{COMBINING}Ͱ-ϿЀ-ԯ]")
#: Joiners that Indic and Arabic scripts need.
NEEDED_JOINER = re.compile("(?<=[؀-ۿऀ-෿])[‌‍]")
_HELD = {"‌": "", "‍": ""}

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ"
TOKEN = re.compile(f"[{_LETTERS}0-9]*[{_LETTERS}][{_LETTERS}0-9]*(?:[-._/][{_LETTERS}0-9]+)*")
CYR = re.compile("[Ѐ-ԯ]")
_DIGIT = re.compile("[0-9]")


def _context(text: str) -> str:
    """The script that prevails in a word: C for Cyrillic, L for others."""
    return "C" if 2 * len(CYR.findall(text)) > len(text) else "L"


def _script(c: str) -> str:
    return "" if not c.isalpha() else "C" if CYR.match(c) else "G" if "\u0370" <= c <= "\u03ff" else "L"


def _tokens(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, token, context)``: the context is the script of the word before, else of the word after."""
    found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    kinds = [_context(t) if len(t) > 2 and not _DIGIT.search(t) else "" for *_, t in found]
    for k, (a, b, t) in enumerate(found):
        before = next((x for x in reversed(kinds[:k]) if x), "")
        after = next((x for x in kinds[k + 1 :] if x), "")
        # Codes and tags are written in Latin letters in every language.
        yield a, b, t, "L" if _DIGIT.search(t) else before or after or "L"


def pairs(token: str, context: str) -> Iterator[str]:
    shape = f"{context}{_DIGIT.sub('0', token)}$"
    for i in range(len(shape) - 1):
        yield shape[i : i + 2]


def pair_counts(texts: Iterable[str]) -> Counter[str]:
    """The character pairs of alphabetic tokens, each with its first character's own count."""
    whole: Counter[tuple[str, str]] = Counter()
    for t in texts:
        if not FOREIGN.search(t):
            whole.update([(x, "L") for x in TOKEN.findall(t)])
        else:
            whole.update([(x, c) for *_, x, c in _tokens(t)])
    units: Counter[str] = Counter()
    for (t, c), n in whole.items():
        for p in pairs(t, c):
            units[p] += n
            units[p[0]] += n
    return units


class Forms:
    """The consistent forms of texts, under a table with the frequencies of words and of pairs."""

    def __init__(self, table: np.ndarray) -> None:
        self.words = Model(table[:SPACE])
        self.table = table[SPACE:]
        self._pair: dict[str, float] = {}
        self._token: dict[tuple[str, str], str] = {}

    def pair(self, p: str) -> float:
        v = self._pair.get(p)
        if v is None:
            v = math.log((int(self.table[_bucket(p)]) + 0.02) / (int(self.table[_bucket(p[0])]) + 2.0))
            self._pair[p] = v
        return v

    def token(self, token: str, context: str) -> str:
        """The best path through the token's look-alike lattice."""
        hit = self._token.get((token, context))
        if hit is None:
            # A state is the last character (figures as one) and the script of the last letter.
            paths: dict[tuple[str, str], tuple[float, str]] = {(context, ""): (0.0, "")}
            for c in token:
                step: dict[tuple[str, str], tuple[float, str]] = {}
                for o in CLASS.get(c, c):
                    shape, script = "0" if o.isdigit() else o, _script(o)
                    cost = 0.0 if o == c else SWAP
                    for (last, was), (v, t) in paths.items():
                        now = v + self.pair(last + shape) - cost - (MIXED if script and was and script != was else 0.0)
                        state = (shape, script or was)
                        if state not in step or (now, t + o) > step[state]:
                            step[state] = (now, t + o)
                paths = step
            hit = max((v + self.pair(last + "$"), t) for (last, _), (v, t) in paths.items())[1]
            if len(self._token) < 500_000:
                self._token[token, context] = hit
        return hit

    def letters(self, text: str) -> str:
        """The text with look-alikes of a foreign script replaced."""
        out, at = [], 0
        for a, b, t, context in _tokens(text):
            if context == "L" and not FOREIGN.search(t):
                continue
            # A unit in Cyrillic letters after a figure or a degree sign is Russian.
            if context == "C" and a and text[a - 1] in "°" and len(t) == 1:
                continue
            if (new := self.token(t, context)) != t:
                out += [text[at:a], new]
                at = b
        return "".join([*out, text[at:]])

    def form(self, text: str | None) -> str | None:
        """The consistent form; the text itself if it needs none."""
        if not text or text.isascii() or not CANDIDATE.search(text):
            return text
        spans = damaged(text, self.words)
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [self._clean(text[at:a]), text[a:b]]
                at = b
        return "".join([*out, self._clean(text[at:])])

    def _clean(self, text: str) -> str:
        if not CANDIDATE.search(text):
            return text
        held = NEEDED_JOINER.search(text)
        if held:
            text = NEEDED_JOINER.sub(lambda m: _HELD[m.group()], text)
        text = _BLANKS.sub(" ", _INVISIBLE.sub("", text))
        if held:
            for joiner, mark in _HELD.items():
                text = text.replace(mark, joiner)
        if _WIDE_LETTER.search(text):
            text = _WIDE_MARK.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
        if _VARIANT.search(text):
            text = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if _VARIANT.match(c) else c for c in text))
        elif MARKS.search(text):
            text = unicodedata.normalize("NFC", text)
        return self.letters(text) if FOREIGN.search(text) else text


def forms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``<keys>, form, changed`` of every row with a text."""
    rows = texts.select(*keys, texts[text].alias("text")).where(F.col("text").isNotNull())
    shared = texts.sparkSession.sparkContext.broadcast(count_units(rows.select("text"), word_counts, pair_counts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Forms(shared.value)
        for pdf in frames:
            out = [model.form(t) for t in pdf["text"]]
            changed = [a != b for a, b in zip(pdf["text"], out)]
            yield pdf[keys].assign(form=pd.Series(out, dtype=object, index=pdf.index), changed=changed)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in keys)
    return rows.mapInPandas(run, f"{schema}, form string, changed boolean")
