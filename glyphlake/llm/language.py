r"""Languages of texts and of their segments by compression.

Each language has a raw-content dictionary for Zstandard, made of sentences
from a bounded sample of labelled rows (``SAMPLE`` texts a language, chosen by
hash; sentences that occur under several labels go to the label they have most
often).  A unit of text is compressed with the dictionary of every language;
only languages that cannot encode it, as their dictionaries hold hardly any
letters of its scripts, are spared.  The smallest result is the unit's language.

A unit is rejected, and has the language ``und``, in two cases.  Its margin is
narrow: the second smallest result is within ``NARROW`` bytes, and stays within
``NARROW_WIDE`` when the unit is compressed again in 32-bit characters at a high
level, where parts of words count.  Or no dictionary fits: the result is hardly
smaller than without any (``GAIN``), nor much smaller than the second (``LEAD``).  The label of a text never decides: it is
wrong if a clear unit is in another language, or if it is none of the close ones
of a narrow unit.  A rejected unit beside clear ones belongs to their segment.

The confidence is the share of held-out labelled sentences of such a margin
that were put right.

Units are the sentences of module ``sentences``.  Names, tags, codes, numbers,
units of measure and bracketed terms say nothing of the language and are left
out; a text without any word has no language.  Neighbouring units of one
language are one segment.

Defined cases: null and blank texts and texts without words have no segments; a
null, blank or unknown label is missing; labels are read in any customary
spelling; repeated rows give one result; without any labelled row no text has a
language; whole texts are read.  A text with a missing label, all of whose units
are narrow, is a case in its likeliest language; a text that no dictionary fits
is none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.lookalikes import CLASS
from glyphlake.llm.mojibake import Model, count_units, damaged, word_counts
from glyphlake.llm.placeholders import is_placeholder
from glyphlake.llm.sentences import sentences

#: Labelled texts sampled for the dictionaries, a language and a table at most about.
SAMPLE = 3000
#: Bytes of a language's dictionary.
DICTIONARY = 96_000
LEVEL = 9
#: Units whose best two languages differ by less, in bytes, are looked at again, and then rejected.
NARROW, NARROW_WIDE, LEVEL_WIDE = 2, 4, 19
#: A dictionary fits if it saves this part of what a unit takes without one; ``SLACK`` bytes are left for new words.
GAIN, SLACK = 0.5, 12
#: Or if the second smallest result is this part larger.
LEAD = 0.1
#: Part of a dictionary's letters that a script must have to be one of its language; part of a unit's letters that must be in such scripts.
SCRIPT_SHARE, ENCODES = 0.2, 0.5
#: Language of a rejected unit.
UND = "und"
#: Margins, in bytes, from which the classes of confidence begin; held-out sentences a language that they are measured on.
MARGINS, HELD_OUT = (0, 2, 3, 5, 8, 13, 21), 200

LANGUAGES = ("en", "zh", "de", "fr", "es", "ja", "ko", "ru", "pt", "th", "hi")
# Customary spellings of language labels besides the two-letter codes.
ALIASES = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "cn": "zh", "chinese": "zh", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "jpn": "ja", "jp": "ja", "japanese": "ja", "kor": "ko", "kr": "ko", "korean": "ko",
    "rus": "ru", "russian": "ru", "por": "pt", "portuguese": "pt", "tha": "th", "thai": "th", "hin": "hi", "hindi": "hi",
}
MISSING = ("", "und", "unknown", "unk", "none", "null", "n/a", "na", "mul", "zxx", "xx", "?", "-", "other", "auto")


def label(col: Column) -> Column:
    """The language code of a label; null if it is missing, ``?`` if it names a language not known here."""
    first = F.lower(F.regexp_extract(F.trim(col), r"^[^-_.\s(]*", 0))
    known = F.create_map(*[F.lit(x) for kv in ({k: k for k in LANGUAGES} | ALIASES).items() for x in kv])
    gone = col.isNull() | F.lower(F.trim(col)).isin(*MISSING) | first.isin(*MISSING)
    return F.when(~gone, F.coalesce(F.element_at(known, first), F.lit("?")))


# Scripts whose letters are told apart, and the letters that count double as they hold more.
SCRIPTS = {"kana": "぀-ヿｦ-ﾟ", "hangul": "ᄀ-ᇿ㄰-㆏가-힣", "han": "一-鿿㐀-䶿豈-﫿", "cyrillic": "Ѐ-ӿ", "thai": "฀-๿", "devanagari": "ऀ-ॿ", "latin": "A-Za-zÀ-ɏ"}
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_WEIGHT = {"kana": 2, "hangul": 2, "han": 2}


def scripts(text: str) -> dict[str, int]:
    """The weight of the letters of each script in a text."""
    if text.isascii():
        n = sum(map(str.isalpha, text))
        return {"latin": n} if n else {}
    return {k: n * _WEIGHT.get(k, 1) for k, p in _SCRIPT.items() if (n := len(p.findall(text)))}


_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_SPACED = re.compile("(?<=[぀-ヿ㐀-鿿])[ \t　]+(?=[぀-ヿ㐀-鿿])")
_MIXED = re.compile("[A-Za-zÀ-ɏͰ-ӿ]*[Ͱ-ӿ][A-Za-zÀ-ɏͰ-ӿ]*")
_BRACKETED = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】")
_OPENS = re.compile(r"[(（\[【]")
_TERM_IN_BRACKETS = re.compile(r"[(（\[【][^.!?。！？]*[)）\]】]\W*")
#: Codes, tags, figures with their units, file names; never words.
_CODE = re.compile(
    r"\b(?i:dwg)\W{0,3}(?i:no)\b[.\s]*\d*|\b(?i:rev)[.\s-]*(?:[A-Z]?\d+\b|[A-Z]\b)|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+(?:\.[A-Za-z0-9]+)?|[A-Za-z0-9_]+\.(?:dxf|dwg|pdf|xlsx?)\b|(?<![A-Za-z])[A-Za-z]{1,5}[-._]\d[A-Za-z0-9./-]*"
    r"|[A-Za-zА-Яа-яΑ-Ω]*\d[A-Za-z\d]*(?:[-./:×~_][A-Za-z\d]*\d[A-Za-z\d]*)*|\b[A-Z]{1,4}-[A-Z\d]+\b"
)
_ONLY_CODE = re.compile(r"\W*[A-Za-z]{1,5}[\W_]{0,4}\d[\dA-Za-z\W_]{0,12}")
_UNIT = re.compile(r"(?:(?<=[\d\s°%²³½±Ø+-])|^)(?:mm|cm|dm|m|km|kW|KW|kw|W|V|A|kV|kVA|Hz|MPa|MPA|mpa|kPa|Pa|bar|kg|g|t|l|L|h|s|min|°?[CF]|м|мм|см|кВт|МПа|मिमी)(?![^\W\d_])")
_FIGURES = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TERMINAL = re.compile(r"[.!?。！？…।:]\W*$")


def _fold(text: str) -> str:
    """Compatibility variants, invisible characters and look-alikes of Latin letters put right."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if re.search("[Ͱ-ӿ]", text) and re.search("[A-Za-z]", text):
        cyrillic, latin = len(re.findall("[бгдёжзийлпфцчшщъыьэюя]", text.lower())), len(re.findall("[A-Za-z]", text))
        if cyrillic * 4 < latin:
            text = _MIXED.sub(lambda m: "".join(CLASS.get(c, c)[0] for c in m.group()) if all(c in CLASS or c < "Ͱ" for c in m.group()) else m.group(), text)
        elif latin:
            text = re.sub("[A-Za-z]*[Ѐ-ӿ][A-Za-zЀ-ӿ]*", lambda m: "".join(next((x for x in CLASS.get(c, c) if "Ѐ" <= x <= "ӿ"), c) for c in m.group()), text)
    return text


def words(unit: str) -> str:
    """The words of a unit in lower case, without what says nothing of its language."""
    text = _CODE.sub(" ", _fold(unit))
    text = _UNIT.sub(" ", text)
    if _OPENS.search(text):
        inner = _BRACKETED.sub(" ", text)
        if re.search(r"[^\W\d_]{2}", inner):
            text = inner
    if not text.isascii():
        text = _SPACED.sub("", text)
    return " ".join(w for w in _WORD.findall(text.lower()))


def worded(text: str) -> str:
    """The words of a text; empty if it holds only codes, figures and single letters."""
    w = "" if _ONLY_CODE.fullmatch(_fold(text)) else words(text)
    return w if any(len(x) > 1 or x > "\u0900" for x in w.split()) else ""


def _codec(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Read(NamedTuple):
    """What compression says of a unit: languages by size, whether they are told apart, whether any fits."""

    lang: str
    margin: int
    close: tuple[str, ...]
    clear: bool
    letters: int
    whole: bool


class Classifier:
    """Languages of units of text under one dictionary for each language."""

    def __init__(self, contents: dict[str, str], confidence: list[float] | None = None) -> None:
        self.contents = contents
        self.codecs = {k: _codec(_encode(v, k), LEVEL) for k, v in contents.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.confidence = confidence or [1.0] * len(MARGINS)
        self.scripts: dict[str, frozenset[str]] = {}
        for k, v in contents.items():
            have = scripts(v)
            self.scripts[k] = frozenset(x for x, n in have.items() if n >= SCRIPT_SHARE * sum(have.values()))
        self._wide: dict[str, zstandard.ZstdCompressor] = {}
        self._units: dict[str, Read | None] = {}
        self._words: dict[str, tuple[str, int, tuple[str, ...], bool] | None] = {}

    def unit(self, unit: str) -> Read | None:
        """The language of a unit; None if it has no words. Figures make no difference."""
        shape = _FIGURES.sub("0", unit)
        if shape in self._units:
            return self._units[shape]
        w, hit = worded(unit), None
        if w and (read := self.words(w)):
            hit = Read(*read, len(w), is_sentence(unit, w))
        if len(self._units) < 200_000:
            self._units[shape] = hit
        return hit

    def candidates(self, w: str) -> list[str]:
        """The languages whose dictionaries can encode some words."""
        have = scripts(w)
        total = sum(have.values())
        part = {k: n for k, own in self.scripts.items() if (n := sum(m for x, m in have.items() if x in own)) and n >= ENCODES * total}
        # Sizes in 8-bit and in 32-bit characters cannot be compared.
        wide = max(part, key=lambda k: (part[k], k in WIDE), default="") in WIDE
        return [k for k in part if (k in WIDE) == wide]

    def words(self, w: str) -> tuple[str, int, tuple[str, ...], bool] | None:
        """``(language, margin, close languages, clear)`` of some words; None if no language can encode them."""
        if w in self._words:
            return self._words[w]
        hit = None
        if langs := self.candidates(w):
            data = {x: _encode(w, x) for x in langs}
            sizes = sorted((len(self.codecs[x].compress(data[x])), x) for x in langs)
            best, lang = sizes[0]
            close = tuple(x for s, x in sizes if s - best < NARROW)
            margin = sizes[1][0] - best if len(sizes) > 1 else len(w)
            clear = len(close) == 1
            if not clear:
                wide = sorted((len(self.wide(x).compress(w.encode("utf-32-le", "surrogatepass"))), x) for x in close)
                lang = wide[0][1]
                if wide[1][0] - wide[0][0] >= NARROW_WIDE:
                    clear, close, margin = True, (lang,), NARROW
            if (len(sizes) == 1 or sizes[1][0] < (1 + LEAD) * best) and next(n for n, x in sizes if x == lang) > (1 - GAIN) * len(self.plain.compress(data[lang])) + SLACK:
                clear, close = False, ()
            hit = (lang, margin, close, clear)
        if len(self._words) < 300_000:
            self._words[w] = hit
        return hit

    def wide(self, lang: str) -> zstandard.ZstdCompressor:
        """The compressor of a language for 32-bit characters, made when it is first asked for."""
        if lang not in self._wide:
            self._wide[lang] = _codec(self.contents[lang].encode("utf-32-le", "surrogatepass"), LEVEL_WIDE)
        return self._wide[lang]

    def sure(self, margin: float) -> float:
        """The confidence in a margin."""
        return self.confidence[bisect_right(MARGINS, margin) - 1]


def units(text: str) -> list[str]:
    return [text[a:b] for a, b in sentences(text)]


def is_sentence(unit: str, w: str) -> bool:
    """Whether a unit is a whole sentence, or long enough for one, and no mere term."""
    if _TERM_IN_BRACKETS.fullmatch(unit.strip()):
        return False
    n = w.count(" ") + 1 if not re.search("[぀-鿿฀-๿]", w) else len(w) // 3
    return n >= 4 or n >= 2 and bool(_TERMINAL.search(unit)) or bool(re.search("[。！？]", unit))


class Segment(NamedTuple):
    """A segment's language (``und`` if rejected), its confidence, its likeliest language, and those that are close to it."""

    lang: str
    confidence: float
    likely: str
    close: tuple[str, ...]


def segments(text: str | None, model: Classifier) -> list[Segment]:
    """The segments of a text in its order."""
    reads = [r for unit in units(text or "") if (r := model.unit(unit))]
    if not reads:
        return []
    usual = Counter(r.lang for r in reads if r.clear and r.whole).most_common(1) or Counter(r.lang for r in reads if r.clear).most_common(1)
    if not usual:
        # All rejected: one segment, as close as its units are.
        best = max(reads, key=lambda r: (len(r.close) > 0, r.letters))
        close = tuple(x for x in best.close if all(x in r.close or not r.close for r in reads)) or best.close
        return [Segment(UND, 0.0, best.lang if best.lang in close or not close else close[0], close)]
    last = None
    merged: list[list] = []
    for r in reads:
        lang = r.lang
        if not r.clear or not r.whole and len(reads) > 1:
            # What is rejected, or a term among sentences, forms no segment of its own.
            lang = last or usual[0][0]
        last = lang
        margin = r.margin if r.clear and r.lang == lang else 0
        if merged and merged[-1][0] == lang:
            merged[-1][1] = max(merged[-1][1], margin)
        else:
            merged.append([lang, margin])
    return [Segment(lang, model.sure(margin), lang, (lang,)) for lang, margin in merged]


def _features(w: str) -> list[str]:
    """Words; character pairs where a script has no blanks."""
    return [x for p in w.split() for x in ([p[i : i + 2] for i in range(max(1, len(p) - 1))] if p[0] > "\u0e00" else [p])]


def cleaned(pairs: Iterable[tuple[str, str]]) -> dict[str, Counter[str]]:
    """The sentences of labelled texts by language, without those that are wrongly labelled.

    A naive Bayes model over the words of all sampled sentences tells which are:
    a few wrong labels hardly change what words a language has.
    """
    under: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, text in pairs:
        for unit in units(text):
            if len(w := words(unit)) > 1:
                under[lang][w] += 1
    likely: dict[str, dict[str, float]] = {}
    floor: dict[str, float] = {}
    for lang, counts in under.items():
        of: Counter[str] = Counter()
        for w, n in counts.items():
            for x in _features(w):
                of[x] += n
        total = sum(of.values())
        floor[lang] = math.log(0.3 / (total + 1))
        likely[lang] = {x: math.log((n + 0.3) / (total + 1)) for x, n in of.items()}
    out: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, counts in under.items():
        for w, n in counts.items():
            xs = _features(w)
            score = {k: sum(p.get(x, floor[k]) for x in xs) for k, p in likely.items()}
            if score[lang] >= max(score.values()):
                out[lang][w] += n
    return out


#: Languages with terms of two or three characters: coded wide, so that a match of one is long enough to be used.
WIDE = ("zh", "ja", "ko")


def _encode(text: str, lang: str) -> bytes:
    return text.encode("utf-32-le" if lang in WIDE else "utf-8", "surrogatepass")


def _content(counts: Counter[str], lang: str) -> str:
    """Sentences for a dictionary: frequent ones and new words, the most frequent last, where they are cheapest to refer to."""
    out: list[str] = []
    size, seen = 0, Counter()
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        parts = w.split() if " " in w else [w[i : i + 3] for i in range(0, len(w), 3)]
        fresh = [p for p in parts if seen[p] < 3]
        if not fresh:
            continue
        seen.update(parts)
        out.append(w)
        size += len(_encode(w, lang)) + len(_encode("\n", lang))
        if size >= DICTIONARY:
            break
    return "\n".join(reversed(out))


def fit(pairs: Iterable[tuple[str, str]]) -> tuple[dict[str, str], list[float]]:
    """The dictionaries of the languages of ``(language, text)`` pairs, and the confidence in each class of margins.

    The confidence is measured on sentences that are held out of dictionaries
    of the others; it never falls as the margin grows.
    """
    counts = {lang: c for lang, c in cleaned(pairs).items() if c}
    held = {lang: [w for w in sorted(c, key=lambda w: xxhash.xxh64_intdigest(w)) if xxhash.xxh64_intdigest(w, 5) % 5 == 0][:HELD_OUT] for lang, c in counts.items()}
    out = {lang: set(ws) for lang, ws in held.items()}
    trial = Classifier({lang: _content(Counter({w: n for w, n in c.items() if w not in out[lang]}), lang) for lang, c in counts.items()})
    right, seen = [1.0] * len(MARGINS), [2.0] * len(MARGINS)
    for lang, ws in held.items():
        for w in ws:
            if (read := trial.words(w)) and read[3]:
                k = bisect_right(MARGINS, read[1]) - 1
                seen[k] += 1
                right[k] += read[0] == lang
    sure, least = [], 0.0
    for r, n in zip(right, seen):
        least = max(least, r / n)
        sure.append(least)
    return {lang: _content(c, lang) for lang, c in counts.items()}, sure


def sample(rows: DataFrame) -> list[tuple[str, str]]:
    """About ``SAMPLE`` labelled texts a language of ``lang, text``, chosen by hash."""
    labelled = rows.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    space = 1_000_003
    cut = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, max(1, round(space * min(1.0, SAMPLE / n))))]), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(space)) < cut)
    # Many copies of one text share its hash; the number of texts stays bounded by counting each once.
    return [(r["lang"], r["text"]) for r in chosen.select("lang", "text").distinct().sort(F.xxhash64("text"), "lang").limit(4 * SAMPLE * len(LANGUAGES)).collect()]


def is_case(segs: list[Segment], named: str | None) -> bool:
    """Whether a text of these segments has a missing or wrong label or mixes languages; ``named`` is the label's language."""
    return bool(segs) and bool(segs[0].close) and (named is None or len(segs) > 1 or named not in segs[0].close)


def identify(rows: DataFrame, keys: list[str], cases_only: bool = False, raw: str | None = None) -> DataFrame:
    """``<keys>, seg_no, lang, confidence, label`` of the segments of every text of ``<keys>, text, lang``.

    ``lang`` is the raw label; the dictionaries are fitted on the rows themselves.
    With ``cases_only`` the texts with a right label and one language are left
    out, and with them placeholders and rows whose column ``raw`` was read with
    the wrong encoding; a rejected segment then gives its likeliest language.
    """
    named = rows.select(*keys, "text", label(F.col("lang")).alias("label"), *([raw] if raw else []))
    context = rows.sparkSession.sparkContext
    fitted = fit(sample(named.select(F.col("label").alias("lang"), "text")))
    shared = context.broadcast((fitted, count_units(named.select(raw), word_counts) if raw else None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, frequencies = shared.value
        model = Classifier(*fitted)
        bytes_model = Model(frequencies) if raw else None
        kept: dict[str, list[Segment]] = {}
        for pdf in frames:
            at, no, lang, conf = [], [], [], []
            raws = pdf[raw] if raw else pdf["text"]
            for i, (t, named, r) in enumerate(zip(pdf["text"], pdf["label"], raws)):
                segs = kept.get(t)
                if segs is None:
                    segs = segments(t, model)
                    if len(t) < 200 and len(kept) < 100_000:
                        kept[t] = segs
                if cases_only and (not is_case(segs, named) or is_placeholder(t) or bytes_model and damaged(r, bytes_model)):
                    continue
                for k, x in enumerate(segs):
                    at.append(i), no.append(k + 1), lang.append(x.likely if cases_only else x.lang), conf.append(x.confidence)
            part = pdf.iloc[at]
            # An empty list would become a column of floats, which cannot be sent as strings.
            yield part[keys].assign(seg_no=no, lang=pd.Series(lang, dtype=object, index=part.index), confidence=conf, label=part["label"])

    types = dict(named.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", seg_no int, lang string, confidence double, label string"
    return named.where(F.col("text").isNotNull()).mapInPandas(run, schema)


def mislabelled(rows: DataFrame, keys: list[str], raw: str | None = None) -> DataFrame:
    """``<keys>, seg_no, lang``: the segments of the texts whose label is missing or wrong or that mix languages."""
    return identify(rows, keys, cases_only=True, raw=raw).select(*keys, "seg_no", "lang").distinct()
