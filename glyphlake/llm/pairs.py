r"""Defective pairs of a source text and its translation.

The checks are made in this order, and the first that holds is the defect.

``empty``: null, blank, marks only, or a placeholder.  ``refusal``: a sentence
whose character n-grams are more likely, by more than ``REFUSES`` nats each on
average, in sentences that refuse a translation (``REFUSALS``, the training
sentences) than in all translations, while no sentence of the source is such.
``copy``: the words of the source, in another format or after a short lead-in;
sources of codes and figures are rightly repeated.  ``wrong_language``: the
language posteriors of every sentence of the translation, by naive Bayes over
character 2- to 5-grams, put another language than the asked one first by more
than ``SURE`` nats, or by half of that if it is the one that the posterior of
the source puts first.  ``truncated``: the translation breaks off.  The evidence
is the likelihood of an end after the last characters (end-of-text n-grams of
three lengths, with back-off), the figures and codes of the source that are
missing, and how much shorter it is than translations of such sources are; it is
summed up in nats and compared with ``BROKEN``.

The models are counted over all rows and hashed into tables of fixed size; texts
are judged in batches, so that the n-grams of a batch are looked up at once.

Defined cases: a null source is compared by language only; with a null or
unknown asked language a translation is in the wrong one if every sentence is
clearly in the language of the source; texts of codes and figures have no
language; repeated rows give one result; an empty table gives none; texts of any
length are judged whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import language, sentences as boundaries
from glyphlake.llm.language import LANGUAGES, _fold, label
from glyphlake.llm.placeholders import is_placeholder


# Several checks ask the same of a text, and texts repeat.
@lru_cache(maxsize=50_000)
def worded(text: str) -> str:
    return language.worded(text)


@lru_cache(maxsize=50_000)
def words(text: str) -> str:
    return language.words(text)


@lru_cache(maxsize=20_000)
def sentences(text: str) -> list[tuple[int, int]]:
    return boundaries.sentences(text)


#: Nats by which another language must lead; nats of evidence for a broken-off text; nats an n-gram for a refusal.
SURE, BROKEN, REFUSES = 6.0, 5.0, 1.0
#: Of a refusal's n-grams this part is taken to be of refusals, the rest of any text; no n-gram counts for more than ``MOST`` nats.
OF_REFUSALS, MOST = 0.7, 4.0
#: Sentences with this part of their n-grams in the training sentences are no ordinary ones; n-grams that short ones are filled up with.
KNOWN_REFUSAL, FILL = 0.8, 8
#: Pairs of all languages that each language's length ratio is mixed with.
POOLED = 20
#: Hash buckets of a language's n-grams and of the end n-grams.
GRAMS, ENDS = 1 << 18, 1 << 20
#: Lengths of the n-grams of the language model.
GRAM_SIZES = (2, 3, 4, 5)
#: Characters of the end n-grams.
TAILS = (4, 8, 14)

# Sentences that refuse a translation, on which the n-grams of refusals are trained. Each line is one language.
REFUSALS = """
I'm sorry, but I can't translate this text. I am sorry, I cannot translate that. Unfortunately I cannot process the segment you sent me. I am unable to provide a translation of this content. As an AI language model I am not able to help with this request. As a language model I cannot assist with that. Apologies, I do not have enough context to translate this sentence. I won't be able to provide a translation for this item. I will not be able to translate this request. I refuse to translate it, as it violates the rules. Translation request refused: unsupported content. The translation was declined. This content was declined by the policy check, no translation was produced. No translation could be produced for this text. I must decline to translate this. Your request could not be processed. Sorry, this text cannot be translated. The translation was refused because of the content policy.
抱歉，我无法翻译这段内容。对不起，我不能翻译这段文字。很抱歉，无法提供翻译。作为人工智能助手，我不能处理该请求。作为语言模型，我无法完成此请求。该内容无法翻译。翻译请求被拒绝。由于政策限制，未能提供翻译。很遗憾，未能为您提供译文。我无法处理您的请求。
申し訳ありませんが、この文章は翻訳できません。申し訳ございませんが、翻訳することができません。この内容を翻訳することはできません。AI言語モデルとして、このご要望にはお応えできません。ご依頼の処理は対応できかねます。翻訳のリクエストは拒否されました。
죄송합니다. 이 텍스트를 번역할 수 없습니다. 죄송하지만 이 내용은 번역할 수 없습니다. 번역을 제공할 수 없습니다. 인공지능 언어 모델로서 이 요청을 처리할 수 없습니다. 번역 요청이 거부되었습니다. 요청하신 내용을 도와드릴 수 없습니다.
Es tut mir leid, ich kann diesen Text nicht übersetzen. Leider kann ich diesen Text nicht übersetzen. Entschuldigung, ich kann diesen Abschnitt nicht bearbeiten. Als KI-Sprachmodell kann ich bei dieser Anfrage nicht helfen. Die Übersetzung wurde abgelehnt. Es konnte keine Übersetzung erstellt werden.
Je suis désolé, je ne peux pas traduire ce texte. Désolé, je ne peux pas traduire cette phrase. Malheureusement, je ne suis pas en mesure de traduire ce contenu. En tant que modèle de langage, je ne peux pas répondre à cette demande. La demande de traduction a été refusée. Il est impossible de traduire ce texte.
Lo siento, no puedo traducir este texto. Lo siento, pero no puedo traducir esta frase. Lamentablemente no es posible traducir este contenido. Como modelo de lenguaje, no puedo atender esta solicitud. La solicitud de traducción fue rechazada. No me es posible ayudar con esta traducción.
Desculpe, não consigo traduzir este texto. Desculpe, mas não posso traduzir esta frase. Infelizmente não é possível traduzir este conteúdo. Como modelo de linguagem, não posso atender a este pedido. O pedido de tradução foi recusado. Não consigo ajudar com esta tradução.
Извините, я не могу перевести этот текст. К сожалению, я не могу перевести это предложение. Простите, перевести этот фрагмент невозможно. Как языковая модель, я не могу выполнить этот запрос. Запрос на перевод отклонён. Не удалось выполнить перевод.
ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้ ขอโทษ ไม่สามารถแปลเนื้อหานี้ได้ ในฐานะโมเดลภาษา ฉันไม่สามารถดำเนินการตามคำขอนี้ได้ คำขอแปลถูกปฏิเสธ ไม่สามารถให้คำแปลได้
क्षमा करें, मैं इस पाठ का अनुवाद नहीं कर सकता। माफ़ कीजिए, मैं इस वाक्य का अनुवाद नहीं कर सकती। खेद है कि इस सामग्री का अनुवाद संभव नहीं है। एक भाषा मॉडल के रूप में मैं इस अनुरोध को पूरा नहीं कर सकता। अनुवाद का अनुरोध अस्वीकार कर दिया गया।
"""
_ALNUM = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"[\W_]*(?:[^\W\d_]+[ '’]?){0,4}[:：>=\-–—]+[\W_]*|[\W_]*")
_FIGURE = re.compile(r"\d+")
#: Figures and codes, which are alike to an end n-gram.
_SHAPED = re.compile(r"(?:(?<![a-z])[a-z]{1,4}-?)?\d+(?:[.,:/]\d+)*(?:[a-z](?![a-z]))?")
_CODE = re.compile(r"\d+(?:[.,:/]\d+)*")
_IGNORED = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
#: Marks of a text that goes on; marks of one that is complete.
_OPEN_END = re.compile(r"(?:\.{2,}|…|[-–—,，、(（\[“„«])\s*$")
_FULL_STOP = re.compile(r"[.!?。！？।][\"'”’»)）\]]*\s*$")
_TRAIL = re.compile(r"[\W_]+$")
_BRACKET = re.compile(r"\s*[(（\[][^()（）\[\]]*[)）\]]\W*$")


def _bare(text: str) -> str:
    folded = text.upper().lower()
    return "".join(_ALNUM.findall(folded if folded.isascii() else unicodedata.normalize("NFKC", folded)))


def is_copy(source: str | None, text: str) -> bool:
    """Whether a text repeats the words of the source, perhaps after a lead-in."""
    if not source:
        return False
    a, b = _bare(source), _bare(text)
    if not a or not b.endswith(a) or not worded(source):
        return False
    if a == b:
        return True
    extra = len(b) - len(a)
    at, seen = 0, 0
    while at < len(text) and seen < extra:
        seen += len(_bare(text[at]))
        at += 1
    # What stands before the copy, up to its first letter or figure.
    while at < len(text) and not text[at].isalnum():
        at += 1
    return bool(_LEAD.fullmatch(text[:at]))


def shape(text: str) -> str:
    """A text for end n-grams: figures alike, without marks at its end."""
    return "^" + _SHAPED.sub("0", _TRAIL.sub("", (text if text.isascii() else _fold(text)).lower()))


def tail_hashes(codes: np.ndarray, n: int, buckets: int = ENDS) -> np.ndarray:
    """A bucket for the ``n`` characters that end at each character; zeros stand for no character."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for j in range(n):
        part = np.zeros(len(codes), dtype=np.uint64)
        part[j:] = codes[: max(0, len(codes) - j)]
        h = h * np.uint64(1_000_003) + part
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


#: Units whose n-grams are looked up at once.
BLOCK = 4096


def grams(units: list[str], sizes: tuple[int, ...] = GRAM_SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of some words each, one unit after the other, and where each unit's begin.

    The units stand between zeros; an n-gram with a zero before its last
    character reaches into another unit and is left out.
    """
    codes = _codes("\0" + "\0".join(f" {w} " for w in units) + "\0")
    stop = np.flatnonzero(codes == 0)
    since = np.arange(len(codes)) - np.repeat(stop, np.diff(np.r_[stop, len(codes)]))
    unit = np.cumsum(codes == 0) - 1
    found = [(unit[inside], tail_hashes(codes, n, GRAMS)[inside]) for n in sizes if len(inside := np.flatnonzero((since >= n) & (codes != 0)))]
    if not found:
        return np.empty(0, dtype=np.int64), np.zeros(len(units), dtype=np.int64)
    at, hashes = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return hashes[order], np.searchsorted(at[order], np.arange(len(units)))


def _value(figure: str) -> str:
    """A figure without leading zeros, in ASCII digits."""
    return (figure if figure.isascii() else "".join(str(unicodedata.digit(c, 0)) for c in figure)).lstrip("0") or "0"


def _missing(source: str, text: str) -> int:
    """How many figures and codes of the source a text does not have."""
    asked = set(_CODE.findall(source if source.isascii() else _IGNORED.sub("", source)))
    if not asked:
        return 0
    have = {_value(x) for x in _FIGURE.findall(text if text.isascii() else _IGNORED.sub("", text))}
    return sum(any(_value(x) not in have for x in _FIGURE.findall(c)) for c in asked)


def units_of(text: str) -> list[str]:
    """The words of each sentence of a text."""
    spans = sentences(text)
    return [words(text)] if len(spans) == 1 else [words(text[a:b]) for a, b in spans]


@lru_cache(maxsize=50_000)
def _content(text: str) -> float:
    """The length of the words of a text; an ideograph or a syllable counts as three letters."""
    return sum(3.0 if "⺀" <= c <= "鿿" or "가" <= c <= "힣" else 1.6 if "぀" <= c <= "ヿ" else 1.0 for c in words(text) if c != " ")


def refusal_counts() -> np.ndarray:
    """The n-grams of the training sentences."""
    said = [w for line in REFUSALS.strip().split("\n") for a, b in boundaries.sentences(line) if (w := words(line[a:b]))]
    return np.bincount(grams(said)[0], minlength=GRAMS).astype(float)


def count_models(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams by language; tails inside and at the end of sentences; moments of the length ratios by language."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs = np.zeros((len(LANGUAGES), GRAMS), dtype=np.int64)
        tails = np.zeros((2 * len(TAILS), ENDS), dtype=np.int64)
        ratios = np.zeros((len(LANGUAGES), 3))
        said = np.minimum(refusal_counts(), 1.0)
        no = {x: i for i, x in enumerate(LANGUAGES)}
        pad = "\0" * TAILS[-1]
        for pdf in frames:
            spoken: dict[int, list[str]] = {}
            ended: list[str] = []
            for source, text, lang in zip(pdf["source"], pdf["text"], pdf["lang"]):
                if is_placeholder(text):
                    continue
                k = no.get(lang)
                spans = sentences(text)
                if k is not None and worded(text):
                    spoken.setdefault(k, []).extend(w for w in units_of(text) if w)
                    if source and (a := _content(source)) > 12:
                        r = math.log(max(1.0, _content(text)) / a)
                        if abs(r) < 1.5:
                            ratios[k] += (1, r, r * r)
                ended += [shape(text[a:b]) for a, b in spans]
            for k, ws in spoken.items():
                hashes, starts = grams(ws)
                counts = np.diff(np.r_[starts, len(hashes)])
                refusing = np.add.reduceat(np.r_[said[hashes], 0.0], starts) * (counts > 0) >= KNOWN_REFUSAL * counts
                langs[k] += np.bincount(hashes[~np.repeat(refusing, counts)], minlength=GRAMS)
            codes = _codes(pad + pad.join(ended) + "\0")
            inside = codes != 0
            at_end = np.flatnonzero(inside[:-1] & ~inside[1:])
            for i, n in enumerate(TAILS):
                h = tail_hashes(codes, n)
                tails[2 * i] += np.bincount(h[inside], minlength=ENDS)
                tails[2 * i + 1] += np.bincount(h[at_end], minlength=ENDS)
        for table, kind in ((langs, 0), (tails, 1)):
            flat = table.ravel()
            hit = np.flatnonzero(flat)
            yield pd.DataFrame({"kind": kind, "h": hit.astype("int64"), "n": flat[hit].astype("float64")})
        yield pd.DataFrame({"kind": 2, "h": np.arange(ratios.size), "n": ratios.ravel()})

    parts = rows.where("text is not null").select("source", "text", "lang").mapInPandas(count, "kind int, h long, n double")
    sums = parts.groupBy("kind", "h").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros((len(LANGUAGES), GRAMS), dtype=np.float32), np.zeros((2 * len(TAILS), ENDS), dtype=np.float32), np.zeros((len(LANGUAGES), 3))]
    for kind, table in enumerate(out):
        own = sums[sums["kind"] == kind]
        table.ravel()[own["h"].to_numpy(dtype="int64")] = own["n"].to_numpy()
    return tuple(out)


class Judge:
    """Defects of pairs under the counted models."""

    def __init__(self, models: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        langs, self.tails, ratios = models
        totals = langs.sum(axis=1, keepdims=True)
        self.known = [x for x, t in zip(LANGUAGES, totals[:, 0]) if t > 0]
        self.at = {x: i for i, x in enumerate(self.known)}
        # N-grams by rows, so that those of one bucket stand together.
        self.log = np.ascontiguousarray(np.log((langs + 0.05) / (totals + 0.05 * GRAMS))[[LANGUAGES.index(x) for x in self.known]].T, dtype=np.float32)
        self.refuses = self._refusals(langs.sum(axis=0))
        n, pooled = ratios[:, 0], ratios.sum(axis=0) / max(1.0, ratios[:, 0].sum())
        spread = max(0.02, pooled[2] - pooled[1] ** 2)
        mean = (ratios[:, 1] + POOLED * pooled[1]) / (n + POOLED)
        square = (ratios[:, 2] + POOLED * (spread + mean**2)) / (n + POOLED)
        self.ratio = {x: (float(mean[i]), math.sqrt(max(0.02, float(square[i] - mean[i] ** 2)))) for i, x in enumerate(LANGUAGES)} if n.sum() else {}
        self._end: dict[str, float] = {}

    @staticmethod
    def _refusals(ordinary: np.ndarray) -> np.ndarray:
        """For each n-gram, the nats by which it is likelier in refusals than in all translations."""
        of = refusal_counts()
        common = (ordinary + 1.0) / (ordinary.sum() + GRAMS)
        return np.minimum(MOST, np.log(1 - OF_REFUSALS + OF_REFUSALS * (of / of.sum()) / common)).astype(np.float32)

    def scores(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit: the log-likelihood in every language, and the nats an n-gram for a refusal."""
        by_lang, refusing = np.zeros((len(units), len(self.known)), dtype=np.float32), np.zeros(len(units), dtype=np.float32)
        for i in range(0, len(units), BLOCK):
            hashes, starts = grams(units[i : i + BLOCK])
            counts = np.diff(np.r_[starts, len(hashes)])
            some = np.flatnonzero(counts)
            if len(some):
                by_lang[i + some] = np.add.reduceat(self.log[hashes], starts[some], axis=0)
                refusing[i + some] = np.add.reduceat(self.refuses[hashes], starts[some]) / (counts[some] + FILL)
        return by_lang, refusing

    def _refused(self, refusing: np.ndarray) -> bool:
        return bool(len(refusing)) and float(refusing.max()) > REFUSES

    def other_language(self, scores: np.ndarray, lang: str | None, source: str | None) -> bool:
        """Whether no sentence, given the scores of those that have words, is in the asked language."""
        if not len(scores) or not self.known:
            return False
        best = scores.argmax(axis=1)
        if lang not in self.at:
            if len(self.known) < 2 or (best != best[0]).any() or (prompt := self._language(source)) is None:
                return False
            second = np.partition(scores, -2, axis=1)[:, -2]
            return bool(best[0] == prompt and (scores.max(axis=1) - second > SURE).all())
        lead = scores.max(axis=1) - scores[:, self.at[lang]]
        if (lead > SURE).all():
            return True
        return bool((lead > SURE / 2).all() and (best == best[0]).all() and self._language(source) == best[0])

    def _language(self, text: str | None) -> int | None:
        """The language that the posterior of a source puts first; None if it has no words."""
        units = [w for w in units_of(text) if w] if text and worded(text) else []
        return int(self.scores([" ".join(units)])[0][0].argmax()) if units else None

    def end(self, text: str) -> float:
        """The probability that a text ends where it does."""
        tail = shape(text)[-(TAILS[-1] + 1) :]
        p = self._end.get(tail)
        if p is None:
            codes, p = _codes(tail), 0.05
            for i, n in enumerate(TAILS):
                h = tail_hashes(codes, n)[-1]
                p = (self.tails[2 * i + 1, h] + 2.0 * p) / (self.tails[2 * i, h] + 2.0)
            if len(self._end) < 200_000:
                self._end[tail] = p
        return float(p)

    def is_truncated(self, source: str | None, text: str, lang: str | None) -> bool:
        if not worded(text) and (not source or not worded(source)):
            return False
        return self.broken(source, text, lang) > BROKEN

    def broken(self, source: str | None, text: str, lang: str | None) -> float:
        """All evidence that a text breaks off, in nats."""
        last = sentences(text)[-1:]
        whole = _BRACKET.sub("", text)
        p = max(self.end(text[last[0][0] :]) if last else 1.0, self.end(whole) if whole != text else 0.0)
        end, missing, z, marks = -math.log(max(p, 1e-6)), 0, 0.0, 0.0
        if source:
            missing = _missing(source, text)
            a = _content(source)
            if lang in self.ratio and a > 5:
                mean, sd = self.ratio[lang]
                # The ratio of short texts, mere terms, varies more.
                z = (mean - math.log(max(1.0, _content(text)) / a)) / math.sqrt(sd * sd + 2.5 / a)
            if _OPEN_END.search(text) and not _OPEN_END.search(source):
                marks = 3.0
            elif _FULL_STOP.search(source) and not _FULL_STOP.search(text):
                marks = 1.0
        # A code may be left out of a complete text; a text that is also short or ends oddly lacks it as it breaks off.
        weight = 3.0 if end > 0.5 or z > 1.2 else 1.5
        return end + weight * (1 + math.log2(missing) if missing else 0.0) + 2.0 * max(0.0, z - 0.5) + marks

    def judge(self, sources: list[str | None], texts: list[str | None], langs: list[str | None]) -> list[str | None]:
        """The defect of each pair."""
        out: list[str | None] = ["empty" if is_placeholder(t) else None for t in texts]
        units: list[str] = []
        spans: dict[int, slice] = {}
        for i, t in enumerate(texts):
            if out[i] is None:
                mine = [w for w in units_of(t) if w]
                spans[i] = slice(len(units), len(units) + len(mine))
                units += mine
        by_lang, refusing = self.scores(units)
        for i, own in spans.items():
            source, text, lang = sources[i], texts[i], langs[i]
            if self._refused(refusing[own]) and not (source and self._refused(self.scores([w for w in units_of(source) if w])[1])):
                out[i] = "refusal"
            elif is_copy(source, text):
                out[i] = "copy"
            elif self.other_language(by_lang[own], lang, source):
                out[i] = "wrong_language"
            elif self.is_truncated(source, text, lang):
                out[i] = "truncated"
        return out


def defects(rows: DataFrame, key: str, source: str, text: str, lang: str) -> DataFrame:
    """``<key>, defect`` of every defective pair."""
    named = rows.select(F.col(key).cast("long").alias("row_id"), F.col(source).alias("source"), F.col(text).alias("text"), label(F.col(lang)).alias("lang"))
    shared = rows.sparkSession.sparkContext.broadcast(count_models(named))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for pdf in frames:
            found = judge.judge(*(pdf[c].tolist() for c in ("source", "text", "lang")))
            yield pd.DataFrame({"row_id": pdf["row_id"], "defect": found}).dropna(subset=["defect"])

    return named.mapInPandas(run, "row_id long, defect string").distinct().withColumnRenamed("row_id", key)
