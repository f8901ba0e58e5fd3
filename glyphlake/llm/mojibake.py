r"""Text read with the wrong encoding: byte lattices and corpus word frequencies.

A *reading* is a pair of encodings: the one the text was wrongly decoded with
and the one its bytes were written in.  A suspicious stretch is turned back
into the bytes of the wrong encoding -- a lost byte (U+FFFD) becomes a wildcard
-- and the bytes form a lattice whose arcs are the characters that one to four
of them spell in the right encoding.  A Viterbi search finds the best path
under the frequencies that words (in scripts without blanks: character pairs)
have in the whole corpus.  A stretch counts as damaged if a reading makes the
text around it more likely than it stands by more than ``MARGIN`` nats; a lost
byte or a C1 control is damage whether or not it can be restored.

The search is exact: hypotheses that no later byte can tell apart are one state.
These are the last character between pairs, the open word as long as some word
of the corpus begins so (prefixes are counted, too), and beyond that only the
open word's length, on which alone the cost of an unseen word depends.  Lost
bytes are wildcards in any number; a stretch (or, among plain letters, a word)
that lost more than half of its bytes is damaged, but nothing is left to read it
by.

The frequencies are counted over all texts of the table, garbled ones included,
and kept in hashed tables of fixed size (``ROWS`` of ``BUCKETS`` counters and one
for the prefixes, 24 MB), which bounds what is collected and broadcast whatever
the size of the corpus.  A unit's frequency is the least of its counters; it
counts as known only above the floor that ``NOISE`` of all counters exceed, so
that a full table makes rare words unknown and not all words known.

Defined cases: null and empty texts, and texts of ASCII characters only, are
undamaged; whole texts are read; repeated rows give one result; format codes
and escapes are ASCII and never count; an empty corpus leaves only lost bytes
and controls to be found.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a row, rows with hashes of their own, and the part of the counters that may exceed the floor of the known.
BUCKETS, ROWS, NOISE = 1 << 21, 2, 0.1
#: Counters of one way of counting: the rows and the prefixes.
SPACE = (ROWS + 1) * BUCKETS
#: Marks a counted prefix of a word; letters of the longest word (no language has longer ones: what goes on is another word).
PREFIX, LONGEST = "\x02", 200
#: Nats by which a reading must beat the text as it stands.
MARGIN = 3.0

LOST = "�"
#: The characters of code page 1252 above ASCII; undefined bytes stand for themselves.
_1252 = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)}
#: A decoder may also keep the C1 controls, as ISO 8859-1 has them.
_1252 |= {chr(b): b for b in range(0x80, 0xA0)}
_HI = re.escape("".join(_1252))
_CJK = "⺀-⿟々-〇぀-ヿㄅ-ㄯ㐀-䶿一-鿿가-힣豈-﫿ｦ-ﾟ"
WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f\W\d_][^\W\d_]*|[^\x00-\x7f\w\s]")
#: What is counted by pairs: scripts without blanks, and three or more accented letters in a row, which no language writes.
PAIRED = re.compile(f"[{_CJK}]+|[\u00a0-\u024f]{{3,}}")

#: Stretches that a reading may apply to, by wrong encoding: single-byte pages with single ASCII trail bytes between.
RUN_1252 = re.compile(f"[{_HI}{LOST}](?:[\\x40-\\x7e]?[{_HI}{LOST}])*[\\x40-\\x7e]?")
_1251 = "".join(sorted({bytes([b]).decode("cp1251", "ignore") for b in range(0x80, 0x100)}))
RUN_1251 = re.compile(f"[{re.escape(_1251)}{LOST}]{{2,}}")
_DOS = "─│┌┐└┘├┤┬┴┼═║╒╓╔╕╖╗╘╙╚╛╜╝╞╟╠╡╢╣╤╥╦╧╨╩╪╫╬▀▄█▌▐░▒▓■√≈≤≥⌠⌡"
RUN_DOS = re.compile(f"(?<![\\u0400-\\u045f])[\\u0400-\\u045f{_DOS}{re.escape('°²·÷©№¤')}{LOST}]*[{_DOS}][\\u0400-\\u045f{_DOS}{re.escape('°²·÷©№¤')}{LOST}]*")
RUN_WIDE = re.compile(f"[{_CJK}！-～　-〿{LOST}‐-⋿①-♯︰-﹫Α-ωЀ-ё]+")
SUSPECT = re.compile(f"[A-Za-z][\\u00a1-\\u024f„”‚‡‰Š‹Œ‘“•–—˜™š›œŸⁿ]|[\\u00a1-\\u024f„”‚‡‰Š‹Œ‘“•–—˜™š›œŸⁿ][A-Za-z]|[{LOST}\\x80-\\x9f]|[{_HI}][\\x40-\\x7e]?[{_HI}]|[Ѐ-ӿ{_DOS}]|[{_CJK}]")
DAMAGE = re.compile(f"[{LOST}\\x80-\\x84\\x86-\\x9f]")

SINGLE = ("utf-8", "gbk", "shift_jis", "cp949", "euc_jp", "big5", "cp1251", "koi8_r")


def _bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & (BUCKETS - 1)


def _buckets(unit: str | int) -> tuple[int, ...]:
    """The counters of a unit, one a row, or of a prefix; a number is a counter itself."""
    if isinstance(unit, int):
        return (unit,)
    h = xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"), 42)
    if unit[0] == PREFIX:
        return (ROWS * BUCKETS + (h & (BUCKETS - 1)),)
    return h & (BUCKETS - 1), BUCKETS + ((h >> 32) & (BUCKETS - 1))


def tokens(text: str) -> Iterator[str]:
    """The counted units of a text: words with a letter beyond ASCII, symbols, character pairs of scripts without blanks."""
    for w in WORD.findall(text):
        if w[0] > "⹿" or PAIRED.search(w):
            at = 0
            for m in PAIRED.finditer(w):
                if m.start() > at:
                    yield w[at : m.start()]
                run = m.group()
                yield run[0]
                for k in range(len(run) - 1):
                    yield run[k : k + 2]
                at = m.end()
            if at < len(w):
                yield w[at:]
        else:
            yield w


def word_counts(texts: Iterable[str]) -> Counter[str | int]:
    """The units of some texts, and the counters of the prefixes of their words."""
    whole: Counter[str] = Counter()
    for t in texts:
        if not t.isascii():
            whole.update(WORD.findall(t))
    units: Counter[str | int] = Counter()
    for w, n in whole.items():
        for u in tokens(w):
            units[u] += n
        if w[0].isalpha() and not WIDE.search(w):
            h = xxhash.xxh64(PREFIX.encode(), 42)
            for c in w[:LONGEST]:
                h.update(c.encode("utf-8", "surrogatepass"))
                units[ROWS * BUCKETS + (h.intdigest() & (BUCKETS - 1))] += n
    return units


def count_units(texts: DataFrame, *counters: Callable[[Iterable[str]], Counter[str]]) -> np.ndarray:
    """Frequencies over all texts (one string column), hashed into ``SPACE`` counters for each way of counting."""
    name, size = texts.columns[0], SPACE * len(counters)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for pdf in frames:
            for k, counter in enumerate(counters):
                for u, n in counter(pdf[name]).items():
                    for b in _buckets(u):
                        total[k * SPACE + b] += n
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"h": hit.astype("int32"), "n": total[hit]})

    parts = texts.where(F.col(name).isNotNull()).mapInPandas(count, "h int, n long")
    sums = parts.groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size, dtype=np.uint32)
    table[sums["h"].to_numpy(dtype="int64")] = np.minimum(sums["n"].to_numpy(dtype="int64"), 2**32 - 1)
    return table


class Model:
    """Log-probabilities of texts under the corpus frequencies."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        rows = table[: ROWS * BUCKETS].reshape(ROWS, BUCKETS)
        place = int((1 - NOISE) * (BUCKETS - 1))
        self.floor = tuple(int(np.partition(r, place)[place]) if np.count_nonzero(r) > NOISE * BUCKETS else 0 for r in rows)
        self.total = math.log(max(1.0, float(rows[0].sum())))
        self._starts: dict[str, bool] = {}
        self._memo: dict[str, float] = {}
        self.runs: dict[str, list[tuple[int, int, str]]] = {}

    def unit(self, u: str) -> float:
        v = self._memo.get(u)
        if v is None:
            counts = [int(self.table[b]) for b in _buckets(u)]
            n = min(counts) if all(c > f for c, f in zip(counts, self.floor)) else 0
            # An unseen word costs more the longer it is: it must be spelled.
            v = math.log(n) - self.total if n else -self.total - 1.5 - (2.5 * len(u) if u[0] < "⺀" else 4.0)
            if len(self._memo) < 200_000:
                self._memo[u] = v
        return v

    def starts(self, word: str) -> bool:
        """Whether some word of the corpus begins so."""
        v = self._starts.get(word)
        if v is None:
            v = bool(self.table[_buckets(PREFIX + word)[0]])
            if len(self._starts) < 200_000:
                self._starts[word] = v
        return v

    def score(self, text: str) -> float:
        return sum(map(self.unit, tokens(text)))

    def knows(self, text: str) -> bool:
        """Whether the corpus has every unit of the text."""
        return all(self.unit(u) > -self.total - 1 for u in tokens(text))


@lru_cache(maxsize=None)
def _arc(piece: bytes, right: str) -> str:
    try:
        c = piece.decode(right)
    except UnicodeDecodeError:
        return ""
    return c if len(c) == 1 and (c >= " " or c in "\t\n") and not "\x7f" <= c < "\xa0" and not "" <= c <= "" else ""


#: Bytes a character may take, by encoding.
WIDTHS = {"utf-8": (1, 2, 3, 4), "gbk": (1, 2), "shift_jis": (1, 2), "cp949": (1, 2), "euc_jp": (1, 2), "big5": (1, 2)}


@lru_cache(maxsize=4096)
def _wild(pattern: tuple[int | None, ...], right: str) -> tuple[str, ...]:
    """The characters whose bytes match a pattern with lost bytes (``None``)."""
    free = [i for i, b in enumerate(pattern) if b is None]
    # Where all bytes of a wide encoding are lost, only Latin letters among others can be told; they take two bytes at most.
    if len(free) == len(pattern) > 2:
        return ()
    out = []
    for lost in product(*(range(0x80, 0xC0) if right == "utf-8" and i else range(0x80, 0x100) for i in free)):
        piece = bytearray(b or 0 for b in pattern)
        for i, x in zip(free, lost):
            piece[i] = x
        c = _arc(bytes(piece), right)
        if c and (c.isalpha() or c in "±°²³½×·，。；：、（）「」“”…—") and (len(free) < len(pattern) or right not in WIDTHS or c < "\u0180"):
            out.append(c)
    return tuple(out)


def viterbi(data: list[int | None], right: str, model: Model, left: str = "", after: str = "", known: bool = False) -> str | None:
    """The best decoding of a byte lattice between two contexts; None if there is no path.

    A state is the last character, if pairs are counted with it, and the open
    word; of an open word that no word of the corpus begins with, only the
    length and whether it is ASCII.  Each state keeps its best ``(score of the
    closed units, open word, text)``; of equal ones the least text.  With ``known``
    only words that some word of the corpus begins with are followed.
    """
    n, unit = len(data), model.unit

    def closed(word: str) -> float:
        return unit(word) if word and not word.isascii() else 0.0

    def add(h: tuple[float, str, str], c: str) -> tuple[float, str, str]:
        score, word, text = h
        if WIDE.match(c):
            prev = text[-1:] or left[-1:]
            return score + unit(prev + c if WIDE.match(prev) else c) + closed(word), "", text + c
        if c.isalpha():
            return score, word + c, text + c
        return score + closed(word) + (unit(c) if c > "\x7f" else 0.0), "", text + c

    def state(word: str, text: str) -> tuple:
        if not word:
            return (text[-1:] if WIDE.match(text[-1:] or left[-1:] or " ") else "",)
        return (word,) if model.starts(word) else (len(word), word.isascii())

    first = "" if WIDE.search(left) else left
    steps: list[dict[tuple, tuple[float, str, str]]] = [{} for _ in range(n + 1)]
    steps[0] = {(): (0.0, first, "")}
    for i in range(n):
        here, steps[i] = steps[i], {}
        for width in WIDTHS.get(right, (1,)) if here else ():
            if i + width > n:
                break
            piece = tuple(data[i : i + width])
            if width == 1 and piece[0] is not None and piece[0] < 0x80:
                cs: tuple[str, ...] = (chr(piece[0]),)
            elif None in piece:
                cs = _wild(piece, right)
            else:
                cs = (c,) if (c := _arc(bytes(piece), right)) else ()
            many, there = None in piece, steps[i + width]
            for h in here.values():
                for c in cs:
                    if not many or c.isalpha() or not (h[2] or left) and after[:1] in ("", "C", "F"):
                        new = add(h, c)
                        key = state(new[1], new[2])
                        if known and len(key) > 1:
                            continue
                        old = there.get(key)
                        if old is None or (-new[0], new[2]) < (-old[0], old[2]):
                            there[key] = new
    ends = [(-v - closed(word + after if word else ""), text) for v, word, text in steps[n].values()]
    return min(ends)[1] if ends else None


WIDE = re.compile(f"[{_CJK}]")


def _bytes(run: str, wrong: str) -> list[int | None] | None:
    """The bytes of a stretch in the encoding it was read with; lost ones are None."""
    if wrong != "cp1252" and LOST not in run:
        try:
            return list(run.encode(wrong))
        except UnicodeEncodeError:
            return None
    out: list[int | None] = []
    for c in run:
        if c == LOST:
            out.append(None)
        elif wrong == "cp1252":
            b = _1252.get(c, ord(c) if c < "\x80" else None)
            if b is None:
                return None
            out.append(b)
        else:
            try:
                out.extend(c.encode(wrong))
            except UnicodeEncodeError:
                return None
    return out


#: Letters that bytes of another encoding spell by chance.
STRANGE = re.compile("[\u0250-\u02c5\u02c7-\u02db\u02dd-\u03ff\u0500-\u08ff\u0980-\u0dff]")


def _decode(data: list[int | None], right: str, model: Model, left: str, after: str) -> str | None:
    if None not in data:
        try:
            s = bytes(data).decode(right)
        except UnicodeDecodeError:
            return None
        return None if STRANGE.search(s) or re.search("[\x00-\x08\x0b-\x1f\x7f-\x9f-]", s) else s
    return viterbi(data, right, model, left, after)


def _edges(text: str, a: int, b: int) -> tuple[str, str]:
    """The word parts that stand directly before and after a stretch."""
    i = a
    while i > 0 and a - i < LONGEST and (text[i - 1].isalpha() or unicodedata.category(text[i - 1]) == "Mn"):
        i -= 1
    j = b
    while j < len(text) and j - b < LONGEST and text[j].isalpha():
        j += 1
    return text[i:a], text[b:j]


CYRILLIC = re.compile("[А-яЁё №«»°±\x00-\x7f]*[А-я][А-яЁё №«»°±\x00-\x7f]*")


def _best(text: str, a: int, b: int, readings: tuple[tuple[str, str], ...], model: Model, margin: float) -> str | None:
    """The restored stretch, if a reading (or two, one upon the other) beats it as it stands."""
    run = text[a:b]
    left, after = _edges(text, a, b)
    stands = model.score(left + run + after)
    best, out = stands + margin, None
    for wrong, right in readings:
        s = run
        for _ in range(3):
            data = _bytes(s, wrong)
            if data is None or all(x is not None and x < 0x80 for x in data) or 2 * data.count(None) > len(data):
                break
            s2 = _decode(data, right, model, left, after)
            if s2 is None or s2 == s or (right in ("cp1251", "koi8_r", "cp866") and not CYRILLIC.fullmatch(s2)):
                break
            s = s2
            # Bytes that spell UTF-8 hardly ever do so by chance; other readings must give known units only.
            if (right == "utf-8" and wrong in ("cp1252", "cp1251") or model.knows(left + s + after)) and (v := model.score(left + s + after)) > best:
                best, out = v, s
            if (wrong, right) != ("cp1252", "utf-8"):
                break
    return out


R_1252 = tuple(("cp1252", r) for r in SINGLE)
R_1251 = (("cp1251", "utf-8"), ("cp1251", "cp866"), ("cp1251", "koi8_r"))
R_DOS = (("koi8_r", "cp1251"), ("cp866", "cp1251"), ("koi8_r", "utf-8"), ("cp866", "utf-8"), ("cp437", "utf-8"), ("cp437", "cp1251"), ("cp850", "cp1252"), ("cp437", "cp1252"))
R_WIDE = tuple((w, r) for w in ("gbk", "shift_jis", "cp949", "big5") for r in ("utf-8", "cp1251", "shift_jis", "cp949", "gbk", "euc_jp") if w != r)
UTF8_BYTES = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}|[\xc3-\xdf][\x80-\xbf]){2,}")


HAN_PART = re.compile("[一-鿿]+")


def _wide_parts(run: str) -> Iterator[tuple[int, int]]:
    """Parts of a stretch of wide characters that may be damaged, in characters."""
    yield 0, len(run)
    if SYLLABLES.search(run) and HAN_PART.search(run):
        yield from (m.span() for m in HAN_PART.finditer(run) if m.end() - m.start() >= PART)
    for wrong in ("gbk", "shift_jis", "big5", "cp949"):
        if not UTF8_BYTES.search(run.encode(wrong, "replace")):
            continue
        ends, data = [0], b""
        for c in run:
            data += c.encode(wrong, "replace")
            ends.append(len(data))
        where = {e: i for i, e in enumerate(ends)}
        for m in UTF8_BYTES.finditer(data):
            # The outermost places in the match where characters of both encodings begin.
            starts = [x for x in range(m.start(), m.end() + 1) if (x == m.end() or not 0x80 <= data[x] < 0xC0) and x in where]
            if len(starts) > 1 and where[starts[-1]] - where[starts[0]] >= PART and (part := (where[starts[0]], where[starts[-1]])) != (0, len(run)):
                yield part


#: Characters that a damaged part of a wide stretch has at least; fewer are too little evidence.
PART = 3
SYLLABLES = re.compile("[가-힣ぁ-ヿ]")
CJK_RUN = re.compile(f"[{_CJK}]+")
#: Wide characters in a row that may be letters of a Latin text.
LONE = 3
R_LONE = tuple((w, r) for w in ("gbk", "shift_jis", "cp949", "big5") for r in ("utf-8", "cp1252"))
#: What a few wide characters can stand for: accented letters with small ones beside them, degrees, signs.
LATIN_TEXT = re.compile("[a-z]?[À-ÖØ-öø-ɏ]{1,3}[a-z]?|°[CF]?|[±²³½¼¾µ·×]")


def _lone(text: str, a: int, b: int, model: Model) -> str | None:
    """A few wide characters among Latin letters, read as what they spell there."""
    left, after = _edges(text, a, b)
    run = text[a:b]
    if any(x and CJK_RUN.match(x) for x in (text[:a].rstrip()[-1:], text[b:].lstrip()[:1])):
        return None
    best, out = model.score(left + run + after) + MARGIN, None
    for wrong, right in R_LONE:
        try:
            s = run.encode(wrong).decode(right)
        except UnicodeError:
            continue
        if LATIN_TEXT.fullmatch(s) and model.knows(left + s + after) and (v := model.score(left + s + after)) > best:
            best, out = v, s
    return out


def _wide(text: str, start: int, end: int, model: Model) -> list[tuple[int, int, str]]:
    """The damaged parts of one stretch of wide characters; texts repeat them, so they are kept."""
    run = text[start:end]
    hit = model.runs.get(run)
    if hit is None:
        hit, last = [], 0
        for a, b in _wide_parts(run):
            # What stands beside a damaged part is no part of its words.
            if a >= last and (s := _best(run[a:b], 0, b - a, R_WIDE, model, MARGIN)):
                hit.append((a, b, s))
                last = b
        if len(model.runs) < 200_000:
            model.runs[run] = hit
    return [(start + a, start + b, s) for a, b, s in hit]


def _lost_word(text: str, at: int, model: Model) -> list[tuple[int, int, str | None]]:
    """What was lost from ``at`` on in a word, read in the Latin page as a word of the corpus."""
    a = at
    while a > 0 and at - a < LONGEST and (text[a - 1].isalpha() or text[a - 1] == LOST):
        a -= 1
    b = at + 1
    while b < len(text) and b - a < LONGEST and (text[b].isalpha() or text[b] == LOST):
        b += 1
    data = _bytes(text[a:b], "cp1252")
    if b - a > 1 and data is not None and 2 * data.count(None) <= len(data):
        word = viterbi(data, "cp1252", model, known=True)
        if word is not None and len(word) == b - a and model.knows(word):
            stop = text.rindex(LOST, at, b) + 1
            return [(at, stop, word[at - a : stop - a])]
    return [(i, i + 1, None) for i in range(at, b) if text[i] == LOST]


def damaged(text: str | None, model: Model) -> list[tuple[int, int, str | None]]:
    """``(start, end, restored)`` of every damaged stretch; ``restored`` is None if nothing fits."""
    if not text or text.isascii() or not SUSPECT.search(text):
        return []
    found: list[tuple[int, int, str | None]] = []

    def take(a: int, b: int, s: str | None) -> None:
        found.append((a, b, s))

    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, y, _ in found)

    for m in RUN_WIDE.finditer(text):
        a, b = m.span()
        if b - a <= LONE and CJK_RUN.search(m.group()) and (s := _lone(text, a, b, model)):
            take(a, b, s)
            continue
        if b - a == 1:
            continue
        for a, b, s in _wide(text, *m.span(), model):
            if free(a, b):
                take(a, b, s)
    if re.search("[Ѐ-ӿ]", text):
        for m in RUN_1251.finditer(text):
            if free(*m.span()) and (s := _best(text, *m.span(), R_1251, model, MARGIN)):
                take(*m.span(), s)
        for m in RUN_CYRILLIC.finditer(text):
            if free(*m.span()) and not model.knows(m.group()) and (s := _best(text, *m.span(), R_DOS[:2], model, 2 * MARGIN)):
                take(*m.span(), s)
    for m in RUN_1252.finditer(text):
        a, b = m.span()
        run = m.group()
        if sum(c > "\x7f" for c in run) < 2:
            # One byte among plain letters; all that are lost in a word are sought at once.
            if LOST in run and free(*(x := (a + run.index(LOST), a + run.index(LOST) + 1))):
                found += _lost_word(text, x[0], model)
            continue
        if not free(a, b):
            continue
        for cut in (0, 1):  # a last ASCII character may be no trail byte
            e = b - cut
            if cut and not ("\x40" <= run[-1] <= "\x7e"):
                break
            ascii_only = set(run) <= {LOST} | set(map(chr, range(128)))
            readings = (("cp1252", "utf-8"), ("cp1252", "cp1252")) if ascii_only else R_1252
            if s := _best(text, a, e, readings, model, MARGIN):
                take(a, e, s)
                break
        else:
            if LOST in run:
                take(a, b, None)
    for m in RUN_DOS.finditer(text):
        if free(*m.span()) and (s := _best(text, *m.span(), R_DOS, model, MARGIN)):
            take(*m.span(), s)
    for m in LATIN_WORD.finditer(text):
        if free(*m.span()) and (s := _reread(m.group(), model)):
            take(*m.span(), s)
    for m in DAMAGE.finditer(text):
        if free(*m.span()):
            take(m.start(), m.end(), None)
    return sorted(found)


RUN_CYRILLIC = re.compile("[Ѐ-ё]{3,}(?: [Ѐ-ё]+)*")


#: Words with a few characters beyond ASCII among letters, as a page of another system may show them.
LATIN_WORD = re.compile(f"[A-Za-z]*[\u00a1-\u024f{_DOS}„”‚’‡‰Š‹Œ‘“•–—˜™š›œŸⁿ]+[A-Za-z]+(?:[\u00a1-\u024f{_DOS}„”‚’‡‰Š‹Œ‘“•–—˜™š›œŸⁿ]+[A-Za-z]*)*|[A-Za-z]{{2,}}[\u00a1-\u024f{_DOS}ⁿ]+")
R_WORD = (("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"))
#: A word reread must be so many times as frequent as it stands.
FREQUENT = 20


def _reread(word: str, model: Model) -> str | None:
    """A word as another single-byte page has it, if the corpus knows that far better than what stands."""
    stands = model.score(word)
    for wrong, right in R_WORD:
        try:
            s = word.encode(wrong).decode(right)
        except UnicodeError:
            continue
        if s != word and PLAIN_WORD.fullmatch(s) and model.knows(s) and model.score(s) > stands + math.log(FREQUENT):
            return s
    return None


PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")


def restore(text: str, spans: list[tuple[int, int, str | None]]) -> str:
    """The text with what could be restored put in place."""
    out, at = [], 0
    for a, b, s in spans:
        if a >= at:
            out += [text[at:a], text[a:b] if s is None else s]
            at = b
    return "".join([*out, text[at:]])


def find_damaged(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, restored, unrestored``: every row with a damaged stretch, its restored text, and how many stretches stay damaged."""
    rows = df.select(df[key].cast("long").alias("row_id"), df[text].alias("text")).where("row_id is not null and text is not null")
    shared = df.sparkSession.sparkContext.broadcast(count_units(rows.select("text"), word_counts))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        kept: dict[str, list[tuple[int, int, str | None]]] = {}
        for pdf in frames:
            out = []
            for i, t in zip(pdf["row_id"], pdf["text"]):
                if t.isascii():
                    continue
                if (spans := kept.get(t)) is None:
                    spans = damaged(t, model)
                    if len(t) < 200 and len(kept) < 200_000:
                        kept[t] = spans
                if spans:
                    out.append((i, restore(t, spans), sum(s is None for *_, s in spans)))
            yield pd.DataFrame(out, columns=["row_id", "restored", "unrestored"])

    return rows.mapInPandas(find, "row_id long, restored string, unrestored int").distinct().withColumnRenamed("row_id", key)
