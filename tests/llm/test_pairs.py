import random

import pytest

from glyphlake.llm import pairs as P
from glyphlake.llm.placeholders import is_placeholder
from tests.llm.test_texts import LINES, NOUNS

REFUSED = ["I'm sorry, but I can't translate this text.", "This content was declined by the policy check, no translation was produced.", "I won't be able to provide a translation for item K-9.", "抱歉，我无法翻译这段内容。", "申し訳ありませんが、この文章は翻訳できません。", "언어 모델로서 이 요청을 처리할 수 없습니다.", "Lo siento, no puedo traducir este texto.", "Als Sprachmodell darf ich diese Anfrage nicht bearbeiten.", "En tant que modèle de langue, je ne suis pas en mesure de répondre.", "Как языковая модель, я не могу выполнить этот запрос."]


def rows(n, seed):
    """Right pairs of every language with English sources, and figures that are carried over."""
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choice([x for x in LINES if x != "en"])
        picks = [(rnd.randrange(3), rnd.randrange(4), rnd.randint(100, 999)) for _ in range(rnd.randint(1, 2))]
        make = lambda x: " ".join(LINES[x][a].format(f"{NOUNS[x][b]} K-{c}") for a, b, c in picks)
        yield i, make("en"), make(lang), lang


def test_placeholders_and_refusals():
    assert all(map(is_placeholder, [None, "", " ", "N/A", "tbd", "待翻译", "[ ]", "...", '""', "_____", "(empty)", "-", "\n"]))
    assert not any(map(is_placeholder, ["0", "±0.5", "蝶阀", "none of it"]))


@pytest.fixture(scope="module")
def judge(spark):
    ordinary = ["The valve could not be closed, so the work has been rejected.", "It was refused by the site office.", "The water could not be drained from the tank.", "Process water flows through the pump.", "The contractor could not process the order in this context."]
    data = [(i, s, t, x) for i, s, t, x in rows(1500, 1)] + [(9000 + i, "x", t, "en") for i in range(80) for t in ordinary]
    df = spark.createDataFrame(data, "id long, source string, text string, lang string")
    return P.Judge(P.count_models(df))


def refusing(judge, text):
    return judge._refused(judge.scores([w for w in P.units_of(text) if w])[1])


def test_refusals_are_told_by_their_n_grams(judge):
    unseen = ["Sorry, but I'm not able to translate this sentence.", "ขออภัย ฉันไม่สามารถแปลประโยคนี้ได้", "क्षमा करें, मैं इसका अनुवाद नहीं कर सकता।", "Lo siento, no puedo traducir la frase."]
    assert [t for t in REFUSED + unseen if not refusing(judge, t)] == []
    for text in ("Drawing transmittal has been rejected. See note 4.", "The pump could not process the context water.", "Do not cover the beam, it cannot be reached from outside.", "I"):
        assert not refusing(judge, text), text
    # A refusal of any length, and none if the source says the same.
    long = "I am sorry, I cannot translate this text. " + "Rule 5 of the site applies to the pump and the valve in the plant room. " * 8
    assert len(long) > 401
    said = "Извините, я не могу перевести этот текст."
    assert judge.judge(["Check the valve.", said], [long, "I'm sorry, but I can't translate this text."], ["en", "en"])[0] == "refusal"
    assert judge.judge([said], ["I'm sorry, but I can't translate this text."], ["en"]) != ["refusal"]


def test_figures_of_any_length_can_be_missing():
    assert P._missing("Order 123456789012 of 0012", "Bestellung vom 12") == 1
    assert P._missing("Order 123456789012345678901234567890", "Auftrag 123456789012345678901234567890") == 0
    assert P._missing("९ ५", "9 5") == 0 and P._missing("9" * 5000, "x") == 1


def test_ratios_of_rare_languages_are_mixed_with_those_of_all(judge):
    assert set(judge.ratio) == set(P.LANGUAGES)


def test_prompt_posterior_decides_without_an_asked_language(judge):
    source = LINES["de"][1].format("Pumpe")
    assert judge.judge([source], ["Die Klappe ist beidseitig zu kennzeichnen."], [None]) == ["wrong_language"]
    assert judge.judge([source], [LINES["en"][2].format("pump")], [None]) == [None]


def test_copies():
    assert P.is_copy("Check the valve.", "CHECK  the valve") and P.is_copy("移交前检查", "Translation: 移交前检查") and P.is_copy("Check it now", "=> Check it now")
    assert not P.is_copy("DN65", "DN65") and not P.is_copy("DWG NO.1", "DWG NO.1") and not P.is_copy(None, "x") and not P.is_copy("Check the valve", "移交前检查")
    assert not P.is_copy("Check the valve", "移交前检查蝶阀。 Check the valve")


def test_defects(spark):
    good = list(rows(1500, 1))
    rnd = random.Random(2)
    bad = {}
    for i, s, t, x in rows(200, 3):
        kind = ("copy", "wrong_language", "truncated", "empty", "refusal")[i % 5]
        other = {"de": "fr", "fr": "de"}.get(x, "de")
        text = {"copy": s.upper(), "wrong_language": LINES[other][i % 3].format(NOUNS[other][i % 4]), "truncated": t[: rnd.randint(len(t) // 4, len(t) // 2)].rstrip(".。 "), "empty": rnd.choice([None, "", "TBD"]), "refusal": rnd.choice(REFUSED)}[kind]
        bad[10_000 + i] = (kind, s, text, x)
    data = [(i, s, t, x, "z") for i, s, t, x in good] + [(i, s, t, x, "z") for i, (k, s, t, x) in bad.items()]
    data += [(1, *data[1][1:])] + [(20_000, None, "移交前应检查水泵。", "zh", "z"), (20_001, "DN65", "DN65", "zh", "z"), (20_002, "x", "y " * 9000, None, "z")]
    df = spark.createDataFrame(data, "sheet_row_id long, source string, translation string, target_lang string, defect string")
    got = P.defects(df, "sheet_row_id", "source", "translation", "target_lang")
    assert got.columns == ["sheet_row_id", "defect"]
    found = {r["sheet_row_id"]: r["defect"] for r in got.collect()}
    assert len(found) == got.count()
    for kind in ("copy", "wrong_language", "empty", "refusal", "truncated"):
        ids = [i for i, b in bad.items() if b[0] == kind]
        assert sum(found.get(i) == kind for i in ids) >= 0.9 * len(ids), kind
    assert sum(i in found for i, *_ in good) <= 0.01 * len(good)
    assert 20_000 not in found and 20_001 not in found


def test_empty_table(spark):
    df = spark.createDataFrame([], "sheet_row_id long, source string, translation string, target_lang string")
    assert P.defects(df, "sheet_row_id", "source", "translation", "target_lang").count() == 0


@pytest.mark.parametrize("n", P.TAILS)
def test_tail_hashes_do_not_depend_on_what_precedes(n):
    a, b = P._codes("^abcdefghijklmnopqrst"), P._codes("xyz123^abcdefghijklmnopqrst")
    assert P.tail_hashes(a, n)[-1] == P.tail_hashes(b, n)[-1]
