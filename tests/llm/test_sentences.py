import pytest
from hypothesis import given
from hypothesis import strategies as st

from glyphlake.llm.sentences import sentence_units, sentences

CASES = [
    ["Check the valve.", "See Dwg. No. 40, approx. 3.3 m from the grid.", "Stop!"],
    ["This applies to Rev. B.", "Delivery follows in Dec. as agreed with the U.K. office."],
    ['The fitter noted "Closed at 7.7 bar."', "Seal it."],
    ['"Is the valve shut?" asked the inspector.', "pH of the water stays near 7."],
    ['The label reads "Do not open. Call the operator." and must stay.', "The old note is no longer valid..."],
    ["Shipped in two lots... if the site is ready.", "Why was it moved?!", "The file is plan_4.dxf in version 2.4."],
    ["Im 2. OG sind max. 5 Stück zulässig, mind. aber zwei.", "Am 3. Oktober beginnt die Montage.", "Das Maß gilt i. d. R. ab OK (vgl. Abschn. 2.3)."],
    ["Das Schild „Nicht öffnen! Leitstelle anrufen.“ muss bleiben.", "Der Monteur schrieb: „Alles dicht.“", "Die Höhe ist +3,2 m.", "Ende."],
    ["L'étiquette « Ne pas ouvrir. Appeler. » doit rester.", "Arrêter tous les travaux !", "La sté. Norvik livre en deux fois… si tout va bien."],
    ["¡Detener todo!", "¿Es necesario?", "El Sr. inspector firmará, p. ej., el acta.", "El montador anotó: «Todo cerrado.»", "Fin."],
    ["См. рис. 16 и черт. M-4, прим. 7,3 м от оси.", "Ключи, лампы и т. д.", "Применять, т. е. как для F-4."],
    ["อย่าเปิด", "ดูแบบเลขที่ S-726", "เว้นช่องว่าง 290 มิลลิเมตร", "ติดตั้งสูง 8.2 เมตร"],
    ["सभी वेल्ड को रंगें।", "क्या यह आवश्यक है?"],
]
UNSPACED = [
    ["标牌“严禁合闸。有人工作。”应保持清晰可见。", "先关闭阀门……再断开回路。", "安装人员记录：“已全部关闭。”", "应急灯坏了！"],
    ["监理问：“阀门关了吗？”并做了记录。", "执行第2.1条（注X除外。）的规定。"],
    ["「開けないこと。呼ぶこと。」という表示を残す。", "作業者の記録は「すべて閉止済み。」", "本図を見よ。"],
]


@pytest.mark.parametrize("want", CASES + UNSPACED)
def test_texts(want):
    text = ("" if want in UNSPACED else " ").join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


def test_korean_and_missing_spaces():
    text = '작업자는 "모두 닫음."이라고 기록했다. 확인한다.시공한다.'
    assert [text[a:b] for a, b in sentences(text)] == ['작업자는 "모두 닫음."이라고 기록했다.', "확인한다.", "시공한다."]
    text = "Installer le filtre.Vérifier la pompe."
    assert len(sentences(text)) == 2


def test_layout():
    text = "2.7 Fire protection\n\n- First entry. Still it.\n(2) Second\n3. 16 valves were moved.\nA line. Another\n  \n"
    assert [text[a:b] for a, b in sentences(text)] == ["2.7 Fire protection", "- First entry. Still it.", "(2) Second", "3. 16 valves were moved.", "A line.", "Another"]


def test_hard_wrap():
    text = "The contractor shall confirm all dimensions on site before\nfitting the pump. See Fig.\n\n1) Item K9 replaces the former detail and\n\nThe gap around the heating coil shall not exceed the given\nvalue."
    got = [text[a:b].replace("\n", " ") for a, b in sentences(text)]
    assert got[0].endswith("fitting the pump.") and got[-1].endswith("given value.")


def test_defined_cases(spark):
    assert sentences(None) == sentences("") == sentences(" \n\t ") == []
    assert sentences("word") == [(0, 4)] and sentences("...") == [(0, 3)]
    assert len(sentences("A short one. " * 20000)) == 20000
    df = spark.createDataFrame([(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, " ", 0), (None, "x", 0)], "doc_id long, text string, row_id int")
    got = sentence_units(df, "doc_id", "text")
    assert got.columns == ["doc_id", "sent_start", "sent_end"] and {tuple(r) for r in got.collect()} == {(1, 0, 4), (1, 5, 9)} and got.count() == 2
    assert sentence_units(df.limit(0), "doc_id", "text").count() == 0


@given(st.text(alphabet="aB9 .!?…\n\"„“«»()（）。！？“”「」ก한д-:,\t", max_size=80))
def test_units_cover_all_and_do_not_overlap(text):
    spans = sentences(text)
    covered = set()
    for a, b in spans:
        assert a < b and text[a:b] == text[a:b].strip() and not covered & set(range(a, b))
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def _parts(text):
    return [text[a:b] for a, b in sentences(text)]


def test_plain_words_end_sentences_and_abbreviations_do_not():
    assert _parts("He said no. Then he left.") == ["He said no.", "Then he left."]
    assert _parts("Read the spec. The pump runs.") == ["Read the spec.", "The pump runs."]
    assert _parts("It is the max. Then stop.") == ["It is the max.", "Then stop."]
    assert _parts("It takes max. 5 bar. See no. A-12.") == ["It takes max. 5 bar.", "See no. A-12."]
    assert _parts("सं. 5 देखें। पंप चालू है।") == ["सं. 5 देखें।", "पंप चालू है।"]


def test_each_sentence_of_a_mixed_text_finds_its_table():
    text = "The pump is in the room of the building. Die Zeichnung Nr. Fünf ist für den Bau gültig und die Maße sind im Plan."
    assert len(_parts(text)) == 2


def test_texts_wrapped_at_any_width_are_one_paragraph():
    import textwrap

    para = "the contractor shall provide all labour and materials for the installation of the pumps and valves in the plant room before the start of the heating season and shall keep the records of all tests that were made on the site during the work so that the engineer can see them at any time."
    for width in (22, 26, 40, 80, 119, 150):
        assert len(sentences(textwrap.fill(para, width))) == 1, width
    assert len(sentences("Pump room\nfire damper\nvalve")) == 3


def test_script_of_a_position_is_looked_for_in_the_whole_sentence():
    text = "ポンプ" + "-1234567890" * 20 + "。次の文。"
    assert _parts(text) == [text[:-4], "次の文。"]
