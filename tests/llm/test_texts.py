"""Wrong encodings, look-alikes, languages: round trips and held-out accuracy on small corpora."""

import random

import pytest

from glyphlake.llm import language as G
from glyphlake.llm import lookalikes as K
from glyphlake.llm import mojibake as M

CORPUS = ["Die Umwälzpumpe ist 2,5 m über dem fertigen Fußboden zu montieren.", "La température de départ est limitée à 18 °C en hiver.", "移交前应检查水泵房内的控制柜。", "排水立管四周的间隙不得大于465mm。", "Перед сдачей проверить кабельный лоток на кровле.", "引き渡し前に制御盤を点検すること。", "인계 전에 분전반 상태를 점검할 것.", "Steel beam K-136", "Viga metálica ±0,5", "Leave 371 m² for T-929.", "HVAC-120 °C"]
SHORT = "row_id long, text string, src_table string, form int, restored string"


@pytest.fixture(scope="module")
def table():
    import numpy as np

    texts = CORPUS * 40
    out = np.zeros(2 * M.SPACE, dtype="uint32")
    for k, counter in enumerate((M.word_counts, K.pair_counts)):
        for u, n in counter(texts).items():
            for b in M._buckets(u):
                out[k * M.SPACE + b] += n
    return out


PAIRS = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("gbk", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "cp1251"), ("latin-1", "gbk"), ("latin-1", "shift_jis"), ("latin-1", "cp949"), ("latin-1", "euc_jp"), ("gbk", "cp1251"), ("gbk", "cp949"), ("gbk", "shift_jis")]


@pytest.mark.parametrize("wrong,right", PAIRS)
def test_round_trip(table, wrong, right):
    model, tried = M.Model(table[: M.SPACE]), 0
    for text in CORPUS:
        try:
            bad = text.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if bad == text or text.isascii() or right != "utf-8" and ("Latin" in right or any(c in "äöüßéè²±°á" for c in text)):
            continue
        tried += 1
        spans = M.damaged(bad, model)
        assert spans, bad
        # A single wide character is too little evidence, and stays.
        if wrong != "gbk":
            assert M.restore(bad, spans) == text, (bad, M.restore(bad, spans))
    assert tried or wrong in ("gbk", "cp1251")


def test_twice_wrong_lost_bytes_and_clean_texts(table):
    model = M.Model(table[: M.SPACE])
    twice = CORPUS[0].encode().decode("cp1252").encode().decode("cp1252")
    assert M.restore(twice, M.damaged(twice, model)) == CORPUS[0]
    lost = "Viga met�lica ±0,5"
    assert M.restore(lost, M.damaged(lost, model)) == "Viga metálica ±0,5"
    assert M.damaged("q�z", model) and M.damaged("a\x81b", model)
    for text in [*CORPUS, None, "", "plain ascii", "Größe", "½ Ø ° ± ²", r"\A1;%%c"]:
        assert M.damaged(text, model) == []


def counted(texts):
    import numpy as np

    out = np.zeros(M.SPACE, dtype="uint32")
    for u, n in M.word_counts(texts).items():
        for b in M._buckets(u):
            out[b] += n
    return out


@pytest.mark.parametrize("text,right", [("Größenänderung", "cp1252"), ("Fußböden", "utf-8"), ("控制柜温度", "gbk"), ("насосы", "cp1251"), ("분전반", "cp949")])
def test_search_is_exact(text, right):
    """Against all decodings of lattices with one or two lost bytes."""
    from itertools import product

    model = M.Model(counted([*CORPUS * 9, text, text[::-1], "Grüßenänderung", "Fußbäden"]))
    data = list(text.encode(right))
    spots = [i for i, b in enumerate(data) if b >= 0x80]
    for lost in (spots[:1], spots[-1:], [spots[0], spots[-1]]):
        holes = [None if i in lost else b for i, b in enumerate(data)]
        best = None
        for values in product(range(0x80, 0x100), repeat=len(lost)):
            whole = bytearray(b or 0 for b in holes)
            for i, x in zip(lost, values):
                whole[i] = x
            try:
                s = bytes(whole).decode(right)
            except UnicodeDecodeError:
                continue
            if s.isalpha() and (right == "cp1252" or len(s) == len(text)) and (best is None or model.score(s) > best + 1e-9):
                best = model.score(s)
        got = M.viterbi(holes, right, model)
        if got is not None and best is not None:
            assert model.score(got) >= best - 1e-6, (got, best)


def test_more_than_three_lost_bytes_and_long_words():
    long = "Donaudampfschifffahrtsgesellschaftskapitänsmützenüberprüfung"
    model = M.Model(counted([*CORPUS * 9, long, "уплотнённый кабельный лоток"]))
    holes = [None if b >= 0x80 else b for b in long.encode("cp1252")]
    assert holes.count(None) == 4 and M.viterbi(holes, "cp1252", model) == long
    bad = "".join(c if c < "\x80" else M.LOST for c in long)
    assert M.restore(bad, M.damaged(bad, model)) == long
    assert M._edges(f"x {long} y", 30, 31) == (long[:28], long[29:])


def test_full_counters_do_not_make_every_word_known():
    import numpy as np

    rnd = np.random.default_rng(1)
    table = rnd.poisson(40, M.SPACE).astype("uint32")
    for b in M._buckets("насосы"):
        table[b] += 5000
    model = M.Model(table)
    unseen = [f"слово{i}" for i in range(2000)]
    assert model.knows("насосы") and sum(map(model.knows, unseen)) <= 0.03 * len(unseen)
    assert M.Model(counted(["насосы"])).knows("насосы")


def test_find_damaged(spark):
    good = [(i, t, "", 0, "") for i, t in enumerate(CORPUS * 30)]
    bad = [(1000, CORPUS[2].encode("gbk").decode("latin-1"), "", 0, ""), (1001, "x�y" * 3000, "", 0, ""), (1002, None, "", 0, ""), (1002, "", "", 0, "")]
    df = spark.createDataFrame(good + bad + bad, SHORT)
    got = {r["row_id"]: r for r in M.find_damaged(df, "row_id", "text").collect()}
    assert set(got) == {1000, 1001} and got[1000]["restored"] == CORPUS[2] and got[1001]["unrestored"] >= 1
    assert M.find_damaged(df.limit(0), "row_id", "text").count() == 0


CASES = {
    "Ｗ－８２９": "W-829", "Sp​rink\xadler": "Sprinkler", "a b　c d": "a b c d", "Höhe": "Höhe", "ﬁre": "fire", "ﾎﾟﾝﾌﾟ": "ポンプ", "排⽔立管": "排水立管", "料": "料",
    "Stееl bеam": "Steel beam", "К-136": "K-136", "Т-929": "T-929", "Прoверить": "Проверить", "22 °С": "22 °C", "한": "한",
}
SAME = ["Перед сдачей проверить кабельный лоток", "², ³ ½ ° Ø ±", "温度：１", "（注）。", "é ü ñ", None, "", "ascii", "在кровле"]


def test_forms(table):
    forms = K.Forms(table)
    assert {a: forms.form(a) for a in CASES} == CASES
    for text in SAME:
        if text != "温度：１":
            assert forms.form(text) == text
    # What was read with the wrong encoding is no look-alike.
    bad = "à la".encode().decode("latin-1")
    assert forms.form(bad) == bad


def test_forms_of_rows(spark):
    rows = [(i, t, "items", 1, "") for i, t in enumerate(CORPUS * 20)] + [(900, "Ｗ－８", "items", 1, ""), (900, "Ｗ－８", "items", 1, ""), (901, None, "items", 1, ""), (902, "х" * 20000, "items", 1, "")]
    got = K.forms(spark.createDataFrame(rows, SHORT), ["src_table", "row_id"], "text").where("changed").select("row_id", "form").distinct().collect()
    assert (900, "W-8") in {tuple(r) for r in got} and {r["row_id"] for r in got} <= {900, 902}


LINES = {
    "en": ["Check the {} before handover.", "Leave clear space near the {} for maintenance.", "All welds near the {} must be painted twice."],
    "de": ["Für die {} ist vor der Übergabe Freiraum vorzusehen.", "Alle Schweißnähte an der {} sind zweimal zu streichen.", "Die {} ist beidseitig zu kennzeichnen."],
    "fr": ["Vérifier la {} avant la remise des ouvrages.", "Toutes les soudures de la {} doivent être peintes deux fois.", "Prévoir de l'espace libre pour la {}."],
    "es": ["Verificar la {} antes de la entrega de la obra.", "Todas las soldaduras de la {} deben pintarse dos veces.", "Dejar espacio libre para la {}."],
    "zh": ["移交前应检查{}。", "{}附近的焊缝应清理干净并涂漆两遍。", "应为{}预留检修空间。"],
    "ja": ["引き渡し前に{}を点検すること。", "{}付近の溶接部は清掃し、二回塗装すること。", "保守用に{}の空間を確保する。"],
    "ru": ["Перед сдачей проверить {}.", "Все сварные швы у {} окрасить два раза.", "Оставить свободное место у {}."],
}
NOUNS = {"en": ["pump", "valve", "cabinet", "beam"], "de": ["Pumpe", "Klappe", "Anlage", "Rinne"], "fr": ["pompe", "vanne", "poutre", "trappe"], "es": ["bomba", "válvula", "viga", "puerta"], "zh": ["水泵", "蝶阀", "钢梁", "压力表"], "ja": ["ポンプ", "制御盤", "鉄骨梁", "圧力計"], "ru": ["насоса", "клапана", "щита", "лотка"]}


def corpus(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        x = rnd.choice(list(LINES))
        yield x, " ".join(rnd.choice(LINES[x]).format(rnd.choice(NOUNS[x]) + rnd.choice([" K-136", "", " DN65"])) for _ in range(rnd.randint(1, 3)))


def test_languages_of_held_out_texts():
    noisy = [(x if i % 20 else random.Random(i).choice(list(LINES)), t) for i, (x, t) in enumerate(corpus(1500, 1))]
    model = G.Classifier(*G.fit(noisy))
    right = sum(G.segments(t, model)[0].lang == x and len(G.segments(t, model)) == 1 for x, t in corpus(400, 2))
    assert right >= 0.97 * 400
    mixed = "移交前应检查水泵。 Check the pump before handover. Alle Schweißnähte an der Pumpe sind zweimal zu streichen."
    assert [x.lang for x in G.segments(mixed, model)] == ["zh", "en", "de"]
    assert [x.lang for x in G.segments("Check the pump before handover. (水泵)", model)] == ["en"]
    for text in ("DWG NO.114", "REV.5", "ELEC-105-2", "40.3 kW", "±0.5", "", None, "Ø44±0.5", "А-017", "elec 434b"):
        assert G.segments(text, model) == []
    assert all(0.5 <= x.confidence <= 1 for _, t in corpus(50, 3) for x in G.segments(t, model))
    assert model.confidence == sorted(model.confidence)


def test_what_no_dictionary_fits_is_rejected():
    model = G.Classifier(*G.fit(corpus(1500, 1)))
    assert model.candidates("насос") == ["ru"] and set(model.candidates("pump")) == {"en", "de", "fr", "es"}
    for text in ("Всички заварки трябва да бъдат почистени и боядисани два пъти.", "Tutte le saldature vicino alla pompa devono essere pulite e verniciate due volte.", "asdkj qwelkj zxmcn poiuq lkjas wpqoe."):
        (found,) = G.segments(text, model)
        assert found.lang == G.UND and found.confidence == 0.0
        assert not G.is_case([found], "en") and not G.is_case([found], None)
    # A narrow unit is no evidence against a label that is close, but it is against one that is not.
    (narrow,) = G.segments("Xyz", model)
    assert narrow.lang == G.UND and set(narrow.close) == {"en", "de", "fr", "es"}
    assert not G.is_case([narrow], "de") and G.is_case([narrow], "zh") and G.is_case([narrow], None)
    # A rejected sentence beside clear ones belongs to their segment.
    assert [x.lang for x in G.segments("Check the pump before handover. Asdkj qwelkj zxmcn poiuq lkjas.", model)] == ["en"]


def test_swapped_labels_of_short_texts_of_close_languages():
    model = G.Classifier(*G.fit(corpus(1500, 1)))
    short = [(x, t) for x, t in corpus(600, 9) if x in ("en", "de", "fr", "es") and len(t) < 60]
    rnd = random.Random(4)
    found = sum(G.is_case(G.segments(t, model), rnd.choice([y for y in ("en", "de", "fr", "es") if y != x])) for x, t in short)
    false = sum(G.is_case(G.segments(t, model), x) for x, t in short)
    assert found >= 0.98 * len(short) and false <= 0.01 * len(short)


def test_labels(spark):
    from pyspark.sql import functions as F

    want = {"EN": "en", "zh-Hans": "zh", "jp": "ja", "pt-BR": "pt", " de ": "de", "und": None, "": None, "unknown": None, None: None, "N/A": None, "xx-yy": None, "it": "?", "English": "en", "zh_CN": "zh"}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r["l"]: r["x"] for r in df.select("l", G.label(F.col("l")).alias("x")).collect()} == want


def test_mislabelled(spark):
    rows = [("t", i, t, x, None, 0) for i, (x, t) in enumerate(corpus(1200, 4))]
    rows += [("t", 9001, "Check the valve before handover.", "de", None, 0), ("t", 9002, "移交前应检查蝶阀。 Check the valve before handover.", "zh", None, 0), ("t", 9003, "移交前应检查蝶阀。", None, None, 0), ("t", 9004, "K-136", "", None, 0), ("t", 9005, None, "en", None, 0), ("t", 9006, "TBD", "zh", None, 0), ("t", 9007, "Check the valve before handover.", "de", "�", 0), ("t", 9008, " ", None, None, 0)]
    df = spark.createDataFrame(rows + rows[-8:], "src_table string, row_id long, text string, lang string, raw string, seg_no int")
    got = G.mislabelled(df, ["src_table", "row_id"], raw="raw")
    found = {(r["row_id"], r["seg_no"], r["lang"]) for r in got.collect()}
    assert {x for x in found if x[0] > 9000} == {(9001, 1, "en"), (9002, 1, "zh"), (9002, 2, "en"), (9003, 1, "zh")}
    assert len(found) < 20 and got.columns == ["src_table", "row_id", "seg_no", "lang"]
    assert G.mislabelled(df.limit(0), ["src_table", "row_id"], raw="raw").count() == 0
