import pytest
from pyspark.sql import functions as F

from glyphlake.functions import predicates as P
from glyphlake.functions import text as T

CASES = {
    "is_number": (["1500", "3.5", "1500mm", "3.5MPa", "220V", "1-10", "3.5~7.2", "1:100", "3/4", " 12 kW ", ".5", "-3e5", "NaN"], ["Room 101", "Level 3", "", None, "1d", "-5-10", "a-1"]),
    "is_code": (["A-001", "ELEC-123B", "STR-001-2", "EL01234", "HVAC5678X", "DWG NO", "DWG NO.123", "REV.1", "REV-2", "REV3", "STR.3.1"], ["Hello World", "电气设计说明", "", None, "a-001"]),
    "is_tag": (["A#1", "@PUMP", "AHU01", "FCU3"], ["ahu01", "Pump01", "Hello", "Design Note", None]),
    "is_symbol": (["---", "+++", "///", "°", "±×÷", "- + /"], ["A-1", "3.5mm", "", "  ", None]),
    "is_non_textual": (["", None, "12.5", "±0.5", "Привет"], ["A", "你", "カ", "한"]),
}


@pytest.mark.parametrize("name", CASES)
def test_predicate(spark, name):
    yes, no = CASES[name]
    rows = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "t string, want boolean")
    got = rows.select("t", "want", getattr(P, name)(F.col("t")).alias("got")).collect()
    assert [r["t"] for r in got if r["got"] != r["want"]] == []


def test_cascade_order(spark):
    rows = [("", "Empty"), (None, "Empty"), ("Hello World", None), ("1500mm", "Number"), ("A-001", "Code"), ("电气设计", "TargetLang(zh)"), ("---", "Symbol"), ("Room 101", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", P.filter_reason(F.col("t")).alias("got")).collect())
    config = P.CleanConfig(filter_empty=False, filter_non_source_lang=True, skip_patterns=("^NOTE:", "("))
    df = spark.createDataFrame([("", None), ("NOTE: x", "CustomSkip"), ("こんにちは", "NonSourceLang(en)")], "t string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", P.filter_reason(F.col("t"), config).alias("got")).collect())


def test_language_ranges(spark):
    df = spark.createDataFrame([("电气设计",), ("Hello",), ("カタカナ",), ("안녕하세요",), (None,)], "t string")
    got = df.select(*[P.matches_language(F.col("t"), x).alias(x) for x in ("zh", "en", "ja", "ko", "fr")]).collect()
    assert [tuple(r) for r in got] == [(True, False, True, False, False), (False, True, False, False, False), (False, False, True, False, False), (False, False, False, True, False), (False,) * 5]


def test_ai_reply(spark):
    text = 'Sure:\n```json\n[{"index": 1, "decision": "skip", "reason": "x"}, {"index": -1}, {"index": 2}]\n```'
    df = spark.createDataFrame([(text,), ("no list",), ("[broken",), (None,)], "t string")
    got = [r[0] for r in df.select(P.parse_ai_decisions(F.col("t"))).collect()]
    assert [tuple(x) for x in got[0]] == [(1, "SKIP", "x"), (2, "KEEP", "")] and not got[1] and not got[2] and not got[3]


def test_scalar_functions(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()[0]
    assert one(T.strip_for_translation(F.lit(r"{\fArial|b0;Bold}\PNext\~x \H2.5;\S1/2; a\\b \; {c}"))) == "Bold\nNext x  a\\b ; c"
    assert one(T.escape_and_normalize(F.lit("a\\b{c}\r\nd\te\x01"))) == r"a\\b\{c\}\Pd e"
    assert one(T.encode_unicode(F.lit("a你😀"))) == r"a\U+4F60\U+0000D83D\U+0000DE00"
    assert one(T.detect_script(F.lit("abc カ"))) == "Japanese" and one(T.detect_script(F.lit("A"))) == "Latin"
    assert one(T.visual_width(F.lit("a 你"))) == 190
    assert [tuple(x) for x in one(T.chunks(F.lit("A" * 250 + "END")))] == [("3", "A" * 250), ("1", "END")]
    assert [tuple(x) for x in one(T.chunks(F.lit("")))] == [("1", "")]
    assert one(T.id_string(F.array(F.lit("2D07D5")))) == "@_2D07D5_&f0"
    assert one(T.owner_handle(F.lit("1A6::R0::C0"))) == "1A6" and one(T.owner_handle(F.lit("9::CTX"))) == "9" and one(T.owner_handle(F.lit("7:P3"))) == "7"
    assert one(T.replace_ignore_case(F.lit("a.B A.b $"), F.lit("A.B"), F.lit("$1\\"))) == "$1\\ $1\\ $"
    assert one(T.normalize_language(F.lit(" JP "))) == "ja" and one(T.source_language(F.lit("auto"), F.lit("en"))) == "zh"
    assert one(T.strip_quotes(F.lit('"a"b"'))) == 'a"b' and one(T.output_name(F.lit("d/x.dxf"), "_t")) == "d/x_t.dxf"
    assert one(T.layout_scale(F.lit(100.0), F.lit(50.0))) == 0.65 and one(T.layout_scale(F.lit(10.0), F.lit(50.0))) is None


def test_skip_patterns_are_checked_where_they_are_matched(spark):
    from pyspark.sql import functions as F

    assert P.usable_patterns(("^NOTE:", "(", "(?P<n>x)", r"\p{IsHan}", "(?<n>x)")) == ["^NOTE:", r"\p{IsHan}", "(?<n>x)"]
    df = spark.createDataFrame([("x",), ("电",), ("NOTE: a",)], "t string")
    config = P.CleanConfig(target_lang="ja", skip_patterns=("(?P<n>x)", r"\p{IsHan}", "^NOTE:"))
    assert [r[0] for r in df.select(P.filter_reason(F.col("t"), config)).collect()] == [None, "CustomSkip", "CustomSkip"]
