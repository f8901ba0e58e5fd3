from hypothesis import given
from hypothesis import strategies as st

from glyphlake.functions import mtext as M


def test_strip_and_restore():
    text, codes = M.strip_codes(r"{\F Arial;Bold Text}")
    assert "Bold Text" in text and len(codes) == 2
    for raw in (r"Start\PMiddle\PEnd", r"{\F Arial;Bold} \H2.5;x \S1/2;", r"\A1;plain", ""):
        assert M.restore_codes(*M.strip_codes(raw)) == raw
    assert M.strip_codes(None) == (None, []) and M.restore_codes(None, []) == ""
    assert M.restore_codes("a{b}\\\n", []) == r"a\{b\}\\\P"


@given(st.lists(st.sampled_from(["a", "你", " ", r"\P", r"\H2.5;", r"\C6;", r"\~", "{", "}", "-"])).map("".join))
def test_round_trip(raw):
    assert M.restore_codes(*M.strip_codes(raw)) == raw


def test_escaped_backslashes_and_semicolons():
    assert M.strip_codes(r"a\\b")[0] == r"a\b" and M.strip_codes(r"a\;b")[0] == "a;b"
    assert M.restore_codes(*M.strip_codes(r"a\\b")) == r"a\\b"


@given(st.lists(st.sampled_from(["a", "你", " ", r"\\ ", r"\\-", r"\P", r"\H2.5;", "{", "}"])).map("".join))
def test_round_trip_with_escapes(raw):
    assert M.restore_codes(*M.strip_codes(raw)) == raw


def test_strict_toggles_keep_text():
    assert "text" not in M.strip_codes(r"\Ltext; rest")[0]
    assert "text; rest" in M.strip_codes(r"\Ltext; rest", strict=True)[0]


def test_slots():
    assert M.fill_slots(M.skeleton(r"\C6;Red"), "红") == r"\C6;红"
    assert M.fill_slots(r"\C6;", "红") == r"\C6;"
    assert M.fill_slots(M.skeleton(r"A\PB"), "甲\n乙") == r"甲\P乙"
    assert M.fill_slots(M.skeleton(r"A\PB\PC"), "甲") == r"甲\P\P"
    got = M.fill_slots(M.skeleton("X"), r"A\B{C}")
    assert r"\\" in got and r"\{" in got and r"\}" in got


def test_wrap_and_rebuild():
    assert r"\P" in M.wrap("ABCDEFGHIJKLMNO", 5) and r"\P" in M.wrap("你好世界再见", 3)
    assert M.wrap("abc", 0) == "abc" and M.wrap(None, 3) is None
    assert M.wrap("{\\H2;" + "x" * 50 + "}", 2) == "{\\H2;" + "x" * 50 + "}"
    assert M.rebuild("Hello", "你好") == "你好" and M.rebuild(None, "你好") == "你好" and M.rebuild("Hello", None) == "Hello"


@given(st.text(alphabet="ab 你\\{}P;H", max_size=40), st.floats(0.5, 5))
def test_wrap_only_adds_breaks(text, width):
    assert M.wrap(text, width).replace("\\P", "") == text.replace("\\P", "")
