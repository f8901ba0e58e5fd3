import itertools
import random
import re

import pytest

from glyphlake.llm import format_dups as D

SCHEMA = "item_id long, path string, entity_type string, original_text string, fields string, fp int"
IGNORED = re.compile(r"[\s\W_]")


def content(s):
    """Plain reading of the rules, character by character."""
    s = s.upper().lower()
    out = []
    i = 0
    ign = lambda c: c.isspace() or c in "$+<=>^`|~±" or not c.isalnum() and c not in "°²³½"
    while i < len(s):
        if not ign(s[i]):
            out.append(s[i])
            i += 1
            continue
        j = i
        while j < len(s) and ign(s[j]):
            j += 1
        run = s[i:j]
        if i and j < len(s) and s[i - 1].isdigit() and s[j].isdigit():
            out.append(re.sub(r"\s+", " ", run))
        elif j < len(s) and s[j].isdigit() and run[-1] in "+-±":
            before = run[-2] if len(run) > 1 else s[i - 1] if i else " "
            if not (before.isascii() and before.isalpha() or before.isdigit() or before == ")"):
                out.append(run[-1])
        i = j
    return "".join(out)


def key(text):
    parts = [p for p in re.split(r"[;|\n]", text) if content(p)]
    if len(parts) >= 2 and all(re.search("[:=]", p) and content(re.split("[:=]", p, maxsplit=1)[0]) for p in parts):
        return tuple(sorted("\x01".join(content(x) for x in re.split("[:=]", p, maxsplit=1)) for p in parts))
    return (content(text),)


def brute(rows):
    groups = {}
    for i, path, kind, text, *_ in rows:
        if text is not None and any(key(text)):
            groups.setdefault((path, kind, key(text)), set()).add(i)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


TEXTS = ["Steel beam K-136", "steel  BEAM (k136)", "Steel beam K-137", "10.5", "105", "10 5", "10  5", "-3.5", "+3.5", "3.5", "±3.5", "x -3.5", "X: -3.5", "A=1; B=2", "b : 2 | a : 1", "a=1\nb=2", "A=2; B=1", "A=1; B=2; A=1", "A=1; A=1; B=2", "A=1; B=2; B=2", "A=1", "a 1", "", " ", "..", None, "EXF.58B", "EXF-58B", "EXF 58B", "Straße", "STRASSE", "(5)-2", "5-2", "5 -2", "a=1;\n", "名：1；值：2", "值:2|名:1"]


def test_against_brute_force(spark):
    random.seed(5)
    rows = [(n, random.choice(["p", "q", None]), random.choice(["Text", None]), t, "x", 1) for n, t in enumerate(TEXTS * 8)]
    rows += rows[:40]
    want = brute([(i, p, k, t and t.replace("：", ":").replace("；", ";")) for i, p, k, t, *_ in rows])
    got = D.copies(spark.createDataFrame(rows, SCHEMA), "item_id", "original_text", ["path", "entity_type"])
    assert got.columns == ["keep_id", "dup_id"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(D, "_sum", lambda hashes, part: F.lit(0).cast("bigint"))
    rows = [(n, "p", "T", t, "", 0) for n, t in enumerate(["a", "b", "A.", "c", "B", "b!", "x=1;y=2", "y=2;x=1", "x=2;y=1"])]
    got = D.copies(spark.createDataFrame(rows, SCHEMA), "item_id", "original_text", ["path", "entity_type"])
    assert {tuple(r) for r in got.collect()} == {(0, 2), (1, 4), (1, 5), (6, 7)}


def test_counts_long_texts_hot_group_and_empty(spark):
    many = [(n, "p", "T", "Same text!" if n % 3 else f"other {n}", "", 0) for n in range(1500)] + [(9000 + n, "p", "T", "=".join(["k", "v"]) * 20000 + "." * n, "", 0) for n in range(2)]
    got = {r["keep_id"]: r["copies"] for r in D.collapse(spark.createDataFrame(many, SCHEMA), "item_id", "original_text", ["path", "entity_type"]).collect()}
    assert got == {1: 1000, 9000: 2}
    assert D.copies(spark.createDataFrame([], SCHEMA), "item_id", "original_text", ["path"]).count() == 0


@pytest.mark.parametrize("pair", list(itertools.islice(itertools.permutations(["n=1", "m=2", "k=3"]), 6)))
def test_order_of_fields(spark, pair):
    rows = [(0, "p", "T", "n=1; m=2; k=3", "", 0), (1, "p", "T", " | ".join(pair).upper(), "", 0)]
    assert D.copies(spark.createDataFrame(rows, SCHEMA), "item_id", "original_text", ["path"]).count() == 1
