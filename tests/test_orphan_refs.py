import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.operators import bitmaps
from glyphlake.operators import orphan_refs as O

D = lambda m, d=1: dt.datetime(2024, m, d)
ITEMS = "item_id long, path string, handle string, cad_handles array<string>, loaded_at timestamp, erased_at timestamp, kid int"
REFS = "ref_table string, ref_row_id long, ref_field string, path string, handle string, at timestamp, rng int"


def brute(refs, items):
    out = set()
    for table, row, field, path, handle, at, _ in refs:
        own = [i for i in items if i[1] == path and path and handle in {h.strip().upper() for h in [i[2] or "", *(i[3] or [])] if h}]
        if not own:
            kind = "missing"
        elif at is None:
            continue
        elif all(i[5] is not None for i in own) and max(i[5] for i in own) <= at:
            kind = "deleted"
        elif min(i[4] for i in own) > at:
            kind = "late"
        else:
            continue
        out.add((table, row, field, handle, kind, at and at.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_against_brute_force(spark, ranges):
    items = [(i, f"p{i % 3}", f"{i:x}", [f"{i:X}", f"c{i}"] if i % 2 else None, D(1 + i % 6, 1 + i % 27), D(7, 1 + i % 20) if i % 5 == 0 else None, 9) for i in range(200)]
    items += [(1, *items[1][1:]), (900, None, "A", None, D(1), None, 9), (901, "p0", None, None, D(1), None, 9)]
    refs = [("s", i, "id", f"p{i % 4}" if i % 17 else None, f"{i % 230:X}" if i % 3 else f"C{i % 230}", D(1 + i % 9, 1 + i % 27) if i % 13 else None, 1) for i in range(600)]
    refs += refs[:50]
    got = O.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(items, ITEMS), ranges).collect()
    assert {tuple(r) for r in got} == brute(refs, items) and len(got) == len({tuple(r) for r in got})


def test_boundaries_of_time(spark):
    items = [(1, "p", "a", None, D(3, 10), D(5, 10), 0)]
    refs = [("s", n, "id", "p", "A", at, 0) for n, at in enumerate([D(3, 9), D(3, 10), D(4), D(5, 9), D(5, 10), D(6)])]
    got = {r["ref_row_id"]: r["kind"] for r in O.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {0: "late", 4: "deleted", 5: "deleted"}


def test_empty_tables(spark):
    none, refs = spark.createDataFrame([], ITEMS), spark.createDataFrame([("s", 1, "id", "p", "A", D(1), 0)], REFS)
    assert [r["kind"] for r in O.orphan_references(refs, none).collect()] == ["missing"]
    assert O.orphan_references(refs.limit(0), none).count() == 0


def test_parsing(spark):
    from pyspark.sql import functions as F

    rows = [("@_1a_&f0, @_2B::R0::C1_&f0,,", ["1A", "2B::R0::C1"]), ("1f ; 2F;;", ["1F", "2F"]), ("", []), (" ; ", []), (None, None), ("a;A", ["A"]), ("x" * 5000, ["X" * 5000])]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    assert [r[0] for r in df.select(O.parse_handles(F.col("v"))).collect()] == [r[1] for r in rows]


def test_hot_key(spark):
    items = [(1, "p", "a", None, D(3), None, 0)]
    refs = [("s", n, "id", "p", "A" if n % 3 else f"N{n}", D(2), 0) for n in range(3000)]
    got = O.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(items, ITEMS))
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"late": 2000, "missing": 1000}


RUNS = st.builds(lambda xs: {n for a, k in xs for n in range(a, min(a + k, bitmaps.SPAN))}, st.lists(st.tuples(st.integers(0, bitmaps.SPAN - 1), st.integers(1, 3000)), max_size=8))
SPARSE = st.sets(st.integers(0, bitmaps.SPAN - 1), max_size=300)
EVERY_THIRD = st.builds(lambda k: set(range(k, bitmaps.SPAN, 3)), st.integers(0, 2))


@settings(max_examples=60, deadline=None)
@given(st.one_of(RUNS, SPARSE, EVERY_THIRD), st.one_of(RUNS, SPARSE, EVERY_THIRD))
def test_bitmaps_are_sets(a, b):
    x, y = (bitmaps.pack(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
    assert max(len(x), len(y)) <= 1 + bitmaps.SPAN // 8
    assert set(bitmaps.members(x).tolist()) == a
    assert set(bitmaps.members(bitmaps.and_not(x, y)).tolist()) == a - b
    assert set(bitmaps.members(bitmaps.union(x, y)).tolist()) == a | b
    asked = np.arange(0, bitmaps.SPAN, 7)
    assert bitmaps.has(x, asked).tolist() == [n in a for n in asked.tolist()]


def test_more_keys_than_one_bitmap(spark):
    items = spark.range(70_000).selectExpr("id as item_id", "'p' as path", "hex(id) as handle", "cast(null as array<string>) as cad_handles", "timestamp '2024-03-05' as loaded_at", "if(id % 1000 = 0, timestamp '2024-04-01', null) as erased_at", "1 as kid")
    refs = spark.range(0, 80_000, 5).selectExpr("'s' as ref_table", "id as ref_row_id", "'id' as ref_field", "'p' as path", "hex(id) as handle", "timestamp '2024-05-05' as at", "1 as rng")
    got = O.orphan_references(refs, items, 1)
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"deleted": 70, "missing": 2000}
