r"""Copies hidden by formatting: commutative multiset hashes over name-value pairs.

Every text is reduced to a list of fields.  A text made only of two or more
name-value fields gives one ``name U+0001 value`` entry per field; any other
text is one entry.  Names, values and texts are normalized: letter case, blanks
and punctuation vanish, but marks or blanks between two digits stay (a run of
blanks as one space), and so does a sign ``+ - ±`` directly before a digit
unless it follows a Latin letter, a digit or ``)``.  Each entry is hashed and
the hashes are added up, so the fingerprint ignores the order of the fields
without sorting them.  Rows are grouped by fingerprint with map-side partial
aggregation; each row is then compared, as a multiset, with the group's
representative, so equal fingerprints of different contents are told apart.

Defined cases: null texts, and texts with nothing but blanks and punctuation,
have no content and are never copies; a null path or entity type is a group
like any other; repeated deliveries of one item count once; a line break inside
a field (no name follows it) is a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.runtime import materialize

#: Blanks and punctuation: Unicode P and Z, the ASCII symbols and their wide forms, and ±.
IGNORED = r"[\s\p{Z}\p{P}\p{Cc}$+<=>^`|~±＄＋＜＝＞＾｀｜～]"
#: What stays of the ignored characters is captured: marks between digits, signs.
DROP = rf"(?U)((?<=\p{{Nd}}){IGNORED}++(?=\p{{Nd}}))|((?<![\p{{IsLatin}}\p{{Nd}})])[+\-±](?=\p{{Nd}}))|{IGNORED}"
FIELD_BREAK = r"[;；|｜]|[\r\n]+(?=[^:=：＝;；|｜\r\n]*[:=：＝])"
#: A line break before the first name's end only wraps that name.
WRAPPED_NAME = r"(^|[;；|｜])([^:=：＝;；|｜\r\n]*\p{L}[^:=：＝;；|｜\r\n]*)[\r\n]+(?=[^:=：＝;；|｜\r\n]*[:=：＝])"
JOINT = r"[:=：＝]"
LOW44 = (1 << 44) - 1


def normalize(text: Column) -> Column:
    """The content of a text, without case, blanks and punctuation."""
    # Upper case first, as it spells ß and joined letters out. The optimizer would drop it directly under lower().
    folded = F.lower(F.concat(F.upper(text), F.lit("")))
    return F.regexp_replace(F.regexp_replace(folded, DROP, "$1$2"), r"(?U)\s+", " ")


def content_fields(text: Column) -> Column:
    """The normalized entries of a text; an empty array if it has no content."""
    parts = F.filter(F.split(F.regexp_replace(text, WRAPPED_NAME, "$1$2 "), FIELD_BREAK), lambda s: F.length(normalize(s)) > 0)
    name = lambda s: normalize(F.regexp_extract(s, r"(?s)^(.*?)[:=：＝]", 1))
    pair = lambda s: F.concat(name(s), F.lit("\u0001"), normalize(F.regexp_replace(s, r"(?s)^.*?[:=：＝]", "")))
    may_be = text.rlike(JOINT) & text.rlike(FIELD_BREAK)
    are = (F.size(parts) >= 2) & F.forall(parts, lambda s: s.rlike(JOINT) & (F.length(name(s)) > 0))
    one = F.array(normalize(text))
    return F.filter(F.when(may_be, F.when(are, F.transform(parts, pair)).otherwise(one)).otherwise(one), lambda s: F.length(s) > 0)


def _sum(hashes: Column, part) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + part(h))


def with_fingerprint(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Adds ``fp``: the count of entries and two sums of parts of their 64-bit hashes.

    The parts have 44 bits, so half a million entries cannot overflow the sums.
    """
    hashes = F.transform(F.col(fields), lambda f: F.xxhash64(f))
    return df.withColumn("_h", hashes).withColumn(
        "fp",
        F.struct(F.size("_h").alias("n"), _sum(F.col("_h"), lambda h: F.shiftrightunsigned(h, 20)).alias("hi"), _sum(F.col("_h"), lambda h: h.bitwiseAND(F.lit(LOW44))).alias("lo")),
    ).drop("_h")


def same_multiset(a: Column, b: Column) -> Column:
    """Exact equality of two arrays as multisets, without sorting them."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    support = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    plain = F.size(F.array_distinct(a)) == F.size(a)
    return (a == b) | (support & (plain | F.forall(F.array_distinct(a), lambda x: times(a, x) == times(b, x))))


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner equi join in which null equals null; the right keys are dropped."""
    named = right.withColumnsRenamed({c: f"r{c}" for c in by})
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in by]).drop(*[f"r{c}" for c in by])


def copies(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """``keep_id, dup_id``: each row that repeats the content of the row ``keep_id``, the smallest key of its group."""
    rows = df.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], content_fields(F.col(text)).alias("fields"))
    # Grouping and comparing read the rows; they are normalized once.
    rows = materialize(with_fingerprint(rows.where(F.size("fields") > 0)))
    by = [*[f"_w{i}" for i in range(len(within))], "fp"]
    groups = rows.groupBy(*by).agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.min_by("fields", "_id").alias("first")).where("first_id < last_id")
    same = same_multiset(F.col("fields"), F.col("first"))
    joined = _join(rows, groups, by).select(*by, "_id", "first_id", same.alias("same"), F.when(~same, F.col("fields")).alias("other"))
    matched = materialize(joined.where("_id <> first_id"))
    hit = matched.where("same").select(F.col("first_id").alias("keep_id"), F.col("_id").alias("dup_id"))
    # Same fingerprint, other content: grouped by the whole content. Hash collisions only, so next to none.
    rest = matched.where("not same").withColumn("other", F.array_sort("other")).drop("first_id", "same")
    heads = rest.groupBy(*by, "other").agg(F.min("_id").alias("keep_id"))
    late = _join(rest, heads, [*by, "other"]).where("_id > keep_id").select("keep_id", F.col("_id").alias("dup_id"))
    return hit.unionByName(late).distinct()


def collapse(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """``keep_id, copies``: one row per group of at least two copies, with their number."""
    return copies(df, key, text, within).groupBy("keep_id").agg((F.count(F.lit(1)) + 1).alias("copies"))
