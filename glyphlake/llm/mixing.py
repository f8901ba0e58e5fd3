r"""Mixing sources to target shares by thresholds on hashes.

Every document of a source has a 60-bit hash.  One aggregation sums the tokens
by source and the leading bits of the hash.  From these sums the budget of each
source is known: the largest total for which no source needs more than its
capped number of repeats.  A budget is some whole passes over the source and a
part of one more; the part is the documents below a threshold on the hash.  The
threshold's bucket is found from the cumulated sums, and only the documents of
that boundary bucket are summed again, by the next bits, until the bits are
used up.  The result is a filter; nothing is sorted or gathered.

Defined cases: a source of the targets without tokens cannot be used: its share
is spread over the others in proportion and reported as 0; documents of null or
other sources are not in the mix; a null or negative share is 0, a null cap 1;
a source named twice uses its first row in the order of its values; documents
without tokens get the repeats of their hash like any other; an empty table
gives no rows and shares of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash looked at in each pass, and passes: 60 bits in all.
BITS, LEVELS = 12, 5


def _hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 64 - BITS * LEVELS)


def _level(level: int) -> Column:
    """The bits of the hash that a level looks at, with all before them."""
    return F.shiftrightunsigned(F.col("h"), BITS * (LEVELS - 1 - level))


def budgets(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens of each usable source in the largest mix of the target shares within the repeat caps."""
    usable = {s: share for s, (share, cap) in targets.items() if share > 0 and cap > 0 and totals.get(s, 0) > 0}
    whole = sum(usable.values())
    if not usable:
        return {}
    total = min(targets[s][1] * totals[s] * whole / share for s, share in usable.items())
    return {s: total * share / whole for s, share in usable.items()}


def mix(sized: DataFrame, mix_targets: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, int]], dict[str, float]]:
    """``doc_id, source, tokens, repeats`` of every document of a target's source; the targets; the budgets.

    ``sized`` has ``doc_id, source, tokens``; ``mix_targets`` one row per source.
    """
    targets: dict[str, tuple[float, int]] = {}
    for r in sorted(mix_targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().collect(), key=str):
        targets.setdefault(r["source"], (max(0.0, r["target_share"] or 0.0), 1 if r["max_repeats"] is None else r["max_repeats"]))
    docs = sized.where(F.col("source").isin(list(targets))).withColumn("h", _hash())
    sums: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", _level(0).alias("b")).agg(F.sum("tokens").alias("n")).collect():
        sums.setdefault(r["source"], {})[r["b"]] = r["n"]
    totals = {s: sum(b.values()) for s, b in sums.items()}
    want = budgets(totals, targets)
    passes = {s: int(min(w // totals[s], targets[s][1])) for s, w in want.items()}
    part = {s: w - passes[s] * totals[s] for s, w in want.items()}
    # The threshold so far: documents in a lower bucket are in; those of the boundary bucket are looked at again.
    edge: dict[str, int] = {}
    for level in range(LEVELS):
        if level:
            still = [F.col("source").eqNullSafe(s) & (_level(level - 1) == b) for s, b in edge.items()]
            if not still:
                break
            at = still[0]
            for c in still[1:]:
                at = at | c
            sums = {}
            for r in docs.where(at).groupBy("source", _level(level).alias("b")).agg(F.sum("tokens").alias("n")).collect():
                sums.setdefault(r["source"], {})[r["b"]] = r["n"]
        for s in list(part):
            first = edge.get(s, 0) << BITS if level else 0
            bucket = first + (1 << BITS)
            for b in sorted(sums.get(s, {})):
                if part[s] < sums[s][b]:
                    # At the last bit one document is left: it is in if that comes closer to the budget.
                    bucket = b + (level == LEVELS - 1 and 2 * part[s] >= sums[s][b])
                    break
                part[s] -= sums[s][b]
            edge[s] = bucket
    repeats = F.lit(0)
    for s, threshold in edge.items():
        repeats = F.when(F.col("source") == s, F.lit(passes[s]) + ((F.col("h") < F.lit(threshold)) & F.lit(passes[s] < targets[s][1])).cast("int")).otherwise(repeats)
    return docs.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")), targets, want


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]], want: dict[str, float]) -> DataFrame:
    """``source, target_share, max_repeats, available_tokens, budget_tokens, used_tokens, used_documents, actual_share``."""
    spark = mixed.sparkSession
    asked = spark.createDataFrame([(s, float(a), int(c), float(want.get(s, 0.0))) for s, (a, c) in sorted(targets.items())], "source string, target_share double, max_repeats int, budget_tokens double")
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count_if(F.col("repeats") > 0).alias("used_documents"))
    out = asked.join(used, "source", "left").fillna(0, ["available_tokens", "used_tokens", "used_documents"])
    total = used.agg(F.sum("used_tokens")).first()[0] or 0
    share = F.col("used_tokens") / F.lit(total) if total else F.lit(0.0)
    return out.withColumn("actual_share", F.round(share, 6)).withColumn("budget_tokens", F.round("budget_tokens", 3))
