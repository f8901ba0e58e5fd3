r"""Filling containers of a fixed capacity by patterns of lengths.

A document longer than the container gives full pieces and a rest; all other
documents stay whole.  What has to be packed is then known by its histogram: at
most ``capacity`` lengths.  On it, the driver enumerates patterns of two to four
documents that fill a container exactly, fits how often each is used to the
histogram by non-negative least squares, rounds down, and packs the residual
histogram by best fit, longest first.  The plan says of each length which
containers its first, second, ... document goes to, and its size depends on the
capacity, not on the number of documents.  Documents get their rank within
their length from counts per length and hash salt, so that no length gathers in
one task, and look their container up in the plan.

Defined cases: null and empty texts have no tokens and need no container; ties
and equal lengths are told apart by document id; a capacity that is null or
under 1 takes no documents; an empty table gives no containers; a document
delivered again counts once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Documents of one length that one task ranks at most, on average; more are spread over hash salts.
RANKED = 20_000
#: Lengths that patterns of three and four documents are enumerated of, if no other number is given, and steps of the least-squares fit.
COMMON, STEPS = 48, 200


def patterns(hist: np.ndarray, capacity: int, common: int | None = COMMON) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths of the histogram that fill a container exactly.

    Those of three and four take two of their lengths from the ``common`` most
    frequent ones (all lengths, if it is None).
    """
    have = np.flatnonzero(hist[:capacity])
    out = {(capacity - a, a) for a in have.tolist() if a <= capacity - a and hist[capacity - a]}
    frequent = sorted(have[np.argsort(-hist[have], kind="stable")][:common].tolist())
    for i, a in enumerate(frequent):
        for j, b in enumerate(frequent[i:], i):
            c = capacity - a - b
            if 0 < c < capacity and hist[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
            for d in frequent[j:]:
                e = capacity - a - b - d
                if e >= d and e < capacity and hist[e]:
                    out.add((e, d, b, a))
    return sorted(out)


def fit(found: list[tuple[int, ...]], hist: np.ndarray) -> np.ndarray:
    """Repeat counts ``x >= 0`` of the patterns that minimize ``|A x - hist|``, by accelerated projected gradient."""
    if not found:
        return np.zeros(0)
    rows = np.array([n for p in found for n in p])
    cols = np.array([k for k, p in enumerate(found) for _ in p])
    target = hist.astype(float)
    times = lambda x: np.bincount(rows, weights=x[cols], minlength=len(target))
    back = lambda r: np.bincount(cols, weights=r[rows], minlength=len(found))
    v = np.ones(len(found))
    for _ in range(15):  # the largest singular value, for the step
        v = back(times(v))
        scale = np.linalg.norm(v)
        v /= scale
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0.0, y - back(times(y) - target) / (1.05 * scale))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def plan(hist: np.ndarray, capacity: int, common: int | None = COMMON) -> list[tuple[int, dict[int, int]]]:
    """``(containers, {length: documents in each})`` that together hold every document of the histogram."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    found = patterns(left, capacity, common)
    x = np.floor(fit(found, left)).astype(np.int64) if found else np.zeros(0, dtype=np.int64)
    for k in np.argsort(-x, kind="stable").tolist():
        need: dict[int, int] = defaultdict(int)
        for n in found[k]:
            need[n] += 1
        times = min([int(x[k]), *(int(left[n]) // m for n, m in need.items())])
        if times > 0:
            out.append((times, dict(need)))
            for n, m in need.items():
                left[n] -= times * m
    # Best fit, longest first, on counts: open containers with the same contents are one class.
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    rooms: list[int] = []
    for n in range(capacity, 0, -1):
        more = int(left[n])
        while more:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                fits = capacity // n
                new, rest = divmod(more, fits)
                for count, each in ((new, fits), (1, rest)):
                    if count and each:
                        room = capacity - n * each
                        if not by_room[room]:
                            insort(rooms, room)
                        by_room[room].append((count, {n: each}))
                more = 0
                continue
            room = rooms[k]
            count, held = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            fits = min(room // n, more)
            use = min(count, more // fits)
            if use < count:
                if not by_room[room]:
                    insort(rooms, room)
                by_room[room].append((count - use, held))
            smaller = room - n * fits
            if not by_room[smaller]:
                insort(rooms, smaller)
            by_room[smaller].append((use, held | {n: fits}))
            more -= use * fits
    return out + [c for room in sorted(by_room) for c in by_room[room]]


def pack(sized: DataFrame, limits: DataFrame, common: int | None = COMMON) -> DataFrame:
    """``container, container_id, doc_id, piece_no, token_start, tokens, used, capacity``: the contents of every container.

    All documents of ``doc_id, tokens`` are packed once for each row of
    ``container, capacity_tokens`` (one row per kind of container); ``common``
    is that of ``patterns``.
    """
    kinds = {r["container"]: int(r["capacity_tokens"]) for r in limits.where("capacity_tokens >= 1").select("container", "capacity_tokens").distinct().collect()}
    spark = sized.sparkSession
    caps = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).alias("capacity")) for k, c in sorted(kinds.items())]).cast("array<struct<container: string, capacity: int>>")
    docs = sized.where("tokens > 0").select("doc_id", "tokens", F.inline(caps))
    rest = F.pmod(F.col("tokens"), F.col("capacity"))
    docs = docs.withColumn("rest", F.when(F.col("tokens") <= F.col("capacity"), F.col("tokens")).otherwise(rest).cast("int"))
    full = (
        docs.where("tokens > capacity")
        .select("container", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.expr("cast(tokens div capacity as int) - 1"))).alias("piece_no"))
        .select("container", F.concat(F.lit("full-"), F.col("doc_id"), F.lit("-"), F.col("piece_no")).alias("container_id"), "doc_id", "piece_no", (F.col("piece_no").cast("long") * F.col("capacity")).alias("token_start"), F.col("capacity").cast("long").alias("tokens"), F.col("capacity").cast("long").alias("used"), "capacity")
    )
    small = docs.where("rest > 0").select("container", "doc_id", "tokens", "capacity", "rest")
    # The histograms have at most as many rows as the capacities are large; with the salts, one more for every RANKED documents.
    hist = small.groupBy("container", "rest").agg(F.ceil(F.count(F.lit(1)) / RANKED).cast("int").alias("salts"))
    small = small.join(F.broadcast(hist), ["container", "rest"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    counts = small.groupBy("container", "rest", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas()
    offsets = counts.sort_values(["container", "rest", "salt"]).assign(first=lambda d: d.groupby(["container", "rest"])["n"].cumsum() - d["n"])
    # Of each kind: where the ranks of a length go. (start key, documents of the length per container, first container, used)
    plans: dict[str, tuple[np.ndarray, ...]] = {}
    # The first rank of each length and salt, by kind, under sorted keys.
    first_of = {k: ((d["rest"].to_numpy(dtype="int64") << 32) + d["salt"].to_numpy(dtype="int64"), d["first"].to_numpy(dtype="int64")) for k, d in offsets.groupby("container")}
    for kind, capacity in kinds.items():
        hist = np.zeros(capacity + 1, dtype=np.int64)
        own = counts[counts["container"] == kind]
        np.add.at(hist, own["rest"].to_numpy(dtype="int64"), own["n"].to_numpy(dtype="int64"))
        entries, taken, base = [], np.zeros(capacity + 1, dtype=np.int64), 0
        for times, need in plan(hist, capacity, common):
            used = sum(n * m for n, m in need.items())
            for n, m in need.items():
                entries.append((n, int(taken[n]), m, base, used))
                taken[n] += times * m
            base += times
        entries.sort()
        table = np.array(entries, dtype=np.int64).reshape(-1, 5)
        plans[kind] = ((table[:, 0] << 42) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4])
    shared = spark.sparkContext.broadcast((first_of, plans))

    @F.pandas_udf("struct<no: long, used: long>")
    def place(kind: pd.Series, length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        firsts, tables = shared.value
        no, used = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
        lengths, salts, ranks = (x.to_numpy(dtype="int64") for x in (length, salt, rank))
        for k in kind.unique():
            at = np.flatnonzero((kind == k).to_numpy())
            keys, first = firsts[k]
            r = first[np.searchsorted(keys, (lengths[at] << 32) + salts[at])] + ranks[at] - 1
            keys, start, each, base, full_to = tables[k]
            i = np.searchsorted(keys, (lengths[at] << 42) + r, side="right") - 1
            no[at], used[at] = base[i] + (r - start[i]) // each[i], full_to[i]
        return pd.DataFrame({"no": no, "used": used})

    w = Window.partitionBy("container", "rest", "salt").orderBy("doc_id")
    placed = small.withColumn("rank", F.row_number().over(w)).withColumn("at", place("container", "rest", "salt", "rank"))
    whole = (F.col("tokens") - F.col("rest")).alias("token_start")
    packed = placed.select("container", F.concat(F.lit("pack-"), F.col("at.no")).alias("container_id"), "doc_id", F.when(F.col("tokens") > F.col("capacity"), F.expr("cast(tokens div capacity as int)")).otherwise(0).alias("piece_no"), whole, F.col("rest").cast("long").alias("tokens"), F.col("at.used").alias("used"), "capacity")
    return packed.unionByName(full)


def fill(packed: DataFrame) -> DataFrame:
    """``container, container_id, pieces, tokens, capacity, fill`` of every container, summed up from its contents."""
    return packed.groupBy("container", "container_id", "capacity").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / F.col("capacity"), 6))
