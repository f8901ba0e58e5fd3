"""Pluggable engines run over distinct texts, and the keep-or-skip filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.predicates import is_blank
from glyphlake.functions.text import text_for_translation

#: ``engine(texts, source, target)``: as many translations in the same order; null where there is none.
Engine = Callable[[list[str], str, str], list[str | None]]


def marker_engine(texts: list[str], source: str, target: str) -> list[str | None]:
    """A deterministic engine that marks a text with its target language."""
    return [f"[{target}] {t}" for t in texts]


def dictionary_engine(pairs: dict[str, str]) -> Engine:
    """An engine that knows some texts only."""
    return lambda texts, source, target: [pairs.get(t) for t in texts]


ENGINES: dict[str, Callable[..., Engine]] = {"marker": lambda: marker_engine, "dictionary": dictionary_engine}
#: Engines that need a network or a native library; named so that asking for one gives a clear error.
UNAVAILABLE = ("deeplx", "bergamot", "nllb", "libretranslate", "openai-compatible", "baidu", "tencent", "microsoft", "deepl")


def make_engine(name: str, *args: object) -> Engine:
    key = name.strip().lower()
    if key in UNAVAILABLE:
        raise NotImplementedError(f"engine {name!r} needs a network service; register your own in ENGINES")
    if key not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[key](*args)


def translate_items(items: DataFrame, engine: Engine, source: str, target: str, batch: int = 100) -> DataFrame:
    """``item_id, translated_text``: blank translations filled, each distinct text sent once.

    A reply of another length than its batch is an error.  A text without
    reply, or with a blank one, stays blank and never takes its source.
    """
    rows = items.withColumn("text", text_for_translation(F.col("raw_original_text"), F.col("original_text")))
    open_ = rows.where(is_blank(F.col("translated_text")) & ~is_blank(F.col("text")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                texts = pdf["text"].iloc[at : at + batch].tolist()
                replies = engine(texts, source, target)
                if len(replies) != len(texts):
                    raise ValueError(f"the engine returned {len(replies)} translations for {len(texts)} texts")
                yield pd.DataFrame({"text": texts, "reply": [r if r and r.strip() else None for r in replies]})

    replies = open_.select("text").distinct().mapInPandas(run, "text string, reply string")
    joined = rows.join(replies, "text", "left")
    return joined.select("item_id", F.when(is_blank(F.col("translated_text")), F.col("reply")).otherwise(F.col("translated_text")).alias("translated_text"))


def prefilter(items: DataFrame) -> DataFrame:
    """``item_id, decision``: SKIP for blank and skipped rows, KEEP for the first row of a table, null where a judge must decide."""
    decision = F.when(is_blank(F.col("original_text")), "SKIP").when(F.col("status") == "skipped", "SKIP").when((F.col("entity_type") == "TableCell") & (F.col("table_row") == 0), "KEEP")
    return items.select("item_id", decision.alias("decision"))


def batches(items: DataFrame, size: int) -> DataFrame:
    """``path, item_id, batch, idx``: the rows of each path in batches of ``size``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("path").orderBy("ord", "item_id")) - 1
    return items.select("path", "item_id", F.floor(n / size).cast("int").alias("batch"), (n % size).alias("idx"))


def apply_decisions(numbered: DataFrame, decisions: DataFrame) -> DataFrame:
    """``item_id, decision`` by batch and index; a row without decision is kept."""
    return numbered.join(decisions, ["path", "batch", "idx"], "left").select("item_id", F.coalesce("decision", F.lit("KEEP")).alias("decision"))
