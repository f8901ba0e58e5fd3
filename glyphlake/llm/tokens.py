"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.runtime import materialize

#: Vocabulary file; on a cluster, a path that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits a text into pieces before byte pairs are merged; the pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with its size ``tokens``; a null or empty text has 0."""
    rest = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text) + ", tokens long"

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for pdf in frames:
            sizes = [len(encode(t)) if t else 0 for t in pdf[text]]
            yield pdf[rest].assign(tokens=pd.Series(sizes, index=pdf.index, dtype="int64"))

    return df.mapInPandas(count, schema)


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens``, once per document (its first delivery), kept for the passes over it."""
    sized = count_tokens(documents.select("doc_id", "source", "loaded_at", "text"), "text", vocabulary)
    first = sized.groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens"), F.struct(F.coalesce("loaded_at", F.timestamp_micros(F.lit(0).cast("long"))), "tokens")).alias("d"))
    return materialize(first.select("doc_id", "d.source", "d.tokens"))
