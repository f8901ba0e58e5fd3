"""Glossaries and settings as files."""

from __future__ import annotations

import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession

from glyphlake.functions.predicates import CleanConfig
from glyphlake.operators.extract import ExtractConfig

SCHEMA = "source_term string, target_term string, source_lang string, target_lang string, is_case_sensitive boolean, is_regex boolean, category string, remark string"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON file or folder; a missing or blank file gives no terms."""
    if not os.path.exists(path) or os.path.isfile(path) and os.path.getsize(path) < 2:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("multiLine", os.path.isfile(path)).json(path)


def write_glossary(glossary: DataFrame, path: str) -> None:
    glossary.select([c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").json(path)


def load_settings(path: str) -> ExtractConfig:
    """Settings of a JSON file; whatever cannot be read, or is no setting, leaves the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        clean = given.pop("clean", {})
        known = lambda cls, d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in {x.name for x in dataclasses.fields(cls)}}
        return ExtractConfig(**known(ExtractConfig, given), clean=CleanConfig(**known(CleanConfig, clean)))
    except (OSError, ValueError, TypeError, AttributeError):
        return ExtractConfig()


def save_settings(config: ExtractConfig, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(config), f, ensure_ascii=False, indent=2)
