"""The drawing pipeline as functions: read, translate, write back.

``Session`` holds the lines of the drawings under a path; its commands answer
with ``{"success", "data", "error", "id"}`` through ``dispatch``, so that a
service can pass its requests on.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.predicates import is_blank
from glyphlake.operators import reconcile as R
from glyphlake.operators import translate as E
from glyphlake.operators import writeback as W
from glyphlake.operators.extract import ExtractConfig, extract_items, merge_paragraphs
from glyphlake.operators.glossary import apply_glossary
from glyphlake.operators.merge import truly_translated
from glyphlake.runtime import materialize
from glyphlake.sources import dxf

log = logging.getLogger(__name__)


def translate_text(text: str | None, engine: E.Engine, source: str = "auto", target: str = "en") -> str | None:
    """One text; null if the engine has no translation."""
    reply = engine([text], source, target) if text else [None]
    return reply[0] if reply and reply[0] else None


def list_engines() -> list[str]:
    return sorted(E.ENGINES) + list(E.UNAVAILABLE)


class Session:
    """Drawings under a path, read once; ``fit`` scales texts whose translation overflows."""

    def __init__(self, spark: SparkSession, path: str, config: ExtractConfig = ExtractConfig(), fit: bool = True) -> None:
        self.spark, self.path, self.config, self.fit = spark, path, config, fit
        self._lines: DataFrame | None = None
        self._items: DataFrame | None = None

    @property
    def lines(self) -> DataFrame:
        if self._lines is None:
            self._lines = materialize(dxf.read_lines(self.spark, self.path))
        return self._lines

    @property
    def items(self) -> DataFrame:
        """Items with ``item_id``, unique over the drawings."""
        if self._items is None:
            found = extract_items(dxf.pairs_of(self.lines), self.config)
            # The id is a function of the row, so a task that runs again gives the same.
            self._items = materialize(found.withColumn("item_id", F.xxhash64("path", "ord", "handle")).withColumn("cad_handles", F.array("handle")).withColumn("translated_text", F.lit(None).cast("string")))
        return self._items

    def read_entities(self) -> DataFrame:
        """``path, id, handle, entity_type, original_text, layer``."""
        return self.items.select("path", R.id_string(F.col("cad_handles")).alias("id"), "handle", "entity_type", "original_text", F.col("layer_name").alias("layer"))

    def write_translation(self, edits: DataFrame, folder: str) -> DataFrame:
        """Edits of ``path, id, original, translated, seq`` resolved, written to files; the summary by path."""
        found = R.resolve_edits(self.items, edits).select("item_id", F.col("translated").alias("translated_text"))
        return self._write(self.items.drop("translated_text").join(found, "item_id"), folder)

    def translate_drawing(self, engine: E.Engine, source: str, target: str, folder: str, glossary: DataFrame | None = None) -> DataFrame:
        """The whole pipeline: distinct texts through the engine, glossary, write-back; the summary by path."""
        done = materialize(E.translate_items(self.items, engine, source, target))
        rows = self.items.drop("translated_text").join(done, "item_id")
        if glossary is not None:
            termed = apply_glossary(rows, glossary, source, target).select("item_id", F.col("translated_text").alias("termed"))
            rows = rows.join(termed, "item_id", "left").withColumn("translated_text", F.coalesce("termed", "translated_text")).drop("termed")
        log.info("translated rows of %s: %s", self.path, truly_translated(rows).count())
        return self._write(rows.where(~is_blank(F.col("translated_text"))), folder)

    def _write(self, rows: DataFrame, folder: str) -> DataFrame:
        if self.config.mtext_paragraphs and not self.config.mtext_whole:
            # A place is a whole entity, so its paragraphs are put together.
            apart, columns = F.col("entity_type") == "MText", ("path", "handle", "entity_type", "ord", "translated_text", "paragraphs")
            rows = rows.withColumn("paragraphs", F.lit(None).cast("map<int,string>"))
            rows = rows.where(~apart).select(*columns).unionByName(merge_paragraphs(rows.where(apart)).select(*columns))
        lines, done = W.write_back(self.lines, rows, self.fit)
        dxf.write_lines(lines, folder, root=self.path)
        return W.summary(done)

    def get_status(self) -> dict[str, Any]:
        return {"path": self.path, "cached": self._lines is not None, "engines": list_engines()}


def dispatch(session: Session, request: dict[str, Any]) -> dict[str, Any]:
    """Run a command of ``{"command", "args", "id"}``; errors are answers, not exceptions."""
    commands = {
        "translate_text": lambda a: translate_text(a.get("text"), E.make_engine(a.get("engine", "marker")), a.get("source", "auto"), a.get("target", "en")),
        "list_engines": lambda a: list_engines(),
        "get_status": lambda a: session.get_status(),
        "read_entities": lambda a: session.read_entities(),
        "write_translation": lambda a: session.write_translation(a["edits"], a["folder"]),
        "translate_drawing": lambda a: session.translate_drawing(E.make_engine(a.get("engine", "marker")), a.get("source", "auto"), a.get("target", "en"), a["folder"]),
    }
    answer: dict[str, Any] = {"success": False, "data": None, "error": None, "id": request.get("id")}
    try:
        answer |= {"success": True, "data": commands[request["command"]](request.get("args") or {})}
    except Exception as e:  # the caller gets the reason
        answer["error"] = f"{type(e).__name__}: {e}"
    return answer
