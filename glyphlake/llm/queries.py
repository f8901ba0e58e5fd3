"""The training-text queries pN_..., over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import format_dups, language, lookalikes, mixing, mojibake, packing, pairs, sentences
from glyphlake.llm.tokens import sized_documents
from glyphlake.runtime import table


def _short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the drawings and of the review sheets."""
    items = table(spark, sf_dir, "items").select(F.lit("items").alias("src_table"), F.col("item_id").alias("row_id"), F.col("original_text").alias("text"))
    sheets = table(spark, sf_dir, "sheet_rows").select(F.lit("sheet_rows").alias("src_table"), F.col("sheet_row_id").alias("row_id"), F.col("translation").alias("text"))
    return items.unionByName(sheets)


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with a language label, and the raw text of those that have one."""

    def of(name: str, key: str, text: str, lang: str, raw: str | None = None) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("src_table"), F.col(key).alias("row_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), (F.col(raw) if raw else F.lit(None).cast("string")).alias("raw"))

    return of("items", "item_id", "original_text", "source_lang", "raw_original_text").unionByName(of("sheet_rows", "sheet_row_id", "translation", "translation_lang")).unionByName(of("documents", "doc_id", "text", "lang"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(_labelled_texts(spark, sf_dir), ["src_table", "row_id"], raw="raw")


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_labelled_texts(spark, sf_dir), ["src_table", "row_id"])
    return found.select("src_table", "row_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.forms(_short_texts(spark, sf_dir), ["src_table", "row_id"], "text").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lookalikes.forms(_short_texts(spark, sf_dir), ["src_table", "row_id"], "text")
    return forms.where("changed").select("src_table", "row_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_damaged(table(spark, sf_dir, "items"), "item_id", "raw_original_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_restored(spark, sf_dir).select("item_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "sheet_rows"), "sheet_row_id", "source", "translation", "target_lang")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.copies(table(spark, sf_dir, "items"), "item_id", "original_text", ["path", "entity_type"])


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.collapse(table(spark, sf_dir, "items"), "item_id", "original_text", ["path", "entity_type"])


def p6_cleaned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.collapse(table(spark, sf_dir, "items"), "item_id", "cleaned_text", ["path", "entity_type"])


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_limits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_pack(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every kind of container: each document with text is in it once and whole, split only if it is larger."""
    packed = p7_pack(spark, sf_dir)
    filled = packed.groupBy("container", "container_id").agg((F.sum("tokens") > F.first("capacity")).alias("over"), (F.sum("tokens") != F.first("used")).alias("wrong"))
    of = filled.groupBy("container").agg(F.count_if("over").alias("overfull"), F.count_if("wrong").alias("misreported"))
    docs = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece_no").alias("kinds"), F.sum("tokens").alias("size"), F.max(F.col("token_start") + F.col("tokens")).alias("reach"), F.first("capacity").alias("capacity"))
    broken = (F.col("size") != F.col("reach")) | (F.col("pieces") != F.col("kinds"))
    split = (F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))
    sums = docs.groupBy("container", F.col("capacity").alias("capacity_tokens")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(broken).alias("broken"), F.count_if(split).alias("split_needlessly"))
    return sums.join(of, "container")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every source of the targets: only its own documents are used, none more often than its cap."""
    targets = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    repeats = p8_repeats(spark, sf_dir).where("repeats > 0")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own")).distinct()
    of = repeats.join(docs, "doc_id").groupBy("source").agg(F.max("repeats").alias("most"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("foreign"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("twice"))
    joined = targets.join(F.broadcast(of), "source", "left")
    return joined.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), F.coalesce("foreign", F.lit(0)).alias("foreign"), F.coalesce("twice", F.lit(0)).alias("twice"))


def p8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.mix(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p6_found": p6_found, "p6_counts": p6_counts, "p6_cleaned_counts": p6_cleaned_counts, "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_checks": p7_checks, "p8_repeats": p8_repeats, "p8_shares": p8_shares, "p8_checks": p8_checks, "p9_found": p9_found}
#: Results that must hold by the tables alone; what the operators make cannot be put in SQL.
ORACLE = {
    "p7_checks": "SELECT container, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0 AS broken, 0 AS split_needlessly, 0 AS overfull, 0 AS misreported FROM pack_limits WHERE capacity_tokens >= 1",
    "p8_checks": "SELECT source, true AS within_cap, 0 AS foreign, 0 AS twice FROM mix_targets",
}
