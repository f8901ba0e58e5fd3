"""Terms of a glossary applied to translations.

The glossary is a reference table; what is put into the plan is checked against
``MAX_TERMS``.  A longer glossary is refused with a clear error instead of
being broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.predicates import is_blank
from glyphlake.functions.text import replace_ignore_case

#: Terms that may be put into a plan.
MAX_TERMS = 20_000


def matching_terms(glossary: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """Terms for a language pair; a blank language of a term fits any. Regular-expression terms and blank terms are left out."""
    fits = lambda c, lang: (F.coalesce(F.trim(c), F.lit("")) == "") | (F.lower(F.trim(c)) == lang.lower())
    return glossary.where(fits(F.col("source_lang"), source_lang) & fits(F.col("target_lang"), target_lang) & ~F.coalesce("is_regex", F.lit(False)) & (F.coalesce("source_term", F.lit("")) != ""))


def term_list(terms: DataFrame) -> Column:
    """The terms as a literal array, the longest first, ties by term."""
    rows = terms.select("source_term", "target_term", "is_case_sensitive").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} glossary terms for one language pair")
    ordered = sorted(rows, key=lambda r: (-len(r["source_term"]), r["source_term"], r["target_term"] or "", bool(r["is_case_sensitive"])))
    structs = [F.struct(F.lit(r["source_term"]).alias("s"), F.lit(r["target_term"] or "").alias("t"), F.lit(bool(r["is_case_sensitive"])).alias("exact")) for r in ordered]
    return F.array(*structs) if structs else F.array().cast("array<struct<s: string, t: string, exact: boolean>>")


def _has(text: Column, term: Column, exact: Column) -> Column:
    return F.when(exact, F.contains(text, term)).otherwise(F.contains(F.lower(text), F.lower(term)))


def apply_glossary(items: DataFrame, glossary: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """``item_id, translated_text, replaced``: the terms folded over each translated row, the longest first.

    An original that is a term takes the term's translation whole; a term that
    was left untranslated inside a translation is replaced there.  The fold
    keeps the text that later terms are looked for in apart from the result, so
    a whole replacement does not change what later terms see.
    """
    terms = term_list(matching_terms(glossary, source_lang, target_lang))
    original = F.coalesce("original_text", F.lit(""))
    start = F.struct(F.col("translated_text").alias("text"), F.col("translated_text").alias("seen"), F.lit(0).alias("n"))
    # Only terms that occur in the original can change anything.
    relevant = F.filter(terms, lambda e: _has(original, e["s"], e["exact"]))

    def fold(acc: Column, e: Column) -> Column:
        whole = F.when(e["exact"], original == e["s"]).otherwise(F.lower(original) == F.lower(e["s"]))
        left = _has(acc["seen"], e["s"], e["exact"])
        new = F.when(e["exact"], F.replace(acc["text"], e["s"], e["t"])).otherwise(replace_ignore_case(acc["text"], e["s"], e["t"]))
        return (
            F.when(whole, F.struct(e["t"].alias("text"), acc["seen"].alias("seen"), (acc["n"] + 1).alias("n")))
            .when(left, F.struct(new.alias("text"), new.alias("seen"), (acc["n"] + 1).alias("n")))
            .otherwise(acc)
        )

    rows = items.where(~is_blank(F.col("translated_text")))
    return rows.withColumn("r", F.aggregate(relevant, start, fold)).select("item_id", F.col("r.text").alias("translated_text"), F.col("r.n").alias("replaced"))


def term_hits(items: DataFrame, glossary: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """``item_id, source_term`` of every term that an original contains."""
    terms = term_list(matching_terms(glossary, source_lang, target_lang))
    text = F.col("original_text")
    hits = F.filter(terms, lambda e: _has(text, e["s"], e["exact"]))
    return items.where("original_text is not null").select("item_id", F.explode(F.array_distinct(F.transform(hits, lambda e: e["s"]))).alias("source_term"))
