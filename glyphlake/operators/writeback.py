"""Translations put back into the lines of drawings.

Items are joined to the entities by path and normalized handle; each match gives
a span of lines and the lines that take its place; the spans are cut out and the
file numbered anew in one pass.  Everything else keeps its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.functions.mtext import rebuild_paragraphs_udf, rebuild_udf
from glyphlake.functions.predicates import is_blank, is_integer_line
from glyphlake.operators import entities as N
from glyphlake.runtime import materialize
from glyphlake.sources.dxf import pairs_of, replace_spans


def targets(pairs: DataFrame) -> DataFrame:
    """``path, key, kind, owner, raw, first_line, last_line, width, chunk_lines`` of every place a text can be written to."""
    # All kinds branch from one pass over the pairs.
    found = materialize(N.with_entities(pairs))
    pairs = found
    column = lambda c, n: c.alias(n)
    none, key = F.lit(None).cast("double"), lambda c: F.upper(F.trim(c))

    def of(df: DataFrame, kind: str, handle: Column, text: str, first: Column, last: Column, width: Column = none, rest: Column | None = None) -> DataFrame:
        extra = rest if rest is not None else F.array().cast("array<int>")
        return df.select("path", column(key(handle), "key"), F.lit(kind).alias("kind"), column(F.col(text), "raw"), first.alias("first_line"), last.alias("last_line"), width.alias("width"), extra.alias("rest_lines"))

    line = F.col("text_line")
    chunk_first = F.coalesce(F.element_at(F.when(F.size("code3_lines") > 0, F.col("code3_lines")), 1), F.col("last_code1_line"))
    cells = N.cells(found, pairs).withColumn("handle", F.concat("table_handle", F.lit("::R"), F.col("row").cast("string"), F.lit("::C"), F.col("column").cast("string")))
    out = [
        of(N.texts(found), "Text", F.coalesce(F.when(F.col("handle") != "", F.col("handle")), F.concat(F.lit("L"), line)), "text", line, line),
        of(N.mtexts(found), "MText", F.col("handle"), "text", chunk_first, F.col("last_code1_line"), F.col("rect_width")),
        of(N.attributes(found), "Attribute", F.col("composite_key"), "text", line, line),
        of(cells.where("cell_type = 1"), "TableCell", F.col("handle"), "text", line, line, rest=F.col("rest_lines")),
        of(N.leaders(found).where("content_type = 2"), "MLeader", F.concat("handle", F.lit("::CTX")), "text", line, line),
    ]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    # A handle that occurs twice: the last in the file.
    last = F.max_by(F.struct("raw", "first_line", "last_line", "width", "rest_lines"), F.coalesce("first_line", F.lit(-1))).alias("t")
    return rows.groupBy("path", "kind", "key").agg(last).select("path", "kind", "key", "t.*")


def match(items: DataFrame, places: DataFrame) -> DataFrame:
    """Items with the place of their handle and kind: ``path, kind, key, text, paragraphs, raw, first_line, last_line, width, rest_lines, state``.

    ``state`` is ``not_found``, ``no_line`` (nothing to write to), ``guarded``
    (the line to overwrite is an integer) or ``ok``.  Of several rows for a
    handle the last by ``ord`` counts; blank translations are left out.
    """
    wanted = items.where(~is_blank(F.col("translated_text"))).select("path", F.col("entity_type").alias("kind"), F.upper(F.trim("handle")).alias("key"), F.col("translated_text").alias("text"), "ord", (F.col("paragraphs") if "paragraphs" in items.columns else F.lit(None).cast("map<int,string>")).alias("paragraphs"))
    last = wanted.groupBy("path", "kind", "key").agg(F.max_by("text", "ord").alias("text"), F.max_by("paragraphs", "ord").alias("paragraphs"))
    joined = last.join(places, ["path", "kind", "key"], "left")
    state = F.when(F.col("raw").isNull() & F.col("first_line").isNull(), "not_found").when(F.col("first_line").isNull() | F.col("last_line").isNull(), "no_line").when(is_integer_line(F.col("raw")), "guarded").otherwise("ok")
    return joined.withColumn("state", state)


def spans(matched: DataFrame) -> DataFrame:
    """``path, first_line, last_line, new_lines`` of the matches that can be written.

    A paragraph text gives its code line and its chunks a new form, from the
    first chunk's code line to the last; other kinds replace their value line.
    If its paragraphs are given by number, each takes the place of its own.
    Further lines of an older table cell are blanked.
    """
    ok = matched.where("state = 'ok'")
    simple = ok.where("kind <> 'MText'").select("path", "first_line", "last_line", F.array(T.sanitize_line(F.col("text"))).alias("new_lines"))
    blanks = ok.where("kind = 'TableCell'").select("path", F.explode("rest_lines").alias("first_line"))
    blanks = blanks.select("path", "first_line", F.col("first_line").alias("last_line"), F.array(F.lit("")).alias("new_lines"))
    width, parts = F.coalesce("width", F.lit(0.0)), F.split("raw", r"\\P")
    # Numbers count the paragraphs that are not blank, as ``paragraphs`` of extraction does.
    own = F.transform(parts, lambda x, i: F.when(~is_blank(x), F.try_element_at("paragraphs", F.size(F.filter(F.slice(parts, 1, i), lambda y: ~is_blank(y))))))
    mtext = ok.where("kind = 'MText'")
    apart = mtext.where("paragraphs is not null").withColumn("body", rebuild_paragraphs_udf(parts, own, width))
    body = mtext.where("paragraphs is null").withColumn("body", rebuild_udf(F.col("raw"), F.col("text"), width)).unionByName(apart)
    chunked = F.flatten(F.transform(T.chunks(F.col("body")), lambda x: F.array(F.lpad(x["code"], 3, " "), x["text"])))
    texts = body.select("path", (F.col("first_line") - 1).alias("first_line"), "last_line", chunked.alias("new_lines"))
    return simple.unionByName(blanks).unionByName(texts)


def write_back(lines: DataFrame, items: DataFrame, fit: bool = False) -> tuple[DataFrame, DataFrame]:
    """The lines with the translations of ``path, handle, entity_type, translated_text, ord`` in them, and the log of the matches.

    The log has ``path, kind, key, state``.  ``fit`` also scales the heights and
    widths of texts that overflow.
    """
    pairs = pairs_of(lines)
    matched = match(items, targets(pairs))
    edits = spans(matched)
    if fit:
        edits = edits.unionByName(layout_spans(pairs, matched))
    return replace_spans(lines, edits), matched.select("path", "kind", "key", "state")


def summary(log: DataFrame) -> DataFrame:
    """``path, ok, skipped, warnings`` of a write-back log."""
    return log.groupBy("path").agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "guarded").alias("skipped"), F.count_if(F.col("state").isin("not_found", "no_line")).alias("warnings"))


def layout_spans(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """``path, first_line, last_line, new_lines`` of the heights and widths of the matches that overflow."""
    ok = matched.where("state = 'ok' and kind in ('Text', 'MText')")
    rows = lambda text: ok.select("path", F.col("kind").alias("entity_type"), F.col("key").alias("handle"), F.col(text).alias("text"))
    # Of several entities of a handle only the one that is written.
    written = ok.select("path", F.col("kind").alias("entity_type"), "key", F.col("last_line").alias("text_line"), "first_line")
    found = layout(pairs, rows("raw"), rows("text")).join(written, ["path", "entity_type", "key", "text_line"])
    outside = (F.col("width_line") < F.col("first_line") - 1) | (F.col("width_line") > F.col("text_line"))
    places = F.array(F.struct(F.col("height_line").alias("line"), F.col("height").alias("value")), F.struct(F.when(outside, F.col("width_line")).alias("line"), F.col("width").alias("value")))
    each = found.select("path", F.explode(places).alias("p")).where("p.line is not null and p.value is not null")
    return each.select("path", F.col("p.line").alias("first_line"), F.col("p.line").alias("last_line"), F.array("p.value").alias("new_lines"))


def layout(pairs: DataFrame, originals: DataFrame, translations: DataFrame) -> DataFrame:
    """``path, entity_type, key, text_line, scale, height_line, height, width_line, width`` of texts that overflow.

    ``originals`` and ``translations`` have ``path, entity_type, handle, text``.  A
    text's bound is the width it had; a paragraph text's is its rectangle.  The
    height is the nearest pair 40 of the entity before the text, at most 25 pairs
    away; the width is the paragraph text's last pair 41.
    """
    found = materialize(N.with_entities(pairs))
    near = N.nearest_before(found.select("path", "pair_idx", "code", "value", "value_line", "entity", "kind"), 40).where("code in (1, 3)")
    at = near.groupBy("path", "entity", "kind").agg(F.min_by("near_value", "pair_idx").alias("h"), F.min_by("near_line", "pair_idx").alias("height_line"))
    own = found.groupBy("path", "entity").agg(F.min("value_line").alias("start"), F.max(F.when((F.col("code") == 41) & (F.col("kind") == "MTEXT"), F.col("value_line"))).alias("width_line"))
    at = at.join(own, ["path", "entity"]).where("height_line >= start")
    texts = N.texts(found).select("path", "entity", "handle", F.lit("Text").alias("entity_type"), F.lit(None).cast("double").alias("rect_width"), "text_line")
    mtexts = N.mtexts(found).select("path", "entity", "handle", F.lit("MText").alias("entity_type"), "rect_width", F.col("last_code1_line").alias("text_line"))
    places = texts.unionByName(mtexts).join(at.select("path", "entity", "h", "height_line", "width_line"), ["path", "entity"]).withColumn("key", F.upper(F.trim("handle")))
    size = lambda df, n: df.select("path", "entity_type", F.upper(F.trim("handle")).alias("key"), (T.visual_width(F.col("text")) / 100).alias(n))
    rows = places.join(size(originals, "before"), ["path", "entity_type", "key"]).join(size(translations, "after"), ["path", "entity_type", "key"]).withColumn("height", F.expr("try_cast(trim(h) as double)")).where("height > 0")
    bound = F.when(F.col("entity_type") == "Text", F.col("before") * F.col("height")).otherwise(F.col("rect_width"))
    scaled = rows.withColumn("scale", T.layout_scale(F.col("after") * F.col("height"), bound)).where("scale is not null")
    high = F.col("height") * F.col("scale")
    return scaled.select("path", "entity_type", "key", "text_line", "width_line", F.round("scale", 6).alias("scale"), "height_line", F.format_string("%.6f", high).alias("height"), F.when(F.col("entity_type") == "MText", F.format_string("%.6f", F.col("after") * high)).alias("width"))


def compose(items: DataFrame) -> DataFrame:
    """Lines of a plain drawing that holds the given items: ``path, line_no, text``.

    ``items`` has ``path, ord, handle, entity_type, raw_original_text,
    layer_name``; kinds other than text and paragraph text are written as text.
    """
    w = Window.partitionBy("path").orderBy("ord", "handle")
    rows = items.where("raw_original_text is not null").select("path", F.row_number().over(w).alias("n"), F.posexplode(_plain(F.col("entity_type") == "MText")).alias("sub", "text"))
    return _framed(items, rows)


def _layer() -> Column:
    return F.when(F.coalesce("layer_name", F.lit("")) != "", F.array(F.lit("  8"), F.col("layer_name"))).otherwise(F.array(F.lit("  8"), F.lit("0")))


def _plain(mtext: Column) -> Column:
    """The lines of a TEXT or an MTEXT."""
    body = F.flatten(F.transform(T.chunks(F.translate("raw_original_text", "\r\n\t", "   ")), lambda x: F.array(F.lpad(x["code"], 3, " "), x["text"])))
    one = F.array(F.lit("  1"), T.sanitize_line(F.col("raw_original_text")))
    return F.concat(F.array(F.lit("  0"), F.when(mtext, "MTEXT").otherwise("TEXT"), F.lit("  5"), F.col("handle")), _layer(), F.array(F.lit(" 40"), F.lit("2.5")), F.when(mtext, F.concat(F.array(F.lit(" 41"), F.lit("50.0")), body)).otherwise(one))


def _framed(items: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, n, sub, text`` of the entities in a section, for every path of the items."""
    ends = items.select("path").distinct()
    frame = lambda n, *texts: ends.select("path", F.lit(n).alias("n"), F.posexplode(F.array(*map(F.lit, texts))).alias("sub", "text"))
    whole = rows.unionByName(frame(0, "  0", "SECTION", "  2", "ENTITIES")).unionByName(frame(2**31 - 1, "  0", "ENDSEC", "  0", "EOF"))
    v = Window.partitionBy("path").orderBy("n", "sub")
    return whole.select("path", (F.row_number().over(v) - 1).alias("line_no"), "text")


def compose_kinds(items: DataFrame) -> DataFrame:
    """As ``compose``, with each kind as the entity it comes from.

    Attributes of an owner are the ATTRIBs of one INSERT, its cells one ACAD_TABLE
    with cells of another type in the gaps, leaders MULTILEADERs with a context.
    Owner, tag, row and column are those of the handle.
    """
    array = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    owner, kind, line = F.regexp_replace("handle", "::.*$", ""), F.col("entity_type"), T.sanitize_line(F.col("raw_original_text"))
    tag = F.regexp_extract("handle", "::(.*)$", 1)
    part = lambda n: F.regexp_extract("handle", "(?i)::R([0-9]+)::C([0-9]+)$", n).try_cast("int")
    own = F.when(kind == "Attribute", F.concat(array("  0", "ATTRIB", "  5", F.col("handle")), _layer(), array("  2", tag, "  1", line)))
    own = own.when(kind == "MLeader", F.concat(array("  0", "MULTILEADER", "  5", owner), _layer(), array("172", "2", "300", "CONTEXT_DATA{", "304", line, "301", "}")))
    own = own.when(kind == "TableCell", array("301", "CELL_VALUE", "171", "1", "302", line)).otherwise(_plain(kind == "MText"))
    shared = kind.isin("Attribute", "TableCell")
    rows = items.where("raw_original_text is not null").select("path", "ord", "handle", kind.alias("kind"), F.when(shared, owner).otherwise(F.col("handle")).alias("entity"), owner.alias("owner"), _layer().alias("layer"), own.alias("own"), part(1).alias("row"), part(2).alias("column"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "handle", "layer", "own", "row", "column")))
    # One row an entity: the first of its items gives place and layer.
    whole = rows.groupBy("path", "kind", "entity", "owner").agg(parts.alias("parts")).withColumn("first", F.col("parts")[0])
    columns = F.array_max(F.transform("parts", lambda x: x["column"])) + 1
    height = F.array_max(F.transform("parts", lambda x: x["row"])) + 1
    cells = F.map_from_entries(F.transform("parts", lambda x: F.struct(x["row"] * F.col("columns") + x["column"], x["own"])))
    gap = array("301", "CELL_VALUE", "171", "2")
    table = F.flatten(F.transform(F.sequence(F.lit(0), F.col("columns") * F.col("rows") - 1), lambda i: F.coalesce(F.try_element_at(F.col("cells"), i), gap)))
    sized = whole.withColumn("columns", columns).withColumn("rows", height).withColumn("cells", F.when(F.col("kind") == "TableCell", cells))
    head = lambda name: F.concat(array("  0", name, "  5", F.col("owner")), F.col("first.layer"))
    flat = F.flatten(F.transform("parts", lambda x: x["own"]))
    lines = F.when(F.col("kind") == "Attribute", F.concat(head("INSERT"), flat, array("  0", "SEQEND")))
    lines = lines.when(F.col("kind") == "TableCell", F.concat(head("ACAD_TABLE"), array(" 91", F.col("rows").cast("string"), " 92", F.col("columns").cast("string")), table)).otherwise(flat)
    w = Window.partitionBy("path").orderBy("first.ord", "first.handle", "kind")
    return _framed(items, sized.select("path", F.row_number().over(w).alias("n"), lines.alias("lines")).select("path", "n", F.posexplode("lines").alias("sub", "text")))
