"""Plain texts, HTML pages and conversations as lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geometry of the typeset view: lines on a page, points a line, a character, and of the margins.
PER_PAGE, LEADING, PER_CHAR, LEFT, TOP, HEIGHT = 40, 12.0, 5.0, 72.0, 60.0, 600.0
#: What is never shown, with its content; the elements that begin a new block, and the marks that take their place.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b.*?(?:</{t}[^>]*>|\z)" for t in ("head", "script", "style", "noscript", "template", "textarea", "svg", "iframe")) + r"|<[!?][^>]*>"
BLOCKS = "h[1-6]|p|li|div|td|th|tr|ul|ol|dl|dt|dd|pre|blockquote|article|section|main|nav|aside|header|footer|figure|figcaption|caption|form|fieldset|address|details|summary|body|html|table|thead|tbody|tfoot|hr"
BLOCK = rf"(?i)<(/?(?:{BLOCKS}))(?:[\s/][^>]*)?>"
TABLE, TAG, TEXT = "\x1d", "\x1e", "\x1f"


def typeset(docs: DataFrame) -> DataFrame:
    """Lines of plain texts as if printed: forty a page, the first one in 14 point, all else in 10.

    ``doc_id, page, ord, text, baseline, size, x0, x1, y0, y1, bold, page_height``; blank lines have no row.
    """
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("ord", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    size = F.when(F.col("ord") == 0, 14.0).otherwise(10.0).cast("float")
    baseline = (F.lit(TOP) + LEADING * (F.col("ord") % PER_PAGE)).cast("float")
    out = lines.select("doc_id", F.floor(F.col("ord") / PER_PAGE).cast("int").alias("page"), "ord", "text", baseline.alias("baseline"), size.alias("size"))
    x1 = (F.lit(LEFT) + PER_CHAR * F.length("text")).cast("float")
    return out.select("*", F.lit(LEFT).cast("float").alias("x0"), x1.alias("x1"), (F.col("baseline") - F.col("size")).alias("y0"), F.col("baseline").alias("y1"), F.lit(False).alias("bold"), F.lit(HEIGHT).cast("float").alias("page_height"))


def _plain(markup: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\b[^>]*>", " "), r"<[^>]*>", "")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _cells(table: Column) -> Column:
    """The rows of a table's markup as arrays of cells; rows without cells go."""
    rows = F.split(table, r"(?i)<tr\b[^>]*>")
    each = F.transform(rows, lambda r: F.transform(F.slice(F.split(r, r"(?i)<t[dh]\b[^>]*>"), F.lit(2), F.lit(1 << 20)), _plain))
    return F.filter(each, lambda r: F.size(r) > 0)


def html_blocks(pages: DataFrame) -> DataFrame:
    """All visible text of pages as blocks: ``doc_id, ord, type, level, ordered, text, rows, header_rows, page, size``.

    A block ends where a block element begins or ends, in whatever case its name is; it is a heading or a list item
    if that is what has begun, and else a paragraph.  A table is one block, with its cells.  The first heading of
    level 1 is the title.  Null pages have no blocks.
    """
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", HIDDEN, ""), r"(?i)<table\b", f"{TABLE}<table"), r"(?i)</table\s*>", f"</table>{TABLE}")
    pieces = F.transform(F.split(shown, TABLE), lambda p: F.when(p.startswith("<table"), F.array(F.concat(F.lit(f"table{TEXT}"), p))).otherwise(F.split(F.regexp_replace(p, BLOCK, f"{TAG}$1{TEXT}"), TAG)))

    def block(x: Column) -> Column:
        tag = F.when(x.contains(TEXT), F.lower(F.substring_index(x, TEXT, 1))).otherwise("")
        return F.struct(tag.alias("tag"), F.when(tag == "table", "").otherwise(_plain(F.substring_index(x, TEXT, -1))).alias("text"), F.when(tag == "table", _cells(x)).alias("rows"), F.when(tag == "table", x.rlike(r"(?is)^[^\x1f]*\x1f<table[^>]*>\s*(?:<thead[^>]*>\s*)?<tr[^>]*>\s*<th\b").cast("int")).alias("header_rows"))

    each = pages.select(F.col("page_id").alias("doc_id"), F.transform(F.flatten(pieces), block).alias("b"))
    title = F.array_position(F.transform("b", lambda x: (x["tag"] == "h1") & (x["text"] != "")), F.lit(True)) - 1
    # the outer form: before the other one Spark puts a filter that extracts the blocks once more
    rows = each.select("doc_id", title.cast("int").alias("title"), F.posexplode_outer("b").alias("ord", "e")).filter("e.text <> '' OR size(e.rows) > 0")
    tag = F.col("e.tag")
    kind = F.when(F.col("ord") == F.col("title"), "title").when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list_item").when(tag == "table", "table").otherwise("paragraph")
    level = F.when(kind == "heading", F.substring(tag, 2, 1).cast("int"))
    return rows.select("doc_id", "ord", kind.alias("type"), level.alias("level"), F.when(kind == "list_item", F.lit(False)).alias("ordered"), F.col("e.text").alias("text"), F.col("e.rows").alias("rows"), F.col("e.header_rows").alias("header_rows"), F.lit(0).alias("page"), F.lit(10.0).cast("float").alias("size"))


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """Turns as blocks: a system turn is a heading of level 1, a user turn one of level 2, others are paragraphs."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    kind = F.when(level.isNotNull(), "heading").otherwise("paragraph")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), kind.alias("type"), level.alias("level"), F.lit(None).cast("boolean").alias("ordered"), "text", F.lit(0).alias("page"), F.lit(10.0).cast("float").alias("size"))
