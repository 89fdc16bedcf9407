"""From positioned pieces of text to paragraphs, and blocks joined to one text and split again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.strings import js_trim

#: Distances in points, and what stands between columns and between blocks.
SAME_LINE, COLUMN_GAP, SOFT_WRAP, STRUCTURAL = 2.0, 16.0, 1.65, 12.0
COLUMN_BREAK, BLOCK_BREAK = "\x1f", "\f"


def for_detection(text: Column) -> Column:
    """Line ends as spaces, so that a value broken over lines is one; the length stays."""
    return F.translate(text, "\n", " ")


def lines(runs: DataFrame, *page: str) -> DataFrame:
    """Visual lines of pages: page columns, line, y, height, text.

    ``runs`` has the page columns, seq, str, x, y, height, width. A piece stands on the line of the
    one before it if it is within 2 points of that line's first; wide gaps and wide blanks become
    column breaks. Windows run within a page, which is the unit of work however large a document is.
    """
    own = runs.filter(F.length("str") > 0)
    piece = F.struct("seq", "str", "x", "y", "height", "width")
    # a line begins where a piece is far from the one that began the current line: a fold over the page's pieces
    folded = own.groupBy(*page).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def step(acc: Column, p: Column) -> Column:
        same = (acc["line"] >= 0) & (F.abs(acc["y"] - p["y"]) <= SAME_LINE)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        y = F.when(same, acc["y"]).otherwise(p["y"])
        return F.struct(line.alias("line"), y.alias("y"), F.concat(acc["out"], F.array(F.struct(line.alias("line"), y.alias("line_y")))).alias("out"))

    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.array().cast("array<struct<line:int,line_y:double>>").alias("out"))
    lined = F.zip_with("pieces", F.aggregate("pieces", start, step)["out"], lambda p, o: F.struct(o["line"].alias("line"), o["line_y"].alias("line_y"), *(p[c].alias(c) for c in ("str", "x", "height", "width"))))
    # pieces of equal seq stand in the order of their other fields
    own = folded.select(*page, F.posexplode(lined).alias("seq", "p")).select(*page, "seq", "p.*")
    blank = js_trim(F.col("str")) == ""
    in_line = Window.partitionBy(*page, "line").orderBy("seq")
    before = in_line.rowsBetween(Window.unboundedPreceding, -1)
    # the last piece before that says something, and whether a wide blank is right before
    last = F.last(F.when(~blank, F.struct((F.col("x") + F.col("width")).alias("edge"), F.col("width").alias("width"), F.col("seq").alias("seq"))), ignorenulls=True).over(before)
    own = own.withColumns({"_last": last, "_prev_wide": F.lag(blank & (F.col("width") >= COLUMN_GAP)).over(in_line)})
    broken = ~blank & (F.col("_last.width") > 0) & ~F.coalesce("_prev_wide", F.lit(False)) & (F.col("x") - F.col("_last.edge") >= COLUMN_GAP)
    said = F.when(blank & (F.col("width") >= COLUMN_GAP), F.lit(COLUMN_BREAK)).when(F.coalesce(broken, F.lit(False)), F.concat(F.lit(COLUMN_BREAK), F.col("str"))).otherwise(F.col("str"))
    made = own.withColumn("_said", said).groupBy(*page, "line").agg(
        F.first("line_y").alias("y"), F.max("height").alias("height"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_said"))), lambda s: s["_said"]), "").alias("text")
    )
    return made.withColumn("text", js_trim(F.col("text"))).filter("text <> ''")


def paragraphs(runs: DataFrame, *page: str) -> DataFrame:
    """Paragraphs of pages: page columns, paragraph, text.

    A line goes on the paragraph before it if both are body-sized and the step down is at most 1.65
    times the upper line's height; without a space after a hyphen.
    """
    order = Window.partitionBy(*page).orderBy("line")
    own = lines(runs, *page)
    gap = F.lag("y").over(order) - F.col("y")
    wraps = (F.lag("height").over(order) < STRUCTURAL) & (F.col("height") < STRUCTURAL) & (gap > 0) & (gap <= F.lag("height").over(order) * SOFT_WRAP)
    own = own.withColumn("_new", F.when(F.coalesce(wraps, F.lit(False)), 0).otherwise(1)).withColumn("paragraph", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    joined = F.aggregate(texts, F.lit(""), lambda a, t: F.when(a == "", t).when(a.endswith("-"), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t)))
    return own.groupBy(*page, "paragraph").agg(joined.alias("text"))


def pages(runs: DataFrame, *page: str) -> DataFrame:
    """The text of each page: its paragraphs, an empty line apart."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n")
    return paragraphs(runs, *page).groupBy(*page).agg(whole.alias("text"))


def flattened(blocks: Column) -> Column:
    """struct<text, segments> of array<struct<locator, region, text>>: one text, and where each block stands in it."""
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), BLOCK_BREAK)

    def segment(b: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["text"]) + 1)
        return F.struct(start.alias("start"), (start + F.length(b["text"])).alias("end"), b["locator"].alias("locator"), b["region"].alias("region"))

    return F.struct(text.alias("text"), F.transform(blocks, segment).alias("segments"))


def split_blocks(text: Column, expected: Column) -> Column:
    """The blocks of a rewritten text, or null if their number has changed."""
    parts = F.split(text, BLOCK_BREAK, -1)
    return F.when(F.size(parts) == expected, parts)


def sanitized_offset(offset: Column, replaced: Column) -> Column:
    """Where a place of the original text is in the rewritten one; inside a replaced value, its placeholder's start."""
    shift = F.aggregate(
        replaced,
        F.lit(0),
        lambda a, r: a + F.when(r["end"] <= offset, F.length(r["placeholder"]) - (r["end"] - r["start"])).when((r["start"] < offset) & (offset < r["end"]), r["start"] - offset).otherwise(0),
    )
    return offset + shift

