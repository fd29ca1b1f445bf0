"""Reading order, page texts and budgeted renderings of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMN_GAP = 0.05
CUT_MARK = "[... page cut ...]"


def reading_order(blocks: DataFrame) -> DataFrame:
    """Numbers the blocks of each page anew: left column before right one where there are two, then top to bottom.

    Two columns: at least three centres on either side of the middle, more than COLUMN_GAP apart.
    """
    page = Window.partitionBy("document_id", "page_number")
    centre = (F.col("x0") + F.col("x1")) / 2
    left, right = (lambda agg, side: agg(F.when(side, centre)).over(page)), centre >= 0.5
    two = (F.count(F.when(~right, 1)).over(page) >= 3) & (F.count(F.when(right, 1)).over(page) >= 3) & (left(F.min, right) - left(F.max, ~right) > COLUMN_GAP)
    column = F.when(two & right, 1).otherwise(0)
    ordered = blocks.withColumn("_column", column)
    number = F.row_number().over(page.orderBy("_column", F.round("y0", 3), "x0", "pos")) - 1
    return ordered.withColumn("reading_order", number).drop("_column")


def page_texts(blocks: DataFrame) -> DataFrame:
    """document_id, page_number, text (blocks in reading order, blank ones left out), n_chars."""
    x0 = F.col("x0") if "x0" in blocks.columns else F.lit(0.0)
    part = F.struct("reading_order", "y0", x0.alias("x0"), "pos", "text")
    pages = blocks.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.when(F.trim("text") != "", part))).alias("parts"))
    text = F.array_join(F.col("parts.text"), "\n")
    return pages.select("document_id", "page_number", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def render(blocks: DataFrame) -> Column:
    return F.format_string("[%s|%s] %s", F.col("block_id"), F.col("block_type"), F.col("text"))


def budgeted(blocks: DataFrame, most: int) -> DataFrame:
    """document_id, page_number, n_shown, n_blocks, layout: rendered lines up to `most` characters (a line counts one more).

    The first line that would pass the budget cuts all that follow it.
    """
    page = Window.partitionBy("document_id", "page_number").orderBy("reading_order", "pos")
    lines = blocks.withColumn("line", render(blocks)).withColumn("used", F.coalesce(F.sum(F.length("line") + 1).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Sums only grow, so all before the first violation fit and it alone decides where the cut is.
    fits = lines.withColumn("_over", F.max((F.col("used") + F.length("line") > most).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.sort_array(F.collect_list(F.when(F.col("_over") == 0, F.struct("reading_order", "pos", "line"))))
    out = fits.groupBy("document_id", "page_number").agg(F.count(F.when(F.col("_over") == 0, 1)).alias("n_shown"), F.count(F.lit(1)).alias("n_blocks"), shown.alias("s"))
    text = F.array_join(F.concat(F.col("s.line"), F.when(F.col("n_shown") < F.col("n_blocks"), F.array(F.lit(CUT_MARK))).otherwise(F.array().cast("array<string>"))), "\n")
    return out.select("document_id", "page_number", "n_shown", "n_blocks", text.alias("layout"))


def group_layout(pages: DataFrame, group_pages: DataFrame) -> DataFrame:
    """The pages of each group as one text, repeated pages marked."""
    head = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.when(F.col("is_overlap"), " (seen before)").otherwise(""), F.lit(" ---\n"))
    part = F.struct("page_number", F.concat(head, F.col("text")).alias("part"))
    joined = group_pages.join(pages, ["document_id", "page_number"]).groupBy("document_id", "group_index").agg(F.sort_array(F.collect_list(part)).alias("ps"))
    return joined.select("document_id", "group_index", F.array_join(F.col("ps.part"), "\n").alias("layout"))
