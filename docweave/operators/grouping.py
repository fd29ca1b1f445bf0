"""Bounded, overlapping groups of pages without a loop over documents.

The window for a cursor depends on the cursor alone, so the next cursor is computed for every page at once
(a range of its following pages, at most max_pages of them); the groups are the orbit of the first page.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say a table goes on (fixed values).
MARKERS = ["continued", "continued on next page", "cont.", "carried forward", "brought forward"]
TOTALS = "total|subtotal|balance|sum"
TABLE_TYPES = ["table", "table_header", "table_row"]
FOOT = 0.80


@dataclass(frozen=True)
class Grouping:
    max_pages: int = 4
    overlap: int = 1
    max_chars: int = 18_000
    min_pages: int = 1
    natural_breaks: bool = True

    def __post_init__(self):
        if self.max_pages < 1 or self.min_pages < 1 or self.max_chars < 1 or not 0 <= self.overlap < self.max_pages or self.min_pages > self.max_pages:
            raise ValueError(f"grouping out of bounds: {self}")


def markers_of(tables: list[list[str]] | None) -> list[str]:
    """The markers of all tables, in order, once each; the defaults if there are none."""
    return list(dict.fromkeys(m for t in tables or [] for m in t)) or MARKERS


def page_ends(blocks: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """document_id, page_number, mid_table boolean, penalty double (how bad a place it is to stop after)."""
    return sized_pages(blocks, markers).drop("n_chars")


def sized_pages(blocks: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """page_ends() with n_chars, the length of the page's text (layout.page_texts), by one aggregation."""
    page = Window.partitionBy("document_id", "page_number")
    down = page.orderBy(F.col("y1").desc(), "pos")
    # Of equal lowest ones the first is the lowest; the last three of a stable sort are the later ones.
    upward = page.orderBy(F.col("y1").desc(), F.col("pos").desc())
    table_foot = F.max(F.when(F.col("block_type").isin(TABLE_TYPES), F.col("y1"))).over(page)
    marked = blocks.select("document_id", "page_number", "pos", "block_type", "text", "y0", "y1").withColumns({"_low": F.row_number().over(down), "_tail": F.row_number().over(upward), "_foot": table_foot})
    lower = F.lower(F.coalesce("text", F.lit("")))
    has_marker = reduce(lambda a, b: a | b, (lower.contains(m) for m in markers))
    after = (F.col("block_type") != "page_footer") & (F.col("y0") >= F.col("_foot")) & lower.rlike(TOTALS)
    ended = lower.rlike(r"[.!?:]\s*$")
    shown = F.trim("text") != ""
    x = marked.groupBy("document_id", "page_number").agg(
        F.bool_or(has_marker).alias("_marked"),
        F.max("_foot").alias("_foot"),
        F.bool_or(after).alias("_totals"),
        F.bool_or((F.col("_tail") <= 3) & F.col("block_type").isin("heading", "title")).alias("_heading"),
        F.bool_or((F.col("_low") == 1) & (F.col("block_type") == "paragraph") & ~ended).alias("_open"),
        F.greatest(F.coalesce(F.sum(F.when(shown, F.length("text").cast("long"))), F.lit(0)) + F.count(F.when(shown, 1)) - 1, F.lit(0)).alias("n_chars"),
    )
    mid: Column = F.col("_marked") | ((F.col("_foot") >= FOOT) & ~F.coalesce("_totals", F.lit(False)))
    mid = F.coalesce(mid, F.lit(False))
    penalty = F.when(mid, 1.0).when(F.col("_heading"), 0.1).when(F.col("_open"), 0.5).otherwise(0.2)
    return x.select("document_id", "page_number", mid.alias("mid_table"), penalty.alias("penalty"), "n_chars")


def group_pages(pages: DataFrame, config: Grouping = Grouping()) -> DataFrame:  # noqa: B008
    """Of pages (document_id, page_number, n_chars, mid_table, penalty): document_id, group_index, page_number,
    is_overlap, continues_table, overlap_dropped.

    Page numbers are unique in a document. A window in which only old pages have room would never advance;
    there the overlap is given up.
    """
    doc = Window.partitionBy("document_id").orderBy("page_number")
    ahead = doc.rowsBetween(0, config.max_pages - 1)
    behind = doc.rowsBetween(-config.overlap, -1) if config.overlap else None
    page = F.struct("n_chars", "penalty")
    x = pages.withColumns({"pos": F.row_number().over(doc) - 1, "after": F.collect_list(page).over(ahead), "before": F.collect_list(page).over(behind) if behind else F.array().cast("array<struct<n_chars:bigint,penalty:double>>")})

    def admitted(window: Column) -> Column:
        """How many pages of the window have room: the first that has none ends it."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

        def step(acc, p):
            full = acc["full"] | (acc["n"] >= config.max_pages) | ((acc["used"] + p["n_chars"] > config.max_chars) & (acc["n"] >= config.min_pages))
            return F.struct(F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(full, acc["used"]).otherwise(acc["used"] + p["n_chars"]).alias("used"), full.alias("full"))

        return F.aggregate(window, start, step, lambda a: a["n"])

    def trimmed(window: Column, n: Column, least: Column) -> Column:
        """The length with the clearly best end, of least or more."""
        if not config.natural_breaks:
            return n
        start = F.struct(n.alias("best"), F.get(window, n - 1)["penalty"].alias("penalty"))
        lengths = F.when(least <= n - 1, F.sequence(least, n - 1)).otherwise(F.array().cast("array<int>"))

        def step(acc, k):
            p = F.get(window, k - 1)["penalty"]
            better = p + 0.25 < acc["penalty"]
            return F.struct(F.when(better, k).otherwise(acc["best"]).alias("best"), F.when(better, p).otherwise(acc["penalty"]).alias("penalty"))

        return F.when(n > least, F.aggregate(lengths, start, step, lambda a: a["best"])).otherwise(n)

    x = x.withColumn("window", F.concat("before", "after")).withColumn("old", F.size("before"))
    x = x.withColumn("n", admitted(F.col("window")))
    # With the overlap alone nothing new fits: do without it.
    x = x.withColumn("dropped", F.col("n") <= F.col("old"))
    x = x.withColumns({"window": F.when(F.col("dropped"), F.col("after")).otherwise(F.col("window")), "old": F.when(F.col("dropped"), 0).otherwise(F.col("old"))})
    x = x.withColumn("n", F.when(F.col("dropped"), admitted(F.col("after"))).otherwise(F.col("n")))
    x = x.withColumn("n", trimmed(F.col("window"), F.col("n"), F.greatest(F.lit(config.min_pages), F.col("old") + 1)))
    x = x.withColumns({"next": F.col("pos") - F.col("old") + F.col("n"), "start": F.col("pos") - F.col("old"), "was_mid": F.lag("mid_table").over(doc)})
    cursor = F.struct("pos", "next", "start", "was_mid", "dropped", "page_number")
    docs = x.groupBy("document_id").agg(F.sort_array(F.collect_list(cursor)).alias("cs"))
    start = F.struct(F.lit(0).alias("at"), F.slice("cs", 1, 0).alias("groups"))

    def follow(acc, c):
        on = c["pos"] == acc["at"]
        return F.struct(F.when(on, c["next"]).otherwise(acc["at"]).alias("at"), F.when(on, F.concat(acc["groups"], F.array(c))).otherwise(acc["groups"]).alias("groups"))

    numbers = F.transform("cs", lambda c: c["page_number"])
    groups = docs.select("document_id", numbers.alias("numbers"), F.posexplode(F.aggregate("cs", start, follow, lambda a: a["groups"])).alias("group_index", "c"))
    pages_of = F.posexplode(F.slice("numbers", F.col("c.start") + 1, F.col("c.next") - F.col("c.start"))).alias("k", "page_number")
    out = groups.select("document_id", "group_index", "c", pages_of)
    return out.select(
        "document_id",
        F.col("group_index").cast("int").alias("group_index"),
        "page_number",
        ((F.col("group_index") > 0) & (F.col("c.start") + F.col("k") < F.col("c.pos"))).alias("is_overlap"),
        ((F.col("group_index") > 0) & F.coalesce(F.col("c.was_mid"), F.lit(False))).alias("continues_table"),
        F.col("c.dropped").alias("overlap_dropped"),
    )


def group_sizes(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, group_index, n_pages, n_new, n_chars, first_page, last_page, continues_table."""
    joined = groups.join(pages.select("document_id", "page_number", "n_chars"), ["document_id", "page_number"])
    return joined.groupBy("document_id", "group_index").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count(F.when(~F.col("is_overlap"), 1)).alias("n_new"),
        F.sum("n_chars").alias("n_chars"),
        F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
        F.bool_or("continues_table").alias("continues_table"),
    )
