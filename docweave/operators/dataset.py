"""Training examples: what a model should answer for each group of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def field_targets(gold: DataFrame, evidence: DataFrame, group_pages: DataFrame, continuing: DataFrame) -> DataFrame:
    """document_id, group_index, key, value: keys whose evidence stands in the group and that no earlier group settled.

    gold (document_id, key, value), evidence (document_id, key, page_number), continuing (key): fields that are
    given again in every group that shows them. A document without any evidence gives all keys to its first group.
    """
    shown = evidence.join(group_pages.select("document_id", "group_index", "page_number"), ["document_id", "page_number"]).select("document_id", "group_index", "key").distinct()
    bare = gold.join(evidence.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit(0).alias("group_index"), "key")
    where = shown.unionByName(bare).join(F.broadcast(continuing.withColumn("_goes_on", F.lit(True))), "key", "left")
    first = F.min("group_index").over(Window.partitionBy("document_id", "key"))
    kept = where.withColumn("_first", first).where(F.col("_goes_on").isNotNull() | (F.col("group_index") == F.col("_first")))
    return kept.join(gold.where("value is not null and value <> ''"), ["document_id", "key"]).select("document_id", "group_index", "key", "value")


def row_targets(rows: DataFrame, group_pages: DataFrame) -> DataFrame:
    """document_id, group_index, table_name, row_indices, is_open: gold rows (document_id, table_name, row_index, page_number)
    by the groups that show their page; open if a row stands beyond the group's last page."""
    last = group_pages.groupBy("document_id", "group_index").agg(F.max("page_number").alias("last_page"))
    final = rows.groupBy("document_id", "table_name").agg(F.max("page_number").alias("final_page"))
    x = rows.join(group_pages.select("document_id", "group_index", "page_number"), ["document_id", "page_number"])
    x = x.groupBy("document_id", "group_index", "table_name").agg(F.sort_array(F.collect_set("row_index")).alias("row_indices"))
    return x.join(last, ["document_id", "group_index"]).join(final, ["document_id", "table_name"]).select("document_id", "group_index", "table_name", "row_indices", (F.col("final_page") > F.col("last_page")).alias("is_open"))


def sample_empty(groups: DataFrame, targets: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Groups without a target, at most share of a document's groups, chosen by hash."""
    empty = groups.join(targets.select("document_id", "group_index").distinct(), ["document_id", "group_index"], "left_anti")
    quota = groups.groupBy("document_id").agg(F.floor(F.count(F.lit(1)) * share).alias("quota"))
    r = F.row_number().over(Window.partitionBy("document_id").orderBy(F.xxhash64(F.lit(seed), "document_id", "group_index")))
    return empty.withColumn("_r", r).join(quota, "document_id").where("_r <= quota").select(groups.columns)


def split(documents: DataFrame, validation: float = 0.1, seed: int = 0) -> DataFrame:
    """documents with part ('train' or 'validation'), the same for all rows of a document."""
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("document_id").cast("string"))), 1, 8), 16, 10).cast("long") / (1 << 32)
    return documents.withColumn("part", F.when(share < validation, "validation").otherwise("train"))


def chat(turns: DataFrame) -> DataFrame:
    """conv_id, messages: turns (conv_id, turn, role, text) as an ordered array of role and content."""
    x = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return x.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
