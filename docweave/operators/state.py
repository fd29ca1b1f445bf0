"""What is known of a document after its groups, as window functions over observations.

observations(document_id, key, visit, value, confidence [, evidence array<string>]): visit orders them
within a document and key. The folds over visits have closed forms, so no row-at-a-time state is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

FIELD = ["document_id", "key"]


def scalar_steps(observations: DataFrame, continues: Column | None = None) -> DataFrame:
    """observations with norm, is_record (its confidence beats all before; equals, where the field continues
    across pages) and changed (a record with another value than the record before)."""
    order = Window.partitionBy(*FIELD).orderBy("visit")
    x = observations.where(~X.is_empty("value")).withColumns({"norm": X.key_form("value"), "prev_max": F.max("confidence").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    record = F.col("prev_max").isNull() | (F.col("confidence") > F.col("prev_max"))
    if continues is not None:
        record = record | (continues & (F.col("confidence") >= F.col("prev_max")))
    x = x.withColumn("is_record", record)
    last = F.last(F.when(F.col("is_record"), F.col("norm")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("changed", F.col("is_record") & (last.isNull() | (last != F.col("norm"))))


def merge_scalars(observations: DataFrame, continues: Column | None = None) -> DataFrame:
    """document_id, key, value, source_visit, confidence, revisions: the last change wins, with its spelling;
    later equal values raise confidence alone. One shuffle."""
    x = scalar_steps(observations, continues)
    winner = F.max_by(F.struct("value", "visit"), F.when(F.col("changed"), F.col("visit")))
    out = x.groupBy(*FIELD).agg(winner.alias("w"), F.max("confidence").alias("confidence"), (F.count(F.when(F.col("changed"), 1)) - 1).alias("revisions"))
    return out.select(*FIELD, F.col("w.value").alias("value"), F.col("w.visit").alias("source_visit"), "confidence", "revisions")


def merge_evidence(observations: DataFrame, continues: Column | None = None) -> DataFrame:
    """document_id, key, evidence: the winner's and that of later observations of the same value, once each, in order."""
    x = scalar_steps(observations, continues)
    field = Window.partitionBy(*FIELD)
    won = x.withColumn("_w", F.max(F.when(F.col("changed"), F.struct("visit", "norm"))).over(field))
    mine = won.where((F.col("visit") >= F.col("_w.visit")) & (F.col("norm") == F.col("_w.norm")))
    out = mine.groupBy(*FIELD).agg(F.sort_array(F.collect_list(F.struct("visit", "evidence"))).alias("e"))
    return out.select(*FIELD, F.array_distinct(F.flatten("e.evidence")).alias("evidence"))


def merge_lists(observations: DataFrame, limit: int | None = None) -> DataFrame:
    """document_id, key, items array, confidence, source_visit: first spelling of each value, in order of first
    sight; confidence and source come from visits that added something."""
    x = observations.where(~X.is_empty("value")).withColumn("norm", X.key_form("value"))
    first = x.withColumn("_r", F.row_number().over(Window.partitionBy(*FIELD, "norm").orderBy("visit"))).where("_r = 1")
    out = first.groupBy(*FIELD).agg(F.sort_array(F.collect_list(F.struct("visit", "value"))).alias("i"), F.max("confidence").alias("confidence"), F.max("visit").alias("source_visit"))
    return out.select(*FIELD, F.col("i.value").alias("items"), "confidence", "source_visit")


#: Columns of a row that say where it stands, not what it holds.
ABOUT_ROWS = frozenset("visit seq group_index page_number row_index table_name block_id confidence evidence".split())


def dedupe_rows(rows: DataFrame, owner: list[str], key: list[str], order: list[str | Column], cells: list[str] | None = None) -> DataFrame:
    """The first row of each key within its owner; rows whose keys are all null are never repeats; rows whose cells
    (by default all columns but the owner's and ABOUT_ROWS) are all null or '' go."""
    cells = cells or [c for c in rows.columns if c not in owner and c not in ABOUT_ROWS]
    blank = reduce(lambda a, b: a & b, (X.is_empty(F.col(c).cast("string")) for c in cells))
    r = F.row_number().over(Window.partitionBy(*owner, *key).orderBy(*order))
    keyless = reduce(lambda a, b: a & b, (F.col(k).isNull() for k in key))
    return rows.where(~blank).withColumn("_r", r).withColumn("_n", keyless).where("_r = 1 or _n").drop("_r", "_n")


def missing(owners: DataFrame, required: DataFrame, filled: DataFrame) -> DataFrame:
    """(document_id, key, position) of required keys without a value; required is a schema's short list."""
    return owners.select("document_id").join(F.broadcast(required)).join(filled.select("document_id", "key"), FIELD, "left_anti")


def coverage(owners: DataFrame, keys: DataFrame, filled: DataFrame) -> DataFrame:
    """document_id, n_filled, n_keys, coverage (1 if nothing is declared)."""
    declared = filled.join(F.broadcast(keys.select("key")), "key", "left_semi").select(*FIELD).distinct()
    n = keys.select("key").distinct().groupBy().agg(F.count(F.lit(1)).alias("n_keys"))  # one row
    got = declared.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_filled"))
    x = owners.select("document_id").join(got, "document_id", "left").join(F.broadcast(n))
    return x.select("document_id", F.coalesce("n_filled", F.lit(0)).alias("n_filled"), "n_keys", F.when(F.col("n_keys") > 0, F.coalesce("n_filled", F.lit(0)) / F.col("n_keys")).otherwise(1.0).alias("coverage"))


def mean_confidence(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id, mean_confidence over fields and all rows."""
    both = fields.select("document_id", "confidence").unionByName(rows.select("document_id", "confidence"))
    return both.groupBy("document_id").agg(F.avg("confidence").alias("mean_confidence"))


def streaks(visits: DataFrame) -> DataFrame:
    """Of visits (document_id, visit, changed): with streak, the visits since the last change, this one included."""
    order = Window.partitionBy("document_id").orderBy("visit")
    x = visits.withColumn("n", F.row_number().over(order))
    last = F.max(F.when(F.col("changed"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("streak", F.col("n") - F.coalesce(last, F.lit(0))).drop("n")


def carry_over(fields: DataFrame, rows: DataFrame, most: int = 1800, last_rows: int = 3) -> DataFrame:
    """document_id, carry: settled fields and each table's last rows as text of bounded length, for the next prompt."""
    f = fields.select("document_id", F.format_string("%s = %s", "key", F.substring("value", 1, 90)).alias("line"), F.lit(0).alias("o"))
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy("document_id", "table_name").orderBy(F.col("visit").desc(), F.col("seq").desc()))).where(F.col("_r") <= last_rows)
    r = r.select("document_id", F.format_string("%s: %s", "table_name", F.substring("row_text", 1, 90)).alias("line"), F.lit(1).alias("o"))
    x = f.unionByName(r).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("ls"))
    return x.select("document_id", F.substring(F.array_join(F.col("ls.line"), "\n"), 1, most).alias("carry"))
