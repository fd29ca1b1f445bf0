"""Scores of predictions against gold: counts by key, ratios derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def score_scalars(predicted: DataFrame, gold: DataFrame, kind: str = "string") -> DataFrame:
    """document_id, key, tp, fp, fn; a wrong value costs both fp and fn. Both sides: document_id, key, value."""
    p = predicted.where(~X.is_empty("value")).select("document_id", "key", F.col("value").alias("p"))
    g = gold.where(~X.is_empty("value")).select("document_id", "key", F.col("value").alias("g"))
    x = p.join(g, ["document_id", "key"], "full_outer")
    hit = F.col("p").isNotNull() & F.col("g").isNotNull() & X.values_match("p", "g", kind)
    return x.select("document_id", "key", hit.cast("long").alias("tp"), (F.col("p").isNotNull() & ~hit).cast("long").alias("fp"), (F.col("g").isNotNull() & ~hit).cast("long").alias("fn"))


def score_bags(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """document_id, key, tp, fp, fn of lists and of table rows (their signature as item): matches are the bags' intersection.

    Both sides: document_id, key, item (in normal form).
    """
    count = lambda df, n: df.groupBy("document_id", "key", "item").agg(F.count(F.lit(1)).alias(n))
    x = count(predicted, "p").join(count(gold, "g"), ["document_id", "key", "item"], "full_outer").na.fill(0, ["p", "g"])
    tp = F.least("p", "g")
    return x.groupBy("document_id", "key").agg(F.sum(tp).alias("tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


def key_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By key: tp, fp, fn, precision, recall, f1, support. Shards add up, so partial results may be given again."""
    x = scores.groupBy(*(by or []), "key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    x = x.withColumns({"precision": p, "recall": r, "support": F.col("tp") + F.col("fn")})
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """weighted_f1 (by support), macro_f1 (over keys with support), micro_f1 (from summed counts)."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    weighted = ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    macro = F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0))
    return keys.groupBy(*(by or [])).agg(weighted.alias("weighted_f1"), macro.alias("macro_f1"), ratio(2 * p * r, p + r).alias("micro_f1"), F.sum("support").alias("support"))


def cross_page(keys: DataFrame, gold_pages: DataFrame, cumulative: bool = False) -> DataFrame:
    """eligible, correct, accuracy over keys whose gold evidence stands on two or more pages.

    keys: document_id, key, correct (fields: the values match; tables: equal numbers of rows), fn. A key is right
    without misses in its document; `cumulative`: without misses in its and all earlier documents.
    """
    wide = gold_pages.groupBy("document_id", "key").agg(F.count_distinct("page_number").alias("n")).where("n >= 2")
    fn = F.col("fn")
    if cumulative:
        totals = keys.groupBy("key", "document_id").agg(F.sum("fn").alias("d"))
        totals = totals.withColumn("fn_all", F.sum("d").over(Window.partitionBy("key").orderBy("document_id"))).select("key", "document_id", "fn_all")
        keys, fn = keys.join(totals, ["key", "document_id"]), F.col("fn_all")
    x = keys.join(wide.select("document_id", "key"), ["document_id", "key"], "left_semi")
    good = F.count(F.when(F.col("correct") & (fn == 0), 1))
    return x.agg(F.count(F.lit(1)).alias("eligible"), good.alias("correct"), ratio(good, F.count(F.lit(1))).alias("accuracy"))


def corpus_rates(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of results (is_valid, n_claims, n_verified, pages_read, pages_total, seconds): the corpus's rates."""
    n = F.count(F.lit(1))
    return results.groupBy(*(by or [])).agg(
        n.alias("documents"),
        ratio(F.count(F.when(F.col("is_valid"), 1)), n).alias("schema_valid_rate"),
        ratio(F.sum("n_verified"), F.sum("n_claims")).alias("citation_precision"),
        ratio(F.sum("pages_read"), F.sum("pages_total")).alias("pages_read_fraction"),
        ratio(F.sum("seconds"), n).alias("seconds_per_document"),
    )
