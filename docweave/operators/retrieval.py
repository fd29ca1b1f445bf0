"""Which pages matter for which field: BM25 within a document, plus a prior by place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B = 1.5, 0.75
MATCH = 0.55


def query_terms(spark: SparkSession, queries: dict[str, str], hints: dict[str, str] | None = None) -> DataFrame:
    """field, region, token, qtf; a row for each token of a field's query, a few hundred for any schema."""
    rows = []
    for name, words in queries.items():
        counts: dict[str, int] = {}
        for w in re.findall("[a-z0-9]+", words.lower()):
            if w not in X.STOP_WORDS:
                counts[w] = counts.get(w, 0) + 1
        rows += [(name, (hints or {}).get(name), w, n) for w, n in counts.items()]
    return spark.createDataFrame(rows, "field string, region string, token string, qtf long")


def term_stats(pages: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (document_id, page_number, token, tf, df) and page lengths (document_id, page_number, n_tokens, n_pages, mean_tokens);
    postings of all tokens, or of those of `words` (token), a short table: their numbers are the same, and the rest isn't counted."""
    tokens = pages.select("document_id", "page_number", X.tokens("text").alias("ts"))
    doc = Window.partitionBy("document_id")
    lengths = tokens.select("document_id", "page_number", F.size("ts").alias("n_tokens"), F.count(F.lit(1)).over(doc).alias("n_pages"), F.avg(F.size("ts")).over(doc).alias("mean_tokens"))
    every = tokens.select("document_id", "page_number", F.explode("ts").alias("token"))
    if words is not None:
        every = every.join(F.broadcast(words.select("token").distinct()), "token", "left_semi")
    tf = every.groupBy("document_id", "page_number", "token").agg(F.count(F.lit(1)).alias("tf"))
    return tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("document_id", "token"))), lengths


def bm25(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """document_id, page_number, field, lexical; pages that hold none of a field's words have no row."""
    postings, lengths = term_stats(pages, terms)
    x = postings.join(F.broadcast(terms), "token").join(lengths, ["document_id", "page_number"])
    idf = F.log(1 + (F.col("n_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean_tokens") > 0, F.col("mean_tokens")).otherwise(1.0)
    norm = F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("n_tokens"), F.lit(1)) / mean)
    score = F.sum(F.col("qtf") * idf * F.col("tf") * (K1 + 1) / norm)
    return x.groupBy("document_id", "page_number", "field").agg(score.alias("lexical")).where("lexical <> 0")


def prior(region: Column, page: Column, n_pages: Column) -> Column:
    """Of a page's place: for what stands in front, at the back or on every page."""
    p = (page - 1) / (n_pages - 1)
    value = F.when(region == "front", 1.5 * F.greatest(F.lit(0.0), 1 - 2.5 * p)).when(region == "back", 1.5 * F.greatest(F.lit(0.0), (p - 0.6) / 0.4)).when(region == "every", 0.25)
    return F.when(n_pages > 1, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def page_fields(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """document_id, page_number, field, lexical, contribution, matched; rows whose contribution is above 0."""
    fields = terms.select("field", "region").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("document_id"))
    # Every page with every field: the fields are those of one schema, so rows grow with the pages alone.
    grid = pages.select("document_id", "page_number", n.alias("n_pages")).join(F.broadcast(fields))
    x = grid.join(bm25(pages, terms), ["document_id", "page_number", "field"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    best = F.max("lexical").over(Window.partitionBy("document_id", "field"))
    x = x.withColumn("matched", (best > 0) & (F.col("lexical") >= MATCH * best))
    return x.withColumn("contribution", F.col("lexical") + prior(F.col("region"), F.col("page_number"), F.col("n_pages"))).where("contribution > 0")


def rank_pages(pages: DataFrame, terms: DataFrame, k: int | None = None) -> DataFrame:
    """document_id, page_number, score, matched_fields, rank: best first, of equal ones (to 9 decimals, as sums differ in their last bits) the earlier page."""
    scored = page_fields(pages, terms).groupBy("document_id", "page_number").agg(F.sum("contribution").alias("score"), F.sort_array(F.collect_set(F.when(F.col("matched"), F.col("field")))).alias("matched_fields"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.round("score", 9).desc(), "page_number")))
    return ranked.where(F.col("rank") <= k) if k else ranked


def rank_groups(groups: DataFrame, pages: DataFrame, terms: DataFrame) -> DataFrame:
    """document_id, group_index, score (mean over new pages, over all if none is new; pages without a score count 0), rank."""
    scored = groups.join(rank_pages(pages, terms).select("document_id", "page_number", "score"), ["document_id", "page_number"], "left")
    value = F.coalesce("score", F.lit(0.0))
    out = scored.groupBy("document_id", "group_index").agg(F.coalesce(F.avg(F.when(~F.col("is_overlap"), value)), F.avg(value)).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.round("score", 9).desc(), "group_index")))


def explain(pages: DataFrame, terms: DataFrame, k: int = 3) -> DataFrame:
    """document_id, field, pages: the k best pages of each field with their scores, as text."""
    top = Window.partitionBy("document_id", "field").orderBy(F.round("contribution", 9).desc(), "page_number")
    x = page_fields(pages, terms).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
    part = F.struct("r", F.format_string("p%d (%.2f)", "page_number", "contribution").alias("t"))
    return x.groupBy("document_id", "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), ", ").alias("pages"))
