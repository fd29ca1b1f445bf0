"""Corpus evaluation: run a profile, score it against gold, compare profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics
from . import extraction
from .config import PROFILES, RunConfig
from .schemas import Schema, get


def row_signature(cells: Column, schema: Schema, table: str) -> Column:
    """A row's cells in normal form, in the table's order of columns."""
    parts = []
    for c in schema.table(table).columns:
        v = cells[c.name]
        if c.type == "currency":
            form = X.money_form(v).cast("string")
        elif c.type == "date":
            form = X.date_form(v).cast("string")
        elif c.type in ("number", "integer"):
            form = F.regexp_replace(v, ",", "").try_cast("double").cast("string")
        else:
            form = X.normal(v)
        parts.append(F.coalesce(form, F.lit("")))
    return F.concat_ws("\x1f", *parts)


def evaluate(blocks: DataFrame, gold_fields: DataFrame, config: RunConfig, gold_rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """gold_fields (document_id, key, value), gold_rows (document_id, table_name, cells): tables keys, summary, rates, run."""
    schema = get(config.schema)
    run = extraction.run(blocks, config, schema)
    predicted = run["fields"].select("document_id", "key", F.explode("values").alias("value"))
    scores = []
    for kind in sorted({f.type for f in schema.fields if not f.many}):
        names = [f.name for f in schema.fields if f.type == kind and not f.many]
        mine = lambda df, names=names: df.where(F.col("key").isin(names))
        scores.append(metrics.score_scalars(mine(predicted), mine(gold_fields), kind))
    many = [f.name for f in schema.fields if f.many]
    bag = lambda df: df.where(F.col("key").isin(many)).select("document_id", "key", X.normal("value").alias("item"))
    if many:
        scores.append(metrics.score_bags(bag(predicted), bag(gold_fields)))
    if gold_rows is not None and "rows" in run:
        name = schema.tables[0].name
        sign = lambda df: df.where(F.col("table_name") == name).select("document_id", F.lit(name).alias("key"), row_signature(F.col("cells"), schema, name).alias("item"))
        scores.append(metrics.score_bags(sign(run["rows"]), sign(gold_rows)))
    keys = metrics.key_scores(reduce(DataFrame.unionByName, scores))
    claims = run["attributed"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count(F.when(F.col("status") != "unverified", 1)).alias("n_verified"))
    pages = blocks.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages_total"))
    results = run["results"].join(claims, "document_id", "left").join(pages, "document_id").na.fill(0, ["n_claims", "n_verified", "pages_read"]).withColumn("seconds", F.lit(0.0))
    return {"keys": keys, "summary": metrics.summary(keys), "rates": metrics.corpus_rates(results), "run": run["results"]}


def sweep(blocks: DataFrame, gold_fields: DataFrame, schema: str = "invoice", profiles: dict | None = None) -> DataFrame:
    """profile, weighted_f1, schema_valid_rate, citation_precision, pages_read_fraction: a row for each profile."""
    out = []
    for name, config in (profiles or PROFILES).items():
        r = evaluate(blocks, gold_fields, config.overlay({"schema": schema}))
        one = r["summary"].select("weighted_f1").crossJoin(r["rates"].select("schema_valid_rate", "citation_precision", "pages_read_fraction"))  # one row each
        out.append(one.select(F.lit(name).alias("profile"), "*"))
    return reduce(DataFrame.unionByName, out)
