"""Command line, for spark-submit: python -m docweave.cli VERB ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import grouping, layout, retrieval
from .plans import dag, extraction, schemas
from .plans.config import PROFILES, RunConfig, from_environment, load
from .sources import documents as D


def settings(args) -> RunConfig:
    base = load(args.config) if args.config else PROFILES[args.profile]
    return from_environment(base).overlay({"schema": args.schema})


def read_blocks(spark, path: str):
    """By suffix: PDF text layers, else JSON documents in reading order."""
    if path.endswith(".pdf"):
        from .sources.pdf import read_pdf

        return read_pdf(spark, path)
    return layout.reading_order(D.to_blocks(D.read_documents(spark, path)))


def extract(spark, args) -> int:
    out = extraction.run(read_blocks(spark, args.documents), settings(args))
    D.write_json(out["results"], args.out)
    return 0 if out["results"].agg(F.bool_and("is_valid").alias("ok")).first().ok else 1


def inspect(spark, args) -> int:
    """Groups of pages, and the best pages for each key."""
    schema = schemas.get(args.schema)
    blocks = read_blocks(spark, args.documents)
    pages = layout.page_texts(blocks).join(grouping.page_ends(blocks), ["document_id", "page_number"])
    grouping.group_sizes(grouping.group_pages(pages, settings(args).grouping), pages).orderBy("document_id", "group_index").show(200, False)
    retrieval.explain(pages, retrieval.query_terms(spark, *schema.queries())).orderBy("document_id", "field").show(200, False)
    return 0


def list_schemas(spark, args) -> int:
    schemas.available(spark).show(100, False)
    return 0


def plan(spark, args) -> int:
    steps = dag.steps(spark)
    dag.reachable(steps).orderBy("level").show(100, False)
    return 1 if dag.unresolved(steps).count() else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, run in (("extract", extract), ("inspect", inspect), ("schemas", list_schemas), ("plan", plan)):
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        if name in ("extract", "inspect"):
            p.add_argument("documents")
            p.add_argument("--schema", default="invoice")
            p.add_argument("--profile", default="balanced", choices=sorted(PROFILES))
            p.add_argument("--config")
        if name == "extract":
            p.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.appName("docweave").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
