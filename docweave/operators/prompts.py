"""Prompts for model backends, as text columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import Schema

TASK = "Read the pages below and answer with one JSON object. Give only values that the pages show, each with the id of its block."
REPAIR_CHARS = 4000


def schema_text(schema: Schema) -> str:
    lines = [f"Target {schema.name} {schema.version}"]
    lines += [f"- {f.name} ({f.type}{', list' if f.many else ''}{', required' if f.required else ''})" + (f": one of {', '.join(f.enums)}" if f.enums else "") for f in schema.fields]
    lines += [f"- table {t.name}: {', '.join(c.name for c in t.columns)}" for t in schema.tables]
    return "\n".join(lines)


def build(layouts: DataFrame, schema: Schema, carry: DataFrame | None = None) -> DataFrame:
    """layouts (document_id, group_index, layout) with prompt: target, what is settled, pages, form of the answer."""
    x = layouts if carry is None else layouts.join(carry.select("document_id", "carry"), "document_id", "left")
    settled = F.lit("") if carry is None else F.when(F.coalesce("carry", F.lit("")) != "", F.concat(F.lit("Known so far:\n"), F.col("carry"))).otherwise("")
    form = json.dumps(schema.envelope_schema(), sort_keys=True)
    parts = F.array(F.lit(TASK), F.lit(schema_text(schema)), settled, F.col("layout"), F.lit(f"Answer in this form: {form}"))
    return x.withColumn("prompt", F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")).drop("carry")


def repair(prompt: Column, answer: Column, error: Column) -> Column:
    """The prompt of a second attempt: what went wrong and the beginning of the first answer."""
    return F.concat_ws("\n\n", prompt, F.concat(F.lit("The last answer could not be used: "), error), F.substring(answer, 1, REPAIR_CHARS))
