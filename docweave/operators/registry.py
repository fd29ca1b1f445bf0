"""Model cards, the promotion gate and the cards' life cycle.

cards(model_id, schema, stage, created_at, corpus_size, corpus_fingerprint, metrics map, per_key map).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    primary: str = "weighted_f1"
    min_improvement: float = 0.005
    guarded: tuple = ("schema_valid_rate", "citation_precision")
    tolerance: float = 0.01
    per_key_tolerance: float = 0.05
    floors: dict = field(default_factory=lambda: {"schema_valid_rate": 0.95, "citation_precision": 0.90})
    min_corpus: int = 25
    same_corpus: bool = True


DEFAULT = Gate()
STRICT = Gate(min_improvement=0.01, tolerance=0.005, per_key_tolerance=0.02)
PERMISSIVE = Gate(min_improvement=0.001, tolerance=0.03, per_key_tolerance=0.10)


def fingerprint(documents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """16 hex digits of sha256 over the sorted distinct document ids, each closed by NUL."""
    ids = F.sort_array(F.collect_set(F.col("document_id").cast("string")))
    text = F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit("\0"))), "")
    return documents.groupBy(*(by or [])).agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def _metric(name: str, prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}metrics")[name], F.lit(0.0))


def gate_checks(candidates: DataFrame, champions: DataFrame, gate: Gate = DEFAULT) -> DataFrame:
    """candidate_id, champion_id, check_name, passed, blocking: a row for each check of each candidate against its schema's champion."""
    ch = champions.select("schema", *(F.col(c).alias(f"ch_{c}") for c in ("model_id", "corpus_fingerprint", "metrics", "per_key")))
    x = candidates.join(ch, "schema", "left")
    old = F.col("ch_model_id").isNotNull()
    delta = _metric(gate.primary) - _metric(gate.primary, "ch_")
    before = F.map_entries("ch_per_key")
    worse = F.exists(before, lambda e: F.col("per_key")[e["key"]].isNotNull() & (e["value"] - F.col("per_key")[e["key"]] > gate.per_key_tolerance))
    untested = F.exists(before, lambda e: F.col("per_key")[e["key"]].isNull())
    always, never = F.lit(True), F.lit(False)
    checks = [(always, "corpus_size", F.col("corpus_size") >= gate.min_corpus, True)]
    checks += [(always, f"floor:{n}", _metric(n) >= v, True) for n, v in sorted(gate.floors.items())]
    checks += [(~old, "baseline", always, True)]
    if gate.same_corpus:
        checks.append((old, "same_corpus", F.col("corpus_fingerprint") == F.col("ch_corpus_fingerprint"), True))
    checks.append((old, f"improvement:{gate.primary}", delta >= gate.min_improvement, True))
    checks += [(old, f"guard:{n}", _metric(n, "ch_") - _metric(n) <= gate.tolerance, True) for n in gate.guarded]
    checks += [(old, "per_key_regression", ~worse, True), (old & untested, "key_coverage", never, False)]
    rows = F.filter(F.array(*(F.when(applies, F.struct(F.lit(i).alias("n"), F.lit(name).alias("check_name"), passed.alias("passed"), F.lit(blocks).alias("blocking"))) for i, (applies, name, passed, blocks) in enumerate(checks))), lambda c: c.isNotNull())
    return x.select(F.col("model_id").alias("candidate_id"), F.col("ch_model_id").alias("champion_id"), F.explode(rows).alias("c")).select("candidate_id", "champion_id", "c.*")


def decisions(checks: DataFrame) -> DataFrame:
    """candidate_id, champion_id, promote: all blocking checks pass."""
    return checks.groupBy("candidate_id", "champion_id").agg(F.bool_and(F.col("passed") | ~F.col("blocking")).alias("promote"))


def regressions(candidate: DataFrame, champion: DataFrame, tolerance: float) -> DataFrame:
    """key, before, after of keys that fell by more than the tolerance (both sides: key, f1)."""
    x = champion.select("key", F.col("f1").alias("before")).join(candidate.select("key", F.col("f1").alias("after")), "key")
    return x.where(F.col("before") - F.col("after") > tolerance)


def untested(candidate: DataFrame, champion: DataFrame) -> DataFrame:
    return champion.select("key").join(candidate.select("key"), "key", "left_anti")


def champion(cards: DataFrame, stage: str = "production") -> DataFrame:
    """The newest card of the stage for each schema."""
    best = cards.where(F.col("stage") == stage).groupBy("schema").agg(F.max_by(F.struct(*cards.columns), F.struct("created_at", "model_id")).alias("c"))
    return best.select("c.*")


def set_stage(cards: DataFrame, model_id: str, stage: str) -> DataFrame:
    return cards.withColumn("stage", F.when(F.col("model_id") == model_id, stage).otherwise(F.col("stage")))


def promote(cards: DataFrame, decided: DataFrame, force: bool = False) -> DataFrame:
    """cards after the decisions: promoted candidates serve, the schema's champion before them is archived."""
    ok = decided.where(F.lit(force) | F.col("promote")).select(F.col("candidate_id").alias("model_id"), F.lit(True).alias("_up"))
    up = cards.join(ok, "model_id", "left")
    schemas = up.where("_up").select("schema").distinct().withColumn("_moved", F.lit(True))
    up = up.join(schemas, "schema", "left")
    stage = F.when(F.col("_up"), "production").when(F.col("_moved") & (F.col("stage") == "production"), "archived").otherwise(F.col("stage"))
    return up.withColumn("stage", stage).select(cards.columns)


def rollback(cards: DataFrame) -> DataFrame:
    """For each schema the archived card that was created last serves again, the serving one is archived."""
    target = cards.where("stage = 'archived'").groupBy("schema").agg(F.max_by("model_id", F.struct("created_at", "model_id")).alias("_target"))
    x = cards.join(target, "schema", "left")
    stage = F.when(F.col("model_id") == F.col("_target"), "production").when((F.col("stage") == "production") & F.col("_target").isNotNull(), "archived").otherwise(F.col("stage"))
    return x.withColumn("stage", stage).select(cards.columns)


def update_required(current: Column, latest: Column) -> Column:
    """A release feed's current version (0.0.0 if unset) differs from its latest."""
    return ~F.coalesce(current, F.lit("0.0.0")).eqNullSafe(latest)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
