"""The retraining steps as tables: checks and order by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, what it depends on
STEPS = [("ingest", []), ("build_dataset", ["ingest"]), ("train", ["build_dataset"]), ("evaluate", ["train"]), ("gate", ["evaluate"]), ("register", ["gate"]), ("deploy", ["register"])]


def steps(spark: SparkSession, rows: list = STEPS) -> DataFrame:
    return spark.createDataFrame(rows, "name string, depends_on array<string>")


def unresolved(plan: DataFrame) -> DataFrame:
    """name, dependency: dependencies that are no step."""
    edges = plan.select("name", F.explode("depends_on").alias("dependency"))
    return edges.join(plan.select(F.col("name").alias("dependency")), "dependency", "left_anti").select("name", "dependency")


def reachable(plan: DataFrame) -> DataFrame:
    """name, level: steps that follow from those without dependencies, by the longest way. Steps on a cycle are not in it."""
    view = f"steps_{abs(hash(plan)) % 10**9}"
    plan.createOrReplaceTempView(view)
    return plan.sparkSession.sql(f"""
        WITH RECURSIVE edges AS (SELECT name, explode(depends_on) AS dep FROM {view}),
        walk(name, level) AS (
          SELECT name, 0 FROM {view} WHERE size(depends_on) = 0
          UNION ALL SELECT e.name, w.level + 1 FROM walk w JOIN edges e ON e.dep = w.name WHERE w.level < 99)
        SELECT name, max(level) AS level FROM walk GROUP BY name""")
