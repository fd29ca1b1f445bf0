"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

Every three consecutive lines of a text are hashed (128 bits). Of a window that stands in several places
the first one, by doc_id and then by place, stays; the lines that later ones cover are removed, each
line once however many windows cover it. Windows of three blank lines don't count.

Cases: null texts stay null and have no lines; texts of fewer than three lines have no window and stay
as they are; a text whose lines are all covered becomes empty; rows alike in doc_id and text are one
document and get one result each; null doc_ids come first; further columns stay as they are, but for
n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 3
#: Of windows in more than 1/HOT of all places there can be at most HOT.
HOT = 500


def _places(docs: DataFrame, text: str, window: int) -> DataFrame:
    """doc_id, text_hash, at, h1, h2 of every window that isn't blank."""
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(F.col(text), "\n").alias("lines"))
    at = lines.where(F.size("lines") >= window).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("lines") - window)))
    line = [F.get("lines", F.col("at") + i) for i in range(window)]
    blank = F.trim(F.concat(*line)) == ""
    return at.where(~blank).select("doc_id", "text_hash", "at", F.xxhash64(*line).alias("h1"), F.xxhash64(F.lit(window), *line).alias("h2"))


def _join_hot(places: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """places with what repeated says of their window. Windows that hold more than 1/HOT of all places, at most HOT, go by
    broadcast: their places stay where they are."""
    hot = F.broadcast(repeated.where(F.col("many") * HOT > total))
    rare = places.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(repeated.where(F.col("many") * HOT <= total), ["h1", "h2"])
    return rare.unionByName(places.join(hot, ["h1", "h2"]))


def dedup_lines(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the text that is left, n_lines long (before) and n_removed long.

    Shuffles: hashes of windows twice (the first time pre-aggregated), texts once.
    """
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    places = _places(docs, text, window)
    total = places.count()
    place = F.struct("doc_id", "text_hash", "at")
    repeated = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    later = _join_hot(places, repeated, total).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("at").alias("_at"))
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    joined = docs.join(gone, key, "left")
    lines = F.split(F.col(text), "\n")
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.sequence(a, a + window - 1))))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_covered"))
    left = F.transform(stay, lambda i: F.get(lines, i))
    out = joined.withColumn("_covered", covered)
    done: Column = F.when(F.col("_at").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    out = out.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("_at").isNull(), 0).otherwise(F.size("_covered")).cast("long"),
        text: done,
    })
    return out.select(*columns, "n_lines", "n_removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM l WHERE len(lines) >= 3)),
n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w WHERE trim(a || b || c, ' ') <> ''),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM n WHERE k > 1),
every AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM l WHERE text IS NOT NULL),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone.pos IS NOT NULL) AS n_removed,
    string_agg(line, chr(10) ORDER BY every.pos) FILTER (WHERE gone.pos IS NULL) AS text
  FROM every LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM l LEFT JOIN kept USING (doc_id)
"""
