"""Benchmark decontamination by winnowing, in DataFrame functions alone.

The GRAM-word grams of a text are hashed. Of the grams in each span of WINDOW words the least hash is kept, with
its place; neighbouring spans often keep the same one, so about half of the places are left. Equal spans keep
equal hashes, so joining those of texts and items misses no shared span of WINDOW words or more. A hash that is
found is extended to the spans that kept it, and the spans' words are compared. The words of matching spans are
merged per document. Items shorter than WINDOW are one span of their own length.

The items' side of the join is broadcast only if it has few rows (they are counted first); then texts are read
once and stay where they are. Otherwise hashes and places alone are shuffled, and only texts with a hit are
fetched again. Each distinct length below WINDOW among the items costs one more pass.

Cases: null and wordless texts have no words and no hits; null and wordless items match nothing; an empty table
of items gives no hits, an empty table of documents no rows; items that repeat an item_id count together; equal
least hashes in one span are all kept; documents are known by doc_id and the hash of their text, rows alike in
both get one result each; very long texts are cut into places, a row for each, of bounded size where they are
shuffled; further columns stay outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
GRAM = 8
#: Up to so many rows (about 100 bytes each) the items' spans are broadcast.
BROADCAST_ROWS = 100_000
#: What is neither a digit, a lower-case letter nor beyond ASCII parts words (fixed by contract).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(common.ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "), " "), "")


def gram_hash(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(F.col(array), at + i) for i in range(size)))


def span_hash(array: str, size: int) -> Column:
    """The least gram hash of an array that is one span."""
    gram = min(GRAM, size)
    grams = [gram_hash(array, F.lit(i), gram) for i in range(size - gram + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def winnowed(rows: DataFrame, size: int, whole: bool = False) -> DataFrame:
    """Of rows with the array w: at (from 0), every place where a span of that size begins, and mark, its least gram hash,
    null where the span keeps the same gram as the one before. whole: each row comes once more, with at -1 and no mark.

    A gram is kept by no more spans than it has room in, so what kept it begins at `at` or up to size - GRAM later.
    """
    gram, at = min(GRAM, size), F.col("at")
    last = F.size("w") - size
    if whole:
        placed = rows.withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), last))))
    else:
        placed = rows.where(F.size("w") >= size).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    grams = [gram_hash("w", at + j, gram) for j in range(-1, size - gram + 1)]
    own = F.least(*grams[1:]) if len(grams) > 2 else grams[1]
    keep = at >= 0
    if len(grams) > 2:  # another gram than before, or the one that has just come in (the same words can stand there again)
        keep = keep & ((at == 0) | (own != F.least(*grams[:-1])) | (own == grams[-1]))
    return placed.withColumn("mark", F.when(keep, own))


def kept_by(size: int) -> Column:
    """The spans that may have kept the gram that was new at `at`; -1 stays alone."""
    end = F.least(F.col("at") + (size - min(GRAM, size)), F.size("w") - size)
    return F.sequence(F.col("at"), F.when(F.col("at") < 0, F.col("at")).otherwise(end))


def span_text(at: Column, size: int) -> Column:
    return F.concat_ws(" ", F.slice("w", at + 1, size))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs (doc_id, text), by items (item_id, text): doc_id, text_hash long, n_words long,
    n_hit long, items array<string> (sorted ids of the items found). Hit words lie inside a matching span."""
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = F.least(F.size("w"), F.lit(window))
    # The spans of the items, each with the items that hold it.
    sized = listed.select("item_id", "w", own.alias("size"))
    span = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size")))
    known = sized.select("item_id", "w", "size", span.alias("at")).select("item_id", "size", F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("size"))).alias("span"))
    known = known.groupBy("size", "span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    known = common.materialise(known, "spans")
    counts = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}  # a row for each length up to window
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    found = None
    for size in sorted({window, *counts}, reverse=True):
        n = counts.get(size, 0)
        mine = known.where(F.col("size") == size)
        marks = mine.select(F.split("span", " ").alias("w")).select(span_hash("w", size).alias("mark")).distinct()
        every = size == window  # this pass also gives every document's row (at -1)
        if n <= BROADCAST_ROWS:
            places = winnowed(base, size, whole=every)
            hit = places.join(F.broadcast(marks.withColumn("is_known", F.lit(True))), "mark", "left").where("at = -1 or is_known")
            hit = hit.withColumn("at", F.explode(kept_by(size)))
        else:
            key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("doc_id", "text_hash")]
            places = winnowed(base, size).drop("w").join(marks, "mark", "left_semi")
            places = places.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(F.collect_set("at").alias("starts"))
            hit = base.join(places, key, "left" if every else "inner")
            at = F.concat(F.array(F.lit(-1)), F.coalesce("starts", F.array().cast("array<int>"))) if every else F.col("starts")
            hit = hit.withColumn("at", F.explode(at)).withColumn("at", F.explode(kept_by(size)))
        hit = hit.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "at", F.when(F.col("at") >= 0, span_text(F.col("at"), size)).alias("span"))
        now = hit.join(few(mine, n), "span", "left").where("at = -1 or size is not null").select("doc_id", "text_hash", "n_words", "at", "size", "items")
        found = found.unionByName(now) if found is not None else now
    return merged(found)


def merged(found: DataFrame) -> DataFrame:
    """Merges the spans (at, size, items) found in each document; at -1 stands for the document itself."""
    hits = F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("size")).alias("end")))
    copies = F.count(F.when(F.col("at") == -1, 1))
    docs = found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), copies.alias("copies"), F.collect_set(hits).alias("hits"), F.collect_set("items").alias("sets"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))
    n_hit = F.aggregate(F.sort_array("hits"), start, step, lambda acc: acc["n"].cast("long"))
    items = F.sort_array(F.array_distinct(F.flatten("sets")))
    rows = docs.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), items.alias("items"), "copies")
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS span
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, s, array_to_string(w[s + 1 : s + k], ' ') AS span
  FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM w, sizes WHERE len(w) >= k)),
hit AS (SELECT r, dw.k, s, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.span = bw.span),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
