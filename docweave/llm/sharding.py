"""Sharding by extendible hashing, in DataFrame functions alone.

A document's address is a hash of its doc_id. The directory is indexed by the address's first bits; only
a bucket over the byte limit is split on its next bit, until each bucket fits or holds one document.
Buckets are sized from a histogram of addresses that is finer than the final buckets; the splits
are then read off its prefix sums. Where a bucket of the histogram itself is too large, only its
documents get a finer histogram.

Documents of one address that are too large together (rows that repeat a doc_id) can't be split by bits.
They overflow into parts, numbered within each input partition, each within the limit. A partition that is read
again after an executor's loss gives the same rows the same parts; rows that are alike may change places.

Cases: a null or empty text has 0 bytes; null doc_ids share an address; a single document over the limit
is a shard of its own; an empty table gives no rows; further columns stay as they are, but for n_bytes,
depth, prefix and part, which are replaced.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LIMIT = 64 << 20
#: Of the query: small enough that its tables are split.
QUERY_LIMIT = 1 << 20
BITS = 60
#: Bits of the histogram beyond what shards of even size would need, and of each finer one.
FINER = 6
BROADCAST_ROWS = 200_000


def address(doc_id: Column) -> Column:
    """60 bits of md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int) -> Column:
    return F.shiftright(bits, BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def assign(docs: DataFrame, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes long, depth int, prefix long (the address's first `depth` bits) and part long: a shard is (depth, prefix, part)."""
    docs = docs.drop("n_bytes", "depth", "prefix", "part")
    columns = docs.columns
    sized = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "_address": address(F.col("doc_id"))})
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    deep = min(BITS, max(0, ceil(log2(max(1, total / limit)))) + FINER)
    left, maps = sized.select("_address", "n_bytes"), []
    while True:
        cells = common.materialise(left.groupBy(prefix(F.col("_address"), deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("many")), "cells")
        paths = cells.select("cell", "bytes", "many", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("d"))
        paths = paths.withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("d")).cast("int")))
        sums = paths.groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.sum("many").alias("many")).where((F.col("bytes") <= limit) | (F.col("many") <= 1))
        # Below a cell that an earlier histogram found too large, sums hold that cell's documents alone, as they should.
        floor = maps[-1][0] if maps else -1
        leaves = paths.where(F.col("d") > floor).select("cell", "d", "p").join(sums.select("d", "p"), ["d", "p"]).groupBy("cell").agg(F.min("d").alias("depth"))
        found = common.materialise(cells.select("cell").join(leaves, "cell", "left"), "leaves")
        n, missing = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("depth").isNull(), 1))).first()
        maps.append((deep, found, n))
        if not missing or deep >= BITS:
            break
        full = found.where("depth is null").select(F.col("cell").alias("_cell"))
        left = left.join(F.broadcast(full) if missing <= BROADCAST_ROWS else full, prefix(F.col("_address"), deep) == F.col("_cell"), "left_semi")
        deep = min(BITS, deep + 2 * FINER)
    out = sized
    for i, (bits, found, n) in enumerate(maps):
        side = found.select(F.col("cell").alias("_cell"), F.col("depth").alias(f"_d{i}"))
        out = out.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, prefix(F.col("_address"), bits) == F.col("_cell"), "left").drop("_cell")
    depth = F.coalesce(*(F.col(f"_d{i}") for i in range(len(maps))), F.lit(BITS)).cast("int")
    out = out.withColumn("depth", depth).withColumn("prefix", prefix(F.col("_address"), F.col("depth")))
    if maps[-1][0] >= BITS and missing:
        over = F.coalesce(*(F.col(f"_d{i}") for i in range(len(maps)))).isNull()
        here = Window.partitionBy("_address", "_piece").orderBy("n_bytes", text)
        rest = out.where(over).withColumn("_piece", F.spark_partition_id())
        # Two neighbours in a chunk of half the limit each can't pass the limit.
        rest = rest.withColumn("_before", F.sum("n_bytes").over(here.rowsBetween(Window.unboundedPreceding, -1)))
        chunk = F.floor(F.coalesce("_before", F.lit(0)) / F.greatest(F.lit(1), F.lit(limit) - F.max("n_bytes").over(Window.partitionBy("_address", "_piece"))))
        rest = rest.withColumn("part", F.col("_piece").cast("long") * 100_000 + chunk + 1)
        out = out.where(~over).withColumn("part", F.lit(0).cast("long")).unionByName(rest.drop("_piece", "_before"))
    else:
        out = out.withColumn("part", F.lit(0).cast("long"))
    return out.select(*columns, "n_bytes", "depth", "prefix", "part")


def name(depth: str = "depth", bits: str = "prefix") -> Column:
    """The shard's name: its bits, 'all' for the bucket of every document."""
    return F.when(F.col(depth) == 0, "all").otherwise(F.expr(f"lpad(bin({bits}), {depth}, '0')"))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes each shard as a folder shard=.../part=... of Parquet."""
    out = assign(docs, limit).withColumn("shard", name())
    out.repartition("shard", "part").write.partitionBy("shard", "part").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, QUERY_LIMIT).select("doc_id", name().alias("shard"), F.col("depth").cast("long").alias("depth"), "n_bytes", "part")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS a
  FROM documents),
s AS (
  SELECT k, a >> ({BITS} - k) AS p, sum(n_bytes) AS bytes, count(*) AS many
  FROM d, (SELECT CAST(unnest(range(0, {BITS} + 1)) AS BIGINT) AS k) GROUP BY ALL),
leaf AS (
  SELECT d.a, min(s.k) AS depth FROM (SELECT DISTINCT a FROM d) d JOIN s ON d.a >> ({BITS} - s.k) = s.p
  WHERE s.bytes <= {QUERY_LIMIT} OR s.many <= 1 GROUP BY d.a)
SELECT doc_id, CASE WHEN depth = 0 THEN 'all' ELSE lpad(ltrim(bin(a >> ({BITS} - depth)), '0'), CAST(depth AS INTEGER), '0') END AS shard,
  CAST(depth AS BIGINT) AS depth, n_bytes, CAST(0 AS BIGINT) AS part
FROM d JOIN leaf USING (a)
"""
