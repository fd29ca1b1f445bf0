"""Queries over claims, observations and records: attribution, merging, early exit, validation, streaming."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import attribution, early_exit, envelope, state, validate
from ..sources import documents as D
from ..sources import scratch
from ..streaming import merge
from . import extraction
from .config import PROFILES
from .queries_layout import ORDER_BLOCKS, ROW_ORDER, one_group, order_blocks
from .registry_of_queries import query, table
from .schemas import INVOICE, STATEMENT

# --- the flagship: an order as an invoice record

FIRST_ROWS = f"dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ROW_ORDER}) AS r FROM lineitem) WHERE r = 1)"


def first_rows(spark, d):
    """Of lineitems with one (order, line number) the first: aggregated with map-side combine instead of sorted."""
    li = table(spark, d, "lineitem")
    order = [c for c in D.ROW_ORDER if c != "l_linenumber"]
    best = li.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*order)).alias("r"))
    return best.select("l_orderkey", "l_linenumber", "r.*")


@query(f"""WITH {FIRST_ROWS}, s AS (SELECT l_orderkey, count(*) AS n_rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS subtotal FROM dd GROUP BY 1)
SELECT o_orderkey AS document_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, c_name AS bill_to, 'USD' AS currency, n_rows, subtotal, o_totalprice AS total_amount
FROM orders JOIN s ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def invoice_record(spark, d):
    """Rows deduped by key, totals exact in DECIMAL, joined with head fields. Lineitem is shuffled once, by order."""
    sums = first_rows(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("subtotal"))
    head = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    x = head.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"), F.col("c_name").alias("bill_to"), F.lit("USD").alias("currency"), "n_rows", "subtotal", F.col("o_totalprice").alias("total_amount"))


@query(f"WITH {FIRST_ROWS} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM dd")
def row_dedupe(spark, d):
    rows = state.dedupe_rows(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], list(D.ROW_ORDER))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT l_orderkey AS document_id, count(*) AS n_rows, count(DISTINCT l_linenumber) AS n_kept FROM lineitem GROUP BY 1")
def row_counts(spark, d):
    li = table(spark, d, "lineitem")
    kept = state.dedupe_rows(li, ["l_orderkey"], ["l_linenumber"], list(D.ROW_ORDER)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_kept"))
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows")).join(kept, "l_orderkey").withColumnRenamed("l_orderkey", "document_id")


# --- attribution: each lineitem claims its row in one of five ways

CLAIMS = ORDER_BLOCKS + """, cl AS (SELECT l_orderkey AS document_id, 0 AS group_index, n AS claim_no, CASE WHEN n % 5 = 0 THEN 'p' || (n // 6 + 1) || 'b' || (n % 6 + 4) ELSE 'nowhere' END AS block_id,
    CASE n % 5 WHEN 1 THEN 'PART  ' || l_partkey || ' ' || CAST(l_quantity AS INTEGER) WHEN 2 THEN '$' || printf('%.2f', l_extendedprice) || ' part ' || l_partkey || ' x' WHEN 4 THEN 'no such thing here' END AS quote,
    CASE WHEN n % 5 = 3 THEN '$' || printf('%.2f', l_extendedprice) ELSE '' END AS value FROM orow)"""
_NORM = r"trim(regexp_replace(lower({0}), '[\s\x{{00a0}}]+', ' ', 'g'), ' ')"
_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), ' '), lambda w: w <> ''))"
LADDER = CLAIMS + f""", cd AS (SELECT c.document_id, c.claim_no, c.value, c.quote, b.page_number, b.pos, b.block_id AS found, b.block_id = c.block_id AS same_id,
    {_NORM.format('b.text')} AS bt, {_NORM.format('c.quote')} AS qt, {_NORM.format('c.value')} AS vt, {_WORDS.format('c.quote')} AS qw, {_WORDS.format('b.text')} AS bw
  FROM cl c JOIN obk b ON b.document_id = c.document_id),
rg AS (SELECT *, CASE WHEN same_id THEN 1 WHEN length(qt) >= 4 AND contains(bt, qt) THEN 3 WHEN length(qt) >= 4 AND len(qw) >= 3 AND len(list_intersect(qw, bw)) / len(qw) >= 0.7 THEN 4 WHEN length(vt) >= 3 AND contains(bt, vt) THEN 5 END AS rung,
    CASE WHEN len(qw) >= 3 THEN len(list_intersect(qw, bw)) / len(qw) ELSE 0 END AS ol FROM cd),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, claim_no ORDER BY rung, CASE WHEN rung = 4 THEN ol ELSE 0 END DESC, page_number, pos) AS r FROM rg WHERE rung IS NOT NULL) WHERE r = 1),
att AS (SELECT cl.document_id, CAST(cl.claim_no AS INTEGER) AS claim_no, CASE WHEN rung <= 2 THEN 'exact' WHEN rung <= 4 THEN 'quote' WHEN rung = 5 THEN 'value' ELSE 'unverified' END AS status, found AS found_block,
  CASE WHEN rung <= 2 THEN 0.8 WHEN rung <= 4 THEN 0.72 WHEN rung = 5 THEN 0.6 END AS found_confidence FROM cl LEFT JOIN bs USING (document_id, claim_no))"""


def order_claims(spark, d):
    li = D.order_rows(table(spark, d, "lineitem"))
    money = F.format_string("$%.2f", "l_extendedprice")
    part = F.col("l_partkey").cast("string")
    kind = F.col("n") % 5
    quote = F.when(kind == 1, F.concat(F.lit("PART  "), part, F.lit(" "), F.col("l_quantity").cast("int").cast("string"))).when(kind == 2, F.concat(money, F.lit(" part "), part, F.lit(" x"))).when(kind == 4, "no such thing here")
    block = F.when(kind == 0, F.concat(F.lit("p"), (F.floor(F.col("n") / 6) + 1).cast("string"), F.lit("b"), (F.col("n") % 6 + 4).cast("string"))).otherwise("nowhere")
    return li.select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("group_index"), F.col("n").alias("claim_no"), block.alias("block_id"), quote.alias("quote"), F.when(kind == 3, money).otherwise("").alias("value"), F.lit(0.8).alias("confidence"))


def attributed(spark, d):
    b = order_blocks(spark, d)
    return attribution.attribute(order_claims(spark, d), b, one_group(b), size=D.order_bytes(table(spark, d, "lineitem")))


@query(f"WITH {LADDER} SELECT document_id, claim_no, status, found_block, round(found_confidence, 4) AS found_confidence FROM att")
def attribution_ladder(spark, d):
    return attributed(spark, d).select("document_id", "claim_no", "status", "found_block", F.round("found_confidence", 4).alias("found_confidence"))


@query(f"WITH {LADDER} SELECT count(*) AS claims, count(*) FILTER (WHERE status = 'exact') AS exact, count(*) FILTER (WHERE status = 'quote') AS quote, count(*) FILTER (WHERE status = 'value') AS value, count(*) FILTER (WHERE status = 'unverified') AS unverified, round(count(*) FILTER (WHERE status <> 'unverified') / count(*), 6) AS precision FROM att")
def citation_precision(spark, d):
    return attribution.stats(attributed(spark, d)).withColumn("precision", F.round("precision", 6))


@query(f"WITH {LADDER} SELECT document_id, max(CASE WHEN found_confidence IS NOT NULL THEN round(found_confidence, 4) END) AS verified, count(*) FILTER (WHERE status <> 'unverified') AS n_evidence FROM att GROUP BY 1")
def claim_merge(spark, d):
    x = attributed(spark, d)
    return x.groupBy("document_id").agg(F.max(F.round("found_confidence", 4)).alias("verified"), F.count(F.when(F.col("status") != "unverified", 1)).alias("n_evidence"))


@query(f"""WITH b AS (SELECT DISTINCT doc_id, line, {_NORM.format('line')} AS bt, {_WORDS.format('line')} AS bw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
q AS (SELECT DISTINCT item_id, quote, {_NORM.format('quote')} AS qt, {_WORDS.format('quote')} AS qw FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS quote FROM benchmark)),
r AS (SELECT doc_id, item_id, CASE WHEN contains(bt, qt) THEN 3 WHEN len(qw) >= 3 AND len(list_intersect(qw, bw)) / len(qw) >= 0.7 THEN 4 END AS rung FROM b JOIN q ON length(qt) >= 4)
SELECT doc_id AS document_id, item_id, min(rung) AS rung FROM r WHERE rung IS NOT NULL GROUP BY ALL""")
def quote_match(spark, d):
    """Each document is tried for every line of every benchmark item."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    quotes = items.select("item_id", F.explode(F.split("text", "\n")).alias("quote"))
    lines = docs.select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("text"))
    found = attribution.quotes_in(lines, quotes)
    return found.groupBy("document_id", "item_id").agg(F.min("rung").alias("rung"))


# --- merging: events as observations of (user, event type)

OBS = "obs AS (SELECT user_id AS document_id, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit, json_extract_string(props, '$.k') AS value, value AS confidence FROM events)"
STEPS = OBS + """, p AS (SELECT *, max(confidence) OVER (PARTITION BY document_id, key ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM obs WHERE value IS NOT NULL AND value <> ''),
q AS (SELECT *, pm IS NULL OR confidence > pm AS rec FROM p),
c AS (SELECT *, rec AND coalesce(value <> last_value(CASE WHEN rec THEN value END IGNORE NULLS) OVER (PARTITION BY document_id, key ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS changed FROM q)"""


def observations(spark, d):
    visit = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("key"), visit.alias("visit"), F.get_json_object("props", "$.k").alias("value"), F.col("value").alias("confidence"))


MERGED = f"WITH {STEPS} SELECT document_id, key, max_by(value, visit) FILTER (WHERE changed) AS value, CAST(max(visit) FILTER (WHERE changed) AS BIGINT) AS source_visit, max(confidence) AS confidence, CAST(count(*) FILTER (WHERE changed) - 1 AS BIGINT) AS revisions FROM c GROUP BY ALL"


@query(MERGED)
def scalar_merge(spark, d):
    return state.merge_scalars(observations(spark, d)).withColumn("source_visit", F.col("source_visit").cast("long"))


@query(f"WITH {STEPS} SELECT key, CAST(count(*) FILTER (WHERE changed) AS BIGINT) AS n_changes, CAST(count(*) FILTER (WHERE rec) AS BIGINT) AS n_records FROM c GROUP BY 1")
def revision_counts(spark, d):
    x = state.scalar_steps(observations(spark, d))
    return x.groupBy("key").agg(F.count(F.when(F.col("changed"), 1)).alias("n_changes"), F.count(F.when(F.col("is_record"), 1)).alias("n_records"))


@query(f"WITH {OBS}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id, key, value ORDER BY visit) AS r FROM obs WHERE value <> '') SELECT document_id, key, string_agg(value, ',' ORDER BY visit) AS items, max(confidence) AS confidence, CAST(max(visit) AS BIGINT) AS source_visit FROM f WHERE r = 1 GROUP BY ALL")
def list_merge(spark, d):
    return state.merge_lists(observations(spark, d)).select("document_id", "key", F.array_join("items", ",").alias("items"), "confidence", F.col("source_visit").cast("long").alias("source_visit"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN l_returnflag ELSE '' END AS description, CASE WHEN l_quantity >= 25 THEN l_extendedprice END AS amount FROM lineitem)
SELECT l_orderkey AS document_id, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT DISTINCT l_orderkey, description, amount FROM r WHERE description <> '' OR amount IS NOT NULL) GROUP BY 1""")
def blank_rows(spark, d):
    """Rows of which some hold nothing: those go before repeats do."""
    full = F.col("l_quantity") >= 25
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.when(full, F.col("l_returnflag")).otherwise("").alias("description"), F.when(full, F.col("l_extendedprice")).alias("amount"))
    kept = state.dedupe_rows(rows, ["l_orderkey"], ["description", "amount"], ["seq"])
    return kept.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {STEPS}, w AS (SELECT *, max(visit) FILTER (WHERE changed) OVER (PARTITION BY document_id, key) AS wv FROM c), v AS (SELECT *, max(CASE WHEN visit = wv THEN value END) OVER (PARTITION BY document_id, key) AS won FROM w) SELECT document_id, key, CAST(count(*) AS BIGINT) AS n_evidence FROM v WHERE visit >= wv AND value = won GROUP BY ALL")
def evidence_merge(spark, d):
    x = observations(spark, d).withColumn("evidence", F.array(F.concat(F.lit("v"), F.col("visit").cast("string"))))
    return state.merge_evidence(x).select("document_id", "key", F.size("evidence").cast("long").alias("n_evidence"))


@query(MERGED)
def stream_merge(spark, d):
    """The same merge as a stream over four batches, through kept state; gives the state after the last batch."""
    obs = observations(spark, d).withColumn("norm", X.key_form("value"))
    base = scratch.path(spark, "stream")
    for k in range(4):  # one file set each, in order of visit, read oldest first
        obs.where(F.col("visit").between(k * 200 + 1, (k + 1) * 200 if k < 3 else 10**9)).coalesce(4).write.parquet(f"{base}/in/batch={k}")
    schema = obs.schema
    stream = spark.readStream.schema(schema.add("batch", "integer")).option("maxFilesPerTrigger", 10**6).parquet(f"{base}/in")

    def keep(df, i):
        df.write.mode("append").parquet(f"{base}/out")

    q = merge.merge_stream(stream.drop("batch")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return merge.latest(spark.read.schema(merge.OUT).parquet(f"{base}/out"))


# --- records of customers as account statements

FILLED = """own AS (SELECT c_custkey AS document_id FROM customer), fl AS (
  SELECT c_custkey AS document_id, 'account_number' AS key FROM customer UNION ALL SELECT c_custkey, 'account_holder' FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey, 'closing_balance' FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT DISTINCT c_custkey, 'transactions' FROM customer JOIN orders ON o_custkey = c_custkey)"""


def filled(spark, d):
    c = table(spark, d, "customer")
    key = lambda df, k: df.select(F.col("c_custkey").alias("document_id"), F.lit(k).alias("key"))
    bought = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(c, "c_custkey", "left_semi")
    out = key(c, "account_number").unionByName(key(c.where("c_custkey % 7 <> 0"), "account_holder")).unionByName(key(c.where("c_acctbal >= 0"), "closing_balance")).unionByName(key(bought, "transactions"))
    return c.select(F.col("c_custkey").alias("document_id")), out


@query(f"WITH {FILLED}, rq(key) AS (VALUES ('account_number'), ('account_holder'), ('closing_balance'), ('transactions')) SELECT document_id, key FROM own, rq WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.document_id = own.document_id AND fl.key = rq.key)")
def missing_required(spark, d):
    owners, f = filled(spark, d)
    return state.missing(owners, STATEMENT.required_dim(spark), f).select("document_id", "key")


@query(f"WITH {FILLED} SELECT own.document_id, CAST(count(fl.key) AS BIGINT) AS n_filled, round(count(fl.key) / 7, 6) AS coverage FROM own LEFT JOIN fl USING (document_id) GROUP BY 1")
def coverage(spark, d):
    owners, f = filled(spark, d)
    keys = spark.createDataFrame([(k,) for k in STATEMENT.keys], "key string")
    return state.coverage(owners, keys, f).select("document_id", "n_filled", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {STEPS}, m AS (SELECT document_id, key, max(confidence) AS confidence FROM c GROUP BY ALL), b AS (SELECT document_id, confidence FROM m UNION ALL SELECT document_id, confidence FROM obs) SELECT document_id, round(avg(confidence), 6) AS mean_confidence FROM b GROUP BY 1")
def mean_confidence(spark, d):
    obs = observations(spark, d)
    return state.mean_confidence(state.merge_scalars(obs), obs).withColumn("mean_confidence", F.round("mean_confidence", 6))


VISITS = STEPS + """, vs AS (SELECT o.document_id, o.visit, count(*) OVER (PARTITION BY o.document_id) AS n_groups, coalesce(c.changed, false) AS changed, o.key, o.confidence FROM obs o LEFT JOIN c ON c.document_id = o.document_id AND c.visit = o.visit),
sk AS (SELECT *, visit - coalesce(max(CASE WHEN changed THEN visit END) OVER (PARTITION BY document_id ORDER BY visit), 0) AS streak,
  5 - count(DISTINCT key) OVER (PARTITION BY document_id ORDER BY visit) AS n_missing FROM vs)"""


def visits(spark, d):
    obs = observations(spark, d)
    steps = state.scalar_steps(obs).select("document_id", "visit", "changed")
    x = obs.join(steps, ["document_id", "visit"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    x = state.streaks(x.withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("document_id"))))
    # Keys seen so far: each counts from its first visit.
    first = (F.col("visit") == F.min("visit").over(Window.partitionBy("document_id", "key"))).cast("int")
    return x.withColumn("_f", first).withColumn("n_missing", F.lit(5) - F.sum("_f").over(Window.partitionBy("document_id").orderBy("visit"))).drop("_f")


@query(f"WITH {VISITS} SELECT document_id, CAST(visit AS BIGINT) AS visit, CAST(streak AS BIGINT) AS streak FROM sk")
def unproductive_streak(spark, d):
    return visits(spark, d).select("document_id", F.col("visit").cast("long").alias("visit"), F.col("streak").cast("long").alias("streak"))


def _exit_sql(open_rule: str, patience: int, min_groups: int) -> str:
    return f"""WITH {VISITS}, dc AS (SELECT *, CASE WHEN visit >= n_groups THEN 'all_groups' WHEN visit < {min_groups} THEN 'min_groups' WHEN {open_rule} THEN 'open_tables' WHEN streak >= {patience} THEN 'no_new_information' WHEN n_missing > 0 THEN 'missing' WHEN confidence < 1 THEN 'confidence' ELSE 'satisfied' END AS reason FROM sk),
st AS (SELECT *, reason IN ('all_groups', 'no_new_information', 'satisfied') AS stop FROM dc)
SELECT document_id, CAST(min(visit) FILTER (WHERE stop) AS BIGINT) AS exit_visit, min_by(reason, visit) FILTER (WHERE stop) AS reason FROM st GROUP BY 1"""


@query(_exit_sql("key = 'purchase' AND visit < 40", 6, 2))
def early_exit_visits(spark, d):
    policy = early_exit.Policy(min_groups=2, patience=6, min_confidence=1.0)
    x = visits(spark, d).withColumns({"open_tables": F.when((F.col("key") == "purchase") & (F.col("visit") < 40), 1).otherwise(0), "n_invalid": F.lit(0), "n_unsupported": F.lit(0), "mean_confidence": F.col("confidence")})
    read = early_exit.read_until_exit(early_exit.decide(x, policy))
    return read.groupBy("document_id").agg(F.max("visit").cast("long").alias("exit_visit"), F.max_by("reason", "visit").alias("reason"))


# --- types

RAW_DATE = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 4 THEN strftime(o_orderdate, '%-d %b %Y') ELSE 'soon' END"


def raw_date():
    k, fmt = F.col("o_orderkey") % 6, lambda f: F.date_format("o_orderdate", f)
    return F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("MM/dd/yyyy")).when(k == 2, fmt("d MMMM yyyy")).when(k == 3, fmt("MMMM d, yyyy")).when(k == 4, fmt("d MMM yyyy")).otherwise("soon")


@query(f"SELECT o_orderkey, {RAW_DATE} AS raw, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def normalise_dates(spark, d):
    return table(spark, d, "orders").withColumn("raw", raw_date()).select("o_orderkey", "raw", X.date_form("raw").cast("string").alias("iso"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$ ' || printf('%.2f', o_totalprice) WHEN 1 THEN printf('%.2f', o_totalprice) || ' EUR' WHEN 2 THEN '-' || printf('%.2f', o_totalprice) ELSE 'none' END AS raw, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS amount FROM orders")
def normalise_money(spark, d):
    two, k = F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("$ "), two)).when(k == 1, F.concat(two, F.lit(" EUR"))).when(k == 2, F.concat(F.lit("-"), two)).otherwise("none")
    return table(spark, d, "orders").withColumn("raw", raw).select("o_orderkey", "raw", X.money_form("raw").alias("amount"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS as_integer, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE NULL END AS as_boolean,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS as_enum, nullif(trim(c_name, ' '), '') AS as_string FROM customer""")
def coerce_types(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        X.coerce(F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), k.cast("string"))), "integer").alias("as_integer"),
        X.coerce(F.when(k % 2 == 0, "Yes").otherwise("maybe"), "boolean").alias("as_boolean"),
        X.coerce(F.lower("c_mktsegment"), "enum", ["BUILDING", "MACHINERY"]).alias("as_enum"),
        X.coerce(F.concat(F.lit("  "), F.col("c_name")), "string").alias("as_string"),
    )


# --- validation

VIOLATIONS = """v AS (
  SELECT c_custkey AS document_id, 'segment' AS path, 'unknown_key' AS code, 'warning' AS severity FROM customer
  UNION ALL SELECT c_custkey, 'account_holder', 'missing_required', 'error' FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 'closing_balance', 'type_mismatch', 'error' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 'statement_period_start', 'cardinality', 'error' FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT o_custkey, 'transactions[' || o_orderkey || '].date', 'type_mismatch', 'error' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 6 IN (3, 5)
  UNION ALL SELECT o_custkey, 'transactions[' || o_orderkey || '].note', 'unknown_column', 'warning' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0
  UNION ALL SELECT c_custkey, 'transactions', 'missing_required', 'error' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))"""


def statement_violations(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    val = lambda key, *v: F.struct(F.lit(key).alias("key"), F.array(*v).alias("values"))
    pair = lambda name, v: F.struct(F.lit(name).alias("k"), v.alias("v"))
    two = F.format_string("%.2f", "c_acctbal")
    fields = c.select(F.col("c_custkey").alias("document_id"), F.explode(F.array(
        val("segment", F.col("c_mktsegment")), val("account_number", k.cast("string")), val("account_holder", F.when(k % 7 == 0, "").otherwise(F.col("c_name"))),
        F.when(k % 5 == 0, val("closing_balance", F.lit("a lot"))).otherwise(val("closing_balance", two)),
        F.when(k % 11 == 0, val("statement_period_start", F.lit("2024-01-01"), F.lit("2024-01-02"))).otherwise(val("statement_period_start", F.lit("2024-01-01"))),
    )).alias("f")).select("document_id", "f.*")
    cells = F.map_from_entries(F.filter(F.array(pair("date", raw_date()), pair("description", F.col("o_orderpriority")), pair("amount", F.format_string("%.2f", "o_totalprice")), F.when(F.col("o_orderkey") % 10 == 0, pair("note", F.lit("x")))), lambda e: e.isNotNull()))
    rows = o.join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("document_id"), F.lit("transactions").alias("table_name"), F.col("o_orderkey").alias("row_index"), cells.alias("cells"))
    owners = c.select(F.col("c_custkey").alias("document_id"))
    _, a = validate.validate_fields(owners, fields, STATEMENT)
    _, b = validate.validate_rows(owners, rows, STATEMENT, "transactions")
    return owners, a.unionByName(b)


@query(f"WITH {VIOLATIONS} SELECT * FROM v")
def validate_records(spark, d):
    return statement_violations(spark, d)[1]


@query(f"WITH {VIOLATIONS} SELECT code, severity, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM v GROUP BY ALL")
def violations_by_code(spark, d):
    v = statement_violations(spark, d)[1]
    return v.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("n_documents"))


@query(f"WITH {VIOLATIONS} SELECT c_custkey AS document_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM customer LEFT JOIN v ON document_id = c_custkey GROUP BY 1")
def record_verdicts(spark, d):
    return validate.verdict(*statement_violations(spark, d))


# --- model answers

ANSWER_VALUE = "CASE WHEN event_id % 7 = 6 THEN NULL ELSE json_extract_string(props, '$.k') END"


@query(f"SELECT event_id, {ANSWER_VALUE} AS invoice_number, CAST(CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS BIGINT) AS n_repairs, CASE WHEN event_id % 7 = 6 THEN 'no object' END AS error FROM events")
def envelope_parse(spark, d):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    answer = (
        F.when(kind == 0, s('{"fields": {"invoice_number": "', k, '"}}'))
        .when(kind == 1, s('```json\n{"fields": {"invoice_number": "', k, '"}}\n```'))
        .when(kind == 2, s('Sure: {"fields": {"invoice_number": "', k, '",}}'))
        .when(kind == 3, s('{"fields": {"invoice_number": "', k, '"'))
        .when(kind == 4, s("{'fields': {'invoice_number': '", k, "'}}"))
        .when(kind == 5, s('{"invoice_number": "', k, '", "other": 1} thanks'))
        .otherwise("nothing found")
    )
    out = envelope.parse_answers(table(spark, d, "events").select("event_id", answer.alias("answer")), INVOICE)
    # Dropped keys are told beside the repairs proper.
    notes = F.filter("repairs", lambda r: ~r.startswith("undeclared"))
    return out.select("event_id", F.col("fields")["invoice_number"].alias("invoice_number"), F.size(notes).cast("long").alias("n_repairs"), "error")


@query("SELECT event_id, sha256('rule' || chr(0) || props || chr(0) || '{\"stop\":[]}') AS cache_key FROM events")
def cache_keys(spark, d):
    options = json.dumps({"stop": []}, sort_keys=True, separators=(",", ":"))
    return table(spark, d, "events").select("event_id", envelope.cache_key(F.lit("rule"), F.col("props"), F.lit(options)).alias("cache_key"))


@query("SELECT event_type, count(*) AS lookups, count(*) FILTER (WHERE r > 1) AS hits, count(*) FILTER (WHERE r = 1) AS stores, round(count(*) FILTER (WHERE r > 1) / count(*), 6) AS hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY props ORDER BY event_id) AS r FROM events) GROUP BY 1")
def cache_stats(spark, d):
    r = F.row_number().over(Window.partitionBy("props").orderBy("event_id"))
    x = table(spark, d, "events").withColumn("r", r)
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("lookups"), F.count(F.when(F.col("r") > 1, 1)).alias("hits"), F.count(F.when(F.col("r") == 1, 1)).alias("stores"), F.round(F.count(F.when(F.col("r") > 1, 1)) / F.count(F.lit(1)), 6).alias("hit_rate"))


@query("SELECT event_id FROM events WHERE props NOT IN (SELECT DISTINCT props FROM events WHERE event_id % 50 = 0)")
def uncached_calls(spark, d):
    calls = table(spark, d, "events").withColumn("cache_key", F.col("props"))
    return envelope.uncached(calls, calls.where("event_id % 50 = 0").select("cache_key")).select("event_id")


# --- whole runs


def _run_orders(spark, d, profile):
    return extraction.run(order_blocks(spark, d), PROFILES[profile])


_RECORD = f"""WITH {FIRST_ROWS}, {ORDER_BLOCKS}, pc AS (SELECT document_id, max(page_number) AS n_pages FROM obk GROUP BY 1)
SELECT o_orderkey AS document_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN '$' || printf('%.2f', o_totalprice) END AS total_amount, CAST(n_pages AS BIGINT) AS pages_read
FROM orders JOIN pc ON document_id = o_orderkey"""


@query(_RECORD)
def extract_orders(spark, d):
    """The accuracy profile reads every page: groups, extraction, attribution, merge, validation for all orders."""
    r = _run_orders(spark, d, "accuracy")["results"]
    first = lambda k: F.col("record")[k][0].alias(k)
    return r.select("document_id", first("invoice_number"), first("invoice_date"), first("total_amount"), "pages_read")


@query(f"""WITH {FIRST_ROWS}, k AS (SELECT l_orderkey, count(DISTINCT (l_linenumber, l_partkey)) AS n_rows FROM lineitem GROUP BY 1)
SELECT o_orderkey AS document_id, coalesce(n_rows, 0) AS n_rows FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""")
def extract_order_rows(spark, d):
    """Rows kept over all groups: those that overlapping groups repeat count once."""
    rows = _run_orders(spark, d, "accuracy")["rows"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id")).join(rows, "document_id", "left").na.fill(0, ["n_rows"])


@query()
def profile_exits(spark, d):
    """Why and after how many groups each profile stops. Blocks are made once, profiles with one grouping share what they read."""
    blocks = scratch.materialise(order_blocks(spark, d), "blocks")
    seen = {g: extraction.observe(blocks, g, INVOICE) for g in dict.fromkeys(c.grouping for c in PROFILES.values())}
    parts = [extraction.traces(seen[c.grouping], c).groupBy("document_id").agg(F.max("visit").alias("groups"), F.max_by("reason", "visit").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.sum("groups").alias("groups")).withColumn("profile", F.lit(p)) for p, c in PROFILES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
