"""Queries over scores, model cards, training examples and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dataset, metrics, registry
from . import dag
from .queries_layout import BLOCKS, CONFIG, GROUPS, ORBIT, PAGES, text_blocks, text_group_pages, text_pages  # noqa: F401
from .registry_of_queries import query, table

# --- scores: labels as gold, a simple rule as prediction

PREDICTED = """g AS (SELECT doc_id AS document_id, 'quality' AS key, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE doc_id % 9 <> 0),
p AS (SELECT doc_id AS document_id, 'quality' AS key, CASE WHEN n_chars > 500 THEN '1' ELSE '0' END AS value FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'toxic', '0' FROM documents WHERE doc_id % 4 <> 0 AND doc_id IN (SELECT doc_id FROM labels))"""
SCORED = PREDICTED + """, s AS (SELECT document_id, key, CAST(p.value IS NOT DISTINCT FROM g.value AND p.value IS NOT NULL AS BIGINT) AS tp, CAST(p.value IS NOT NULL AND p.value IS DISTINCT FROM g.value AS BIGINT) AS fp, CAST(g.value IS NOT NULL AND p.value IS DISTINCT FROM g.value AS BIGINT) AS fn FROM p FULL JOIN g USING (document_id, key))"""
RATIOS = "precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


def keyed_sql(source: str) -> str:
    return f"""ks AS (SELECT *, {RATIOS} FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, tp + fn AS support FROM (SELECT key, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM {source} GROUP BY 1)))"""


def scored(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    mine = docs.select("doc_id", "n_chars").join(labels.select("doc_id"), "doc_id", "left_semi")
    row = lambda df, k, v: df.select(F.col("doc_id").alias("document_id"), F.lit(k).alias("key"), v.alias("value"))
    gold = row(labels, "quality", F.col("quality").cast("string")).unionByName(row(labels.where("doc_id % 9 <> 0"), "toxic", F.col("toxic").cast("string")))
    predicted = row(mine, "quality", F.when(F.col("n_chars") > 500, "1").otherwise("0")).unionByName(row(mine.where("doc_id % 4 <> 0"), "toxic", F.lit("0")))
    return metrics.score_scalars(predicted, gold)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {SCORED} SELECT * FROM s")
def score_scalars(spark, d):
    return scored(spark, d)


@query(f"WITH {SCORED}, {keyed_sql('s')} SELECT key, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ks")
def key_scores(spark, d):
    return rounded(metrics.key_scores(scored(spark, d)), "precision", "recall", "f1")


SUMMARY = """SELECT round(CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0 END, 6) AS weighted_f1, round(coalesce(avg(f1) FILTER (WHERE support > 0), 0), 6) AS macro_f1,
  round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, CAST(sum(support) AS BIGINT) AS support FROM ks"""


@query(f"WITH {SCORED}, {keyed_sql('s')} {SUMMARY}")
def f1_summary(spark, d):
    return rounded(metrics.summary(metrics.key_scores(scored(spark, d))), "weighted_f1", "macro_f1", "micro_f1")


@query(f"WITH {SCORED}, {keyed_sql('s')} {SUMMARY}")
def shard_aggregate(spark, d):
    """Partial scores of eight shards, scored again, give what the whole gives."""
    x = scored(spark, d).withColumn("shard", F.pmod(F.col("document_id"), F.lit(8)))
    parts = metrics.key_scores(x, ["shard"]).select("key", "tp", "fp", "fn")
    return rounded(metrics.summary(metrics.key_scores(parts)), "weighted_f1", "macro_f1", "micro_f1")


BAGS = """a AS (SELECT l_orderkey AS document_id, l_returnflag AS item, count(*) AS g, count(*) FILTER (WHERE l_quantity > 10) + count(*) FILTER (WHERE l_tax > 0.06) AS p FROM lineitem GROUP BY ALL),
s AS (SELECT document_id, 'flags' AS key, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn FROM a GROUP BY 1)"""


@query(f"WITH {BAGS} SELECT * FROM s")
def bag_match(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit("flags").alias("key"), F.col("l_returnflag").alias("item"), "l_quantity", "l_tax")
    predicted = li.where("l_quantity > 10").unionByName(li.where("l_tax > 0.06"))
    return metrics.score_bags(predicted.drop("l_quantity", "l_tax"), li.drop("l_quantity", "l_tax"))


CROSS = """k AS (SELECT l_orderkey AS document_id, CASE l_returnflag WHEN 'A' THEN 'field_a' ELSE 'table_b' END AS key, sum(l_quantity) > 60 AS correct, CAST(count(*) FILTER (WHERE l_tax > 0.07) AS BIGINT) AS fn, count(DISTINCT l_suppkey % 3) AS pages FROM lineitem GROUP BY ALL)"""


def cross_keys(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "field_a").otherwise("table_b").alias("key"), "l_quantity", "l_tax", (F.col("l_suppkey") % 3).alias("page_number"))
    keys = li.groupBy("document_id", "key").agg((F.sum("l_quantity") > 60).alias("correct"), F.count(F.when(F.col("l_tax") > 0.07, 1)).alias("fn"))
    return keys, li.select("document_id", "key", "page_number")


@query(f"WITH {CROSS} SELECT count(*) AS eligible, count(*) FILTER (WHERE correct AND fn = 0) AS correct, round(count(*) FILTER (WHERE correct AND fn = 0) / count(*), 6) AS accuracy FROM k WHERE pages >= 2")
def cross_page_accuracy(spark, d):
    return rounded(metrics.cross_page(*cross_keys(spark, d)), "accuracy")


@query(f"WITH {CROSS}, r AS (SELECT *, sum(fn) OVER (PARTITION BY key ORDER BY document_id) AS fa FROM k) SELECT count(*) AS eligible, count(*) FILTER (WHERE correct AND fa = 0) AS correct, round(count(*) FILTER (WHERE correct AND fa = 0) / count(*), 6) AS accuracy FROM r WHERE pages >= 2")
def cross_page_cumulative(spark, d):
    return rounded(metrics.cross_page(*cross_keys(spark, d), cumulative=True), "accuracy")


@query("""WITH r AS (SELECT source, doc_id % 3 <> 0 AS is_valid, length(text) % 7 AS n_claims, least(length(text) % 7, doc_id % 4) AS n_verified, n_chars // 100 AS pages_read, n_chars // 50 + 1 AS pages_total, n_chars / 1000 AS seconds FROM documents)
SELECT source, count(*) AS documents, round(count(*) FILTER (WHERE is_valid) / count(*), 6) AS schema_valid_rate, round(CASE WHEN sum(n_claims) > 0 THEN sum(n_verified) / sum(n_claims) ELSE 0 END, 6) AS citation_precision, round(sum(pages_read) / sum(pages_total), 6) AS pages_read_fraction, round(sum(seconds) / count(*), 6) AS seconds_per_document FROM r GROUP BY 1""")
def corpus_rates(spark, d):
    n = F.length("text") % 7
    r = table(spark, d, "documents").select("source", (F.col("doc_id") % 3 != 0).alias("is_valid"), n.alias("n_claims"), F.least(n, F.col("doc_id") % 4).alias("n_verified"), F.floor(F.col("n_chars") / 100).alias("pages_read"), (F.floor(F.col("n_chars") / 50) + 1).alias("pages_total"), (F.col("n_chars") / 1000).alias("seconds"))
    return rounded(metrics.corpus_rates(r, ["source"]), "schema_valid_rate", "citation_precision", "pages_read_fraction", "seconds_per_document")


@query(f"WITH {PAGES}, n AS (SELECT document_id, count(*) AS pages FROM pg GROUP BY 1) SELECT lang, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, min(pages) AS least_pages, max(pages) AS most_pages, round(avg(pages), 6) AS mean_pages FROM documents JOIN n ON document_id = doc_id GROUP BY 1")
def corpus_stats(spark, d):
    n = text_pages(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    x = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang").join(n, "document_id")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.min("pages").alias("least_pages"), F.max("pages").alias("most_pages"), F.round(F.avg("pages"), 6).alias("mean_pages"))


@query("SELECT lang AS run, m.name, m.value FROM (SELECT lang, unnest([{'name': 'documents', 'value': CAST(count(*) AS DOUBLE)}, {'name': 'chars', 'value': CAST(sum(n_chars) AS DOUBLE)}]) AS m FROM documents GROUP BY 1)")
def metric_log(spark, d):
    x = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    return x.select(F.col("lang").alias("run"), F.expr("stack(2, 'documents', cast(documents as double), 'chars', cast(chars as double)) as (name, value)"))


# --- model cards: each source's labels as one model's results

CARDS = """lb AS (SELECT source, quality, toxic, doc_id FROM labels JOIN documents USING (doc_id)),
cd AS (SELECT 'model-' || source AS model_id, 'schema-' || (CAST(substr(source, 4) AS INTEGER) // 4) AS schema, CASE CAST(substr(source, 4) AS INTEGER) % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'archived' ELSE 'candidate' END AS stage,
  CAST(substr(source, 4) AS INTEGER) AS created_at, count(*) AS corpus_size, CAST(CAST(substr(source, 4) AS INTEGER) % 3 = 2 AS INTEGER) AS corpus_fingerprint,
  avg(quality) AS weighted_f1, avg(1 - toxic) AS schema_valid_rate, avg(CASE WHEN quality = 1 THEN 1 ELSE 0.5 END) AS citation_precision, avg(quality) AS k1, avg(1 - toxic) AS k2 FROM lb GROUP BY source)"""
CHECKS = CARDS + """, ch AS (SELECT * FROM cd WHERE stage = 'production'),
x AS (SELECT c.*, ch.model_id AS champion_id, ch.corpus_fingerprint AS cf, ch.weighted_f1 AS cw, ch.schema_valid_rate AS cs, ch.citation_precision AS cc, ch.k1 AS ck1, ch.k2 AS ck2 FROM cd c LEFT JOIN ch USING (schema) WHERE c.stage = 'candidate'),
ck AS (
  SELECT model_id AS candidate_id, champion_id, 'corpus_size' AS check_name, corpus_size >= 25 AS passed FROM x
  UNION ALL SELECT model_id, champion_id, 'floor:citation_precision', citation_precision >= 0.9 FROM x UNION ALL SELECT model_id, champion_id, 'floor:schema_valid_rate', schema_valid_rate >= 0.95 FROM x
  UNION ALL SELECT model_id, champion_id, 'baseline', true FROM x WHERE champion_id IS NULL
  UNION ALL SELECT model_id, champion_id, 'same_corpus', corpus_fingerprint = cf FROM x WHERE champion_id IS NOT NULL
  UNION ALL SELECT model_id, champion_id, 'improvement:weighted_f1', weighted_f1 - cw >= 0.005 FROM x WHERE champion_id IS NOT NULL
  UNION ALL SELECT model_id, champion_id, 'guard:schema_valid_rate', cs - schema_valid_rate <= 0.01 FROM x WHERE champion_id IS NOT NULL
  UNION ALL SELECT model_id, champion_id, 'guard:citation_precision', cc - citation_precision <= 0.01 FROM x WHERE champion_id IS NOT NULL
  UNION ALL SELECT model_id, champion_id, 'per_key_regression', NOT (ck1 - k1 > 0.05 OR ck2 - k2 > 0.05) FROM x WHERE champion_id IS NOT NULL)"""


def cards(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = F.substring("source", 4, 9).cast("int")
    good, safe = F.avg(F.col("quality").cast("double")), F.avg(1.0 - F.col("toxic"))
    y = x.groupBy("source").agg(F.count(F.lit(1)).alias("corpus_size"), good.alias("good"), safe.alias("safe"), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.5)).alias("cites"))
    stage = F.when(n % 4 == 0, "production").when(n % 4 == 1, "archived").otherwise("candidate")
    pairs = lambda **kw: F.map_from_arrays(F.array(*map(F.lit, kw)), F.array(*kw.values()))
    return y.select(
        F.concat(F.lit("model-"), "source").alias("model_id"), F.concat(F.lit("schema-"), F.floor(n / 4).cast("string")).alias("schema"), stage.alias("stage"), n.alias("created_at"), "corpus_size", (n % 3 == 2).cast("int").alias("corpus_fingerprint"),
        pairs(weighted_f1=F.col("good"), schema_valid_rate=F.col("safe"), citation_precision=F.col("cites")).alias("metrics"), pairs(k1=F.col("good"), k2=F.col("safe")).alias("per_key"),
    )


def gate_rows(spark, d):
    c = cards(spark, d)
    return registry.gate_checks(c.where("stage = 'candidate'"), registry.champion(c))


@query(f"WITH {CHECKS} SELECT * FROM ck")
def gate_checks(spark, d):
    return gate_rows(spark, d).select("candidate_id", "champion_id", "check_name", "passed")


@query(f"WITH {CHECKS} SELECT candidate_id, champion_id, bool_and(passed) AS promote FROM ck GROUP BY ALL")
def promotion_gate(spark, d):
    return registry.decisions(gate_rows(spark, d))


@query(f"WITH {CARDS}, up AS (SELECT schema, max(model_id) AS m FROM cd WHERE stage = 'candidate' GROUP BY 1) SELECT model_id, CASE WHEN model_id = m THEN 'production' WHEN stage = 'production' AND m IS NOT NULL THEN 'archived' ELSE stage END AS stage FROM cd LEFT JOIN up USING (schema)")
def promote_models(spark, d):
    """The last candidate of each schema is promoted by force."""
    c = cards(spark, d)
    chosen = c.where("stage = 'candidate'").groupBy("schema").agg(F.max("model_id").alias("candidate_id")).withColumn("promote", F.lit(False))
    return registry.promote(c, chosen, force=True).select("model_id", "stage")


@query(f"WITH {CARDS}, t AS (SELECT schema, max_by(model_id, created_at) AS t FROM cd WHERE stage = 'archived' GROUP BY 1) SELECT model_id, CASE WHEN model_id = t THEN 'production' WHEN stage = 'production' AND t IS NOT NULL THEN 'archived' ELSE stage END AS stage FROM cd LEFT JOIN t USING (schema)")
def rollback_models(spark, d):
    return registry.rollback(cards(spark, d)).select("model_id", "stage")


@query(f"WITH {CARDS} SELECT schema, model_id, CAST(row_number() OVER (PARTITION BY schema ORDER BY created_at DESC) AS INTEGER) AS age FROM cd")
def champion_history(spark, d):
    return cards(spark, d).select("schema", "model_id", F.row_number().over(Window.partitionBy("schema").orderBy(F.col("created_at").desc())).alias("age"))


@query("""WITH a AS (SELECT l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem), o AS (SELECT l_returnflag || l_linestatus AS key, avg(l_discount) * 10 AS before, avg(l_tax) * 12 AS after FROM a GROUP BY 1)
SELECT key, round(before, 6) AS before, round(after, 6) AS after FROM o WHERE before - after > 0.01""")
def per_key_regression(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("key")).agg((F.avg("l_discount") * 10).alias("old"), (F.avg("l_tax") * 12).alias("new"))
    out = registry.regressions(x.select("key", F.col("new").alias("f1")), x.select("key", F.col("old").alias("f1")), 0.01)
    return rounded(out, "before", "after")


@query("SELECT DISTINCT l_returnflag || l_linestatus AS key FROM lineitem WHERE l_returnflag || l_linestatus NOT IN (SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem WHERE l_linestatus = 'O')")
def untested_keys(spark, d):
    x = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("key"), "l_linestatus")
    return registry.untested(x.where("l_linestatus = 'O'").distinct(), x.select("key").distinct())


@query("SELECT lang, left(sha256(string_agg(d || chr(0), '' ORDER BY d)), 16) AS fingerprint FROM (SELECT DISTINCT lang, CAST(doc_id AS VARCHAR) AS d FROM documents) GROUP BY 1")
def corpus_fingerprint(spark, d):
    return registry.fingerprint(table(spark, d, "documents").select("lang", F.col("doc_id").alias("document_id")), ["lang"])


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END, '0.0.0') <> CAST(p_size % 50 AS VARCHAR) AS update_required FROM part")
def update_required(spark, d):
    p = table(spark, d, "part")
    current = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string"))
    return p.select("p_partkey", registry.update_required(current, (F.col("p_size") % 50).cast("string")).alias("update_required"))


# --- the plan of steps

_STEPS = "st(name, dep) AS (VALUES ('ingest', NULL), ('build_dataset', 'ingest'), ('train', 'build_dataset'), ('evaluate', 'train'), ('gate', 'evaluate'), ('register', 'gate'), ('deploy', 'register'))"


@query(f"WITH RECURSIVE {_STEPS}, w AS (SELECT name, 0 AS level FROM st WHERE dep IS NULL UNION ALL SELECT st.name, w.level + 1 FROM w JOIN st ON st.dep = w.name) SELECT name, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY 1")
def plan_reachability(spark, d):
    return dag.reachable(dag.steps(spark)).select("name", F.col("level").cast("int").alias("level"))


@query("SELECT * FROM (VALUES ('publish', 'sign_off')) t(name, dependency)")
def plan_unresolved(spark, d):
    return dag.unresolved(dag.steps(spark, [*dag.STEPS, ("publish", ["deploy", "sign_off"])]))


# --- training examples over text pages: a document's first words as gold, shown on pages that hold them

GOLD = """gd AS (SELECT document_id, 'opening' AS key, text AS value FROM blk WHERE page_number = 1 AND pos = 0 AND text <> '' UNION ALL SELECT document_id, 'closing', max_by(text, page_number * 10 + pos) FROM blk WHERE text <> '' GROUP BY 1),
ev AS (SELECT DISTINCT gd.document_id, key, page_number FROM gd JOIN blk ON blk.document_id = gd.document_id AND blk.text = gd.value WHERE gd.document_id % 5 <> 0)"""


def gold(spark, d):
    b = text_blocks(spark, d).where("text <> ''")
    first = b.where("page_number = 1 and pos = 0").select("document_id", F.lit("opening").alias("key"), F.col("text").alias("value"))
    last = b.groupBy("document_id").agg(F.max_by("text", F.struct("page_number", "pos")).alias("value")).select("document_id", F.lit("closing").alias("key"), "value")
    g = first.unionByName(last)
    e = g.join(b, (g["document_id"] == b["document_id"]) & (F.col("value") == F.col("text"))).where(g["document_id"] % 5 != 0).select(g["document_id"], "key", "page_number").distinct()
    return g, e


@query(f"""WITH RECURSIVE {GROUPS}{ORBIT}, {GOLD}, sh AS (SELECT DISTINCT document_id, group_index, key FROM ev JOIN gp USING (document_id, page_number) UNION SELECT document_id, 0, key FROM gd WHERE document_id % 5 = 0),
f AS (SELECT *, min(group_index) OVER (PARTITION BY document_id, key) AS g0 FROM sh)
SELECT document_id, CAST(group_index AS INTEGER) AS group_index, key, value FROM f JOIN gd USING (document_id, key) WHERE key = 'closing' OR group_index = g0""")
def training_targets(spark, d):
    g, e = gold(spark, d)
    groups = text_group_pages(spark, d)[1]
    continuing = spark.createDataFrame([("closing",)], "key string")
    return dataset.field_targets(g, e, groups, continuing).select("document_id", F.col("group_index").cast("int").alias("group_index"), "key", "value")


@query(f"""WITH RECURSIVE {GROUPS}{ORBIT}, rw AS (SELECT document_id, pos AS row_index, page_number FROM blk WHERE pos = 2), l AS (SELECT document_id, group_index, max(page_number) AS last FROM gp GROUP BY ALL), m AS (SELECT document_id, max(page_number) AS final FROM rw GROUP BY 1)
SELECT document_id, group_index, CAST(count(DISTINCT row_index) AS BIGINT) AS n_rows, max(final) > max(last) AS is_open FROM rw JOIN gp USING (document_id, page_number) JOIN l USING (document_id, group_index) JOIN m USING (document_id) GROUP BY ALL""")
def row_targets(spark, d):
    rows = text_blocks(spark, d).where("pos = 2").select("document_id", F.lit("lines").alias("table_name"), F.col("pos").alias("row_index"), "page_number")
    out = dataset.row_targets(rows, text_group_pages(spark, d)[1])
    return out.select("document_id", "group_index", F.size("row_indices").cast("long").alias("n_rows"), "is_open")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY 1")
def chat_turns(spark, d):
    out = dataset.chat(table(spark, d, "conversations"))
    return out.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("rendered"))


@query("SELECT part, CAST(count(*) AS BIGINT) AS documents FROM (SELECT CASE WHEN CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296 < 0.2 THEN 'validation' ELSE 'train' END AS part FROM documents) GROUP BY 1")
def split_by_document(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return dataset.split(docs, 0.2).groupBy("part").agg(F.count(F.lit(1)).alias("documents"))


@query()
def sampled_empty_groups(spark, d):
    g, e = gold(spark, d)
    groups = text_group_pages(spark, d)[1]
    targets = dataset.field_targets(g, e, groups, spark.createDataFrame([("closing",)], "key string"))
    return dataset.sample_empty(groups.select("document_id", "group_index").distinct(), targets, 0.25)
