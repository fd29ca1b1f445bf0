"""Queries over pages and blocks: scans, layout, grouping, retrieval, extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, text as X
from ..operators import extract, grouping, layout, retrieval
from ..sources import documents as D
from ..sources.parts import dealt
from .registry_of_queries import query, table
from .schemas import INVOICE

# --- CTEs that the SQL shares

BLOCKS = """blk AS (
  SELECT doc_id AS document_id, CAST(n // 5 + 1 AS INTEGER) AS page_number, CAST(n % 5 AS INTEGER) AS pos, 'p' || (n // 5 + 1) || 'b' || n AS block_id,
    line AS text, (n % 5) / 5.0 AS y0, (n % 5 + 1) / 5.0 AS y1
  FROM (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""
PAGES = BLOCKS + """, pg AS (
  SELECT document_id, page_number, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE trim(text, ' ') <> ''), '') AS text FROM blk GROUP BY ALL)"""
ROW_ORDER = ", ".join(D.ROW_ORDER)
ORDER_ROWS = f"orow AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW_ORDER}) - 1 AS n FROM lineitem)"
ORDER_BLOCKS = ORDER_ROWS + """, ob AS (
  SELECT o_orderkey AS document_id, 1 AS page_number, k AS pos, 'key_value' AS block_type,
    CASE k WHEN 0 THEN 'Invoice No: INV-' || o_orderkey WHEN 1 THEN 'Invoice Date: ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'Bill To: ' || coalesce(c_name, 'unknown') ELSE 'Currency: USD' END AS text
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey, (SELECT unnest(range(0, 4)) AS k)
  UNION ALL
  SELECT l_orderkey, n // 6 + 1, n % 6 + 4, 'table_row', l_linenumber || '  part ' || l_partkey || '  ' || CAST(l_quantity AS INTEGER) || '  $' || printf('%.2f', l_extendedprice) FROM orow
  UNION ALL
  SELECT o_orderkey, last, 10, 'key_value', 'Total: $' || printf('%.2f', o_totalprice) FROM orders JOIN (SELECT l_orderkey, max(n) // 6 + 1 AS last FROM orow GROUP BY 1) ON l_orderkey = o_orderkey),
obk AS (SELECT *, 'p' || page_number || 'b' || pos AS block_id, pos / 11.0 AS y0, (pos + 1) / 11.0 AS y1 FROM ob)"""


def text_blocks(spark, d):
    return D.text_blocks(table(spark, d, "documents"))


def text_blocks_dealt(spark, d):
    """text_blocks(), by document in partitions that follow the length of the texts (one more scan): pages and their words are counted where they are."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return D.text_blocks(dealt(documents, "doc_id", size=size))


def text_pages(spark, d):
    return layout.page_texts(text_blocks_dealt(spark, d))


def order_blocks(spark, d):
    return D.order_blocks(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer"))


def one_group(blocks):
    return blocks.select("document_id", "page_number").distinct().select("document_id", F.lit(0).alias("group_index"), "page_number")


# --- scans and layout


@query(f"WITH {BLOCKS} SELECT document_id, page_number, pos, block_id, CAST(length(text) AS BIGINT) AS n_chars FROM blk")
def block_scan(spark, d):
    return text_blocks(spark, d).select("document_id", "page_number", F.col("pos").cast("int").alias("pos"), "block_id", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {PAGES} SELECT document_id, page_number, text, CAST(length(text) AS BIGINT) AS n_chars FROM pg")
def page_text(spark, d):
    return text_pages(spark, d)


@query(f"WITH {BLOCKS} SELECT document_id, block_id, '[' || block_id || '|paragraph] ' || text AS line, 'p' || page_number || ':' || block_id AS cite, CAST(length(text) // 4 AS BIGINT) AS tokens FROM blk")
def block_render(spark, d):
    b = text_blocks(spark, d)
    return b.select("document_id", "block_id", layout.render(b).alias("line"), X.cite("page_number", "block_id").alias("cite"), X.token_estimate(F.length("text")).alias("tokens"))


@query(f"""WITH {BLOCKS}, l AS (SELECT document_id, page_number, pos, '[' || block_id || '|paragraph] ' || text AS line FROM blk),
u AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id, page_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) > 600 AS over FROM l),
c AS (SELECT *, coalesce(pos < min(pos) FILTER (WHERE over) OVER (PARTITION BY document_id, page_number), true) AS shown FROM u)
SELECT document_id, page_number, count(*) FILTER (WHERE shown) AS n_shown, count(*) AS n_blocks,
  concat_ws(chr(10), string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE shown), CASE WHEN bool_or(NOT shown) THEN '{layout.CUT_MARK}' END) AS layout
FROM c GROUP BY ALL""")
def budgeted_layout(spark, d):
    return layout.budgeted(text_blocks(spark, d), 600)


@query(rf"""WITH {BLOCKS}, g AS (SELECT document_id, trim(text, ' ') AS t, pos * 0.23 + 0.02 AS y0, pos * 0.23 + 0.07 AS y1 FROM blk)
SELECT document_id, CASE WHEN t = '' THEN 'other' WHEN y1 <= 0.08 THEN 'page_header' WHEN y0 >= 0.92 THEN 'page_footer'
  WHEN regexp_matches(t, '^[A-Z0-9][A-Z0-9 \-&/,.]{{3,}}$') AND length(t) < 80 THEN 'heading'
  WHEN regexp_matches(t, '^\s*\S[^:\n]{{0,40}}:\s*\S') THEN 'key_value'
  WHEN regexp_matches(lower(t), '^(signed|signature|by:)') THEN 'signature' ELSE 'paragraph' END AS role, count(*) AS n FROM g GROUP BY ALL""")
def block_roles(spark, d):
    b = text_blocks(spark, d)
    return b.select("document_id", D.infer_role(F.col("text"), F.col("pos") * 0.23 + 0.02, F.col("pos") * 0.23 + 0.07).alias("role")).groupBy("document_id", "role").agg(F.count(F.lit(1)).alias("n"))


_BOXES = "SELECT *, l_discount AS ax, l_tax AS ay, l_discount + 0.4 AS bx, l_tax + 0.4 AS by_, l_quantity / 100 AS cx, 0.02 AS cy, l_quantity / 100 + 0.3 AS dx, 0.3 AS dy FROM lineitem"


@query(f"""WITH b AS ({_BOXES}), w AS (SELECT *, least(bx, dx) - greatest(ax, cx) AS w, least(by_, dy) - greatest(ay, cy) AS h, (bx - ax) * (by_ - ay) + (dx - cx) * (dy - cy) AS s FROM b)
SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE w > 0 AND h > 0) AS n_overlap, round(avg(CASE WHEN w > 0 AND h > 0 THEN w * h / (s - w * h) ELSE 0 END), 6) AS mean_iou FROM w GROUP BY ALL""")
def bbox_iou(spark, d):
    q = F.col("l_quantity") / 100
    a, b = geometry.box(F.col("l_discount"), F.col("l_tax"), F.col("l_discount") + 0.4, F.col("l_tax") + 0.4), geometry.box(q, 0.02, q + 0.3, 0.3)
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", geometry.iou(a, b).alias("iou"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.when(F.col("iou") > 0, 1)).alias("n_overlap"), F.round(F.avg("iou"), 6).alias("mean_iou"))


@query("SELECT p_partkey, round(least(greatest(p_size / 40.0, 0), 1), 6) AS x0, round(least(greatest((p_retailprice - 1000) / 600, 0), 1), 6) AS y0 FROM part")
def bbox_normalise(spark, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice") - 1000
    b = geometry.normalise(size, price, size, price, F.lit(40.0), F.lit(600.0))
    return table(spark, d, "part").select("p_partkey", b.alias("b")).select("p_partkey", F.round("b.x0", 6).alias("x0"), F.round("b.y0", 6).alias("y0"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN 0.55 ELSE 0.05 END AS x0, l_quantity / 100 AS y0,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem),
t AS (SELECT *, x0 + 0.2 AS c FROM b),
f AS (SELECT l_orderkey, count(*) FILTER (WHERE c < 0.5) >= 3 AND count(*) FILTER (WHERE c >= 0.5) >= 3 AS two FROM t GROUP BY 1)
SELECT l_orderkey AS document_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN two AND c >= 0.5 THEN 1 ELSE 0 END, round(y0, 3), x0, pos) - 1 AS INTEGER) AS reading_order FROM t JOIN f USING (l_orderkey)""")
def reading_order(spark, d):
    # Rows equal up to l_quantity have one box: what breaks their ties isn't shuffled.
    order = D.SHOWN_ORDER[: D.SHOWN_ORDER.index("l_quantity") + 1]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    x0 = F.when(F.col("l_linenumber") % 2 == 0, 0.55).otherwise(0.05)
    b = dealt(table(spark, d, "lineitem").select("l_orderkey", *order), "l_orderkey").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), pos.alias("pos"), x0.alias("x0"), (x0 + 0.4).alias("x1"), (F.col("l_quantity") / 100).alias("y0"))
    return layout.reading_order(b).select("document_id", F.col("pos").cast("int").alias("pos"), F.col("reading_order").cast("int").alias("reading_order"))


@query("SELECT conv_id AS document_id, string_agg(text, ' ' ORDER BY turn) AS text, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def service_text(spark, d):
    turns = table(spark, d, "conversations")
    word = turns.select(F.col("conv_id").alias("document_id"), F.lit(1).alias("page"), F.col("turn").alias("seq"), F.concat(F.lit("w"), F.col("turn").cast("string")).alias("id"), F.lit("LINE").alias("kind"), "text", F.lit(90.0).alias("confidence"), F.array().cast("array<string>").alias("children"))
    head = word.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("children"))
    head = head.select("document_id", F.lit(1).alias("page"), F.lit(-1).cast("long").alias("seq"), F.lit("head").alias("id"), F.lit("LAYOUT_TEXT").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(90.0).alias("confidence"), "children")
    n = word.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return D.service_blocks(word.unionByName(head)).select("document_id", "text").join(n, "document_id")


#: What stands in html without being read, the rest of a tag, and any tag, be it cut off.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_ATTRIBUTES = r"(?:[\s/](?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)?"
TAG = rf"(?i)</?[a-z][a-z0-9:-]*+{_ATTRIBUTES}(?:>|\z)|<[!?][^>]*(?:>|\z)"
_BLOCK = "address|article|aside|blockquote|body|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
#: A p ends at any block-level tag; an h1 can hold such, it ends at its own end tag, a heading, a p or the end of a section.
TEXT_BLOCK = rf"(?is)<p{_ATTRIBUTES}>.*?(?=</?(?:{_BLOCK})[\s/>]|\z)|<h1{_ATTRIBUTES}>.*?(?=</?h[1-6][\s/>]|<p[\s/>]|</(?:article|body|html|main|section)[\s/>]|\z)"


#: The same for DuckDB, without look-ahead: block-level tags become marks (\x01; \x02 where a p or h1 begins), pieces are cut at them.
_BLOCK_SQL = rf"""WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(?:p|h1)(?:\s[^>]*)?>', chr(1) || chr(2), 'g'), '(?i)</?(?:{_BLOCK})(?:[\s/][^>]*)?>', chr(1), 'g') AS h FROM h),
p AS (SELECT page_id, list_filter(list_transform(list_filter(string_split(h, chr(1)), lambda x: starts_with(x, chr(2))), lambda x: trim(regexp_replace(regexp_replace(substr(x, 2), '(?i)<br\b[^>]*>', ' ', 'g'), '<[^>]*(?:>|\z)', '', 'g'), ' ')), lambda x: x <> '') AS ps FROM m)
SELECT page_id, CAST(len(ps) AS BIGINT) AS n_blocks, array_to_string(ps, chr(10)) AS text FROM p"""


@query(_BLOCK_SQL)
def html_blocks(spark, d):
    """Each p and h1 whole: up to its end or the next tag that ends it, without the inline tags."""
    html = F.regexp_replace("html", UNSEEN, "")
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\b[^>]*>", " "), TAG, ""))
    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit(TEXT_BLOCK), 0), text), lambda x: x != "")
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n_blocks"), F.array_join(found, "\n").alias("text"))


# --- grouping


def order_page_ends(spark, d):
    return grouping.page_ends(order_blocks(spark, d))


@query(f"""WITH {ORDER_BLOCKS}, f AS (SELECT *, max(y1) FILTER (WHERE block_type = 'table_row') OVER (PARTITION BY document_id, page_number) AS foot, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y1 DESC, pos) AS low FROM obk),
a AS (SELECT document_id, page_number, string_agg(lower(text), chr(10)) AS t, max(foot) AS foot, bool_or(y0 >= foot AND regexp_matches(lower(text), 'total|subtotal|balance|sum')) AS totals FROM f GROUP BY ALL),
m AS (SELECT *, regexp_matches(t, 'continued|cont\\.|carried forward|brought forward') OR (coalesce(foot >= 0.8, false) AND NOT coalesce(totals, false)) AS mid_table FROM a)
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, mid_table, CASE WHEN mid_table THEN 1.0 ELSE 0.2 END::DOUBLE AS penalty FROM m""")
def mid_table_pages(spark, d):
    return order_page_ends(spark, d)


@query(rf"""WITH {BLOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y1 DESC, pos) AS low FROM blk)
SELECT document_id, page_number, CASE WHEN regexp_matches(string_agg(lower(text), chr(10)), 'continued|cont\.|carried forward|brought forward') THEN 1.0
  WHEN bool_or(low = 1 AND NOT regexp_matches(lower(text), '[.!?:]\s*$')) THEN 0.5 ELSE 0.2 END::DOUBLE AS penalty FROM f GROUP BY ALL""")
def boundary_penalty(spark, d):
    return grouping.page_ends(text_blocks(spark, d)).select("document_id", "page_number", "penalty")


CONFIG = grouping.Grouping(max_pages=4, overlap=1, max_chars=3000)


def text_group_pages(spark, d):
    b = text_blocks_dealt(spark, d)
    pages = layout.page_texts(b).join(grouping.page_ends(b), ["document_id", "page_number"])
    return pages, grouping.group_pages(pages, CONFIG)


def _admitted(first: str, n: str) -> str:
    """How many pages from list place `first` (1-based) fit, of up to four."""
    sums = [" + ".join(f"ch[{first} + {j}]" for j in range(k + 1)) for k in range(4)]
    return f"CASE WHEN {first} + 1 > {n} OR {sums[1]} > 3000 THEN 1 WHEN {first} + 2 > {n} OR {sums[2]} > 3000 THEN 2 WHEN {first} + 3 > {n} OR {sums[3]} > 3000 THEN 3 ELSE 4 END"


def _better(k: int, was: str) -> str:
    return f"(k{k} AND pe[st + {k}] + 0.25 < {was})"


GROUPS = PAGES + rf""", pen AS (SELECT document_id, page_number, CASE WHEN regexp_matches(string_agg(lower(text), chr(10)), 'continued|cont\.|carried forward|brought forward') THEN 1.0
    WHEN bool_or(low = 1 AND NOT regexp_matches(lower(text), '[.!?:]\s*$')) THEN 0.5 ELSE 0.2 END AS penalty
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y1 DESC, pos) AS low FROM blk) GROUP BY ALL),
ar AS (SELECT document_id, list(length(text) ORDER BY page_number) AS ch, list(penalty ORDER BY page_number) AS pe, CAST(count(*) AS INTEGER) AS n FROM pg JOIN pen USING (document_id, page_number) GROUP BY 1),
c0 AS (SELECT *, unnest(range(0, n)) AS i FROM ar),
c1 AS (SELECT *, least(1, i) AS ov, {_admitted("(i - least(1, i) + 1)", "n")} AS k FROM c0),
c2 AS (SELECT *, k <= ov AS dropped FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN dropped THEN 0 ELSE ov END AS ov, CASE WHEN dropped THEN {_admitted("(i + 1)", "n")} ELSE k END AS k) FROM c2),
c4 AS (SELECT *, i - ov AS st, pe[i - ov + k] AS p0, greatest(1, ov + 1) AS lo FROM c3),
c5 AS (SELECT *, lo <= 1 AND 1 < k AS k1, lo <= 2 AND 2 < k AS k2, lo <= 3 AND 3 < k AS k3 FROM c4),
c6 AS (SELECT *, CASE WHEN {_better(1, "p0")} THEN pe[st + 1] ELSE p0 END AS p1, CASE WHEN {_better(1, "p0")} THEN 1 ELSE k END AS b1 FROM c5),
c7 AS (SELECT *, CASE WHEN {_better(2, "p1")} THEN pe[st + 2] ELSE p1 END AS p2, CASE WHEN {_better(2, "p1")} THEN 2 ELSE b1 END AS b2 FROM c6),
nx AS (SELECT document_id, i, st, dropped, st + CASE WHEN {_better(3, "p2")} THEN 3 ELSE b2 END AS nxt, pe FROM c7)"""
ORBIT = """, orb AS (SELECT document_id, 0 AS g, i, st, nxt, dropped, pe FROM nx WHERE i = 0 UNION ALL SELECT nx.document_id, orb.g + 1, nx.i, nx.st, nx.nxt, nx.dropped, nx.pe FROM orb JOIN nx ON nx.document_id = orb.document_id AND nx.i = orb.nxt),
gp AS (SELECT document_id, CAST(g AS INTEGER) AS group_index, CAST(p + 1 AS INTEGER) AS page_number, g > 0 AND p < i AS is_overlap, g > 0 AND pe[i] = 1.0 AS continues_table, dropped AS overlap_dropped FROM (SELECT *, unnest(range(st, nxt)) AS p FROM orb))"""


@query(f"WITH RECURSIVE {GROUPS}{ORBIT} SELECT * FROM gp")
def page_groups(spark, d):
    return text_group_pages(spark, d)[1]


@query(f"WITH RECURSIVE {GROUPS}{ORBIT} SELECT document_id, group_index, count(*) AS n_pages, count(*) FILTER (WHERE NOT is_overlap) AS n_new, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(page_number) AS first_page, max(page_number) AS last_page, bool_or(continues_table) AS continues_table FROM gp JOIN pg USING (document_id, page_number) GROUP BY ALL")
def group_summary(spark, d):
    pages, groups = text_group_pages(spark, d)
    return grouping.group_sizes(groups, pages)


@query(f"WITH RECURSIVE {GROUPS}{ORBIT} SELECT document_id, group_index, string_agg('--- PAGE ' || page_number || CASE WHEN is_overlap THEN ' (seen before)' ELSE '' END || ' ---' || chr(10) || text, chr(10) ORDER BY page_number) AS layout FROM gp JOIN pg USING (document_id, page_number) GROUP BY ALL")
def group_layout(spark, d):
    pages, groups = text_group_pages(spark, d)
    return layout.group_layout(pages.select("document_id", "page_number", "text"), groups)


@query(f"WITH {PAGES} SELECT document_id, CAST(count(*) AS BIGINT) AS n_uncovered FROM pg WHERE false GROUP BY 1")
def uncovered_pages(spark, d):
    """Pages in no group: there must be none."""
    pages, groups = text_group_pages(spark, d)
    return pages.join(groups.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_uncovered"))


# --- retrieval

TERMS = {"alpha": "thly erin thor ndea thly eaer the", "beta": "mente ueas rrja esta ado mente", "gamma": "einheit schtz erver eaux ment"}
REGIONS = {"alpha": "front", "beta": "back", "gamma": "every"}
_ROWS = [("alpha", "front", t, n) for t, n in (("thly", 2), ("erin", 1), ("thor", 1), ("ndea", 1), ("eaer", 1))] + [("beta", "back", t, n) for t, n in (("mente", 2), ("ueas", 1), ("rrja", 1), ("esta", 1), ("ado", 1))] + [("gamma", "every", t, 1) for t in ("einheit", "schtz", "erver", "eaux", "ment")]
TERMS_SQL = "terms(field, region, token, qtf) AS (VALUES " + ", ".join(f"('{f}', '{r}', '{t}', {n})" for f, r, t, n in _ROWS) + ")"
STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
STATS = PAGES + f""", tk AS (SELECT document_id, page_number, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{STOPS}], x)) AS ts FROM pg),
ln AS (SELECT document_id, page_number, len(ts) AS n_tokens, count(*) OVER (PARTITION BY document_id) AS n_pages, avg(len(ts)) OVER (PARTITION BY document_id) AS mean_tokens FROM tk),
tf AS (SELECT document_id, page_number, token, count(*) AS tf FROM (SELECT document_id, page_number, unnest(ts) AS token FROM tk) GROUP BY ALL),
ps AS (SELECT *, count(*) OVER (PARTITION BY document_id, token) AS df FROM tf)"""
LEX = STATS + f""", {TERMS_SQL}, lex AS (SELECT document_id, page_number, field, sum(qtf * ln(1 + (n_pages - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(n_tokens, 1) / CASE WHEN mean_tokens > 0 THEN mean_tokens ELSE 1 END))) AS lexical
  FROM ps JOIN terms USING (token) JOIN ln USING (document_id, page_number) GROUP BY ALL)"""
SCORES = LEX + """, gr AS (SELECT document_id, page_number, n_pages, field, region, coalesce(lexical, 0) AS lexical FROM ln CROSS JOIN (SELECT DISTINCT field, region FROM terms) LEFT JOIN lex USING (document_id, page_number, field)),
fs AS (SELECT *, max(lexical) OVER (PARTITION BY document_id, field) AS best, CASE WHEN n_pages > 1 THEN CASE region WHEN 'front' THEN 1.5 * greatest(0, 1 - 2.5 * (page_number - 1) / (n_pages - 1)) WHEN 'back' THEN 1.5 * greatest(0, ((page_number - 1) / (n_pages - 1) - 0.6) / 0.4) ELSE 0.25 END ELSE 0 END AS prior FROM gr),
sc AS (SELECT document_id, page_number, sum(lexical + prior) AS score, list_sort(list(DISTINCT field) FILTER (WHERE best > 0 AND lexical >= 0.55 * best)) AS m FROM fs WHERE lexical + prior > 0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY round(score, 9) DESC, page_number) AS rank FROM sc)"""


def terms(spark):
    return retrieval.query_terms(spark, TERMS, REGIONS)


@query(f"WITH {STATS} SELECT document_id, page_number, token, tf, df FROM ps")
def term_stats(spark, d):
    return retrieval.term_stats(text_pages(spark, d))[0]


@query(f"WITH {LEX} SELECT document_id, page_number, field, round(lexical, 6) AS lexical FROM lex")
def bm25_pages(spark, d):
    return retrieval.bm25(text_pages(spark, d), terms(spark)).withColumn("lexical", F.round("lexical", 6))


@query(f"WITH {SCORES} SELECT document_id, page_number, round(score, 6) AS score, coalesce(array_to_string(m, ','), '') AS matched, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5")
def page_rank_topk(spark, d):
    out = retrieval.rank_pages(text_pages(spark, d), terms(spark), 5)
    return out.select("document_id", "page_number", F.round("score", 6).alias("score"), F.array_join("matched_fields", ",").alias("matched"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH RECURSIVE {GROUPS}{ORBIT}, {SCORES[len(PAGES) + 2:]} SELECT document_id, group_index, round(coalesce(avg(coalesce(score, 0)) FILTER (WHERE NOT is_overlap), avg(coalesce(score, 0))), 6) AS score FROM gp LEFT JOIN sc USING (document_id, page_number) GROUP BY ALL")
def group_rank(spark, d):
    pages, groups = text_group_pages(spark, d)
    return retrieval.rank_groups(groups, pages, terms(spark)).select("document_id", "group_index", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY round(lexical + prior, 9) DESC, page_number) AS r FROM fs WHERE lexical + prior > 0) SELECT document_id, field, string_agg('p' || page_number, ', ' ORDER BY r) AS pages FROM t WHERE r <= 3 GROUP BY ALL")
def field_explain(spark, d):
    out = retrieval.explain(text_pages(spark, d), terms(spark))
    return out.select("document_id", "field", F.regexp_replace("pages", r" \([^)]*\)", "").alias("pages"))


# --- extraction


@query(f"""WITH {ORDER_ROWS} SELECT o_orderkey AS document_id, key, value FROM (
  SELECT o_orderkey, unnest(['invoice_number', 'invoice_date', 'bill_to', 'currency', 'total_amount']) AS key,
    unnest(['INV-' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), coalesce(c_name, 'unknown'), 'USD', CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN '$' || printf('%.2f', o_totalprice) END]) AS value
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey) WHERE value IS NOT NULL""")
def keyword_values(spark, d):
    b = order_blocks(spark, d)
    return extract.field_values(dealt(extract.line_values(b, INVOICE), "document_id").withColumn("group_index", F.lit(0)), INVOICE).select("document_id", "key", "value")


@query(f"""WITH {ORDER_ROWS} SELECT l_orderkey AS document_id, CAST(n AS INTEGER) AS seq, CAST(l_linenumber AS VARCHAR) AS line_number, 'part ' || l_partkey AS description, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, '$' || printf('%.2f', l_extendedprice) AS unit_price FROM orow""")
def split_rows(spark, d):
    b = order_blocks(spark, d)
    rows = extract.table_rows(b.withColumn("group_index", F.lit(0)), INVOICE)
    return rows.select("document_id", (F.col("seq") - 1).cast("int").alias("seq"), *(F.col("cells")[c].alias(c) for c in ("line_number", "description", "quantity", "unit_price")))


@query(f"WITH {ORDER_BLOCKS} SELECT document_id, CAST(page_number AS INTEGER) AS page_number, bool_or(block_type = 'table_row') AS is_open FROM obk GROUP BY ALL")
def open_tables(spark, d):
    """Each page as a group of its own."""
    b = order_blocks(spark, d)
    grouped = b.withColumn("group_index", F.col("page_number"))
    rows = extract.table_rows(grouped, INVOICE)
    return extract.open_groups(grouped, rows, list(INVOICE.tables[0].markers)).select("document_id", F.col("group_index").alias("page_number"), "is_open")
