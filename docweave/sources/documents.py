"""Documents as tables: readers, writers and adapters that give blocks.

blocks(document_id, page_number, pos, block_id, block_type, text, y0, y1, reading_order, row_index): one row
for each layout block; further box columns may stand beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .parts import dealt, input_bytes, looked_up

BLOCK_TYPES = "title heading paragraph table table_header table_row key_value page_header page_footer figure signature other".split()
BLOCK = "block_id string, block_type string, text string, bbox array<double>, confidence double, reading_order int, row_index int"
PAGE = f"page_number int, width int, height int, image_path string, blocks array<struct<{BLOCK}>>"
DOCUMENT = f"document_id string, source_path string, metadata map<string,string>, pages array<struct<{PAGE}>>"
LINES_PER_PAGE = 5
ROWS_PER_PAGE = 6


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Labelled documents: document, gold, gold_evidence, row_pages; in order of file name by `file`."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", pattern)
    df = df.json(path)
    return df.withColumn("file", F.col("_metadata.file_name"))


def to_blocks(documents: DataFrame) -> DataFrame:
    """Explodes nested documents; unknown block types raise, unset values get their defaults."""
    pages = documents.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.*")
    blocks = pages.select("document_id", "page_number", "width", "height", F.posexplode("blocks").alias("pos", "b")).select("document_id", "page_number", "width", "height", "pos", "b.*")
    kind = F.when(F.coalesce("block_type", F.lit("paragraph")).isin(BLOCK_TYPES), F.coalesce("block_type", F.lit("paragraph"))).otherwise(F.raise_error(F.concat(F.lit("unknown block type "), F.col("block_type"))).cast("string"))
    return blocks.select(
        "document_id", "page_number", "width", "height", "pos", "block_id", kind.alias("block_type"), F.coalesce("text", F.lit("")).alias("text"),
        *(F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("reading_order", F.lit(0)).alias("reading_order"), "row_index",
    )


def to_documents(blocks: DataFrame) -> DataFrame:
    """The inverse of to_blocks()."""
    block = F.struct("pos", "block_id", "block_type", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "confidence", "reading_order", "row_index")
    pages = blocks.groupBy("document_id", "page_number", "width", "height").agg(F.sort_array(F.collect_list(block)).alias("bs"))
    pages = pages.withColumn("blocks", F.transform("bs", lambda b: F.struct(*(b[k].alias(k) for k in ("block_id", "block_type", "text", "bbox", "confidence", "reading_order", "row_index")))))
    page = F.struct("page_number", "width", "height", "blocks")
    return pages.groupBy("document_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A run's artefacts: its summary, and results by document."""
    write_json(summary, f"{path}/run")
    results.write.mode("overwrite").partitionBy("document_id").json(f"{path}/documents")


def metric_log(metrics: DataFrame, run: str) -> DataFrame:
    """Numeric columns in long form (run, name, value)."""
    names = [n for n, t in metrics.dtypes if t in ("double", "bigint", "int", "float")]
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return metrics.select(F.lit(run).alias("run"), F.expr(f"stack({len(names)}, {pairs}) as (name, value)"))


def infer_role(text: Column, y0: Column, y1: Column, default: str = "paragraph") -> Column:
    """A block's role by ordered rules."""
    t = F.trim(text)
    return (
        F.when(t == "", "other")
        .when(y1 <= 0.08, "page_header")
        .when(y0 >= 0.92, "page_footer")
        .when(t.rlike(r"^[A-Z0-9][A-Z0-9 \-&/,.]{3,}$") & (F.length(t) < 80), "heading")
        .when(t.rlike(r"^\s*\S[^:\n]{0,40}:\s*\S") & ~t.contains("\n"), "key_value")
        .when(F.lower(t).rlike("^(signed|signature|by:)"), "signature")
        .otherwise(default)
    )


#: What service block types mean here (fixed values).
SERVICE_ROLES = {
    "LAYOUT_TITLE": "title",
    "LAYOUT_SECTION_HEADER": "heading",
    "LAYOUT_HEADER": "page_header",
    "LAYOUT_FOOTER": "page_footer",
    "LAYOUT_TEXT": "paragraph",
    "LAYOUT_TABLE": "table",
    "LAYOUT_KEY_VALUE": "key_value",
    "LAYOUT_FIGURE": "figure",
    "TABLE": "table",
    "CELL": "table_row",
}
SERVICE_PAGES = 500


def service_blocks(raw: DataFrame) -> DataFrame:
    """An OCR service's flat blocks (document_id, page, seq, id, kind, text, confidence per cent, children array<string>)
    as blocks; a block without text gets the texts of its children, in their order."""
    roles = F.create_map(*(F.lit(x) for kv in SERVICE_ROLES.items() for x in kv))
    mine = raw.where(F.col("page") <= SERVICE_PAGES).withColumn("block_type", roles[F.col("kind")]).where("block_type is not null")
    parts = mine.where(F.coalesce("text", F.lit("")) == "").select("document_id", "id", F.posexplode("children").alias("n", "child"))
    words = raw.where(F.col("kind").isin("WORD", "LINE")).select("document_id", F.col("id").alias("child"), F.col("text").alias("word"))
    joined = parts.join(words, ["document_id", "child"]).groupBy("document_id", "id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ws"))
    texts = joined.select("document_id", "id", F.array_join(F.col("ws.word"), " ").alias("joined"))
    out = mine.join(texts, ["document_id", "id"], "left")
    pos = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("seq")) - 1
    return out.select("document_id", F.col("page").alias("page_number"), pos.alias("pos"), F.col("id").alias("block_id"), "block_type", F.coalesce(F.nullif("text", F.lit("")), "joined", F.lit("")).alias("text"), (F.col("confidence") / 100).alias("confidence"))


def text_blocks(documents: DataFrame, lines: int = LINES_PER_PAGE) -> DataFrame:
    """A table (doc_id, text) as documents: a block for each line, `lines` to a page. No shuffle."""
    split = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return split.select(
        "document_id",
        (F.floor(F.col("n") / lines) + 1).cast("int").alias("page_number"),
        (F.col("n") % lines).alias("pos"),
        F.concat(F.lit("p"), (F.floor(F.col("n") / lines) + 1).cast("string"), F.lit("b"), F.col("n").cast("string")).alias("block_id"),
        F.lit("paragraph").alias("block_type"),
        "text",
        ((F.col("n") % lines) / lines).alias("y0"),
        ((F.col("n") % lines + 1) / lines).alias("y1"),
        (F.col("n") % lines).alias("reading_order"),
    )


def order_rows(lineitem: DataFrame) -> DataFrame:
    """lineitem with n, its place in its order from 0. Only the columns that a block shows, or that stand before such in
    ROW_ORDER: rows equal in those give equal blocks, so the others need not be shuffled to break their ties."""
    order = Window.partitionBy("l_orderkey").orderBy(*SHOWN_ORDER)
    return dealt(lineitem.select("l_orderkey", *SHOWN_ORDER), "l_orderkey", size=order_bytes(lineitem)).withColumn("n", F.row_number().over(order) - 1)


def order_bytes(lineitem: DataFrame) -> int:
    """What orders as documents are dealt by: a row's block is about four times as long as the row in its file."""
    return 4 * input_bytes(lineitem)


def order_blocks(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as invoices: a head block for each field, rows of line items, ROWS_PER_PAGE to a page, and totals on the last page."""
    size = order_bytes(lineitem)  # heads go where order_rows() deals their rows
    sizes = dealt(lineitem.select("l_orderkey"), "l_orderkey", size=size).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_value"))
    head = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    head = looked_up(dealt(head, "o_orderkey", size=size), sizes, ["o_orderkey"], F.max, "_rows").withColumn("_last", (F.floor((F.col("_rows") - 1) / ROWS_PER_PAGE) + 1).cast("int"))
    money = lambda c: F.format_string("$%.2f", c)
    field = lambda page, n, label, value: F.struct(page.alias("page_number"), F.lit(n).alias("pos"), F.concat(F.lit(label), value).alias("text"))
    fields = [
        field(F.lit(1), 0, "Invoice No: ", F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))),
        field(F.lit(1), 1, "Invoice Date: ", F.date_format("o_orderdate", "yyyy-MM-dd")),
        field(F.lit(1), 2, "Bill To: ", F.coalesce("c_name", F.lit("unknown"))),
        field(F.lit(1), 3, "Currency: ", F.lit("USD")),
    ]
    total = field(F.col("_last"), 10, "Total: ", money("o_totalprice"))
    heads = head.select(F.col("o_orderkey").alias("document_id"), F.explode(F.when(F.col("_last").isNull(), F.array(*fields)).otherwise(F.array(*fields, total))).alias("b"))
    heads = heads.select("document_id", "b.page_number", "b.pos", F.lit("key_value").alias("block_type"), "b.text")
    rows = order_rows(lineitem).select(
        F.col("l_orderkey").alias("document_id"), (F.floor(F.col("n") / ROWS_PER_PAGE) + 1).cast("int").alias("page_number"), (F.col("n") % ROWS_PER_PAGE + 4).cast("int").alias("pos"), F.lit("table_row").alias("block_type"),
        F.concat_ws("  ", F.col("l_linenumber").cast("string"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string"), money("l_extendedprice")).alias("text"),
    )
    out = heads.unionByName(rows)
    return out.withColumns({"block_id": F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("b"), F.col("pos").cast("string")), "y0": F.col("pos") / 11, "y1": (F.col("pos") + 1) / 11, "reading_order": F.col("pos")})


#: (l_orderkey, l_linenumber) isn't unique: all other columns break ties.
ROW_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: Of these the ones up to the last that a block shows.
SHOWN_ORDER = ROW_ORDER[:5]
