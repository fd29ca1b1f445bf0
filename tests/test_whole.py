"""Queries give all of what they are asked for: cases that a cut would lose."""

from docweave.plans import catalogue


def test_html_blocks_gives_whole_paragraphs(spark, tmp_path):
    html = (
        "<html><head><script>var t='<p>no</p>';</script></head><body><!-- <p>no</p> --><h1 class=\"a > b\">The <i>head</i></h1><p><b>Bold first</b>, then <a href='x'>a link</a>.<br>Next if 1 < 2 line."
        "<p id=it's>Open<ul><li>item</ul><P>Upper</P><pre>no</pre><p> <b> </b></p><h1><div>Deep head</div></h1><p>cut <b"
    )
    spark.createDataFrame([(1, html), (2, "plain")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n_blocks, r.text) for r in catalogue.QUERIES["html_blocks"](spark, str(tmp_path)).collect()}
    assert got == {1: (6, "The head\nBold first, then a link. Next if 1 < 2 line.\nOpen\nUpper\nDeep head\ncut"), 2: (0, "")}


def test_html_blocks_loses_no_text_of_the_tables(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in catalogue.QUERIES["html_blocks"](spark, sf_dir).collect():
        inner = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        want = html.unescape(re.sub(r"</?(?:p|h1|b)>|<br>", " ", inner))
        assert "".join(want.split()) == "".join(html.unescape(r.text).split())


def test_quote_match_tries_every_line_of_every_item(spark, tmp_path):
    from docweave.operators.attribution import quote_rung
    from pyspark.sql import functions as F

    items = ["First line of this item.\nA later line, of the item here", "Other passage that is planted somewhere", "über.\nab cd", "日本語の文", "", None, "one two three four five six seven eight nine ten", "Er.\n\n  "]
    docs = [
        "x\nso: a LATER  line, of the item here!\nxab cdx", "other passage that is planted elsewhere", "a über. b\n日本語の文。", "ten nine eight seven six five four", "ten nine eight seven six five", None, "", "nothing er. here",
        "First line of this item.\nother passage that is planted somewhere", "aFirst line of this item.",
    ]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    i.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["quote_match"](spark, str(tmp_path)).select("document_id", "item_id", "rung").collect()}
    assert {(0, 0, 3), (0, 2, 3), (1, 1, 4), (2, 2, 3), (2, 3, 3), (3, 6, 4), (8, 0, 3), (8, 1, 3), (9, 0, 3)} == got
    assert got == brute(d, i, quote_rung, F)


def test_quote_match_of_the_tables_by_brute_force(spark, sf_dir):
    from docweave.operators.attribution import quote_rung
    from pyspark.sql import functions as F

    got = {tuple(r) for r in catalogue.QUERIES["quote_match"](spark, sf_dir).select("document_id", "item_id", "rung").collect()}
    d, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got == brute(d, i, quote_rung, F)


def brute(docs, items, quote_rung, F):
    lines, quotes = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text")), items.select("item_id", F.explode(F.split("text", "\n")).alias("quote"))
    pairs = lines.crossJoin(quotes).withColumn("rung", quote_rung(F.col("quote"), F.col("text"))).where("rung is not null")
    return {tuple(r) for r in pairs.groupBy("doc_id", "item_id").agg(F.min("rung")).collect()}


def test_split_rows_of_an_order_with_many_lines(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = li.first().l_orderkey
    many = li.where(F.col("l_orderkey") == key).limit(1).withColumn("l_linenumber", F.explode(F.sequence(F.lit(1), F.lit(450))))
    many.select(li.columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["split_rows"](spark, str(tmp_path)).collect()
    assert sorted((r.document_id, r.seq, r.line_number) for r in got) == [(key, n, str(n + 1)) for n in range(450)]
