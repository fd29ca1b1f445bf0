"""Plans and partitions of queries whose cost or memory grew faster than their input."""

import os
import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.plans import catalogue
from docweave.sources import parts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"^[\s:+\-*()\d]*{node}\b", plan(df).partition("== Initial Plan ==")[0], re.M))


def test_dealt_follows_the_input(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    few = parts.dealt(df, "l_orderkey").rdd.getNumPartitions()
    monkeypatch.setattr(parts, "PART", parts.input_bytes(df) // 50)
    assert few == spark.sparkContext.defaultParallelism and 50 <= parts.dealt(df, "l_orderkey").rdd.getNumPartitions() <= 52


def test_split_rows_shuffles_once_and_splits_once(spark, sf_dir):
    df = catalogue.QUERIES["split_rows"](spark, sf_dir)
    assert count(df, "Exchange") == 1 and count(df, "SortMergeJoin") + count(df, "BroadcastHashJoin") == 0
    assert plan(df).count("split(") <= 2  # the line, its cells


def test_split_rows_as_split_row(spark):
    cols = [("line_number", "integer"), ("what", "string"), ("price", "currency")]
    lines = ["1  blue cup  $4.00", "2 | red\tx", "one cell", "", None, " ", "what  price", "| a | b |", "\ta\t \tb\r", "3  cup", " \x0ba  5", "What\tprice | $1.00"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    want = {r.i: r.m for r in df.select("i", X.split_row("t", cols).alias("m")).collect() if r.m is not None}
    assert {r.i: r.cells for r in X.split_rows(df, F.col("t"), cols).collect()} == want
    assert want[0] == {"line_number": "1", "what": "blue cup", "price": "$4.00"} and want[7] == {"what": "b"} and sorted(want) == [0, 1, 7, 8, 9, 10, 11]


def test_open_tables_joins_no_pages(spark, sf_dir):
    df = catalogue.QUERIES["open_tables"](spark, sf_dir)
    assert "group_index" not in "".join(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) \[.*", plan(df)))
    assert plan(df).count("split(") <= 2


def test_keyword_values_joins_no_pages_and_reads_places_once(spark, sf_dir):
    df = catalogue.QUERIES["keyword_values"](spark, sf_dir)
    assert not re.search(r"Join \[document_id", plan(df)) and len(re.findall(r"regexp_?instr\(", plan(df), re.I)) == 1


def test_profiles_share_blocks_and_what_one_grouping_reads(spark, sf_dir, monkeypatch):
    from docweave.plans import extraction
    from docweave.sources import scratch

    made, plain = [], scratch.materialise
    for m in (scratch, extraction):
        monkeypatch.setattr(m, "materialise", lambda df, name: (made.append(name), plain(df, name))[1])
    got = {(r.profile, r.reason): (r.documents, r.groups) for r in catalogue.QUERIES["profile_exits"](spark, sf_dir).collect()}
    assert made.count("blocks") == 1 and made.count("claims") == 2 and "attributed" not in made and got


def test_own_claims_without_a_block_id_are_looked_for(spark):
    from docweave.plans import extraction

    blocks = spark.createDataFrame([(1, 1, 0, None, "Invoice No: A-1"), (1, 1, 1, "b1", "Total: $2.00")], "document_id long, page_number int, pos int, block_id string, text string")
    groups = spark.createDataFrame([(1, 0, 1)], "document_id long, group_index int, page_number int")
    kinds = "document_id long, group_index int, claim_no string, block_id string, quote string, value string, confidence double, found_page int"
    claims = spark.createDataFrame([(1, 0, "a", None, "Invoice No: A-1", "A-1", 0.5, 1), (1, 0, "b", "b1", "Total: $2.00", "$2.00", 0.5, 1)], kinds)
    got = {r.claim_no: (r.rung, r.status, r.page_number, r.found_block) for r in extraction.own_claims(claims, blocks, groups).collect()}
    assert got == {"a": (3, "quote", 1, None), "b": (1, "exact", 1, "b1")}


@pytest.mark.parametrize("name", ["term_stats", "reading_order"])
def test_partitions_follow_the_input(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert count(df, "Exchange") == 1 and plan(df).count("REPARTITION_BY_NUM") == 1


@pytest.mark.parametrize("name", ["bm25_pages", "page_rank_topk", "group_rank", "field_explain"])
def test_ranking_counts_only_words_that_are_asked_for(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "LeftSemi" in text and "REPARTITION_BY_NUM" in text


def test_dealt_by_a_given_size(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert parts.dealt(df, "doc_id", size=parts.PART * 30).rdd.getNumPartitions() == 30


def test_attribution_ladder_shuffles_tables_once(spark, sf_dir):
    """What is dealt by document stays there: orders, rows and customers are shuffled, claims and blocks are not."""
    df = catalogue.QUERIES["attribution_ladder"](spark, sf_dir)
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan(df))) <= {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey"} and count(df, "SortMergeJoin") == 0
    whole = [s for s in re.findall(r"FileScan parquet \[(.*?)\].*?PushedFilters: (\[.*?\])", plan(df)) if "l_partkey" in s[0]]
    assert len(whole) > 1 and len({filters for _, filters in whole}) == 1  # one shuffle, used again


def test_looked_up_as_a_left_join(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (2, "b", 4), (None, "a", 5)], "k long, s string, n int")
    other = spark.createDataFrame([(1, "a", 7), (1, "a", 5), (1, None, 1), (3, "b", 2), (None, "a", 3)], "k long, s string, _value int")
    got = parts.looked_up(df, other, ["k", "s"], F.min, "least")
    assert got.columns == ["k", "s", "n", "least"] and {r.n: r.least for r in got.collect()} == {1: 5, 2: 5, 3: None, 4: None, 5: None}


def test_ladder_of_overlapping_groups_and_repeated_ids(spark):
    from docweave.operators import attribution

    blocks = spark.createDataFrame([(1, 1, 0, "a", "first total due"), (1, 2, 0, "a", "second total due"), (1, 2, 1, None, "Other-text, total"), (1, 3, 0, "c", None), (1, None, 0, "d", "no page")], "document_id long, page_number int, pos int, block_id string, text string")
    groups = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 1, 2), (1, 1, 3)], "document_id long, group_index int, page_number int")
    kinds = "document_id long, group_index int, claim_no string, block_id string, quote string, value string, confidence double"
    claims = [(1, 0, "id", "a", None, None, 1.0), (1, 1, "id", "a", "first total due", None, 1.0), (1, 0, "far", "c", None, None, 1.0), (1, 0, "lost", "d", None, None, None), (1, 1, "words", None, "total, OTHER text", None, 1.0), (1, 1, "out", "", "first total due", "first", 1.0), (1, 7, "none", "a", "total due", None, 1.0), (2, 0, "none", "a", "total due", None, 1.0)]
    got = {tuple(r)[:3]: (r.rung, r.page_number, r.found_block) for r in attribution.attribute(spark.createDataFrame(claims, kinds), blocks, groups).collect()}
    want = [(1, 1, "a"), (1, 2, "a"), (2, 3, "c"), (2, None, "d"), (4, 2, None), (None, None, None), (2, 1, "a"), (None, None, None)]
    assert got == {c[:3]: w for c, w in zip(claims, want, strict=True)}


def test_claim_merge_shuffles_no_claims(spark, sf_dir):
    df = catalogue.QUERIES["claim_merge"](spark, sf_dir)
    assert not re.search(r"Exchange hashpartitioning\((?:document_id|claim_no)#", plan(df)) and count(df, "SortMergeJoin") == 0


def test_citation_precision_shuffles_only_counts(spark, sf_dir):
    df = catalogue.QUERIES["citation_precision"](spark, sf_dir)
    assert not re.search(r"Exchange hashpartitioning\((?:document_id|claim_no)#", plan(df)) and count(df, "SortMergeJoin") == 0 and plan(df).count("Exchange SinglePartition") == 1


def shuffled_by_stage(spark):
    """Bytes that stages wrote for shuffles, by the stage's id; of many stages Spark keeps the last."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("name", ["claim_merge", "citation_precision"])
def test_attribution_shuffles_a_few_times_its_input(spark, sf_dir, name):
    read = sum(os.path.getsize(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    before = shuffled_by_stage(spark)
    catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert 0 < sum(n for stage, n in shuffled_by_stage(spark).items() if stage not in before) < 4 * read
