"""Operators against plain Python folds, and their stated cases."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import geometry, text as X
from docweave.operators import attribution, dataset, early_exit, envelope, extract, grouping, layout, metrics, registry, retrieval, state, validate
from docweave.plans import config, dag, extraction, schemas
from docweave.sources import documents as D
from docweave.streaming import merge


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


# --- functions


@pytest.mark.parametrize(
    "kind, cases",
    [
        ("string", {" a ": "a", "": None, "  ": None}),
        ("integer", {"1,204": "1204", " 7 ": "7", "7.5": None, "x": None}),
        ("number", {"1,204.5": "1204.5", "3": "3.0", "abc": None}),
        ("boolean", {"Yes": "true", "1": "true", "n": "false", "perhaps": None}),
        ("date", {"2026-01-05": "2026-01-05", "1/5/2026": None, "01/05/2026": "01/05/2026", "5  Jan 2026": "5  Jan 2026", "next week": None}),
        ("currency", {"$1,204.50": "$1,204.50", "-3": "-3", "12 EUR": None}),
        ("enum", {"usd": "USD", "yen": None}),
    ],
)
def test_coerce(spark, kind, cases):
    assert values(spark, lambda c: X.coerce(c, kind, ["USD", "EUR"]), list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    "a, b, kind, same",
    [
        ("01/02/2026", "2026-01-02", "date", True),  # month first
        ("13/02/2026", "2026-02-13", "date", True),
        ("5 January 2026", "January 5, 2026", "date", True),
        ("soon", "soon", "date", False),
        ("$1,200.00", "1200", "currency", True),
        ("1.0000001", "1", "number", True),
        ("1.1", "1", "number", False),
        (" ACME  Ltd ", "acme ltd", "string", True),
        (None, None, "string", True),
        (None, "x", "string", False),
    ],
)
def test_values_match(spark, a, b, kind, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.values_match("a", "b", kind).alias("m")).first().m is same


def test_value_after(spark):
    lines = ["Subtotal 5.00  Total: $ 7.00", "Total (8.25%) $107.25", "Invoice No: INV-7  x", "Currency: eur only", "It renews: NOTICE", "Total", "totally 3"]
    assert values(spark, lambda c: X.value_after(c, "total", "currency"), lines)[:2] == ["$ 7.00", "$107.25"]
    assert values(spark, lambda c: X.value_after(c, "total", "currency"), lines)[5:] == [None, None]
    assert values(spark, lambda c: X.value_after(c, "invoice no"), lines)[2] == "INV-7"
    assert values(spark, lambda c: X.value_after(c, "currency", "enum", ["USD", "EUR"]), lines)[3] == "EUR"
    assert values(spark, lambda c: X.value_after(c, "renews", "boolean"), lines)[4] == "false"  # "notice" holds "no"


def test_split_row(spark):
    cols = [("n", "integer"), ("what", "string"), ("amount", "currency")]
    got = values(spark, lambda c: X.split_row(c, cols), ["1  blue cup  $4.00", "2 | red\tx", "one cell", "N  What  Amount", "3  cup"])
    assert got == [{"n": "1", "what": "blue cup", "amount": "$4.00"}, {"n": "2", "what": "red"}, None, None, {"n": "3", "what": "cup"}]


def test_boxes(spark):
    df = spark.range(1).select(geometry.box(0.0, 0.0, 0.5, 0.5).alias("a"), geometry.box(0.25, 0.25, 0.75, 0.75).alias("b"), geometry.box(0.5, 0.0, 1.0, 0.5).alias("c"))
    r = df.select(geometry.iou(F.col("a"), F.col("b")).alias("ab"), geometry.iou(F.col("a"), F.col("c")).alias("ac"), geometry.area(F.col("a")).alias("s"), geometry.centre(F.col("b"))["x"].alias("x")).first()
    assert (round(r.ab, 6), r.ac, r.s, r.x) == (round(0.0625 / 0.4375, 6), 0.0, 0.25, 0.5)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(geometry.normalise(*[F.lit(1.0)] * 4, F.lit(0.0), F.lit(5.0))).collect()


# --- documents


def test_documents_round_trip(spark, tmp_path):
    block = lambda i, t: (f"b{i}", "paragraph", t, [0.1, i / 10, 0.9, i / 10 + 0.05], 1.0, i, None)
    df = spark.createDataFrame([("d1", "src", {"k": "v"}, [(1, 100, 200, None, [block(0, "a"), block(1, "b")]), (2, 100, 200, None, [block(0, "c")])])], D.DOCUMENT)
    D.write_json(df, f"file://{tmp_path}/docs")
    blocks = D.to_blocks(D.read_documents(spark, f"file://{tmp_path}/docs"))
    assert sorted((r.page_number, r.pos, r.text, r.y0) for r in blocks.collect()) == [(1, 0, "a", 0.0), (1, 1, "b", 0.1), (2, 0, "c", 0.0)]
    back = D.to_documents(blocks).first()
    assert [[b.text for b in p.blocks] for p in back.pages] == [["a", "b"], ["c"]]
    with pytest.raises(Exception, match="unknown block type"):
        D.to_blocks(spark.createDataFrame([("d", None, None, [(1, 1, 1, None, [("b", "poem", "x", [0.0, 0.0, 1.0, 1.0], 1.0, 0, None)])])], D.DOCUMENT)).collect()
    D.write_jsonl(blocks.select("block_id", "text"), f"file://{tmp_path}/lines")
    assert D.read_jsonl(spark, f"file://{tmp_path}/lines", "block_id string, text string").count() == 3


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [("d", 1, i, f"b{i}", x, x + 0.3, y) for i, (x, y) in enumerate([(0.05, 0.1), (0.6, 0.1), (0.05, 0.3), (0.6, 0.3), (0.05, 0.5), (0.6, 0.5)])]
    df = spark.createDataFrame(rows, "document_id string, page_number int, pos int, block_id string, x0 double, x1 double, y0 double")
    order = lambda d: [r.block_id for r in layout.reading_order(d).orderBy("reading_order").collect()]
    assert order(df) == ["b0", "b2", "b4", "b1", "b3", "b5"]
    assert order(df.where("pos <> 5")) == ["b0", "b1", "b2", "b3", "b4"]


# --- grouping


def loop_groups(pages, c):
    """(n_chars, mid_table, penalty) of a document's pages, grouped by a plain loop."""
    groups, cursor = [], 0
    while cursor < len(pages):
        for overlap in (c.overlap, 0):
            start = max(0, cursor - overlap) if groups else cursor
            n = used = 0
            while start + n < len(pages) and n < c.max_pages and (n < c.min_pages or used + pages[start + n][0] <= c.max_chars):
                used += pages[start + n][0]
                n += 1
            if start + n > cursor:
                break
        least = max(c.min_pages, cursor - start + 1)
        if c.natural_breaks and n > least:
            best, penalty = n, pages[start + n - 1][2]
            for k in range(least, n):
                if pages[start + k - 1][2] + 0.25 < penalty:
                    best, penalty = k, pages[start + k - 1][2]
            n = best
        groups.append([(p + 1, bool(groups) and p < cursor) for p in range(start, start + n)])
        cursor = start + n
    return groups


def test_groups_equal_the_loop(spark):
    rng = random.Random(1)
    docs = {i: [(rng.choice([100, 2000, 9000]), m := rng.random() < 0.2, 1.0 if m else rng.choice([0.0, 0.1, 0.2, 0.5])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))] for i in range(60)}
    df = spark.createDataFrame([(i, k + 1, *p) for i, ps in docs.items() for k, p in enumerate(ps)], "document_id int, page_number int, n_chars long, mid_table boolean, penalty double")
    for c in (grouping.Grouping(), grouping.Grouping(max_chars=10_000), grouping.Grouping(3, 0, 10_000, 1, False), grouping.Grouping(5, 2, 10_000, 2)):
        got: dict = {}
        for r in grouping.group_pages(df, c).orderBy("page_number").collect():
            got.setdefault(r.document_id, {}).setdefault(r.group_index, []).append((r.page_number, r.is_overlap))
        for i, pages in docs.items():
            assert [got[i][g] for g in sorted(got[i])] == loop_groups(pages, c), (i, c)


def test_fat_pages_do_not_stall(spark):
    df = spark.createDataFrame([("d", k, 10_000, False, 0.2) for k in range(1, 5)], "document_id string, page_number int, n_chars long, mid_table boolean, penalty double")
    rows = grouping.group_pages(df).collect()
    assert {r.page_number for r in rows} == {1, 2, 3, 4} and any(r.overlap_dropped for r in rows)
    with pytest.raises(ValueError):
        grouping.Grouping(max_pages=2, overlap=2)
    assert grouping.markers_of([["a", "b"], ["b", "c"]]) == ["a", "b", "c"] and grouping.markers_of(None) == grouping.MARKERS


def test_prior_by_region(spark):
    df = spark.createDataFrame([("front", 1, 11), ("front", 6, 11), ("back", 11, 11), ("back", 6, 11), ("every", 3, 11), (None, 1, 11), ("front", 1, 1)], "region string, p int, n int")
    assert [round(r.v, 6) for r in df.select(retrieval.prior(F.col("region"), F.col("p"), F.col("n")).alias("v")).collect()] == [1.5, 0.0, 1.5, 0.0, 0.25, 0.0, 0.0]


# --- merging


def test_merge_equals_the_fold(spark):
    rng = random.Random(2)
    rows = [(d, k, v, rng.choice(["a", "A", "b", "c", "", None]), rng.choice([0.1, 0.5, 0.5, 0.9])) for d in range(80) for k in "xy" for v in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, "document_id long, key string, visit long, value string, confidence double")
    got = {(r.document_id, r.key): (r.value, r.source_visit, r.confidence, r.revisions) for r in state.merge_scalars(df).collect()}
    want = {}
    for d, k, v, value, conf in rows:
        s = merge.fold(want.get((d, k)), [(v, value, (value or "").lower(), conf)])
        if s:
            want[d, k] = s
    assert got == {k: (s[0], s[2], s[3], s[4]) for k, s in want.items()}


def test_fields_that_continue_take_equal_confidence(spark):
    df = spark.createDataFrame([(1, "t", 0, "a", 0.5, ["e0"]), (1, "t", 1, "b", 0.5, ["e1"]), (1, "t", 2, "B", 0.5, ["e2"])], "document_id long, key string, visit long, value string, confidence double, evidence array<string>")
    assert state.merge_scalars(df).first().value == "a"
    assert state.merge_scalars(df, F.col("key") == "t").first().value == "b"
    assert state.merge_evidence(df, F.col("key") == "t").first().evidence == ["e1", "e2"]
    assert state.merge_evidence(df).first().evidence == ["e0"]


def test_rows_without_keys_are_never_repeats(spark):
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 2), (1, "a", None, "y", 3), (1, "a", None, "y", 4), (1, None, "", None, 5), (1, None, None, "", 6)]
    df = spark.createDataFrame(rows, "d long, k1 string, k2 string, v string, seq long")
    assert sorted(r.seq for r in state.dedupe_rows(df, ["d"], ["k1", "k2"], ["seq"]).collect()) == [1, 2, 3]  # blank rows go


def test_exit_rules_in_order(spark):
    base = {"document_id": 1, "visit": 2, "n_groups": 9, "open_tables": 0, "streak": 0, "n_missing": 0, "n_invalid": 0, "n_unsupported": 0, "mean_confidence": 0.5}
    P = early_exit.Policy
    cases = [
        (P(), {}, (True, "satisfied")), (P(), {"visit": 9}, (True, "all_groups")), (P(enabled=False), {}, (False, "disabled")), (P(enabled=False, max_groups=2), {}, (True, "budget")),
        (P(min_groups=3), {}, (False, "min_groups")), (P(), {"open_tables": 1, "streak": 5}, (False, "open_tables")), (P(), {"streak": 2, "n_missing": 3}, (True, "no_new_information")),
        (P(), {"n_missing": 1}, (False, "missing")), (P(), {"n_invalid": 1}, (False, "invalid")), (P(), {"n_unsupported": 1}, (False, "unsupported")), (P(min_confidence=0.6), {}, (False, "confidence")),
    ]
    for policy, change, want in cases:
        r = early_exit.decide(spark.createDataFrame([base | change]), policy).first()
        assert (r.stop, r.reason) == want


# --- attribution, validation, scores


def test_ladder_rungs(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "b1", "The total amount due is $5.00"), (1, 2, 0, "b2", "Paid by Acme Ltd. on Monday")], "document_id long, page_number int, pos int, block_id string, text string")
    groups = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "document_id long, group_index int, page_number int")
    claims = spark.createDataFrame(
        [(1, 0, "id", "b1", None, "zzz", 1.0), (1, 0, "far", "b2", None, None, 1.0), (1, 0, "quote", "?", "AMOUNT  due", None, 1.0), (1, 0, "words", None, "due total: amount", None, 1.0), (1, 1, "value", None, None, "acme ltd", 1.0), (1, 1, "none", None, "total amount", "5.00", 1.0), (1, 0, "short", None, "due", "is", 1.0)],
        "document_id long, group_index int, claim_no string, block_id string, quote string, value string, confidence double",
    )
    got = {r.claim_no: (r.rung, r.status, r.found_confidence) for r in attribution.attribute(claims, blocks, groups).collect()}
    assert got == {"id": (1, "exact", 1.0), "far": (2, "exact", 1.0), "quote": (3, "quote", 0.9), "words": (4, "quote", 0.9), "value": (5, "value", 0.75), "none": (None, "unverified", None), "short": (None, "unverified", None)}


def test_validation_repairs_and_reports(spark):
    owners = spark.createDataFrame([(1,), (2,)], "document_id long")
    fields = spark.createDataFrame([(1, "agreement_title", ["T"]), (1, "parties", ["A", "", "B"]), (1, "effective_date", ["soon"]), (1, "auto_renews", ["Yes"]), (1, "governing_law", ["X", "Y"]), (1, "nonsense", ["1"])], "document_id long, key string, values array<string>")
    good, bad = validate.validate_fields(owners, fields, schemas.AGREEMENT)
    assert {(r.key, tuple(r["values"])) for r in good.collect()} == {("agreement_title", ("T",)), ("parties", ("A", "B")), ("auto_renews", ("true",))}
    one = {(r.path, r.code) for r in bad.where("document_id = 1").collect()}
    assert one == {("effective_date", "type_mismatch"), ("governing_law", "cardinality"), ("nonsense", "unknown_key")}
    assert {r.path for r in bad.where("document_id = 2").collect()} == {"agreement_title", "parties", "effective_date"}
    v = {r.document_id: r.is_valid for r in validate.verdict(owners, bad.where("path = 'nonsense'")).collect()}
    assert v == {1: True, 2: True}


def test_scores(spark):
    p = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "")], "document_id long, key string, value string")
    g = spark.createDataFrame([(1, "a", "X"), (1, "b", "z"), (2, "a", "q")], "document_id long, key string, value string")
    got = {r.key: (r.tp, r.fp, r.fn, r.support) for r in metrics.key_scores(metrics.score_scalars(p, g)).collect()}
    assert got == {"a": (1, 0, 1, 2), "b": (0, 1, 1, 1)}
    s = metrics.summary(metrics.key_scores(metrics.score_scalars(p, g))).first()
    assert round(s.weighted_f1, 6) == round((2 / 3) * 2 / 3, 6) and round(s.macro_f1, 6) == round(1 / 3, 6)


# --- registry, dataset, plan, config


def test_gate(spark):
    card = "model_id string, schema string, stage string, created_at int, corpus_size long, corpus_fingerprint string, metrics map<string,double>, per_key map<string,double>"
    m = lambda f1, valid=0.99: {"weighted_f1": f1, "schema_valid_rate": valid, "citation_precision": 0.95}
    old = spark.createDataFrame([("old", "s", "production", 1, 50, "f", m(0.9), {"a": 0.9, "b": 0.9})], card)
    new = spark.createDataFrame([("good", "s", "candidate", 2, 50, "f", m(0.92), {"a": 0.9, "b": 0.9}), ("flat", "s", "candidate", 3, 50, "f", m(0.901), {"a": 0.9, "b": 0.9}), ("worse", "s", "candidate", 4, 50, "f", m(0.95), {"a": 0.8, "b": 1.0}), ("partial", "s", "candidate", 5, 50, "f", m(0.92), {"a": 0.9}), ("small", "t", "candidate", 6, 5, "f", m(0.9), {}), ("first", "t", "candidate", 7, 30, "f", m(0.1), {})], card)
    checks = registry.gate_checks(new, old)
    got = {r.candidate_id: r.promote for r in registry.decisions(checks).collect()}
    assert got == {"good": True, "flat": False, "worse": False, "partial": True, "small": False, "first": True}
    assert checks.where("candidate_id = 'partial' and check_name = 'key_coverage' and not blocking").count() == 1
    after = {r.model_id: r.stage for r in registry.promote(old.unionByName(new), registry.decisions(checks.where("candidate_id = 'good'"))).collect()}
    assert after["good"] == "production" and after["old"] == "archived" and after["first"] == "candidate"


def test_targets_settle_once(spark):
    g = spark.createDataFrame([(1, "a", "x"), (1, "c", "z"), (2, "a", "y")], "document_id long, key string, value string")
    e = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (1, "c", 1), (1, "c", 3)], "document_id long, key string, page_number int")
    gp = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 1, 3), (2, 0, 1), (2, 1, 2)], "document_id long, group_index int, page_number int")
    got = {(r.document_id, r.group_index, r.key) for r in dataset.field_targets(g, e, gp, spark.createDataFrame([("c",)], "key string")).collect()}
    assert got == {(1, 0, "a"), (1, 0, "c"), (1, 1, "c"), (2, 0, "a")}


def test_plan_checks(spark):
    rows = [*dag.STEPS, ("loop_a", ["loop_b"]), ("loop_b", ["loop_a"]), ("lost", ["nowhere"])]
    plan = dag.steps(spark, rows)
    assert {r.name for r in dag.reachable(plan).collect()} == {n for n, _ in dag.STEPS}
    assert [(r.name, r.dependency) for r in dag.unresolved(plan).collect()] == [("lost", "nowhere")]


def test_schema_and_config_objects(monkeypatch, spark):
    for s in (schemas.INVOICE, schemas.STATEMENT, schemas.AGREEMENT):
        assert schemas.Schema.from_json(s.to_json()) == s
        assert spark.createDataFrame([], s.ddl()).columns == s.keys
        assert s.json_schema()["required"] == s.required and s.envelope_schema()["required"] == ["fields"]
    with pytest.raises(ValueError):
        schemas.Field("x", "enum")
    with pytest.raises(ValueError):
        schemas.Schema("s", "1", (schemas.Field("a"), schemas.Field("a")))
    c = config.RunConfig().overlay({"exit": {"patience": 5, "unknown": 1}, "nothing": 2})
    assert c.exit.patience == 5 and c.exit.min_groups == 1 and c.flat()["exit.patience"] == 5 and c.digest() != config.RunConfig().digest()
    monkeypatch.setenv("DOCWEAVE_GROUPING__MAX_PAGES", "7")
    assert config.from_environment(c).grouping.max_pages == 7
    assert schemas.available(spark).count() >= 3


# --- model answers


@pytest.mark.parametrize(
    "text, fields, error",
    [
        ('{"fields": {"invoice_number": "7"}}', {"invoice_number": "7"}, None),
        ('x {"fields": {"invoice_number": "a}b"}} y', {"invoice_number": "a}b"}, None),
        ('```json\n{"fields": {"invoice_number": 7}}\n```', {"invoice_number": "7"}, None),
        ("{fields: {invoice_number: 7,}}", {"invoice_number": "7"}, None),
        ("{'fields': {'invoice_number': 'x',}}", {"invoice_number": "x"}, None),
        ('{"fields": {"invoice_number": NaN, "currency": None}}', {"invoice_number": None, "currency": None}, None),
        ('{"fields": {"invoice_number": -Infinity}}', {"invoice_number": None}, None),
        ('{"fields": {"invoice_number": "cut of', {"invoice_number": "cut of"}, None),
        ('{"invoice_number": "bare", "other": 1}', {"invoice_number": "bare"}, None),
        ("no answer", {}, "no object"),
        (None, {}, "no object"),
        ('{"fields": [1, 2', {}, "not recoverable as JSON"),
    ],
)
def test_envelope(text, fields, error):
    got = envelope.parse(text, {f.name for f in schemas.INVOICE.fields}, {"line_items"})
    assert (got["fields"], got["error"]) == (fields, error)


@pytest.mark.parametrize(
    ("text", "repairs", "currency"),
    [
        ('{"fields": {"currency": "USD"}}', [], "USD"),
        ('so: {"fields": {"currency": "USD",},} and more', ["trailing text dropped", "trailing commas removed"], "USD"),
        ('{fields: {currency: "USD"', ["truncated object closed", "bare keys quoted"], "USD"),
        ("{'fields': {'currency': None}}", ["single quotes replaced", "literals replaced"], None),
        ('{"fields": {"currency": -Infinity}}', ["literals replaced"], None),
        ('{"fields": {"currency": "US', ["truncated object closed"], "US"),
        ('{"fields": {"currency": "a } \\" {", }}', ["trailing commas removed"], 'a } " {'),
    ],
)
def test_envelope_repairs(text, repairs, currency):
    got = envelope.parse(text, {"currency"}, set())
    assert (got["repairs"], got["fields"], got["error"]) == (repairs, {"currency": currency}, None)


@pytest.mark.parametrize("text", ["{'a': \"b\"}", '{"a" 1}', '{"a": }', '{"a": [1,, 2]}', '{"a": "b"', "{a", '{"fields": {"x": [1', '{"a": 1 "b": 2}'])
def test_envelope_never_raises(text):
    for i in range(len(text) + 1):
        envelope.parse(text[:i], {"currency"}, set())


def test_envelope_claims_and_rows():
    text = '{"fields": {}, "evidence": {"currency": ["p1b2", "a longer quote here", {"block_id": "x", "confidence": 0.5}]}, "tables": {"line_items": [{"values": {"amount": 1}, "page": 2}, {"amount": 3}], "other": []}, "open_tables": ["line_items", "other"]}'
    got = envelope.parse(text, {"currency"}, {"line_items"})
    assert got["evidence"]["currency"] == [("p1b2", None, 1.0), (None, "a longer quote here", 1.0), ("x", None, 0.5)]
    assert [r[0] for r in got["rows"]["line_items"]] == [{"amount": "1"}, {"amount": "3"}] and got["open_tables"] == ["line_items"]


def test_model_calls_and_cache(spark):
    calls = spark.createDataFrame([("k1", "p1"), ("k2", "boom"), ("k3", "p3")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k3", "old", 0.0)], "cache_key string, answer string, stored_at double").withColumn("stored_at", F.timestamp_seconds("stored_at"))
    assert {r.cache_key for r in envelope.uncached(calls, cache).collect()} == {"k1", "k2"}
    assert {r.cache_key for r in envelope.uncached(calls, cache, 60).collect()} == {"k1", "k2", "k3"}

    def backend():
        def answer(prompts):
            if "boom" in prompts:
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

        return answer

    got = {r.cache_key: r.answer for r in envelope.call_model(calls.repartition(3, "cache_key"), backend, attempts=2).collect()}
    assert got["k2"] is None and set(got) == {"k1", "k2", "k3"}


def test_extraction_of_a_small_invoice(spark):
    page1 = ["Invoice No: INV-1", "Invoice Date: 2026-01-05", "Remit To: Acme", "1  cup  2  $4.00  $8.00", "2  pot  1  $9.00  $9.00"]
    page2 = ["2  pot  1  $9.00  $9.00", "3  pan  1  $5.00  $5.00", "Total: $22.00"]
    rows = [("d", p, i, f"p{p}b{i}", "table_row" if t[0].isdigit() else "key_value", t, i / 10, i / 10 + 0.05, i) for p, ts in ((1, page1), (2, page2)) for i, t in enumerate(ts)]
    blocks = spark.createDataFrame(rows, "document_id string, page_number int, pos int, block_id string, block_type string, text string, y0 double, y1 double, reading_order int")
    out = extraction.run(blocks, config.PROFILES["accuracy"])
    r = out["results"].first()
    assert r.is_valid and {k: v[0] for k, v in r.record.items()} == {"invoice_number": "INV-1", "invoice_date": "2026-01-05", "vendor_name": "Acme", "total_amount": "$22.00"}
    assert out["rows"].count() == 3 and r.pages_read == 2 and r.exit_reason == "all_groups"
    assert {x.status for x in out["attributed"].collect()} == {"exact"}
    assert extract.MOST_ROWS == 200


def test_evaluation_and_command_line(spark, tmp_path):
    from docweave import cli
    from docweave.operators import prompts
    from docweave.plans import evaluation

    lines = ["Invoice No: INV-1", "Invoice Date: 2026-01-05", "Remit To: Acme", "1  cup  2  $4.00  $8.00", "Total: $8.00"]
    block = [(f"b{i}", "table_row" if t[0].isdigit() else "key_value", t, [0.1, i / 10, 0.9, i / 10 + 0.05], 1.0, i, None) for i, t in enumerate(lines)]
    D.write_json(spark.createDataFrame([("d", None, None, [(1, 100, 200, None, block)])], D.DOCUMENT), f"file://{tmp_path}/docs")
    blocks = layout.reading_order(D.to_blocks(D.read_documents(spark, f"file://{tmp_path}/docs")))
    gold = spark.createDataFrame([("d", "invoice_number", "inv-1"), ("d", "invoice_date", "January 5, 2026"), ("d", "vendor_name", "Other"), ("d", "total_amount", "8")], "document_id string, key string, value string")
    rows = spark.createDataFrame([("d", "line_items", {"line_number": "1", "description": "Cup", "quantity": "2", "unit_price": "4", "amount": "8.00"})], "document_id string, table_name string, cells map<string,string>")
    out = evaluation.evaluate(blocks, gold, config.PROFILES["accuracy"], rows)
    assert {r.key: (r.tp, r.fp, r.fn) for r in out["keys"].collect()} == {"invoice_number": (1, 0, 0), "invoice_date": (1, 0, 0), "total_amount": (1, 0, 0), "vendor_name": (0, 1, 1), "line_items": (1, 0, 0)}
    assert out["rates"].first().schema_valid_rate == 1.0
    assert cli.main(["extract", f"file://{tmp_path}/docs", "--profile", "accuracy", "--out", f"file://{tmp_path}/out"]) == 0
    assert cli.main(["schemas"]) == 0
    p = prompts.build(spark.createDataFrame([("d", 0, "pages")], "document_id string, group_index int, layout string"), schemas.INVOICE, spark.createDataFrame([("d", "x = 1")], "document_id string, carry string")).first().prompt
    assert "Known so far:\nx = 1" in p and "invoice_number" in p
