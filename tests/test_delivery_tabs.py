"""Resuming by content, sources, clues, tabs, displays and caches on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from cataloom.functions import constants as K, display, rules, text as T
from cataloom.operators import answers as N, delivery as D, metrics as M, resume as R, store as S
from cataloom.plans.small import catalog_sheet_order
from cataloom.sources import resolution
from cataloom.sources.readers import sheet_rows
from cataloom.sources.writers import workbook_bytes


def rows_of(spark, cells):
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(cells)], "row_id long, a string, b double")


CELLS = [(f"x{i}" if i % 7 else None, i / 2) for i in range(95)]


@pytest.mark.parametrize(
    "change, through",
    [
        (lambda c: c, 95),
        (lambda c: c + [("new", 1.0)] * 30, 95),
        (lambda c: c[:42] + [("changed", 21.0)] + c[43:], 40),
        (lambda c: c[:42] + [c[43], c[42]] + c[44:], 40),  # the same rows in another order
        (lambda c: [c[-1]] + c[1:], 0),
        (lambda c: c[:94], 90),  # shorter
        (lambda c: c[:7] + [("", 3.5)] + c[8:], 0),  # null and empty differ
        (lambda c: c[:94] + [("x", None)] + [("more", 0.0)], 90),
        (lambda c: [], 0),
    ],
)
def test_a_file_is_resumed_as_far_as_it_is_the_same(spark, change, through):
    guard = R.file_guard(rows_of(spark, CELLS), 10)
    now = rows_of(spark, change(CELLS))
    assert R.unchanged_through(now, guard, 10) == through
    stored = spark.range(1, 96).selectExpr("id as row_id", "if(id % 4 = 0, 'FAILED', 'COMPLETED') as status")
    done, todo = R.resumed_by_content(now, stored, guard, 10)
    here = {r.row_id for r in now.collect()}
    want = {i for i in range(1, through + 1) if i % 4 and i in here}
    assert {r.row_id for r in done.collect()} == want and {r.row_id for r in todo.collect()} == here - want


def test_guard_of_nothing_and_of_other_columns(spark):
    now = rows_of(spark, CELLS)
    assert R.unchanged_through(now, R.file_guard(rows_of(spark, [])), 10) == 0
    guard = R.file_guard(now, 10)
    assert R.unchanged_through(now.select("b", "row_id", "a"), guard, 10) == 95
    assert R.unchanged_through(now.withColumnRenamed("a", "c"), guard, 10) == 0


def test_sources_in_turn(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/full")
    spark.range(0).write.parquet(f"{tmp_path}/none")
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "_SUCCESS").write_text("x")
    opened = []

    def source(name):
        def read():
            opened.append(name)
            return spark.read.parquet(f"{tmp_path}/{name}")

        return name, f"{tmp_path}/{name}", read

    name, rows = resolution.resolved(spark, [source("gone"), source("bytes"), source("none"), source("full"), ("sample", None, lambda: resolution.sample_products(spark))])
    assert name == "full" and rows.count() == 3 and opened == ["none", "full"]
    name, rows = resolution.resolved(spark, [source("gone"), ("sample", None, lambda: resolution.sample_products(spark))])
    assert name == "sample" and [r.sku_id for r in rows.orderBy("pos").collect()] == ["Honeywell-TH6320U2008", "3M-775L"]
    with pytest.raises(ValueError, match="no source"):
        resolution.resolved(spark, [source("gone"), source("none")])


def test_sample_is_delivered(spark):
    records = D.related(resolution.sample_products(spark), resolution.sample_attributes(spark))
    got = D.catalog_sheet(records).collect()
    assert [r["SKU - MY_PART_NUMBER"] for r in got] == ["Honeywell-TH6320U2008", "3M-775L"] and got[0]["VOLTAGE"] == "24" and got[1]["ATTRIBUTE_VALUE 2"] == "5"


def test_clues(spark):
    rows = [(1, " Honeywell ", "T6 Pro"), (2, "3M", None), (3, None, " "), (4, "Apollo", "Ball Valve")]
    got = {r.row_id: r for r in resolution.starter_clues(spark.createDataFrame(rows, "row_id int, manufacturer string, mfg_part_number string")).collect()}
    assert got[1].source_url == "mock://fallback/honeywell-t6-pro" and got[1].raw_content.startswith("Honeywell T6 Pro HVAC Technical") and got[1].raw_content.count("\n") == 7
    assert got[2].raw_content.startswith("3M PART Product") and got[3].raw_content.startswith("UNKNOWN PART") and got[3].source_url == "mock://fallback/unknown"
    assert "PTFE" in got[4].raw_content


def audited(spark):
    records = spark.createDataFrame([(1, "s1", "m", "p", "HVAC", "COMPLETED", True, 1.0, 0.9, 5.0, [], "d1"), (2, None, "m", "q", "HVAC", "MANUAL_REVIEW", True, 0.5, 0.4, 5.0, ["A", "B"], None), (3, "s3", None, None, None, "COMPLETED", False, 0.0, 0.0, 5.0, ["C"], "d3")], "row_id int, sku_id string, manufacturer string, mfg_part_number string, category string, status string, validity boolean, completeness double, overall_confidence double, total_time_ms double, validation_flags array<string>, raw_description string")
    attributes = spark.createDataFrame([(2, 0, "zeta", "24 V", "24", "V", 0.9, "regex", "at 24 V"), (1, 1, "beta", "x", "", None, None, None, None), (1, 0, "mid", "7", "7", "in", 0.5, "llm_8b", "http://e")], "row_id int, pos int, field_name string, raw_value string, normalized_value string, unit string, confidence double, source string, evidence_snippet string")
    return records, attributes


def test_lineage_tab_has_columns_as_rows_bring_them(spark):
    got = D.lineage_tab(*audited(spark))
    assert got.columns[10::4] == ["attr_mid_value", "attr_beta_value", "attr_zeta_value"]
    rows = {r.row_id: r for r in got.collect()}
    assert rows[1].attr_beta_value == "x" and rows[2].attr_zeta_evidence == "at 24 V" and rows[3].attr_mid_value is None
    with pytest.raises(ValueError, match="more than 2 fields"):
        D.lineage_tab(*audited(spark), max_fields=2)
    records, attributes = audited(spark)
    assert len(D.lineage_tab(records, attributes.limit(0)).columns) == 10


def test_four_tabs(spark):
    transitions = spark.createDataFrame([(1, "COMPLETED", ["regex"], False, 10, 5.0), (2, "MANUAL_REVIEW", [], False, 5, 5.0)], "row_id int, status string, sources array<string>, cache_hit boolean, tokens int, ms double")
    tabs = D.delivery_tabs(*audited(spark), transitions, 0.5)
    book = workbook_bytes(tabs)
    assert list(tabs) == ["Enriched Catalog", "Lineage Audit", "Judge Telemetry", "Manual Review Queue"]
    catalog, lineage, telemetry, review = (sheet_rows(book, i) for i in range(4))
    assert len(catalog[0]) == 252 and catalog[1][0] == "s1" and catalog[2][0] == "m-q"
    assert lineage[0][:2] == ["row_id", "sku_id"] and len(telemetry) == 14
    assert ["Rows Per Second", "2.0"] in telemetry and ["Elapsed Seconds", "0.5"] in telemetry and ["Total Rows", "2"] in telemetry
    assert review[0] == list(K.REVIEW_COLUMNS) and sorted(r[:1] + r[6:7] for r in review[1:]) == [["2", "A, B"], ["3", "C"]]
    assert M.snapshot(transitions, 0).first().elapsed_seconds == 0.0


def test_nested_json(spark):
    got = {r.row_id: json.loads(r.json) for r in D.nested_json(*audited(spark)).collect()}
    assert got[1]["attributes"]["mid"] == {"raw_value": "7", "normalized_value": "7", "unit": "in", "confidence": 0.5, "source": "llm_8b", "evidence_snippet": "http://e"}
    assert got[2]["identity"]["sku_id"] == "m-q" and got[3]["identity"]["sku_id"] == "s3" and got[3]["attributes"] == {} and got[3]["identity"]["category"] is None and list(got[1]["attributes"]) == ["mid", "beta"]


def test_rules_tell_what_they_matched(spark):
    df = spark.createDataFrame([(1, "Fan 120 Volts, 6 in. x 1/8 in SST p80"), (2, None)], "row_id int, raw_description string")
    got = {r.field_name: r for r in rules.extract_long(df).collect()}
    assert all(r.raw_value == r.evidence_snippet and r.raw_value in "Fan 120 Volts, 6 in. x 1/8 in SST p80" for r in got.values())
    assert got["grit"].raw_value == "p80" and got["grit"].normalized_value == "P80" and got["material"].raw_value == "SST"


def test_displays(spark):
    one = spark.range(1)
    size = lambda n: one.select(display.file_size(F.lit(n).cast("long"))).first()[0]
    assert [size(n) for n in (None, 0, 9, 1023, 1024, 1536, 10240, 1 << 20, 5 << 30, 20000 << 30)] == ["—", "0 B", "9 B", "1023 B", "1.0 KB", "1.5 KB", "10 KB", "1.0 MB", "5.0 GB", "20000 GB"]
    buttons = lambda a, b: one.select(display.page_buttons(F.lit(a), F.lit(b))).first()[0]
    assert buttons(1, 1) == [1] and buttons(2, 5) == [1, 2, 3, 4, 5] and buttons(9, 20) == [1, 2, 3, 8, 9, 10, 20] and buttons(20, 20) == [1, 2, 3, 19, 20]
    shown = lambda f, x: one.select(f(F.lit(x).cast("double"))).first()[0]
    assert [shown(display.percent, x) for x in (0.9834, 0.0, None)] == ["98.3%", "0.0%", "—"]
    assert [shown(display.duration, x) for x in (842.0, 999.4, 1234.56, 0.5, None)] == ["842ms", "999ms", "1.23s", "1ms", "—"]
    assert [shown(display.currency, x) for x in (0.000184, 12.5, None)] == ["$0.000184", "$12.50", "—"]
    assert [shown(display.tone, x) for x in (0.9, 0.7, 0.1, None)] == ["high", "medium", "low", "neutral"]
    prompt = one.select(display.request_prompt(F.lit("HVAC"), F.lit(None).cast("string"), F.lit("x" * 30_000))).first()[0]
    assert prompt.startswith("Category: HVAC\nSource URL: \n\nProduct document text:\nxxx") and prompt.count("x") == 25_001


def test_retry_after_and_lines(spark):
    rows = [({"RETRY-After": "7.5"}, "try again in 3s"), ({"retry-after": "soon"}, "try again in 1m2.5s"), (None, "in 4s"), ({}, "nothing"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h map<string,string>, m string")
    assert [r[0] for r in df.orderBy("i").select(T.retry_after(F.col("h"), F.col("m"))).collect()] == [7.5, 62.5, 4.0, None, None]
    assert spark.range(1).select(T.clean_lines(F.lit(" a \t b\r\n\n c　d \x0b e "))).first()[0] == "a b\nc d\ne"


def test_search_pages_and_candidates(spark):
    rows = [(i, f"s{i}", "ACME" if i % 2 else None, f"p{i}", "HVAC", "success") for i in range(45)]
    df = spark.createDataFrame(rows, "row_id int, sku_id string, manufacturer_name string, part_number string, category string, status string")
    assert N.searched(df, " ").count() == 45 and N.searched(df, "acme").count() == 22 and N.searched(df, "S44").count() == 1 and N.searched(df, "nothing").count() == 0
    page, number, pages = N.result_page(df, "row_id", 99)
    assert [r.row_id for r in page.collect()] == [40, 41, 42, 43, 44] and (number, pages) == (3, 3)
    assert N.result_page(df.limit(0), "row_id", 0)[1:] == (1, 1)
    links = spark.createDataFrame([(1, k, f"http://h/{k % 10}") for k in range(30)] + [(1, 0, " "), (2, 5, None)], "row_id int, rank int, url string")
    got = N.search_candidates(spark.createDataFrame([(1, "m", "p"), (2, "m", "q")], "row_id int, manufacturer string, mfg_part_number string"), links).orderBy("rank").collect()
    assert [(r["rank"], r.url) for r in got] == [(k + 1, f"http://h/{k}") for k in range(8)] and got[0].query == "m p technical specifications"


def test_enrichment_cache(spark):
    schema = "cache_key string, sku_id string, attributes_json string, created_at int"
    old = spark.createDataFrame([("a", "s", "{}", 1)], schema)
    new = spark.createDataFrame([("a", "t", '{"x": 1}', 2), ("a", "u", '{"x": 2}', 3), ("b", "v", '{"y": 1}', 2), ("c", "w", " {} ", 2), ("d", "w", None, 2), (None, "w", '{"z": 1}', 2)], schema)
    assert sorted(map(tuple, S.enrichment_cached(old, new).collect())) == [("a", "s", '{"x": 2}', 1), ("b", "v", '{"y": 1}', 2)]


def test_api_confidence(spark):
    df = spark.createDataFrame([(1, 0.33333), (1, None), (2, None)], "row_id int, confidence double")
    assert {r.row_id: r.overall_confidence for r in N.api_confidence(df).collect()} == {1: 0.1667, 2: 0.0}

def test_sheet_keeps_all_rows_in_order_in_many_partitions(spark):
    """Small partitions, which plans over more and fewer columns of a sheet join in different ways."""
    few = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        got = catalog_sheet_order(spark, "/root/testdata/sf0.01").orderBy("place").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    keys = [int(r["part"].removeprefix("PN-")) for r in got]
    assert [r["place"] for r in got] == list(range(1, 2001))
    assert keys == list(range(1999, -1, -1)) and [r["value_1"] for r in got] == [f"v{k}" for k in keys]


def test_prompts_are_made_in_several_tasks_of_one_split(spark):
    """One row group, which one task reads; what is made of its rows is dealt out."""
    from cataloom.plans.delivery import prompts

    conf, few = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set(conf, "false")  # it would join partitions as small as these
        got = prompts(spark, "/root/testdata/sf0.001").select("row_id", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set(conf, few)
    assert len({r.row_id for r in got}) == len(got) and len({r.p for r in got}) == 4
