import pytest
from pyspark.sql import functions as F

from cataloom.functions import rules, text as T
from cataloom.operators import attributes as A, delivery as D, metrics as M, rows as R, store as S
from cataloom.plans.enrichment import answered
from cataloom.sources.readers import read_catalog, read_workbook, sheet_rows
from cataloom.sources.writers import workbook_bytes
from cataloom.streaming.jobs import admitted


def test_rules(spark):
    texts = ["Freud 6 in x 1/8 in Cut-Off Wheel 24V", "3M 775L Stikit Film P120 Cubitron II SST", "PVC Conduit 1 in x 10 ft", "Generic Industrial Item", None]
    got = rules.extract_wide(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, raw_description string")).orderBy("row_id").collect()
    assert (got[0].voltage, got[0].voltage_unit, got[0].dimensions, got[0].dimensions_unit) == ("24", "V", "6 x 1/8", "in")
    assert (got[1].grit, got[1].material) == ("P120", "Stainless Steel")
    assert (got[2].material, got[2].dimensions, got[2].dimensions_unit) == ("PVC", "1 x 10", "ft")
    assert all(x is None for x in got[3][2:]) and all(x is None for x in got[4][2:])


def test_gate(spark):
    rows = [(1, "3M P120 5 in x 1/8 in Stainless Steel", "Abrasives"), (2, "Generic Industrial Item", "General"), (3, "120V 800W Fan", "General"), (4, "120V 800W Fan", "HVAC"), (5, None, None)]
    got = {r.row_id: (r.coverage_ratio, r.status) for r in rules.gated(spark.createDataFrame(rows, "row_id int, raw_description string, category string")).collect()}
    assert got == {1: (1.0, "COMPLETED"), 2: (0.0, "CACHE_CHECK"), 3: (0.5, "CACHE_CHECK"), 4: (0.5, "CACHE_CHECK"), 5: (0.0, "CACHE_CHECK")}


def test_headers(spark):
    rows = spark.createDataFrame([(1, "Omron (JPN)", "MY4N-DC24", "Relay 24VDC", "Electrical"), (2, "-- Unbranded --", " ", "n/a", None)], "row_id int, Vendor string, SKU string, Description string, Dept string")
    got = R.normalized_rows(rows).orderBy("row_id").collect()
    assert (got[0].manufacturer, got[0].sku_id, got[0].category) == ("Omron", "Omron-MY4N-DC24", "Electrical")
    assert (got[1].manufacturer, got[1].mfg_part_number, got[1].raw_description, got[1].category) == ("Unknown", "UNKNOWN", "", "General")


def test_conflicts_and_merge(spark):
    schema = "row_id int, field_name string, pos int, source string, confidence double"
    rows = [(1, "v", 0, "llm_8b", 0.9), (1, "v", 1, "regex", 0.99), (1, "m", 0, "llm_8b", 0.6), (1, "m", 1, "llm_8b", 0.85), (1, "t", 0, "llm_8b", 0.5), (1, "t", 1, "llm_8b", 0.5)]
    got = {r.field_name: (r.source, r.confidence, r.pos) for r in A.resolved_conflicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"v": ("regex", 0.99, 1), "m": ("llm_8b", 0.85, 1), "t": ("llm_8b", 0.5, 0)}


def test_flags(spark):
    rows = [("voltage", "abc"), ("voltage", "-5"), ("grit", "fine"), ("dimensions", "big"), ("voltage", "24"), ("grit", "P120")]
    got = [r[0] for r in spark.createDataFrame(rows, "f string, v string").select(A.validation_flags(F.col("f"), F.col("v"))).collect()]
    assert got == ["INVALID_VOLTAGE_FORMAT: abc", "INVALID_VOLTAGE_NEGATIVE: -5", "INVALID_GRIT_FORMAT: fine", "INVALID_DIMENSIONS_FORMAT: big", None, None]


def test_upsert_and_resume(spark):
    folder = S.work_folder(spark)
    table = S.Table(spark, f"{folder}/t")
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    old, new = spark.createDataFrame([(1, "a", 10)], "k int, v string, t int"), spark.createDataFrame([(1, "z", 20), (2, "y", 20)], "k int, v string, t int")
    assert sorted(map(tuple, S.upserted(old, new, ["k"], replaced=["v"]).collect())) == [(1, "z", 10), (2, "y", 20)]
    done, todo = S.resumed(spark.range(1, 4).selectExpr("id as row_id"), spark.createDataFrame([(1, "COMPLETED"), (2, "FAILED")], "row_id long, status string"))
    assert [r.row_id for r in done.collect()] == [1] and sorted(r.row_id for r in todo.collect()) == [2, 3]


def test_cache_key_depends_on_version_only_as_stated(spark):
    key = lambda *x: spark.range(1).select(T.cache_key(*[F.lit(v) for v in x])).first()[0]
    assert key("A ", "b", "c", "1") == key("a", "B", " C", "1") != key("a", "b", "c", "2")


@pytest.mark.parametrize("text,seconds", [("Please try again in 3.455s", 3.455), ("Please try again in 10m34s", 634.0), ("no hint", 0.0)])
def test_retry(spark, text, seconds):
    assert spark.range(1).select(T.retry_seconds(F.lit(text))).first()[0] == pytest.approx(seconds)


def test_delivery_has_all_columns(spark):
    attrs = "array<struct<field_name:string,value:string,unit:string,source_url:string>>"
    rows = spark.createDataFrame([(1, "3M", "775L", "Abrasives", "3M-775L", [("voltage", "", "x", None), ("operating_voltage", "24", None, "https://a"), ("overall_length_in", "5", "in", "ftp://b")]), (2, None, None, None, None, [])], f"row_id int, manufacturer string, mfg_part_number string, category string, sku_id string, attrs {attrs}")
    out = A.delivery(rows).orderBy("row_id").collect()
    assert len(out[0]) == 253 and out[0]["VOLTAGE"] == "24" and out[0]["VOLTAGE_UOM"] == "V" and out[0]["ATTRIBUTE_LABEL 3"] == "Overall Length" and out[0]["MFR URL"] == "https://a"
    assert out[1]["SKU - MY_PART_NUMBER"] == "" and out[1]["STATUS"] == "Active"


def test_label_capitalises_after_every_non_letter(spark):
    assert spark.range(1).select(T.label(F.lit("7-day_2nd o'neil"))).first()[0] == "7-Day 2Nd O'Neil"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Vendor,SKU\nOmron,\"M,Y\"\n,\n", encoding="utf-8")
    assert [tuple(r) for r in read_catalog(spark, str(tmp_path / "a.csv")).collect()] == [("Omron", "M,Y")]
    data = workbook_bytes({"Catalog": spark.createDataFrame([("a<b", None), (" x ", "2")], "p string, q string"), "Other": spark.range(1)})
    (tmp_path / "a.xlsx").write_bytes(data)
    assert [tuple(r) for r in read_workbook(spark, str(tmp_path / "a.xlsx")).collect()] == [("a<b", ""), (" x ", "2")]
    with pytest.raises(ValueError):
        read_catalog(spark, "x.pdf")
    with pytest.raises(ValueError):
        read_catalog(spark, str(tmp_path / "a.xlsx"), max_rows=1)


def test_admission(spark):
    calls = spark.createDataFrame([(1, 1, 0.0, 100), (1, 2, 1.0, 100), (1, 3, 2.0, 100), (2, 4, 5.0, 900)], "user_id long, call_id long, at double, tokens long")
    got = {r.call_id: r.start for r in admitted(calls, rpm=2, tpm=300).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 60.0, 4: 5.0}
    got = {r.call_id: r.start for r in admitted(calls, rpm=9, tpm=250).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 60.0, 4: 5.0}


def test_shards(spark):
    rows = spark.range(1, 11).selectExpr("id as p")
    assert [r.shard for r in M.contiguous_shards(rows, "p", 10, 4).orderBy("p").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert M.contiguous_shards(rows, "p", 10, 0).count() == 0


def test_workbook_of_four_tabs(spark):
    products = spark.createDataFrame([(1, "S1", "HVAC", "Omron", "MY4", None), (2, " ", "HVAC", "x", "y", 0.9), (3, "S1", "General", "Omron", "MY4N", 0.0)], "pos int, sku_id string, category string, manufacturer_name string, part_number string, overall_confidence double")
    attributes = spark.createDataFrame([(2, "S1", "voltage", "24V", "24", "V", "https://a"), (1, "S1", "color", "red", None, None, None), (1, "S9", "color", "x", None, None, None)], "pos int, sku_id string, field_name string, raw_value string, normalized_value string, unit string, source_url string")
    nested = D.related(products, attributes)
    row = nested.first()
    assert nested.count() == 1 and (row.pos, row.category, row.part_number, row.overall_confidence) == (1, "General", "MY4N", 0.95) and [a.value for a in row.attrs] == ["red", "24"]
    transitions = spark.createDataFrame([(1, "COMPLETED", ["regex"], False, 10, 5.0), (1, "COMPLETED", ["regex"], False, 10, 5.0)], "row_id int, status string, sources array<string>, cache_hit boolean, tokens long, ms double")
    records = spark.createDataFrame([(1, "COMPLETED", True), (2, "MANUAL_REVIEW", True), (3, "COMPLETED", False)], "row_id int, status string, validity boolean")
    data = D.workbook(D.catalog_sheet(nested), spark.range(1), transitions, records)
    sheets = [sheet_rows(data, i) for i in range(4)]
    assert len(sheets[0][0]) == 252 and ["total_rows", "1"] in sheets[2] and ["completed", "2"] in sheets[2] and [r[0] for r in sheets[3]] == ["row_id", "2", "3"]


def test_first_seen_columns_and_preflight(spark):
    maps = spark.createDataFrame([(2, {"c": "1", "a": "2"}), (1, {"b": "1"}), (3, {"a": "1"})], "n int, m map<string,string>")
    assert set(D.first_seen_columns(maps, "m", "n")) == {"a", "b", "c"} and D.first_seen_columns(maps, "m", "n")[0] == "b"
    assert D.preflight(["Mfg. Part-Num", "Vendor", "x"]) == ["manufacturer", "mfg_part_number"] and D.preflight(["x"]) == []


def test_failed_batches_answer_nothing(spark):
    class Broken:
        def extract(self, prompts):
            raise RuntimeError("no service")

    rows = spark.createDataFrame([(1, "p")], "row_id long, prompt string")
    assert [tuple(r) for r in answered(rows, Broken()).collect()] == [(1, "")]


def test_keys_and_daily_limit(spark):
    keys = F.array(*map(F.lit, "abc"))
    one = spark.range(1)
    assert one.select(M.usable_keys(keys, F.array(F.lit("b")))).first()[0] == ["a", "c"] and one.select(M.usable_keys(keys, keys)).first()[0] == ["a", "b", "c"]
    assert [one.select(T.daily_limit(F.lit(m))).first()[0] for m in ("Limit: tokens per day (TPD)", "rate limit")] == [True, False]


def test_labels_lose_every_unit_suffix(spark):
    one = spark.range(1)
    label = lambda x: one.select(T.label(F.lit(x))).first()[0]
    assert [label(x) for x in ("voltage_vac", "flow_gpm", "temp_DegC", " width_m ", "noise_dba", "m")] == ["Voltage", "Flow", "Temp", "Width", "Noise Dba", "M"]


def test_delivery_trims_names_and_skips_empty_values(spark):
    attrs = "array(named_struct('field_name', ' Voltage ', 'value', '24', 'unit', 'V', 'source_url', ''), named_struct('field_name', 'color', 'value', ' ', 'unit', cast(null as string), 'source_url', ''), named_struct('field_name', 'finish', 'value', 'matt', 'unit', cast(null as string), 'source_url', ''))"
    row = A.delivery(spark.range(1).selectExpr("id as row_id", "'m' as manufacturer", "'p' as mfg_part_number", "'c' as category", "'s' as sku_id", f"{attrs} as attrs")).first()
    assert row.VOLTAGE == "24" and row.LONG_DESC1 == "Voltage: 24 V; Finish: matt"


def test_context_within_the_budget_stays(spark):
    short, long = "<p>Short &amp; plain.</p>\n\n no numbers", "\n".join(["Add to cart now and see 24 V"] + [f"Nothing of note in line {i}." for i in range(80)] + ["Voltage: 24 V and 5 in wide"])
    got = spark.createDataFrame([(1, short), (2, long), (3, None)], "n int, t string").select(A.reduced_context(F.col("t"), F.lit(""), F.lit("")).alias("r")).collect()
    assert [r.r for r in got] == ["Short & plain.\nno numbers", "Voltage: 24 V and 5 in wide", ""]


@pytest.mark.parametrize("strict", [False, True])
def test_strict_review_judges_early_rows(spark, strict):
    from cataloom.plans.enrichment import enriched

    rows = [(1, "M", "P1", "120V 800W 60 Hz Fan", "Electrical"), (2, "M", "P2", "Generic", "General"), (3, "M", "P3", "Generic", "General")]
    df = spark.createDataFrame(rows, "row_id long, manufacturer string, mfg_part_number string, raw_description string, category string")
    key = T.cache_key(F.col("manufacturer"), F.col("mfg_part_number"), F.col("raw_description"), F.lit("1.0.0"))
    cached = df.where("row_id = 2").select(key.alias("cache_key"), F.lit("voltage").alias("field_name"), F.lit("abc").alias("value"), F.lit(0.9).alias("confidence"), F.lit("llm_8b").alias("source"))
    none = spark.createDataFrame([], "row_id long, response string")
    got = {r.row_id: r for r in enriched(df, cached, none, none, strict_review=strict)[0].collect()}
    assert [(got[i].status, got[i].via) for i in (1, 2, 3)] == [("COMPLETED", "rules"), ("COMPLETED", "cache"), ("MANUAL_REVIEW", "model")]
    assert [got[i].validity for i in (1, 2)] == ([True, False] if strict else [False, False])
    assert [got[i].completeness for i in (1, 2)] == ([1.0, 0.25] if strict else [0.0, 0.0])


def test_sentence_queries_end_words_as_their_sql_does(spark, tmp_path):
    """A letter outside ASCII after a unit, white space outside ASCII after a full stop; the operator itself knows all letters."""
    import duckdb

    import cataloom.plans.catalogue as catalogue

    long = "\n".join([f"Nothing of note in line {i}." for i in range(80)] + ["Die 40.130.212.161 inßlichver von.", "Der Wert ist 24 mm breit."])
    texts = ["Die Tzente. Die 40.130.212.161 inßlichver von.", "Ab 5 mm. Noch 6 mm hochä.\x0bUnd 7\x0bmm hoch.", "ä24 mm, 24 mm und 12\"x 12\"ä 24 mm", "copyright\x0b12 und 24 mm breit", long, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("sentence_score", "sentence_score_named", "context_reduce"):
        mine, sql = catalogue.QUERIES[name](spark, str(tmp_path)), con.sql(catalogue.ORACLE_SQL[name])
        rows = [dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()]
        if name == "context_reduce":  # cleaning has white space of its own
            mine, rows = mine.where("doc_id in (0, 4)"), [r for r in rows if r["doc_id"] in (0, 4)]
        assert sorted((r.asDict() for r in mine.collect()), key=lambda r: r["doc_id"]) == sorted(rows, key=lambda r: r["doc_id"]), name
    score = lambda ascii_only: spark.range(1).select(T.sentence_score(F.lit("161 inßlich zehn"), F.lit(""), F.lit(""), ascii_only)).first()[0]
    assert (score(False), score(True)) == (0.0, 3.0)


def test_enrichment_runs_its_rules_once(spark, capsys):
    """Later steps read the rules' values: their plan has none of the rules' patterns."""
    from cataloom.plans.enrichment import enriched

    rows = spark.createDataFrame([(1, "M", "P", "24 V 5 W 60 Hz", "Electrical"), (2, "M", "Q", "none", "Electrical")], "row_id long, manufacturer string, mfg_part_number string, raw_description string, category string")
    cache = spark.createDataFrame([], "cache_key string, field_name string, value string, confidence double, source string")
    answers = spark.createDataFrame([], "row_id long, response string")
    records, attributes = enriched(rows, cache, answers, answers)
    records.explain("extended")
    attributes.explain("extended")
    assert "(Hz)" not in capsys.readouterr().out
    assert sorted((r.row_id, r.status, r.via) for r in records.collect()) == [(1, "COMPLETED", "rules"), (2, "MANUAL_REVIEW", "model")]
    assert sorted((r.row_id, r.field_name, r.value, r.source) for r in attributes.collect()) == [(1, "frequency", "60", "regex"), (1, "power", "5", "regex"), (1, "voltage", "24", "regex")]
