"""Registered queries over resuming by content, sources, clues, tabs, prompts, evidence, caches and pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.functions import constants as K, display, rules, text as T
from cataloom.operators import answers as N, delivery as D, resume as R, store as S
from cataloom.plans.catalogue import _GATED, _sql_list, query
from cataloom.plans.fixtures import CATALOG_SQL, catalog, table
from cataloom.sources import resolution

_RANGE = 64


def _file(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a file's rows, numbered from 1."""
    return table(spark, d, "part").selectExpr("p_partkey + 1 as row_id", "p_name", "p_retailprice")


_STORED = "select p_partkey + 1 as row_id, case when (p_partkey + 1) % 5 = 0 then 'FAILED' else 'COMPLETED' end as status from part"


@query(f"""with n as (select count(*) as n from part), s as ({_STORED}), x as (select floor(((n * 2) // 3 - 1) / {_RANGE}) * {_RANGE} as through from n)
select row_id, row_id % 5 <> 0 and row_id <= through as restored from s cross join x""")
def resume_changed_file(spark: SparkSession, d: str) -> DataFrame:
    """A row two thirds through the file has changed: what lies before its range is restored."""
    old = _file(spark, d)
    at = old.count() * 2 // 3
    now = old.withColumn("p_name", F.when(F.col("row_id") == at, F.lit("changed")).otherwise(F.col("p_name")))
    return _restored(old, now)


@query(f"with s as ({_STORED}) select row_id, status = 'COMPLETED' as restored from s union all select row_id + (select count(*) from part), false from s where row_id <= 70")
def resume_extended_file(spark: SparkSession, d: str) -> DataFrame:
    """A file that was only added to is restored through its old end."""
    old = _file(spark, d)
    n = old.count()
    return _restored(old, old.unionByName(old.where("row_id <= 70").withColumn("row_id", F.col("row_id") + n)))


def _restored(old: DataFrame, now: DataFrame) -> DataFrame:
    stored = old.select("row_id", F.when(F.col("row_id") % 5 == 0, "FAILED").otherwise("COMPLETED").alias("status"))
    done, todo = R.resumed_by_content(now, stored, R.file_guard(old, _RANGE), _RANGE)
    return done.select("row_id", F.lit(True).alias("restored")).unionByName(todo.select("row_id", F.lit(False).alias("restored")))


@query("select 'store' as source, s_suppkey as row_id, s_name as name from supplier")
def source_resolution(spark: SparkSession, d: str) -> DataFrame:
    """No file, a table without rows, a store with rows, the sample: the store is read."""
    folder = S.work_folder(spark)
    stored = table(spark, d, "supplier").selectExpr("s_suppkey as row_id", "s_name as name")
    stored.limit(0).write.parquet(f"{folder}/empty")
    stored.write.parquet(f"{folder}/store")
    read = lambda name: lambda: spark.read.parquet(f"{folder}/{name}")
    chain = [("file", f"{folder}/missing", read("missing")), ("empty", f"{folder}/empty", read("empty")), ("store", f"{folder}/store", read("store")), ("sample", None, lambda: resolution.sample_products(spark))]
    name, rows = resolution.resolved(spark, chain)
    return rows.select(F.lit(name).alias("source"), "row_id", "name")


_KINDS = ("furnace", "brass valve", "relay", "widget")


def _clue_sql() -> str:
    lines = {c: "'" + "\n".join(K.CLUE_LINES[c]).replace("'", "''") + "'" for c in K.CLUE_LINES}
    text = " ".join(f"when {i} then {lines[c]}" for i, c in enumerate(("HVAC", "Plumbing", "Electrical", "General")))
    return f"""with c as ({CATALOG_SQL}), k as (select row_id, manufacturer as maker, (list_value({_sql_list(_KINDS)}))[row_id % 4 + 1] || ' ' || row_id as part, row_id % 4 as kind from c)
select row_id, 'mock://fallback/' || regexp_replace(lower(maker || ' ' || part), '[^a-z0-9]+', '-', 'g') as source_url, replace(replace(case kind {text} end, '{{manufacturer}}', maker), '{{part_number}}', part) as raw_content from k"""


@query(_clue_sql())
def starter_clues(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.get(F.array(*map(F.lit, _KINDS)), (F.col("row_id") % 4).cast("int")), F.lit(" "), "row_id")
    return resolution.starter_clues(catalog(spark, d).select("row_id", "manufacturer", part.alias("mfg_part_number"))).select("row_id", "source_url", "raw_content")


@query(f"""with c as ({CATALOG_SQL}) select row_id, 'S' || row_id as sku_id, case when row_id % 2 = 0 then '24' end as attr_voltage_value, case when row_id % 3 = 0 then 'P80' end as attr_grit_value, case when row_id % 3 = 0 then 'LLM_8B' end as attr_grit_source, case when row_id % 2 = 0 then 'at 24 V' end as attr_voltage_evidence,
'row_id,sku_id,manufacturer,mfg_part_number,category,status,validity,completeness,overall_confidence,total_time_ms,attr_voltage_value,attr_voltage_confidence,attr_voltage_source,attr_voltage_evidence,attr_grit_value,attr_grit_confidence,attr_grit_source,attr_grit_evidence' as columns from c""")
def lineage_tab(spark: SparkSession, d: str) -> DataFrame:
    """The audit tab over two sets of fields; voltage comes first since row 2 brings it."""
    x = D.lineage_tab(*_audited(spark, d))
    return x.select("row_id", "sku_id", "attr_voltage_value", "attr_grit_value", "attr_grit_source", "attr_voltage_evidence", F.lit(",".join(x.columns)).alias("columns"))


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = catalog(spark, d)
    quality = {"sku_id": F.concat(F.lit("S"), "row_id"), "status": F.when(F.col("row_id") % 9 == 0, "MANUAL_REVIEW").otherwise("COMPLETED"), "validity": F.col("row_id") % 5 > 0, "completeness": F.lit(1.0), "overall_confidence": F.lit(0.9), "total_time_ms": F.lit(5.0), "validation_flags": F.when(F.col("row_id") % 5 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))}
    volts = rows.where("row_id % 2 = 0").selectExpr("row_id", "0 as pos", "'voltage' as field_name", "'24 V' as raw_value", "'24' as normalized_value", "'V' as unit", "cast(null as double) as confidence", "'regex' as source", "'at 24 V' as evidence_snippet")
    grit = rows.where("row_id % 3 = 0").selectExpr("row_id", "1 as pos", "'grit' as field_name", "'P80' as raw_value", "cast(null as string) as normalized_value", "cast(null as string) as unit", "cast(0.5 as double) as confidence", "cast(null as string) as source", "cast(null as string) as evidence_snippet")
    return rows.select("*", *[c.alias(n) for n, c in quality.items()]), volts.unionByName(grit)


@query(f"""with c as ({CATALOG_SQL}) select cast(row_id as varchar) as row_id, 'S' || row_id as sku, mfg_part_number as part, case when row_id % 9 = 0 then 'MANUAL_REVIEW' else 'COMPLETED' end as status, case when row_id % 5 = 0 then 'A, B' else '' end as flags, raw_description as description from c where row_id % 9 = 0 or row_id % 5 = 0""")
def review_tab(spark: SparkSession, d: str) -> DataFrame:
    names = {"Row ID": "row_id", "SKU ID": "sku", "Part Number": "part", "Status": "status", "Validation Flags": "flags", "Description": "description"}
    return D.review_tab(_audited(spark, d)[0]).select(*[F.col(a).alias(b) for a, b in names.items()])


@query(f"""{_GATED}, t as (select row_id, status = 'COMPLETED' as done, row_id % 5 as r, row_id * 3 as tokens from gated), x as (select count(*) as total, count(*) filter (done) as done, count(*) filter (done and r not in (1, 2, 3)) as rules, count(*) filter (done and r = 3) as cached, count(*) filter (done and r = 2) as small, count(*) filter (done and r = 1) as large, sum(tokens) as tokens from t)
select unnest(['Total Rows', 'Completed Rows', 'Deterministic Resolved', 'Cache Hits', 'Llm 8B Count', 'Llm 70B Count', 'Manual Review Count', 'Failed Count', 'Total Tokens Consumed', 'Rows Per Second', 'Elapsed Seconds']) as metric,
unnest([total, done, rules, cached, small, large, 0, 0, tokens, round(done / 8.0, 2), 8.0]::double[]) as value from x""")
def telemetry_tab(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("row_id") % 5
    sources = F.when(r == 1, F.array(F.lit("llm_70b_fallback"), F.lit("llm_8b"))).when(r == 2, F.array(F.lit("llm_8b"), F.lit("regex"))).when(r == 3, F.array(F.lit("enrichment_cache"))).otherwise(F.array(F.lit("regex")))
    x = rules.gated(catalog(spark, d)).select("row_id", "status", sources.alias("sources"), F.lit(False).alias("cache_hit"), (F.col("row_id") * 3).alias("tokens"), F.lit(1.0).alias("ms"))
    return D.telemetry_tab(x, 8.0).where("metric not in ('Llm Bypass Ratio', 'Avg Latency Ms')").select("metric", F.col("value").cast("double").alias("value"))


@query(f"""with c as ({CATALOG_SQL}) select row_id, 'S' || row_id as sku, case when row_id % 2 = 0 then '24' end as volts, case when row_id % 3 = 0 then 'P80' end as grit, case when row_id % 5 = 0 then 2 else 0 end as n_flags from c""")
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    """Records as nested JSON, read back."""
    x = D.nested_json(*_audited(spark, d))
    at = lambda path: F.get_json_object("json", path)
    return x.select("row_id", at("$.identity.sku_id").alias("sku"), at("$.attributes.voltage.normalized_value").alias("volts"), at("$.attributes.grit.raw_value").alias("grit"), F.size(F.from_json(at("$.quality.validation_flags"), "array<string>")).alias("n_flags"))


@query(f"""with c as ({CATALOG_SQL}), e as (
select row_id, 'voltage' as field_name, (cast(split_part(mfg_part_number, '-', 2) as bigint) * 0 + p_size * 10)::varchar || 'V' as evidence from c join part on p_partkey = row_id where row_id % 2 = 0
union all select row_id, 'power', p_size || ' W' from c join part on p_partkey = row_id where row_id % 3 = 0
union all select row_id, 'grit', 'P' || (p_size + 40) from c join part on p_partkey = row_id where row_id % 5 = 0
union all select row_id, 'dimensions', p_size || ' in x 1/8 in' from c join part on p_partkey = row_id where row_id % 4 = 0
union all select row_id, 'frequency', '60 Hz' from c where row_id % 7 = 0
union all select row_id, 'material', case row_id % 3 when 1 then 'Stainless Steel' else 'brass' end from c where row_id % 3 > 0) select * from e""")
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The text that each rule matched."""
    return rules.extract_long(catalog(spark, d)).select("row_id", "field_name", F.col("evidence_snippet").alias("evidence"))


@query(f"""with c as ({CATALOG_SQL}) select row_id, 'Category: ' || category || chr(10) || 'Source URL: ' || 'http://x.example/' || row_id || chr(10) || chr(10) || 'Product document text:' || chr(10) || substr(repeat(raw_description || ' ', 900), 1, 25000) as prompt,
length(substr(repeat(raw_description || ' ', 900), 1, 1500)) + length('Manufacturer: ' || manufacturer || chr(10) || 'Part number: ' || mfg_part_number || chr(10) || 'Category: ' || category || chr(10) || 'Description: ' || raw_description || chr(10) || 'Context:' || chr(10)) as small_chars from c""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their documents cut to the models' caps."""
    # A row grows some 200-fold here, so the table's few splits are dealt out first.
    x = catalog(spark, d).repartition("row_id").withColumn("document", F.repeat(F.concat("raw_description", F.lit(" ")), 900))
    small = display.extraction_prompt(F.col("manufacturer"), F.col("mfg_part_number"), F.col("category"), F.col("raw_description"), F.col("document"))
    return x.select("row_id", display.request_prompt(F.col("category"), F.concat(F.lit("http://x.example/"), "row_id"), F.col("document")).alias("prompt"), F.length(small).cast("long").alias("small_chars"))


@query("select event_id, case when event_id % 3 = 0 then (event_id % 50) + 0.5 when event_id % 3 = 1 then 120.0 + event_id % 60 end::double as wait from events")
def retry_after_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header first, then the message, then nothing."""
    x = table(spark, d, "events")
    k = F.col("event_id")
    headers = F.when(k % 3 == 0, F.create_map(F.lit("Date"), F.lit("x"), F.lit("Retry-After"), F.concat((k % 50).cast("string"), F.lit(".5")))).otherwise(F.create_map(F.lit("retry-after"), F.lit("soon")))
    message = F.when(k % 3 < 2, F.concat(F.lit("Please try again in 2m"), (k % 60).cast("string"), F.lit("s"))).otherwise(F.lit("no hint"))
    return x.select("event_id", T.retry_after(headers, message).alias("wait"))


@query("""with w as (select l_orderkey as row_id, 'http://h.example/' || (l_partkey % 40) as url, min(l_linenumber) as rank from lineitem where l_partkey % 40 > 0 group by 1, 2), r as (select *, row_number() over (partition by row_id order by rank, url) as place from w)
select row_id, 'M' || (row_id % 7) || ' P' || row_id || ' technical specifications' as query, cast(place as int) as rank, url from r where place <= 8""")
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    links = lines.selectExpr("l_orderkey as row_id", "l_linenumber as rank", "if(l_partkey % 40 = 0, ' ', concat(if(l_linenumber % 2 = 0, ' ', ''), 'http://h.example/', l_partkey % 40)) as url")
    rows = lines.selectExpr("l_orderkey as row_id").distinct().selectExpr("row_id", "concat('M', row_id % 7) as manufacturer", "concat('P', row_id) as mfg_part_number")
    return N.search_candidates(rows, links)


@query("select l_orderkey as row_id, round(avg(case when l_linenumber % 3 = 0 then 0 else l_discount * 10 end), 4)::double as overall_confidence from lineitem group by 1")
def api_confidence(spark: SparkSession, d: str) -> DataFrame:
    return N.api_confidence(table(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "if(l_linenumber % 3 = 0, null, cast(l_discount * 10 as double)) as confidence"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey as row_id", "concat(p_brand, '-PN-', p_partkey) as sku_id", "p_brand as manufacturer_name", "concat('PN-', p_partkey) as part_number", "p_type as category", "if(p_partkey % 3 = 0, 'error', 'success') as status")


@query("""with f as (select p_partkey as row_id, 'PN-' || p_partkey as part_number from part where contains(lower(p_brand || '-PN-' || p_partkey || chr(0) || p_type || chr(0) || case when p_partkey % 3 = 0 then 'error' else 'success' end), 'err')), n as (select greatest(1, ceil(count(*) / 20.0)) as pages from f)
select row_id, part_number, cast(pages as bigint) as page from (select *, row_number() over (order by row_id) as k from f) cross join n where k > (pages - 1) * 20""")
def result_page_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Results that hold a word in any of five columns; a page beyond the last is the last."""
    found, page, _ = N.result_page(N.searched(_results(spark, d), "  ERR "), "row_id", 10_000_000)
    return found.select("row_id", "part_number", F.lit(page).cast("long").alias("page"))


_SIZE = "case when k < 1024 then k || ' B' when k < 10240 then printf('%.1f', round(k / 1024.0, 1)) || ' KB' when k < 1048576 then printf('%.0f', round(k / 1024.0, 0)) || ' KB' when k < 10485760 then printf('%.1f', round(k / 1048576.0, 1)) || ' MB' else printf('%.0f', round(k / 1048576.0, 0)) || ' MB' end"


@query(f"""with o as (select o_orderkey as row_id, o_orderkey * 7 as k, o_orderkey % 9 + 1 as total from orders)
select row_id, {_SIZE} as size, array_to_string(list_sort(list_distinct(list_filter(case when total <= 5 then [1, 2, 3, 4, 5] else [1, 2, 3, total, 4] end, lambda x: x <= total))), ',') as buttons from o""")
def shown_sizes_and_buttons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("row_id"), display.file_size(k * 7).alias("size"), F.array_join(display.page_buttons(F.lit(3), (k % 9 + 1).cast("int")), ",").alias("buttons"))


@query("""select 'k' || k as cache_key, case when k % 2 = 0 then 'old' else 'new' end as sku_id, case when k % 2 = 0 and (k % 3 = 0 or k % 5 = 0) then '{"a": 0}' else '{"a": ' || k || '}' end as attributes_json, cast(case when k % 2 = 0 then 1 else 2 end as int) as created_at
from (select c_custkey as k from customer) where k % 2 = 0 or (k % 3 > 0 and k % 5 > 0)""")
def enrichment_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Known keys keep their sku and time; records without attributes change nothing."""
    x = table(spark, d, "customer").selectExpr("c_custkey as k")
    old = x.where("k % 2 = 0").selectExpr("concat('k', k) as cache_key", "'old' as sku_id", "'{\"a\": 0}' as attributes_json", "1 as created_at")
    records = x.selectExpr("concat('k', k) as cache_key", "'new' as sku_id", "case when k % 3 = 0 then '{ }' when k % 5 = 0 then null else concat('{\"a\": ', k, '}') end as attributes_json", "2 as created_at")
    return S.enrichment_cached(old, records)


_ENDS, _SPACES = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]", r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '{_ENDS}'), lambda x: trim(regexp_replace(x, '{_SPACES}', ' ', 'g'))), lambda x: x <> ''), chr(10)) as cleaned from documents")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines, white space collapsed."""
    return table(spark, d, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("cleaned"))
