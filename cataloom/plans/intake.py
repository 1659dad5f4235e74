"""Registered queries over requests, fetched pages and answers, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.functions import constants as K, text as T
from cataloom.operators import answers as N, intake as I
from cataloom.plans.catalogue import query
from cataloom.plans.fixtures import CATALOG_SQL, catalog, table

_CATEGORY = "case p_partkey % 5 when 0 then 'HVAC' when 1 then ' ' when 2 then 'Toys' when 3 then 'General' else ' Plumbing ' end"


@query(f"""with x as (select p_partkey as row_id, case when p_partkey % 3 = 0 then p_brand else p_brand || '-B' end as manufacturer_name, case when p_partkey % 4 = 0 then '' else 'PN-' || p_partkey end as part_number,
case when p_partkey % 7 > 0 then trim(p_name) end as raw_description, coalesce(nullif(trim({_CATEGORY}), ''), 'General') as category from part)
select *, case when category = 'Toys' then 'error' else 'pending' end as status, case when category = 'Toys' then 'category: Toys is none of HVAC, Plumbing, Electrical, General' end as error from x""")
def api_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.concat("p_brand", F.lit(" (X1)")).alias("Part_Manuf"),
        F.expr("case when p_partkey % 3 = 0 then '  ' else concat(p_brand, '-B') end").alias("BRAND"),
        F.expr("case when p_partkey % 4 > 0 then concat(' PN-', p_partkey) end").alias("Mfg Part.Num"),
        F.expr("case when p_partkey % 7 > 0 then p_name else '' end").alias("Part-Desc"),
        F.expr(_CATEGORY).alias("Category"),
    )
    return I.api_requests(rows)


@query("select o_orderkey as pos, o_orderpriority as file, row_number() over (order by o_orderpriority, o_orderkey) as row_id from orders")
def positional_row_ids(spark: SparkSession, d: str) -> DataFrame:
    return I.positional_ids(table(spark, d, "orders").selectExpr("o_orderkey as pos", "o_orderpriority as file"), "file", "pos")


# Every "<" begins a piece: a tag and the text after it.  Tags of noise elements raise and lower a depth; text at depth 0 is kept.
_PAGE_SQL = f"""with p as (select page_id, unnest(string_split(substr(coalesce(html, ''), 1, 500000), '<')) as piece, generate_subscripts(string_split(substr(coalesce(html, ''), 1, 500000), '<'), 1) as i from pages),
t as (select *, case when i > 1 then lower(regexp_extract(piece, '^/?([a-zA-Z0-9]+)', 1)) else '' end as tag, case when i = 1 then piece when contains(piece, '>') then substr(piece, strpos(piece, '>') + 1) else '' end as text from p),
n as (select *, sum(case when tag in ({", ".join(f"'{x}'" for x in K.PAGE_NOISE)}) then case when starts_with(piece, '/') then -1 else 1 end else 0 end) over (partition by page_id order by i) as depth from t),
l as (select page_id, i, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as j from n where depth = 0),
d as (select page_id, i, j, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(line, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), ' ' || chr(9) || chr(13) || chr(160)) as line from l),
page as (select pages.page_id, substr(coalesce(string_agg(line, chr(10) order by i, j), ''), 1, 6000) as raw_content from pages left join (select * from d where line <> '') d using (page_id) group by 1)"""


@query(f"{_PAGE_SQL} select page_id, raw_content from page")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.page_text(F.col("html")).alias("raw_content"))


@query(f"""{_PAGE_SQL} select p_partkey as row_id, coalesce(raw_content, '') as raw_content, concat_ws(chr(10) || chr(10), case when p_partkey % 2 = 0 then trim(p_name) end, nullif(trim(coalesce(raw_content, ''), ' ' || chr(10)), ''), 'note') as context
from part left join page on page_id = p_partkey""")
def row_context(spark: SparkSession, d: str) -> DataFrame:
    """A row's description, its page and a note as one context."""
    rows = table(spark, d, "part").selectExpr("p_partkey as row_id", "case when p_partkey % 2 = 0 then concat(' ', p_name) else ' ' end as description")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("row_id"), T.page_text(F.col("html")).alias("raw_content"))
    x = I.texts_of_rows(rows, pages)
    sources = F.array("raw_content", F.lit(None).cast("string"), F.lit(" note\n"))
    return x.select("row_id", "raw_content", I.combined_sources(F.col("description"), sources).alias("context"))


@query("select page_id, page_id % 4 in (0, 1) as allowed, page_id % 4 in (0, 2) as open from pages")
def domain_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Hosts under an exclusive list, and under a block list alone."""
    host = F.expr("case page_id % 4 when 0 then 'maker.com' when 1 then 'shop.maker.com' when 2 then 'notmaker.com' end")
    return table(spark, d, "pages").select("page_id", T.allowed_host(host, (), ("maker.com",)).alias("allowed"), F.coalesce(T.allowed_host(host, ("shop.maker.com",)), F.lit(False)).alias("open"))


@query("""select p_partkey as row_id, case p_partkey % 6 when 0 then 'length' when 1 then 'Depth' when 2 then 'Rotation' when 3 then 'height' else 'Grade' end as field_name,
case p_partkey % 6 when 0 then cast(p_size * 12 as varchar) when 4 then 'fine' when 3 then p_size || '.5' else cast(p_size as varchar) end as normalized_value,
case p_partkey % 6 when 0 then 'in' when 1 then 'ft' when 2 then 'deg' when 3 then 'in' end as unit, case when p_size % 2 = 0 then 1.0 else 0.5 end::double as confidence, 'https://maker.com/' || p_partkey as source_url
from part where p_partkey % 6 < 5""")
def answer_postprocess(spark: SparkSession, d: str) -> DataFrame:
    """Values by the grammar, given ones kept without conversion, reserved names gone."""
    x = table(spark, d, "part").selectExpr(
        "p_partkey as row_id",
        "case p_partkey % 6 when 0 then 'length' when 1 then 'Depth' when 2 then 'Rotation' when 3 then 'height' when 4 then 'Grade' else if(p_partkey % 4 = 1, 'Usage', ' STATUS') end as field_name",
        "case p_partkey % 6 when 0 then concat(p_size, ' ft') when 1 then concat(p_size, ' feet') when 2 then concat(p_size, ' degrees') when 3 then concat(p_size, ' in') else '' end as raw_value",
        "case p_partkey % 6 when 1 then cast(p_size as string) when 2 then concat(' ', p_size) when 3 then concat(p_size, '.5') when 4 then 'fine' end as normalized_value",
        "case p_partkey % 6 when 1 then 'feet' when 2 then 'degrees' when 3 then '\"' end as unit",
        "cast(if(p_size % 2 = 0, 7, 0.5) as double) as confidence",
    )
    return N.postprocessed(x, F.concat(F.lit("https://maker.com/"), "row_id")).drop("raw_value")


@query(f"""with c as ({CATALOG_SQL}) select row_id, 'S' || row_id as sku_id, manufacturer, mfg_part_number, category, 'COMPLETED' as status, true as validity, 1.0::double as completeness, 0.9::double as overall_confidence, 5.0::double as total_time_ms,
case when row_id % 2 = 0 then case when row_id % 4 = 0 then '24' else '24 V' end end as attr_voltage_value, case when row_id % 2 = 0 then 0.9 end::double as attr_voltage_confidence, case when row_id % 2 = 0 then 'regex' end as attr_voltage_source, case when row_id % 4 = 0 then 'at 24 V' end as attr_voltage_evidence,
case when row_id % 3 = 0 then 'P80' end as attr_grit_value, case when row_id % 3 = 0 then 0.5 end::double as attr_grit_confidence, case when row_id % 3 = 0 then 'LLM_8B' end as attr_grit_source, cast(null as varchar) as attr_grit_evidence from c""")
def provenance_export(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d)
    records = rows.select("*", F.concat(F.lit("S"), "row_id").alias("sku_id"), F.lit("COMPLETED").alias("status"), F.lit(True).alias("validity"), F.lit(1.0).alias("completeness"), F.lit(0.9).alias("overall_confidence"), F.lit(5.0).alias("total_time_ms"))
    volts = rows.where("row_id % 2 = 0").selectExpr("row_id", "'voltage' as field_name", "'24 V' as raw_value", "if(row_id % 4 = 0, '24', '') as normalized_value", "cast(null as double) as confidence", "'regex' as source", "if(row_id % 4 = 0, 'at 24 V', '') as evidence_snippet")
    grit = rows.where("row_id % 3 = 0").selectExpr("row_id", "'grit' as field_name", "'P80' as raw_value", "cast(null as string) as normalized_value", "cast(0.5 as double) as confidence", "cast(null as string) as source", "cast(null as string) as evidence_snippet")
    return N.provenance(records, volts.unionByName(grit), ["voltage", "grit"])


@query("select l_orderkey as row_id, string_agg(l_returnflag, ',' order by l_linenumber, l_returnflag) as models from lineitem group by 1")
def models_called(spark: SparkSession, d: str) -> DataFrame:
    x = N.models_called(table(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "l_linenumber as pos", "l_returnflag as model"))
    return x.select("row_id", F.array_join("models", ",").alias("models"))


_RESULTS = "select o_orderkey as row_id, o_custkey as job_id, case when o_orderstatus = 'F' then 'success' else 'error' end as status, (o_orderkey % 5) / 4.0 as confidence from orders"


@query(f"with x as ({_RESULTS}) select job_id, round(avg(case when status = 'success' then confidence end), 6)::double as mean_confidence from x group by 1")
def ui_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").selectExpr("o_custkey as job_id", "if(o_orderstatus = 'F', 'success', 'error') as status", "cast((o_orderkey % 5) / 4.0 as double) as confidence")
    return N.mean_confidence(x, "job_id").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"with x as ({_RESULTS}) select row_id, job_id from x where status = 'success'")
def exportable_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.exportable(table(spark, d, "orders").selectExpr("o_orderkey as row_id", "o_custkey as job_id", "if(o_orderstatus = 'F', 'success', 'error') as status")).select("row_id", "job_id")


@query("select s_suppkey as row_id, 'k' || s_suppkey || '|k2|k3' as keys from supplier")
def key_lists(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(' "k'), "s_suppkey", F.lit("\" ,, 'k2',\" \" , k3 ,"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array_join(T.key_list(raw), "|").alias("keys"))


@query("select event_id, (event_id % 900) + 0.5::double as total_time_ms, case when event_type = 'error' then 2 else 1 end as n_errors, case when event_type = 'error' then 'Timeout' else 'ValueError' end as last_type, case when event_type = 'error' then 'LLM' else 'RULES' end as last_stage from events")
def timing_and_errors(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("start", F.col("ts").cast("timestamp"))
    end = F.timestamp_micros(F.unix_micros("start") + (F.col("event_id") % 900) * 1000 + 500)
    first = N.with_error(F.lit(None), F.lit("ValueError"), F.lit("no part"), F.lit("RULES"))
    second = N.with_error(first, F.lit("Timeout"), F.lit("no answer"), F.lit("LLM"))
    errors = F.when(F.col("event_type") == "error", second).otherwise(first)
    last = F.element_at(errors, -1)
    return x.select("event_id", N.elapsed_ms(F.col("start"), end).alias("total_time_ms"), F.size(errors).alias("n_errors"), last["type"].alias("last_type"), last["stage"].alias("last_stage"))
