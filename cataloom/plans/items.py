"""Registered queries over delimited files, items of several shapes, declared schemas, calls that fail and the cache by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.functions import schema as S
from cataloom.operators import attributes as A, pages as P, shapes as H
from cataloom.operators.store import work_folder
from cataloom.plans.catalogue import query
from cataloom.plans.enrichment import answered_or_failed
from cataloom.plans.fixtures import CATALOG_SQL, catalog, table
from cataloom.sources.delimited import scan
from cataloom.sources.readers import preflight_report


def _written(spark: SparkSession, d: str) -> str:
    """The documents as delimited files, with line breaks and quotes in their fields: one for each split of the table, three at least."""
    folder = f"{work_folder(spark)}/documents.csv"
    note = F.concat(F.col("lang"), F.lit(' 3/4" pipe, "'), "source", F.lit('"'))
    rows = table(spark, d, "documents").select("text", F.col("source").alias("Part Number"), note.alias("note"), "doc_id")
    rows = rows if rows.rdd.getNumPartitions() >= 3 else rows.repartition(3)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return folder


@query("""select cast(doc_id as varchar) as doc_id, text, source as part_number, lang || ' 3/4" pipe, "' || source || '"' as note from documents""")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts through delimited files and back."""
    return scan(spark, _written(spark, d)).rows.select("doc_id", "text", F.col("Part Number").alias("part_number"), "note")


@query("select cast(count(*) as bigint) as n_rows, 'text,Part Number,note,doc_id' as columns, '' as problems from documents")
def csv_preflight(spark: SparkSession, d: str) -> DataFrame:
    return preflight_report(spark, _written(spark, d), 1 << 60).select("n_rows", F.array_join("columns", ",").alias("columns"), F.array_join("problems", ",").alias("problems"))


@query("""with p as (select page_id, case when page_id % 4 = 0 then 'failed' when page_id % 4 = 1 and not contains(url, '#') and not contains(url, '?') then 'pdf' else 'html' end as outcome from pages) select outcome, cast(count(*) as bigint) as n, cast(count(*) filter (outcome <> 'html') as bigint) as empty from p group by 1""")
def page_fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A URL's path tells a document; where it ends in a fragment or a query, what is added to it is none of the path."""
    pages = table(spark, d, "pages").withColumn("url", F.when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("/Sheet.PDF"))).otherwise(F.col("url")))
    x = P.fetched(pages, failed=F.col("page_id") % 4 == 0)
    return x.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("raw_content") == "").alias("empty"))


#: Items of a third of the catalog each: record, response, dictionary with a map.
_ITEM = """case row_id % 3
when 0 then to_json(named_struct('identity', named_struct('manufacturer', manufacturer, 'mfg_part_number', mfg_part_number, 'category', category), 'attributes', map('weight', named_struct('raw_value', concat(row_id, ' lbs'), 'normalized_value', '', 'unit', 'lbs', 'evidence_snippet', ' http://e.example '))))
when 1 then to_json(named_struct('sku_id', concat(manufacturer, '-', mfg_part_number), 'category', category, 'enriched_attributes', array(named_struct('field_name', 'weight', 'raw_value', 'r', 'normalized_value', concat(' ', row_id, ' '), 'unit', '', 'source_url', 'http://r.example'))))
else to_json(named_struct('mfg', manufacturer, 'part_num', mfg_part_number, 'attributes', map('weight', row_id, 'z_mm', 7))) end"""


@query(f"""with c as ({CATALOG_SQL}) select row_id, manufacturer as maker, mfg_part_number as part, manufacturer || '-' || mfg_part_number as sku, case when row_id % 3 = 2 then 'General' else category end as category,
cast(row_id as varchar) || case when row_id % 3 = 0 then ' lbs' else '' end as weight, 'lbs' as weight_uom, case row_id % 3 when 0 then 'http://e.example' when 1 then 'http://r.example' else '' end as url, case when row_id % 3 = 2 then 'Z' else '' end as label_2, case when row_id % 3 = 2 then '7' else '' end as value_2,
'Weight: ' || cast(row_id as varchar) || case row_id % 3 when 0 then ' lbs lbs' when 2 then '; Z: 7' else '' end as long_desc from c""")
def delivery_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Items of three shapes in one table, one plan."""
    items = catalog(spark, d).select("row_id", F.expr(_ITEM).alias("item"))
    names = {"MANUFACTURER_NAME": "maker", "PART_NUMBER": "part", "SKU - MY_PART_NUMBER": "sku", "CATEGORY": "category", "WEIGHT": "weight", "WEIGHT_UOM": "weight_uom", "MFR URL": "url", "ATTRIBUTE_LABEL 2": "label_2", "ATTRIBUTE_VALUE 2": "value_2", "LONG_DESC1": "long_desc"}
    return A.delivery(H.delivery_items(items)).select("row_id", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query("""select p_partkey as row_id, cast(case when p_partkey % 5 = 0 then 0 else 1 end + case when p_partkey % 7 = 0 then 0 else 1 end as int) as n, case when p_partkey % 5 > 0 then 'volts=' || p_size || ':0.9' end as first, case when p_partkey % 7 > 0 then 'amps=' || p_partkey || ':1.0' end as second from part""")
def attribute_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Attributes given as lists and as objects; blank and reserved ones go."""
    x = table(spark, d, "part").selectExpr("p_partkey as row_id", "concat('[[\"', if(p_partkey % 5 = 0, ' ', ' volts'), '\", ', p_size, ', null, \"V\", \"?\"], {\"field_name\": \"', if(p_partkey % 7 = 0, 'Usage', 'amps'), '\", \"raw_value\": \"', p_partkey, '\", \"confidence\": 4}, null, 5]') as j")
    found = H.coerced(F.from_json("j", "array<variant>"), F.lit("http://d.example"))
    x = x.select("row_id", found.alias("a"))
    told = lambda name: F.get(F.transform(F.filter("a", lambda y: y["field_name"] == name), lambda y: F.concat(y["field_name"], F.lit("="), y["raw_value"], F.lit(":"), y["confidence_score"].cast("string"))), F.lit(0))
    return x.select("row_id", F.size("a").alias("n"), told("volts").alias("first"), told("amps").alias("second"))


@query("""select p_partkey as row_id, concat_ws('; ', case when p_partkey % 3 = 0 then 'manufacturer_name missing' end, case when p_partkey % 4 = 0 then 'part_number string_type' end, case when p_partkey % 5 = 0 then 'category literal_error' end) as errors from part where p_partkey % 11 > 0
union all select p_partkey, ' json_invalid' from part where p_partkey % 11 = 0""")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    body = "concat('{', if(p_partkey % 3 = 0, '', concat('\"manufacturer_name\": \"', p_brand, '\", ')), '\"part_number\": ', if(p_partkey % 4 = 0, cast(p_partkey as string), concat('\"', p_partkey, '\"')), ', \"category\": \"', if(p_partkey % 5 = 0, 'Toys', 'HVAC'), '\"', if(p_partkey % 11 = 0, '', '}'))"
    x = S.validated(table(spark, d, "part").selectExpr("p_partkey as row_id", f"{body} as body"), "body", S.REQUEST)
    return x.select("row_id", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(" "), e["rule"])), "; ").alias("errors"))


@query("""select o_orderkey as row_id, case when o_orderkey % 2 = 0 then 'enriched_attributes[1].confidence_score less_than_equal' else '' end || case when o_orderkey % 3 = 0 then case when o_orderkey % 2 = 0 then '; ' else '' end || 'processing_time_ms greater_than_equal' else '' end as errors from orders""")
def response_validation(spark: SparkSession, d: str) -> DataFrame:
    """Violations inside lists, with their place."""
    attribute = '{"field_name": "f", "raw_value": "r", "normalized_value": "n", "source_url": "u", "confidence_score": '
    body = F.concat(F.lit(f'{{"sku_id": "s", "category": "c", "enriched_attributes": [{attribute}0.5}}, {attribute}'), F.when(F.col("o_orderkey") % 2 == 0, "1.5").otherwise("1"), F.lit('}], "processing_time_ms": '), F.when(F.col("o_orderkey") % 3 == 0, "-1").otherwise("2.5"), F.lit("}"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), S.violations(body, S.RESPONSE).alias("errors"))
    return x.select("row_id", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(" "), e["rule"])), "; ").alias("errors"))


@query(f"""with c as ({CATALOG_SQL}) select row_id, case when row_id % 97 = 0 then '' else 'answer to ' || mfg_part_number end as response, case when row_id % 97 = 0 then 'RuntimeError: no ' || mfg_part_number || ' (LLM)' else '' end as error from c""")
def row_faults(spark: SparkSession, d: str) -> DataFrame:
    """A service that fails as a whole for one row in 97: only those rows fail."""

    class Service:
        def extract(self, prompts: list[str]) -> list[str]:
            bad = [p for p in prompts if int(p.removeprefix("PN-")) % 97 == 0]
            if bad:
                raise RuntimeError(f"no {bad[0]}")
            return [f"answer to {p}" for p in prompts]

    x = answered_or_failed(catalog(spark, d).withColumnRenamed("mfg_part_number", "prompt"), Service())
    told = F.transform("errors", lambda e: F.concat(e["type"], F.lit(": "), e["message"], F.lit(" ("), e["stage"], F.lit(")")))
    return x.select("row_id", "response", F.array_join(told, "; ").alias("error"))


@query(f"""with c as ({CATALOG_SQL}), r as (select row_id, manufacturer || ' text' as text, 'http://host.example/' || (row_id % 40) as url from c), f as (select url, min(row_id) as first from r group by 1)
select r.row_id, case when r.row_id % 40 < 5 then 'cached ' || (r.row_id % 40) else g.text end as cleaned_text, r.row_id % 40 < 5 as from_cache from r join f using (url) join r g on g.row_id = f.first""")
def scrape_cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Pages reduced once per URL: the first row's text, or the cache's, serves all rows of the URL."""
    rows = catalog(spark, d).selectExpr("row_id", "concat(if(row_id % 2 = 0, ' ', ''), 'http://host.example/', row_id % 40) as url", "manufacturer as maker", "mfg_part_number as part", "concat(manufacturer, ' text') as raw_content")
    cache = rows.select((F.col("row_id") % 40).alias("k")).where("k < 5").distinct().select(P.url_hash(F.concat(F.lit("http://host.example/"), "k")).alias("url_hash"), F.concat(F.lit("cached "), "k").alias("cleaned_text"))
    return P.reduced_by_url(rows, cache)[0]
