"""Registered queries over single rules: identity, words, units, formats, key lists, splits of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.functions import constants as K, display, text as T, units
from cataloom.operators import delivery as D, intake as I, metrics as M, rows as R, store as S
from cataloom.plans.catalogue import _SCORE, _sql_list, query
from cataloom.plans.fixtures import CATALOG_SQL, catalog, table


@query("select p_partkey as row_id, case p_partkey % 3 when 0 then 'UNKNOWN' else p_brand end || '-' || case p_partkey % 4 when 0 then 'PART' else 'P ' || p_partkey end as sku from part")
def api_skus(spark: SparkSession, d: str) -> DataFrame:
    maker, part = F.expr("case p_partkey % 3 when 0 then ' ' when 1 then concat(' ', p_brand, ' ') else p_brand end"), F.expr("if(p_partkey % 4 = 0, null, concat('P ', p_partkey, ' '))")
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), R.api_sku(maker, part).alias("sku"))


_WORDS = [w for words in K.CATEGORY_WORDS.values() for w in words]


def _category_sql(text: str) -> str:
    return "case " + " ".join(f"when len(list_filter([{_sql_list(words)}], lambda w: contains({text}, w))) > 0 then '{name}'" for name, words in K.CATEGORY_WORDS.items()) + " else 'General' end"


@query(f"with x as (select p_partkey as row_id, lower(p_name || ' ' || ([{_sql_list(_WORDS)}])[p_partkey % {len(_WORDS)} + 1] || ' ' || ([{_sql_list(_WORDS)}])[p_partkey * 7 % {len(_WORDS)} + 1]) as t from part) select row_id, {_category_sql('t')} as category from x")
def category_words(spark: SparkSession, d: str) -> DataFrame:
    """Every category word, alone with another one; the first category in order counts."""
    words = F.array(*map(F.lit, _WORDS))
    text = F.concat("p_name", F.lit(" "), F.upper(F.get(words, (F.col("p_partkey") % len(_WORDS)).cast("int"))), F.lit(" "), F.get(words, (F.col("p_partkey") * 7 % len(_WORDS)).cast("int")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), display.category_of(text).alias("category"))


# Raw values with what they mean: signs and separators, airflow, noise words, angles, threads, areas.
_VECTORS = (
    ("1,200 CFM", "1200", "CFM"), ("1,234,567 CFM", "1234567", "CFM"), ("−40 °F", "-40", "°F"), ("800 CFM", "800", "CFM"), ("800 CFM @ 0.5 in. wc", "800 CFM @ 0.5 in. wc", None), ("1,5 mm", "1,5 mm", None),
    ("3.5 tons", "42000", "BTU/h"), ("1/2-14 NPT", "0.5-14 NPT", None), ("12 sq ft", "12", "sq ft"), ("1 1/2 inch", "1.5", "in"), ("37 to 102 deg F", "37-102", "°F"), ("10/16 mm", "10-16", "mm"), ("PN-1234-A", "PN-1234-A", None), ("100 millmeters", "100", "mm"),
    ("120-277 VAC", "120-277", "V"), ("20-30 XYZ", "20-30", "XYZ"), ("40%", "40", "%"), ("1/3 HP", "0.333", "HP"), ("150 lb-in", "150", "lb-in"), ("   ", "", None),
)


@query(f"select p_partkey as row_id, ([{_sql_list(v[1] for v in _VECTORS)}])[p_partkey % {len(_VECTORS)} + 1] as value, nullif(([{_sql_list(v[2] or '' for v in _VECTORS)}])[p_partkey % {len(_VECTORS)} + 1], '') as unit from part")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(v[0]) for v in _VECTORS]), (F.col("p_partkey") % len(_VECTORS)).cast("int"))
    return units.normalized(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), raw.alias("raw_value"))).select("row_id", "value", "unit")


@query(f"""with {_SCORE.strip()}, w as (select doc_id, lower(split_part(trim(text), ' ', 2)) as maker, lower(split_part(trim(text), ' ', 3)) as part from documents)
select doc_id, sum(case when score = -5 or length(trim(sentence)) < 10 then score else score + case when maker <> '' and contains(lower(sentence), maker) then 2 else 0 end + case when part <> '' and contains(lower(sentence), part) then 2 else 0 end end) as total from scored join w using (doc_id) group by 1""")
def sentence_score_named(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that name the maker or the part count for more; here the second and third word of each text stand for them."""
    words = F.split(F.trim("text"), " ")
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.coalesce(F.get(words, 1), F.lit("")).alias("maker"), F.coalesce(F.get(words, 2), F.lit("")).alias("part"))
    scored = x.select("doc_id", "maker", "part", F.explode(T.sentences(F.col("text"), True)).alias("sentence"))
    return scored.select("doc_id", T.sentence_score(F.col("sentence"), F.col("maker"), F.col("part"), True).alias("score")).groupBy("doc_id").agg(F.sum("score").alias("total"))


@query("select event_id, event_id % 3 < 2 as daily from events")
def daily_limits(spark: SparkSession, d: str) -> DataFrame:
    message = F.expr("case event_id % 3 when 0 then concat('Limit 500 reached on Tokens per Day, key ', event_id) when 1 then 'rate limit (TPD)' else 'rate limit, try again in 5s' end")
    return table(spark, d, "events").select("event_id", T.daily_limit(message).alias("daily"))


@query("""select o_orderkey as row_id, printf('%.1f', o_orderkey % 1000 / 10.0) || '%' as share, case when o_orderkey % 300 < 100 then (o_orderkey % 300 * 10) || 'ms' else printf('%.2f', o_orderkey % 300 / 100.0) || 's' end as took,
'$' || case when o_orderkey % 2 = 1 then printf('%.6f', o_orderkey % 9 / 1000.0) when o_orderkey % 400 = 0 then '0.000000' else printf('%.2f', o_orderkey % 400 / 100.0) end as price, case when o_orderkey % 100 >= 90 then 'high' when o_orderkey % 100 >= 70 then 'medium' else 'low' end as tone from orders""")
def shown_formats(spark: SparkSession, d: str) -> DataFrame:
    """Shares, times, prices and tones as they are shown."""
    k = F.col("o_orderkey")
    price = F.when(k % 2 == 1, k % 9 / 1000.0).otherwise(k % 400 / 100.0)
    return table(spark, d, "orders").select(k.alias("row_id"), display.percent(k % 1000 / 1000.0).alias("share"), display.duration((k % 300 * 10).cast("double")).alias("took"), display.currency(price).alias("price"), display.tone(k % 100 / 100.0).alias("tone"))


@query("select user_id, case when sum(case when event_type = 'error' then 1 else 0 end) = 0 then 'a,b,c' else 'a,c' end as keys from events group by 1")
def usable_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "error", F.lit("b"))).alias("gone"))
    return x.select("user_id", F.array_join(M.usable_keys(F.array(*map(F.lit, "abc")), F.col("gone")), ",").alias("keys"))


@query(f"with c as ({CATALOG_SQL}) select row_id, substr(case when row_id % 3 = 0 then raw_description else repeat('context ' || row_id || ' ', 30) end, 1, 100) as evidence from c")
def evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    context = F.when(F.col("row_id") % 3 == 0, F.lit("")).otherwise(F.repeat(F.concat(F.lit("context "), "row_id", F.lit(" ")), 30))
    return catalog(spark, d).select("row_id", display.evidence(context, F.col("raw_description")).alias("evidence"))


@query(f"""with c as ({CATALOG_SQL}) select cast(row_number() over (order by row_id desc) as bigint) as place, manufacturer || '-' || mfg_part_number as sku, mfg_part_number as part, 'v' || row_id as value_1 from c""")
def catalog_sheet_order(spark: SparkSession, d: str) -> DataFrame:
    """Products and attributes as two sheets; the delivered sheet has the products in their order."""
    rows = catalog(spark, d)
    sku = F.concat("manufacturer", F.lit("-"), "mfg_part_number")
    products = rows.select((-F.col("row_id")).alias("pos"), sku.alias("sku_id"), "category", F.col("manufacturer").alias("manufacturer_name"), F.col("mfg_part_number").alias("part_number"), F.lit(0.5).alias("overall_confidence"))
    values = rows.select(F.col("row_id").alias("pos"), sku.alias("sku_id"), F.lit("color").alias("field_name"), F.concat(F.lit("v"), "row_id").alias("raw_value"), F.lit(None).cast("string").alias("normalized_value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("source_url"))
    sheet = D.catalog_sheet(D.related(products, values))
    # A reader of the sheet numbers its rows by their place; a place belongs to one run of the sort, so the rows are written with theirs.
    placed = sheet.select(F.lit("sheet").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("`SKU - MY_PART_NUMBER`").alias("sku"), F.col("PART_NUMBER").alias("part"), F.col("`ATTRIBUTE_VALUE 1`").alias("value_1"))
    return I.positional_ids(S.kept(placed, "sheet"), "file", "at").select(F.col("row_id").cast("long").alias("place"), "sku", "part", "value_1")
