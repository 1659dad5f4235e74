"""Catalog tables derived from the star schema, as expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = {
    "row_id": "p_partkey",
    "manufacturer": "p_brand",
    "mfg_part_number": "concat('PN-', p_partkey)",
    "category": "case p_type when 'PROMO' then 'Abrasives' when 'ECONOMY' then 'Electrical' when 'SMALL' then 'Fittings' else 'General' end",
    "raw_description": """concat_ws(' ', p_name, case when p_partkey % 2 = 0 then concat(p_size * 10, 'V') end, case when p_partkey % 3 = 0 then concat(p_size, ' W') end,
        case when p_partkey % 5 = 0 then concat('P', p_size + 40) end, case when p_partkey % 4 = 0 then concat(p_size, ' in x 1/8 in') end,
        case when p_partkey % 3 = 1 then 'Stainless Steel' when p_partkey % 3 = 2 then 'brass' end, case when p_partkey % 7 = 0 then '60 Hz' end)""",
}
CATALOG_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in CATALOG.items()) + " from part"

# Competing values of a part's attribute, one per order line.
COMPETING = {
    "row_id": "l_orderkey",
    "field_name": "concat('f', l_linenumber % 3)",
    "pos": "l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber * 10",
    "raw_value": "concat(cast(l_quantity as int), ' V')",
    "normalized_value": "cast(cast(l_quantity as int) as string)",
    "unit": "'V'",
    "confidence": "l_discount * 10",
    "source": "case l_returnflag when 'A' then 'regex' when 'N' then 'llm_8b' else 'enrichment_cache' end",
    "price": "l_extendedprice",
}
COMPETING_SQL = "select " + ", ".join(f"{e.replace('as string', 'as varchar')} as {n}" for n, e in COMPETING.items()) + " from lineitem"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "part"), CATALOG)


def competing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "lineitem"), COMPETING)
