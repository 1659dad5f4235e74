"""From stored records or relational sheets to what is delivered: nested products, workbook tabs and export payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.functions import constants as K
from cataloom.operators.answers import provenance
from cataloom.operators.attributes import delivery, review_queue
from cataloom.operators.metrics import snapshot
from cataloom.sources.writers import workbook_bytes

ATTRIBUTE = "struct<field_name:string,value:string,unit:string,source_url:string>"


def related(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Products (pos, sku_id, category, manufacturer_name, part_number, overall_confidence) with their attributes (pos, sku_id, field_name,
    raw_value, normalized_value, unit, source_url) as ``attrs``.

    Products without sku_id and attributes without a product go.  Of a repeated sku_id the last row counts, at the first
    one's place; a missing or zero confidence counts as 0.95."""
    rest = ["category", "manufacturer_name", "part_number", "overall_confidence"]
    filled = products.where(F.coalesce(F.trim("sku_id"), F.lit("")) != "")
    one = filled.groupBy("sku_id").agg(F.min("pos").alias("pos"), F.max(F.struct("pos", *rest)).alias("b")).select("sku_id", "pos", *[F.col(f"b.{c}").alias(c) for c in rest])
    one = one.withColumn("overall_confidence", F.coalesce(F.nullif(F.col("overall_confidence").cast("double"), F.lit(0.0)), F.lit(0.95)))
    item = F.struct("field_name", F.coalesce("normalized_value", "raw_value").alias("value"), "unit", "source_url")
    lists = attributes.groupBy("sku_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("a")))), lambda x: x["a"]).alias("attrs"))
    return one.join(lists, "sku_id", "left").withColumn("attrs", F.coalesce("attrs", F.array().cast(f"array<{ATTRIBUTE}>")))


def catalog_sheet(records: DataFrame) -> DataFrame:
    """The 252 columns of :func:`related` rows, in order of place."""
    named = records.select(F.col("pos").alias("row_id"), F.col("manufacturer_name").alias("manufacturer"), F.col("part_number").alias("mfg_part_number"), "category", "sku_id", "attrs")
    return delivery(named).orderBy("row_id").drop("row_id")


def first_seen_columns(maps: DataFrame, key: str, order: str) -> list[str]:
    """Keys of a map column in the order in which rows bring them; as many names as there are columns reach the driver."""
    entries = maps.select(order, F.posexplode(F.map_keys(key)).alias("at", "name"))
    first = entries.groupBy("name").agg(F.min(F.struct(order, "at")).alias("first")).orderBy("first")
    return [r["name"] for r in first.collect()]


def lineage_tab(records: DataFrame, attributes: DataFrame, max_fields: int = 500) -> DataFrame:
    """The audit tab: ten columns of identity and quality, then four of each field, fields in the order in which rows bring them.

    A first pass finds the fields, a second one turns them.  More than ``max_fields`` raise ValueError, so a sheet has at most
    10 + 4 * max_fields columns and the driver reads no more names."""
    first = attributes.where("field_name is not null").groupBy("field_name").agg(F.min(F.struct("row_id", "pos")).alias("first")).orderBy("first", "field_name")
    fields = [r["field_name"] for r in first.select("field_name").limit(max_fields + 1).collect()]
    if len(fields) > max_fields:
        raise ValueError(f"more than {max_fields} fields")
    return provenance(records, attributes, fields)


def telemetry_tab(transitions: DataFrame, elapsed_seconds: float) -> DataFrame:
    """(metric, value): the thirteen measures of a run as they are shown, in order."""
    measures = snapshot(transitions, elapsed_seconds)
    return measures.select(F.inline(F.array(*[F.struct(F.lit(shown).alias("metric"), F.col(c).cast("string").alias("value")) for shown, c in K.TELEMETRY])))


def review_tab(records: DataFrame) -> DataFrame:
    """The records for manual review, in the eight columns of their tab."""
    found = review_queue(records)
    cells = (F.col("row_id").cast("string"), "sku_id", "manufacturer", "mfg_part_number", "category", "status", F.array_join("validation_flags", ", "), "raw_description")
    return found.select(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias(name) for c, name in zip(cells, K.REVIEW_COLUMNS, strict=True)])


def delivery_tabs(records: DataFrame, attributes: DataFrame, transitions: DataFrame, elapsed_seconds: float) -> dict[str, DataFrame]:
    """The four tabs of a delivery by name.  ``records`` have identity, quality and raw_description, ``attributes`` row_id, pos and what a
    value has."""
    item = F.struct("field_name", F.coalesce(F.nullif("normalized_value", F.lit("")), "raw_value").alias("value"), "unit", F.col("evidence_snippet").alias("source_url"))
    lists = attributes.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("a")))), lambda x: x["a"]).alias("attrs"))
    catalog = delivery(records.join(lists, "row_id", "left")).orderBy("row_id").drop("row_id")
    return {"Enriched Catalog": catalog, "Lineage Audit": lineage_tab(records, attributes).orderBy("row_id"), "Judge Telemetry": telemetry_tab(transitions, elapsed_seconds), "Manual Review Queue": review_tab(records)}


def nested_json(records: DataFrame, attributes: DataFrame) -> DataFrame:
    """(row_id, json): each record as one nested JSON text with its derived sku, identity, quality and attributes by name, nulls kept."""
    value = F.struct("raw_value", "normalized_value", "unit", "confidence", "source", "evidence_snippet")
    entries = F.array_sort(F.collect_list(F.struct("pos", "field_name", value.alias("v"))))
    maps = attributes.groupBy("row_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["field_name"], e["v"]))).alias("attributes"))
    sku = F.coalesce(F.nullif("sku_id", F.lit("")), F.concat(F.coalesce("manufacturer", F.lit("")), F.lit("-"), F.coalesce("mfg_part_number", F.lit(""))))
    x = records.join(maps, "row_id", "left")
    none = F.create_map().cast(maps.schema["attributes"].dataType)
    record = F.struct(F.struct("row_id", "manufacturer", "mfg_part_number", "category", "raw_description", sku.alias("sku_id")).alias("identity"), F.struct("validity", "completeness", "overall_confidence", "validation_flags").alias("quality"), "status", F.coalesce("attributes", none).alias("attributes"))
    return x.select("row_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def payload_items(payload: Column, schema: str) -> Column:
    """The objects of a JSON array; null for what isn't an array of objects."""
    trimmed = F.regexp_replace(payload, r"^\s+|\s+$", "")
    return F.when(trimmed.startswith("["), F.from_json(trimmed, f"array<{schema}>"))


def workbook(catalog: DataFrame, lineage: DataFrame, transitions: DataFrame, records: DataFrame) -> bytes:
    """The delivery workbook of four tabs: catalog, lineage audit, telemetry and manual review."""
    measures = snapshot(transitions)
    telemetry = measures.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in measures.columns])))
    return workbook_bytes({"Catalog": catalog, "Lineage Audit": lineage, "Telemetry": telemetry, "Manual Review": review_queue(records).select("row_id", "status")})


def preflight(columns: list[str]) -> list[str]:
    """Fields that a file's header can fill; an empty list means it identifies no product."""
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()) for c in columns}
    return [f for f, aliases in K.HEADER_ALIASES.items() if plain & {a.replace("_", "") for a in aliases}]
