"""What becomes of a model's answers: reserved names, units, provenance columns, calls, timing and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cataloom.functions import constants as K, units
from cataloom.functions.display import search_query

PROVENANCE = ("row_id", "sku_id", "manufacturer", "mfg_part_number", "category", "status", "validity", "completeness", "overall_confidence", "total_time_ms")


def unreserved(attributes: DataFrame) -> DataFrame:
    """Without attributes that are named like parts of a response."""
    return attributes.where(~F.lower(F.trim("field_name")).isin(*K.RESERVED_NAMES))


def postprocessed(attributes: DataFrame, source_url: Column) -> DataFrame:
    """Attributes (row_id, field_name, raw_value, normalized_value, unit, confidence) with values and units by the unit grammar, what
    the model has normalised itself kept, confidence in [0, 1] and the source forced."""
    x = units.normalized_or_given(unreserved(attributes).withColumnsRenamed({"normalized_value": "_given_value", "unit": "_given_unit"}), "raw_value", "_given_value", "_given_unit", "field_name")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return x.select("row_id", "field_name", "raw_value", F.col("value").alias("normalized_value"), "unit", sure.alias("confidence"), source_url.alias("source_url"))


def provenance(records: DataFrame, attributes: DataFrame, fields: list[str]) -> DataFrame:
    """A row per record: ten columns of identity and quality, then value, confidence, source and evidence of the given fields.

    A field that a record lacks is null in all four; one without confidence has 0.9, one without source LLM_8B."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    cells = []
    for f in fields:
        mine = F.col("field_name") == f
        told = {"value": F.coalesce(filled("normalized_value"), filled("raw_value")), "confidence": F.coalesce("confidence", F.lit(0.9)), "source": F.coalesce("source", F.lit("LLM_8B")), "evidence": filled("evidence_snippet")}
        cells += [F.max(F.when(mine, x)).alias(f"attr_{f}_{name}") for name, x in told.items()]
    if not fields:
        return records.select(*PROVENANCE)
    return records.select(*PROVENANCE).join(attributes.where(F.col("field_name").isin(fields)).groupBy("row_id").agg(*cells), "row_id", "left")


def models_called(calls: DataFrame) -> DataFrame:
    """The models that a row (row_id, pos, model) was sent to, in order, repeats kept.  Calls of the same place are ordered by model."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "model")))
    return calls.groupBy("row_id").agg(F.transform(ordered, lambda x: x["model"]).alias("models"))


def exportable(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "success")


SEARCHED = ("sku_id", "manufacturer_name", "part_number", "category", "status")


def searched(results: DataFrame, words: str) -> DataFrame:
    """Results that hold the words, in any case, in one of five columns; blank words find all."""
    wanted = words.strip().lower()
    if not wanted:
        return results
    found = None
    for c in SEARCHED:
        here = F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(wanted)
        found = here if found is None else found | here
    return results.where(found)


def result_page(results: DataFrame, order: str, page: int, size: int = K.PAGE_ROWS) -> tuple[DataFrame, int, int]:
    """One page of results, its number, which is the last page's if ``page`` is beyond it, and the number of pages, at least one."""
    pages = max(1, -(-results.count() // size))
    page = min(max(page, 1), pages)
    return results.orderBy(order).offset((page - 1) * size).limit(size), page, pages


def search_candidates(rows: DataFrame, links: DataFrame, limit: int = K.SEARCH_LINKS) -> DataFrame:
    """(row_id, query, rank, url): the first ``limit`` links that a search brought for a row, ranked from 1 without gaps.

    ``rows``: row_id, manufacturer, mfg_part_number; ``links``: row_id, rank, url.  A link that comes again counts once, blank ones don't;
    rows that found nothing have no candidates."""
    found = links.where(F.coalesce(F.trim("url"), F.lit("")) != "").groupBy("row_id", F.trim("url").alias("url")).agg(F.min("rank").alias("rank"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("row_id").orderBy("rank", "url"))).where(F.col("rank") <= limit)
    query = search_query(F.col("manufacturer"), F.col("mfg_part_number"))
    return rows.select("row_id", query.alias("query")).join(ranked, "row_id").select("row_id", "query", "rank", "url")


def api_confidence(attributes: DataFrame) -> DataFrame:
    """(row_id, overall_confidence): the mean of a row's confidences to four places, as the service reports it; a missing one counts as 0."""
    return attributes.groupBy("row_id").agg(F.round(F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)), 4).alias("overall_confidence"))


def mean_confidence(results: DataFrame, *by: str) -> DataFrame:
    """Mean confidence of the rows that succeeded; null where none did."""
    return results.groupBy(*by).agg(F.avg(F.when(F.col("status") == "success", F.col("confidence"))).alias("mean_confidence"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def with_error(errors: Column, kind: Column, message: Column, stage: Column) -> Column:
    """The list of errors (null: none yet) with one more."""
    shape = "array<struct<type:string,message:string,stage:string>>"
    one = F.struct(kind.cast("string").alias("type"), message.cast("string").alias("message"), stage.cast("string").alias("stage"))
    return F.concat(F.coalesce(errors, F.array().cast(shape)), F.array(one))
