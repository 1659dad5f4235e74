"""Rule extraction: one native expression per field, first match, without regard to case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.functions import constants as K


def _part(text: Column, field: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + K.RULES[field], group), F.lit(""))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical_material(found: Column) -> Column:
    return F.coalesce(F.get(F.array(F.try_element_at(literal_map(K.MATERIALS), F.lower(found))), 0), F.initcap(found))


def rule_columns(text: Column) -> dict[str, Column]:
    """Value and unit columns of the six rules; null where a rule finds nothing."""
    volt, watt, size = _part(text, "voltage", 2), _part(text, "power", 2), _part(text, "dimensions", 3)
    a, b = _part(text, "dimensions", 1), _part(text, "dimensions", 2)
    unit = lambda u, known, other: F.when(u.isNotNull(), F.when(F.upper(u).isin(*known), F.upper(u)).otherwise(other))
    return {
        "voltage": _part(text, "voltage", 1),
        "voltage_unit": unit(volt, ("V", "VAC", "VDC"), "V"),
        "power": _part(text, "power", 1),
        "power_unit": unit(watt, ("W", "KW", "HP"), "W"),
        "grit": F.upper(_part(text, "grit", 1)),
        "frequency": _part(text, "frequency", 1),
        "frequency_unit": F.when(_part(text, "frequency", 1).isNotNull(), F.lit("Hz")),
        "dimensions": F.when(a.isNotNull(), F.concat(a, F.lit(" x "), b)),
        "dimensions_unit": F.when(a.isNotNull(), F.coalesce(F.lower(F.nullif(size, F.lit('"'))), F.lit("in"))),
        "material": canonical_material(_part(text, "material", 1)),
    }


FIELDS = (("voltage", "voltage_unit"), ("power", "power_unit"), ("grit", None), ("frequency", "frequency_unit"), ("dimensions", "dimensions_unit"), ("material", None))


def extract_wide(rows: DataFrame, text: str = "raw_description") -> DataFrame:
    """Adds the ten rule columns."""
    return rows.withColumns(rule_columns(F.col(text)))


def extract_long(rows: DataFrame, key: str = "row_id", text: str = "raw_description") -> DataFrame:
    """One row per attribute found: key, pos, field_name, normalized_value, unit, raw_value, evidence_snippet, confidence, source.

    raw_value and evidence_snippet are the text that the rule matched."""
    wide = extract_wide(rows, text)
    none = F.lit(None).cast("string")
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field_name"), F.col(f).alias("normalized_value"), (F.col(u) if u else none).alias("unit"), F.when(F.col(f).isNotNull(), _part(F.col(text), f, 0)).alias("raw_value")) for i, (f, u) in enumerate(FIELDS)])
    found = wide.select(key, F.inline(F.filter(items, lambda x: x["normalized_value"].isNotNull()))).withColumn("evidence_snippet", F.col("raw_value"))
    return found.withColumns({"confidence": F.lit(K.RULE_CONFIDENCE), "source": F.lit("regex")})


def required_fields(category: Column) -> Column:
    table = F.create_map(*[x for c, fields in K.REQUIRED_FIELDS.items() for x in (F.lit(c), F.array(*map(F.lit, fields)))])
    return F.coalesce(F.try_element_at(table, category), F.array(*map(F.lit, K.REQUIRED_FIELDS["General"])))


def coverage(present: Column, category: Column) -> Column:
    """Share of the category's required fields among ``present`` (array of names), to two places."""
    need = required_fields(category)
    return F.round(F.size(F.array_intersect(need, present)) / F.size(need), 2)


def gated(rows: DataFrame, text: str = "raw_description") -> DataFrame:
    """Adds coverage_ratio and status: COMPLETED from 0.8 on, else CACHE_CHECK."""
    wide = extract_wide(rows, text)
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f, _ in FIELDS]))
    ratio = wide.withColumn("coverage_ratio", coverage(present, F.col("category")))
    return ratio.withColumn("status", F.when(F.col("coverage_ratio") >= K.COVERAGE_GATE, "COMPLETED").otherwise("CACHE_CHECK"))
