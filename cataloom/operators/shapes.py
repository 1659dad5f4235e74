"""Items of several shapes brought to one: nested records, responses and plain dictionaries, from JSON texts or VARIANT values.

All shapes of a table go through one plan; a row's own shape decides, field by field.  What counts as given is what a
dictionary lookup with a fallback would take: null, empty text, zero, false and empty lists aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import VariantType

from cataloom.functions import constants as K

_SPACE = " \t\n\r\x0b\x0c"
ITEM = "struct<field_name:string,value:string,unit:string,source_url:string>"
COERCED = "struct<field_name:string,raw_value:string,normalized_value:string,unit:string,confidence_score:double,source_url:string>"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ...; null for null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(value: Column, path: str = "$") -> Column:
    """A scalar as text; null for null, objects and lists."""
    return F.try_variant_get(value, path, "string")


def _given(value: Column, path: str = "$") -> Column:
    """A scalar as text, null unless it is given."""
    found = F.try_variant_get(value, path, "variant")
    text = F.nullif(_text(found), F.lit(""))
    return F.when((_kind(found) == "STRING") | ~text.rlike(r"^(?:false|-?0+(?:\.0+)?)$"), text)


def _first(value: Column, *names: str) -> Column:
    return F.coalesce(*[_given(value, f"$.{n}") for n in names], F.lit(""))


def _attribute(name: Column, value: Column, unit: Column, url: Column) -> Column:
    return F.struct(F.coalesce(name, F.lit("")).alias("field_name"), F.coalesce(value, F.lit("")).alias("value"), unit.alias("unit"), url.alias("source_url"))


def delivery_items(items: DataFrame, column: str = "item") -> DataFrame:
    """Adds to rows with an item what the delivery needs: manufacturer, mfg_part_number, category, sku_id, attrs and ``shape``.

    ``column`` holds JSON text or VARIANT.  Shapes: ``record`` has an object ``identity`` and a map of attributes, whose evidence is their
    source; ``item`` is a response or a dictionary, with attributes as a list of objects or a map of objects or scalars, and maker and
    part taken from the sku where no maker is given; ``broken`` is anything but an object, and has no identity and no attributes.  Maps keep
    the order of a JSON text; a VARIANT has its keys sorted.  Numbers and truth values become their JSON text.
    """
    source = F.col(column)
    is_variant = isinstance(items.schema[column].dataType, VariantType)
    x = items.withColumn("_v", source if is_variant else F.try_parse_json(source))
    v = F.col("_v")

    def container(name: str) -> Column:
        """The JSON text of a list or map that isn't empty."""
        text = F.to_json(F.try_variant_get(v, f"$.{name}", "variant")) if is_variant else F.get_json_object(source, f"$.{name}")
        return F.when(text.rlike(r"^\s*[\[{]") & ~text.rlike(r"^\s*(?:\[\s*\]|\{\s*\})\s*$"), text)

    x = x.withColumn("_object", F.coalesce(_kind(v) == "OBJECT", F.lit(False)))
    x = x.withColumn("_record", F.col("_object") & F.coalesce(_kind(F.try_variant_get(v, "$.identity", "variant")) == "OBJECT", F.lit(False)))
    record = F.col("_record")
    x = x.withColumn("_attributes", F.when(record, container("attributes")).otherwise(F.coalesce(container("enriched_attributes"), container("attributes"))))
    attributes = F.col("_attributes")

    def of_object(name: Column | None, a: Column) -> Column:
        """``name``: the key of a map, which a name of its own overrides."""
        own = _text(a, "$.field_name")
        value = F.coalesce(_given(a, "$.normalized_value"), _given(a, "$.raw_value"))
        url = F.when(record, _given(a, "$.evidence_snippet")).otherwise(_given(a, "$.source_url"))
        return _attribute(own if name is None else F.when(record, name).otherwise(F.coalesce(own, name)), value, _given(a, "$.unit"), url)

    none = F.lit(None).cast("string")
    listed = F.transform(F.filter(F.from_json(attributes, "array<variant>"), lambda a: _kind(a) == "OBJECT"), lambda a: of_object(None, a))
    entries = F.map_entries(F.from_json(attributes, "map<string,variant>"))
    mapped = F.transform(entries, lambda e: F.when(_kind(e["value"]) == "OBJECT", of_object(e["key"], e["value"])).otherwise(_attribute(e["key"], _text(e["value"]), none, none)))
    attrs = F.when(attributes.rlike(r"^\s*\["), listed).when(attributes.isNotNull(), mapped)

    inner = F.try_variant_get(v, "$.identity", "variant")
    maker = F.when(record, _first(inner, "manufacturer")).otherwise(_first(v, "manufacturer_name", "manufacturer", "mfg"))
    part = F.when(record, _first(inner, "mfg_part_number")).otherwise(_first(v, "part_number", "part_num", "mfg_part_number"))
    sku = F.when(record, _first(inner, "sku_id")).otherwise(_first(v, "sku_id"))
    category = F.when(record, _first(inner, "category")).otherwise(_first(v, "category"))
    x = x.withColumns({"_maker": F.coalesce(maker, F.lit("")), "_part": F.coalesce(part, F.lit("")), "_sku": F.coalesce(sku, F.lit(""))})
    split = ~record & (F.col("_maker") == "") & F.col("_sku").contains("-")
    both = F.concat("_maker", F.lit("-"), "_part")
    own_sku = F.when(F.col("_sku") != "", F.col("_sku")).when(record | ((F.col("_maker") != "") & (F.col("_part") != "")), both).otherwise("")
    rest = F.regexp_extract("_sku", r"(?s)^[^-]*-(.*)$", 1)
    broken = ~F.col("_object")
    out = {
        "manufacturer": F.when(split, F.substring_index("_sku", "-", 1)).otherwise(F.col("_maker")),
        "mfg_part_number": F.when(split, rest).otherwise(F.col("_part")),
        "category": F.coalesce(F.nullif(category, F.lit("")), F.lit("General")),
        "sku_id": F.when(broken, F.lit("")).otherwise(own_sku),
        "attrs": F.coalesce(attrs, F.array().cast(f"array<{ITEM}>")),
        "shape": F.when(record, "record").when(broken, "broken").otherwise("item"),
    }
    return x.select(*items.columns, *[c.alias(name) for name, c in out.items()])


def coerced(values: Column, default_url: Column) -> Column:
    """A model's attributes, an array of VARIANT, as array<COERCED>: lists by place, objects by name.

    A list has name, raw and normalized value, unit, confidence and source; an object may call its confidence so.  Blank names and raw
    values and reserved names go, a missing normalized value is the raw one, confidence is 0.9 where it is missing or no number, and clamped to [0, 1].
    """

    def shaped(a: Column) -> Column:
        placed = _kind(a) == "ARRAY"
        pick = lambda i, *names: F.when(placed, _text(a, f"$[{i}]")).otherwise(F.coalesce(*[_text(a, f"$.{n}") for n in names]))
        raw = stripped(pick(1, "raw_value"))
        sure = F.coalesce(pick(4, "confidence_score", "confidence").try_cast("double"), F.lit(0.9))
        return F.struct(
            stripped(pick(0, "field_name")).alias("field_name"),
            raw.alias("raw_value"),
            F.coalesce(stripped(pick(2, "normalized_value")), raw).alias("normalized_value"),
            pick(3, "unit").alias("unit"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence_score"),
            F.coalesce(pick(5, "source_url"), default_url).alias("source_url"),
        )

    known = F.transform(F.filter(F.coalesce(values, F.array().cast("array<variant>")), lambda a: _kind(a).isin("ARRAY", "OBJECT")), shaped)
    return F.filter(known, lambda a: (F.coalesce(a["field_name"], F.lit("")) != "") & (F.coalesce(a["raw_value"], F.lit("")) != "") & ~F.lower(a["field_name"]).isin(*K.RESERVED_NAMES))
