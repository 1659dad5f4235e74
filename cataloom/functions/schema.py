"""Declared shapes of JSON values, compiled to one expression that lists what is wrong with each row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.functions import constants as K

VIOLATION = "struct<path:string,rule:string,value:string>"

_KINDS = {"string": ("STRING",), "float": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "int": ("BIGINT",), "bool": ("BOOLEAN",), "list": ("ARRAY",), "object": ("OBJECT",)}


@dataclass(frozen=True)
class Field:
    """A field of an object.  kind: string, float, int, bool, list or object; fields: of an object, or of a list's objects.

    An optional field may be missing; one that is nullable may be null.  Numbers may also be given as text, as forms do.
    """

    name: str
    kind: str = "string"
    required: bool = True
    nullable: bool = False
    choices: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    shortest: int | None = None
    longest: int | None = None
    fields: tuple[Field, ...] = ()


def _no_violations() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _one(wrong: Column, path: Column, rule: str, value: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), value.cast("string").alias("value")))).otherwise(_no_violations())


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), of), 0)


def _of_field(owner: Column, f: Field, path: Column) -> Column:
    return _with(F.try_variant_get(owner, f"$['{f.name}']", "variant"), lambda found: _of_value(found, f, path))


def _of_value(found: Column, f: Field, path: Column) -> Column:
    is_null = F.coalesce(F.is_variant_null(found), F.lit(False))
    here = F.concat(path, F.lit(f.name))
    shown = F.to_json(found)
    null = _no_violations() if f.nullable else _one(F.lit(True), here, f"{f.kind}_type", shown)
    absent = _one(F.lit(f.required), here, "missing", F.lit(None))
    kind = F.regexp_extract(F.schema_of_variant(found), "^[A-Z]+", 0)
    return F.when(found.isNull(), absent).when(is_null, null).otherwise(_with(kind, lambda k: _of_kind(found, k, f, here)))


def _of_kind(found: Column, kind: Column, f: Field, here: Column) -> Column:
    shown = F.to_json(found)
    text = F.try_variant_get(found, "$", "string")
    number = F.try_variant_get(found, "$", "double") if f.kind in ("float", "int") else F.lit(None).cast("double")
    typed = kind.isin(*_KINDS[f.kind])
    if f.kind == "float":
        typed = typed | ((kind == "STRING") & number.isNotNull())
    if f.kind == "int":
        typed = typed | ((kind.isin("STRING", "DOUBLE", "DECIMAL")) & (number == F.floor(number)))
    checks = [(~typed, f"{f.kind}_type")]
    if f.choices:
        checks.append((typed & ~text.isin(*f.choices), "literal_error"))
    if f.least is not None:
        checks.append((typed & (number < f.least), "greater_than_equal"))
    if f.most is not None:
        checks.append((typed & (number > f.most), "less_than_equal"))
    if f.shortest is not None:
        checks.append((typed & (F.length(text) < f.shortest), "string_too_short"))
    if f.longest is not None:
        checks.append((typed & (F.length(text) > f.longest), "string_too_long"))
    wrong = F.concat(*[_one(c, here, rule, shown) for c, rule in checks])
    if f.fields and f.kind == "list":
        items = F.try_variant_get(found, "$", "array<variant>")

        def of_item(item: Column, i: Column) -> Column:
            at = F.concat(here, F.lit("["), i.cast("string"), F.lit("]"))
            return of_object(item, f.fields, at)

        wrong = F.concat(wrong, F.when(typed, F.flatten(F.transform(items, of_item))).otherwise(_no_violations()))
    elif f.fields:
        wrong = F.concat(wrong, F.when(typed, _fields(found, f.fields, F.concat(here, F.lit(".")))).otherwise(_no_violations()))
    return wrong


def _fields(owner: Column, fields: tuple[Field, ...], path: Column) -> Column:
    return F.concat(*[_of_field(owner, f, path) for f in fields])


def of_object(value: Column, fields: tuple[Field, ...], path: Column) -> Column:
    """The violations of one VARIANT that is to be an object at ``path``."""
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, _fields(value, fields, F.concat(path, F.lit(".")))).otherwise(_one(F.lit(True), path, "object_type", F.to_json(value)))


def violations(text: Column, fields: tuple[Field, ...]) -> Column:
    """What is wrong with a JSON text, as array<VIOLATION> in the fields' order: path, rule and the value as JSON (null: there is none).

    A text that isn't JSON has the one violation json_invalid, one that is no object object_type; unknown fields are passed over.
    """
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("json_invalid").alias("rule"), text.alias("value")))
    wrong = lambda value: F.transform(of_object(value, fields, F.lit("")), lambda x: F.struct(F.ltrim(x["path"], F.lit(".")).alias("path"), x["rule"].alias("rule"), x["value"].alias("value")))
    return _with(F.try_parse_json(text), lambda value: F.when(value.isNull(), broken).otherwise(wrong(value)))


def validated(rows: DataFrame, column: str, fields: tuple[Field, ...], mode: str = "PERMISSIVE") -> DataFrame:
    """Rows with ``errors``, the violations of a JSON column.

    PERMISSIVE keeps every row, DROPMALFORMED the rows without violation; FAILFAST fails the job at the first row that has one, and
    names path, rule and value.
    """
    out = rows.withColumn("errors", violations(F.col(column), fields))
    if mode == "PERMISSIVE":
        return out
    if mode == "DROPMALFORMED":
        return out.where(F.size("errors") == 0)
    if mode != "FAILFAST":
        raise ValueError(f"unknown mode: {mode}")
    first = F.get("errors", F.lit(0))
    said = F.concat(F.coalesce(F.nullif(first["path"], F.lit("")), F.lit("the row")), F.lit(": "), first["rule"], F.lit(" "), F.coalesce(first["value"], F.lit("")))
    return out.withColumn("errors", F.when(F.size("errors") == 0, F.col("errors")).otherwise(F.raise_error(said).cast(f"array<{VIOLATION}>")))


def parsed(rows: DataFrame, column: str, fields: tuple[Field, ...]) -> DataFrame:
    """Adds the scalar fields of a JSON column as text columns."""
    return rows.withColumns({f.name: F.try_variant_get(F.try_parse_json(F.col(column)), f"$['{f.name}']", "string") for f in fields if f.kind not in ("list", "object")})


#: An attribute, a request for one product, and a response.
ATTRIBUTE = (Field("field_name"), Field("raw_value"), Field("normalized_value"), Field("unit", required=False, nullable=True), Field("confidence_score", "float", False, least=0.0, most=1.0), Field("source_url"))
REQUEST = (Field("manufacturer_name"), Field("part_number"), Field("raw_description", required=False, nullable=True), Field("category", choices=K.CATEGORIES))
RESPONSE = (Field("sku_id"), Field("category"), Field("enriched_attributes", "list", False, fields=ATTRIBUTE), Field("overall_confidence", "float", False, least=0.0, most=1.0), Field("processing_time_ms", "float", False, least=0.0), Field("estimated_cost_usd", "float", False, least=0.0))
