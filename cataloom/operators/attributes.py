"""Long attribute tables: conflicts, precedence, quality gate, lineage, delivery columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.functions import constants as K, text as T
from cataloom.functions.rules import literal_map, required_fields
from cataloom.functions.text import label


def resolved_conflicts(attributes: DataFrame) -> DataFrame:
    """One row per row_id and field_name: highest source priority, then confidence, then earliest position.

    A maximum over a struct, so it is combined before the shuffle and a hot key isn't gathered."""
    rank = F.coalesce(F.try_element_at(literal_map(K.SOURCE_PRIORITY), F.col("source")), F.lit(0))
    rest = [c for c in attributes.columns if c not in ("row_id", "field_name")]
    best = attributes.groupBy("row_id", "field_name").agg(F.max(F.struct(rank.alias("_rank"), F.col("confidence").alias("_sure"), (-F.col("pos")).alias("_place"), *rest)).alias("b"))
    return best.select("row_id", "field_name", *[F.col(f"b.{c}").alias(c) for c in rest])


def last_wins(attributes: DataFrame) -> DataFrame:
    """The last value of a repeated field, at the position of its first."""
    rest = [c for c in attributes.columns if c not in ("row_id", "field_name", "pos")]
    kept = attributes.groupBy("row_id", "field_name").agg(F.min("pos").alias("first_pos"), F.max(F.struct("pos", *rest)).alias("b"))
    return kept.select("row_id", "field_name", F.col("first_pos").alias("pos"), *[F.col(f"b.{c}").alias(c) for c in rest])


def merged_by_stage(rules: DataFrame, cache: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """The pipeline's precedence on (row_id, field_name, value, confidence, source) tables with a row a key each:
    cache overwrites rules, the small model fills gaps and values below 0.8, the large model overwrites."""
    keys = ["row_id", "field_name"]
    side = lambda df, n: df.select(*keys, F.struct("value", "confidence", "source").alias(n))
    stacked = side(rules, "x").withColumn("stage", F.lit("r")).unionByName(side(cache, "x").withColumn("stage", F.lit("c"))).unionByName(side(small, "x").withColumn("stage", F.lit("s"))).unionByName(side(large, "x").withColumn("stage", F.lit("l")))
    pick = lambda s: F.max(F.when(F.col("stage") == s, F.col("x"))).alias(s)
    wide = stacked.groupBy(*keys).agg(pick("r"), pick("c"), pick("s"), pick("l"))
    before = F.coalesce("c", "r")
    after = F.when(before.isNull() | ((before["confidence"] < 0.8) & F.col("s").isNotNull()), F.col("s")).otherwise(before)
    return wide.select(*keys, F.coalesce(F.col("l"), after).alias("x")).select(*keys, "x.*")


def validation_flags(field: Column, value: Column) -> Column:
    """The flag of one attribute, or null."""
    first = F.regexp_extract(value, r"(-?\d+(?:\.\d+)?)", 1)
    return (
        F.when((field == "voltage") & (first == ""), F.concat(F.lit("INVALID_VOLTAGE_FORMAT: "), value))
        .when((field == "voltage") & (first.try_cast("double") < 0), F.concat(F.lit("INVALID_VOLTAGE_NEGATIVE: "), value))
        .when((field == "grit") & ~value.rlike(r"(?i)^P?\d{2,4}$"), F.concat(F.lit("INVALID_GRIT_FORMAT: "), value))
        .when((field == "dimensions") & ~value.rlike(r"\d"), F.concat(F.lit("INVALID_DIMENSIONS_FORMAT: "), value))
    )


def quality_gate(records: DataFrame, attributes: DataFrame) -> DataFrame:
    """row_id, completeness, overall_confidence, validation_flags, validity and status of every record.

    Passes with no flag, completeness 0.75 and mean confidence 0.8; a record without attributes fails."""
    flag = validation_flags(F.col("field_name"), F.coalesce("normalized_value", "raw_value"))
    per = attributes.withColumn("flag", flag).groupBy("row_id").agg(F.collect_set("field_name").alias("fields"), F.avg("confidence").alias("mean"), F.array_sort(F.collect_list("flag")).alias("flags"))
    need = required_fields(F.col("category"))
    x = records.select("row_id", "category").join(per, "row_id", "left")
    x = x.withColumn("completeness", F.round(F.size(F.array_intersect(need, F.coalesce("fields", F.array().cast("array<string>")))) / F.size(need), 2))
    x = x.withColumns({"overall_confidence": F.round(F.coalesce("mean", F.lit(0.0)), 2), "validation_flags": F.coalesce("flags", F.array().cast("array<string>"))})
    x = x.withColumn("validity", F.size("validation_flags") == 0)
    passed = F.col("validity") & (F.col("completeness") >= K.COMPLETENESS_GATE) & (F.col("overall_confidence") >= K.CONFIDENCE_GATE)
    return x.select("row_id", "completeness", "overall_confidence", "validation_flags", "validity", F.when(passed, "PROVENANCE_MERGE").otherwise("70B_PENDING").alias("status"))


def lineage(records: DataFrame, attributes: DataFrame, fields: list[str]) -> DataFrame:
    """A row per record with attr_<field>_value, _confidence and _source; the fields are given, so no job finds them."""
    cells = []
    for f in fields:
        mine = F.col("field_name") == f
        cells += [F.max(F.when(mine, F.coalesce("normalized_value", "raw_value"))).alias(f"attr_{f}_value"), F.max(F.when(mine, F.col("confidence"))).alias(f"attr_{f}_confidence"), F.max(F.when(mine, F.col("source"))).alias(f"attr_{f}_source")]
    return records.join(attributes.groupBy("row_id").agg(*cells), "row_id", "left")


def delivery(records: DataFrame) -> DataFrame:
    """The 252 delivery columns in order.  ``records``: manufacturer, mfg_part_number, category, sku_id and attrs, an array of
    (field_name, value, unit, source_url) in order.

    White space around values, units and URLs goes.  A missing maker, part or category is an empty text; a missing sku is maker and
    part joined by a dash.  A slot takes the first attribute of its names that has a value, else the last of them."""
    none, space = F.lit(""), F.lit(" \t\n\r\x0b\x0c")
    plain = lambda x: F.coalesce(F.btrim(x, space), none)
    # Names, labels and values once per attribute: fifty columns and a text refer to them.
    told = F.transform("attrs", lambda a: F.struct(F.lower(plain(a["field_name"])).alias("name"), F.coalesce(label(a["field_name"]), none).alias("label"), plain(a["value"]).alias("value"), plain(a["unit"]).alias("unit"), plain(a["source_url"]).alias("url")))
    records = records.withColumns({"told": told, **{c: F.coalesce(c, none) for c in ("manufacturer", "mfg_part_number", "category", "sku_id")}})
    attrs, maker, part, category = F.col("told"), F.col("manufacturer"), F.col("mfg_part_number"), F.col("category")
    urls = F.slice(F.array_distinct(F.filter(F.transform(attrs, lambda a: a["url"]), lambda u: u.rlike("^https?://"))), 1, 5)
    # Attributes without a name or a value have no part in the description.
    named = F.filter(attrs, lambda a: (a["label"] != "") & (a["value"] != ""))
    shown = F.transform(named, lambda a: F.trim(F.concat(a["label"], F.lit(": "), a["value"], F.lit(" "), a["unit"])))
    columns = {
        "SKU - MY_PART_NUMBER": F.coalesce(F.nullif(F.col("sku_id"), none), F.btrim(F.concat(maker, F.lit("-"), part), F.lit("-"))),
        "MANUFACTURER_NAME": maker, "MANUFACTURER_PART_NUMBER": part, "Mfg_Part_Num": part, "PART_NUMBER": part,
        "Product Name": F.btrim(F.concat(maker, F.lit(" "), part), space), "Classpath": F.concat(F.lit("Industrial & Commercial > "), category), "BRAND": maker, "CATEGORY": category, "STATUS": F.lit("Active"),
        "SHORT_DESC": F.btrim(F.concat(maker, F.lit(" "), part, F.lit(" "), category, F.lit(" Component")), space), "MOBILE_DESC": F.btrim(F.concat(maker, F.lit(", "), category, F.lit(", "), part), F.lit(", ")),
        "LONG_DESC1": F.array_join(shown, "; "), "MFR URL": F.get(urls, 0),
    }
    columns |= {f"Ref URL {i + 1}": F.get(urls, i) for i in range(5)}

    def slot(names: list[str]) -> Column:
        mine = F.filter(attrs, lambda a: a["name"].isin(*names))
        return F.coalesce(F.get(F.filter(mine, lambda a: a["value"] != ""), 0), F.try_element_at(mine, F.lit(-1)))

    for name, unit_name, default, synonyms in K.SLOTS:
        filled = slot(list(synonyms))
        columns[name] = filled["value"]
        if unit_name:
            columns[unit_name] = F.when(filled.isNotNull(), F.coalesce(F.nullif(filled["unit"], none), F.lit(default)))
    for n in range(K.TRIPLETS):
        one = F.get(attrs, n)
        columns |= {f"ATTRIBUTE_LABEL {n + 1}": one["label"], f"ATTRIBUTE_VALUE {n + 1}": one["value"], f"ATTRIBUTE_UOM {n + 1}": one["unit"]}
    order = [*K.CORE_COLUMNS, *[f"ATTRIBUTE_{x} {n + 1}" for n in range(K.TRIPLETS) for x in ("LABEL", "VALUE", "UOM")]]
    return records.select("row_id", *[F.coalesce(columns.get(c, none), none).alias(c) for c in order])


def nested(products: DataFrame, attributes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Products with their attributes as an array in order; orphans go, products without attributes keep an empty array."""
    rest = [c for c in attributes.columns if c != key and c not in order]
    lists = attributes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("attrs"))
    joined = products.join(lists, key, "left")
    return joined.withColumn("attrs", F.coalesce("attrs", F.array().cast(lists.schema["attrs"].dataType)))


def review_queue(records: DataFrame) -> DataFrame:
    return records.where((F.col("status") == "MANUAL_REVIEW") | ~F.col("validity"))


def reduced_context(text: Column, maker: Column, part: Column, budget: int = K.CONTEXT_CHARS, ascii_only: bool = False) -> Column:
    """The cleaned text where it is within a budget of characters, else its best sentences, joined in order.

    By score, then place; the first stays even when it alone is over, and the first that overflows ends the list.
    All within the row: no shuffle, no sort of the table.  Null gives an empty text."""
    cleaned = T.html_clean(text)
    scored = F.transform(T.sentences(cleaned, ascii_only), lambda s, i: F.struct((-T.sentence_score(F.trim(s), maker, part, ascii_only)).alias("rank"), i.alias("idx"), F.trim(s).alias("sentence")))
    ranked = F.array_sort(F.filter(scored, lambda x: x["rank"] < 0))
    none = F.array().cast("array<struct<idx:int,sentence:string>>")

    def take(state: Column, x: Column) -> Column:
        used = state["used"] + F.length(x["sentence"]) + 1
        fits = state["open"] & ((used <= budget) | (F.size(state["kept"]) == 0))
        kept = F.when(fits, F.concat(state["kept"], F.array(F.struct(x["idx"].alias("idx"), x["sentence"].alias("sentence"))))).otherwise(state["kept"])
        return F.struct(F.when(fits, used).otherwise(state["used"]).alias("used"), fits.alias("open"), kept.alias("kept"))

    begin = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), none.alias("kept"))
    best = F.aggregate(ranked, begin, take, lambda s: F.array_join(F.transform(F.array_sort(s["kept"]), lambda x: x["sentence"]), " "))
    return F.when(F.length(cleaned) <= budget, cleaned).otherwise(best)
