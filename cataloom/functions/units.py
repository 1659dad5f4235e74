"""Unit grammar: raw values such as "1 1/2 inch", "120/240 VAC" or "37 to 102 deg F" to a value and a unit.

The rules are native expressions in layers of select.  Only spelling repair of unknown units runs in Python,
over the distinct unit texts that the exact aliases don't know.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from cataloom.functions import constants as K
from cataloom.functions.constants import AIRFLOW, AREA, NUMBER, PLAUSIBLE, THREAD, TONS, VOLTS
from cataloom.functions.rules import literal_map
from cataloom.operators.store import kept

LEADING = r"(?is)^([+-]?(?:\d+/\d+|\d+\.\d*|\.\d+|\d+)(?:\s+\d+/\d+)?(?:\s*[-/]\s*[+-]?\d+(?:\.\d+)?|\s+to\s+[+-]?\d+(?:\.\d+)?)?)\s*(.*)$"
MIXED = r"^(\d+)\s+(\d+/\d+)$"
SPAN = rf"(?i)^([+-]?{NUMBER})(?:\s+to\s+|\s*-\s*)([+-]?{NUMBER})$"
PAIR = rf"^([+-]?{NUMBER})/({NUMBER})$"
SCALAR = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"

SYMBOLS = {c: s for c, _, s, _ in K.UNITS}
FACTORS = {c: f for c, _, _, f in K.UNITS}
ALIASES: dict[str, str] = {}
for _name, _aliases, _, _ in K.UNITS:
    for _alias in _aliases:
        ALIASES.setdefault(_alias, _name)


def number(text: Column) -> Column:
    """A decimal or a fraction; null for anything else and for a zero divisor."""
    halves = F.split(text, "/")
    ratio = F.try_divide(F.get(halves, 0).try_cast("double"), F.get(halves, 1).try_cast("double"))
    return F.when(text.contains("/"), ratio).otherwise(text.try_cast("double"))


def plain(x: Column, places: int = 4) -> Column:
    """Rounded, without trailing zeros."""
    return F.regexp_replace(F.round(x, places).cast(f"decimal(38,{places})").cast("string"), r"\.?0+$", "")


def fraction(x: Column) -> Column:
    return F.when(F.abs(x - F.round(x, 4)) < 1e-9, plain(x)).otherwise(plain(x, 3))


def cleaned(raw: Column) -> Column:
    """Plain minus signs, no thousands separators, trimmed."""
    return F.trim(F.regexp_replace(F.translate(raw, "−", "-"), r"(?<=\d),(?=\d{3}(?:\D|$))", ""))


def similarity(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b))."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def _bound(a: str, counts: Counter, b: str, others: Counter) -> float:
    """What :func:`similarity` can't exceed: the common part has at most the characters that both texts have."""
    return 200.0 * min(len(a), len(b), sum((counts & others).values())) / (len(a) + len(b))


_ALIAS_COUNTS = [(alias, Counter(alias), name) for alias, name in ALIASES.items()]


def closest(token: str) -> str | None:
    """The unit of the most similar alias from FUZZY_LEAST on, the first of equals; aliases that can't be it are passed over."""
    best, found, counts = K.FUZZY_LEAST, None, Counter(token)
    for alias, others, name in _ALIAS_COUNTS:
        if token and _bound(token, counts, alias, others) >= best:
            score = similarity(token, alias)
            if score > best or (found is None and score == best):
                best, found = score, name
    return found


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"_unknown": frame["_unknown"], "_repaired": [closest(t) for t in frame["_unknown"]], "_to": 0})


def resolved(rows: DataFrame, token: str, name: str = "canonical") -> DataFrame:
    """Adds ``name`` for the unit text in the column ``token``: exact alias, else the most similar one from 85 on."""
    exact = rows.withColumn("_exact", F.try_element_at(literal_map(ALIASES), F.col(token)))
    # Known tokens match nothing and are dealt out by the row, so that one of them fills no task.
    plain_columns = [F.col(f"`{f.name}`") for f in rows.schema.fields if isinstance(f.dataType, (NumericType, StringType))]
    exact = exact.withColumn("_deal", F.when(F.col("_exact").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*plain_columns), F.lit(1024)).cast("int")))
    unknown = exact.where(F.col("_exact").isNull() & (F.col(token) != "")).select(F.col(token).alias("_unknown")).distinct()
    repaired = unknown.mapInPandas(_repair, "_unknown string, _repaired string, _to int")
    return exact.join(repaired, (exact[token] == repaired["_unknown"]) & (exact["_deal"] == repaired["_to"]), "left").withColumn(name, F.coalesce("_exact", "_repaired")).drop("_exact", "_repaired", "_unknown", "_deal", "_to")


def normalized(rows: DataFrame, raw: str = "raw_value", field: str | None = None) -> DataFrame:
    """Adds ``value`` and ``unit`` for the text in ``raw``; ``field`` names the column with the attribute's name."""
    t = F.col("_unit_text")
    x = rows.withColumn("_unit_text", cleaned(F.coalesce(F.col(raw), F.lit(""))))
    part = lambda p, g: F.regexp_extract(t, p, g)
    x = x.withColumns({"_unit_lead": part(LEADING, 1), "_unit_tail": F.trim(part(LEADING, 2))})
    words = F.filter(F.split(F.lower(F.col("_unit_tail")), r"\s+"), lambda w: ~w.isin(*K.NOISE_WORDS) & (w != ""))
    x = resolved(x.withColumn("_unit_token", F.array_join(words, " ")), "_unit_token", "_unit_name")
    lead, name = F.col("_unit_lead"), F.col("_unit_name")
    angular = F.col(field).rlike(K.ANGULAR_FIELDS) & F.col("_unit_token").isin(*K.ANGULAR_TOKENS) if field else F.lit(False)
    symbol = F.when(angular, F.lit("deg")).otherwise(F.try_element_at(literal_map(SYMBOLS), name))
    known = symbol.isNotNull()
    factor = F.when(angular, F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(literal_map(FACTORS), name), F.lit(1.0)))
    kept = F.when(F.col("_unit_tail").rlike(PLAUSIBLE), F.col("_unit_tail"))
    low, high = number(F.regexp_extract(lead, SPAN, 1)), number(F.regexp_extract(lead, SPAN, 2))
    first, second = F.regexp_extract(lead, PAIR, 1).try_cast("double"), F.regexp_extract(lead, PAIR, 2).try_cast("double")
    whole = F.regexp_extract(lead, MIXED, 1).try_cast("double") + number(F.regexp_extract(lead, MIXED, 2))
    as_fraction = ~known | name.isin("inch", "foot")
    pair = lambda v, u: F.struct(v.cast("string").alias("value"), u.cast("string").alias("unit"))
    none = F.lit(None).cast("string")
    unit = F.when(known, symbol).otherwise(kept)
    span = F.concat(plain(low * factor), F.lit("-"), plain(high * factor))
    sizes = F.concat(plain(first * factor), F.lit("-"), plain(second * factor))
    scalar = number(lead) * factor
    v1, sep, v2 = part(VOLTS, 1), F.trim(part(VOLTS, 2)), part(VOLTS, 3)
    area = F.regexp_replace(F.regexp_replace(F.lower(part(AREA, 2)), r"^sq(uare)?\s*", ""), r"^(inch(es)?|in)$", "sq in")
    area = F.when(area == "sq in", area).otherwise(F.concat(F.lit("sq "), F.when(area.rlike("^f"), "ft").when(area.rlike("^c"), "cm").otherwise("m")))
    out = (
        F.when(t == "", pair(F.lit(""), none))
        .when(t.rlike(THREAD), pair(F.concat(fraction(number(part(THREAD, 1))), F.lit("-"), part(THREAD, 2), F.lit(" "), F.upper(part(THREAD, 3))), none))
        .when(t.rlike(TONS), pair(plain(part(TONS, 1).try_cast("double") * K.BTU_PER_TON), F.lit("BTU/h")))
        .when(t.rlike(VOLTS), pair(F.when(v2 == "", plain(v1.try_cast("double"))).otherwise(F.concat(v1, F.when(sep == "", "/").otherwise(sep), v2)), F.lit("V")))
        .when(t.rlike(AIRFLOW), pair(plain(part(AIRFLOW, 1).try_cast("double")), F.lit("CFM")))
        .when(t.rlike(AREA), pair(plain(part(AREA, 1).try_cast("double")), area))
        .when(lead == "", pair(F.col(raw), none))
        .when(lead.rlike(MIXED), F.when(whole.isNull(), pair(F.col(raw), none)).otherwise(pair(fraction(whole * factor), unit)))
        .when(lead.rlike(SPAN), F.when(known | F.col("_unit_tail").rlike(PLAUSIBLE) | (F.col("_unit_tail") == ""), pair(span, F.when(F.col("_unit_tail") != "", unit))).otherwise(pair(F.col(raw), none)))
        .when(lead.rlike(PAIR) & as_fraction & (second == 0), pair(F.col(raw), none))
        .when(lead.rlike(PAIR) & as_fraction, pair(fraction(F.try_divide(first, second) * factor), F.when(F.col("_unit_tail") != "", unit)))
        .when(lead.rlike(PAIR), pair(sizes, unit))
        .when(lead.rlike(SCALAR) & (known | F.col("_unit_tail").rlike(PLAUSIBLE)), pair(plain(scalar), unit))
        .when(lead.rlike(SCALAR) & (F.col("_unit_tail") == ""), pair(plain(scalar), none))
        .otherwise(pair(F.col(raw), none))
    )
    x = x.withColumn("_unit_out", out)
    return x.select(*rows.columns, F.col("_unit_out.value").alias("value"), F.col("_unit_out.unit").alias("unit"))


def normalized_by_value(rows: DataFrame, raw: str = "raw_value", field: str | None = None) -> DataFrame:
    """:func:`normalized`, worked out once for every distinct text (and field) and joined back: for tables whose values repeat.

    Texts without a digit ("N/A") stay as they are and take no part in the join, so one that fills a third of a table is no hot key."""
    keys = [raw, field] if field else [raw]
    digits = F.coalesce(F.col(raw).rlike("[0-9]"), F.lit(False))
    numbered = rows.where(digits)
    # Both are written: else the grammar's conditions are worked out for every row, before the texts are made distinct, and a join whose
    # other side turns out to be small has dealt out the rows already.
    texts = kept(numbered.select(*keys).distinct(), "texts")
    known = kept(normalized(texts, raw, field).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "value", "unit"), "values")
    same = [F.col(raw) == F.col("_key0"), *[F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys) if i]]
    joined = numbered.join(known, same).drop(*[f"_key{i}" for i in range(len(keys))])
    text = F.coalesce(F.col(raw), F.lit(""))
    plain_ = rows.where(~digits).select(*rows.columns, F.when(cleaned(text) == "", F.lit("")).otherwise(F.col(raw)).alias("value"), F.lit(None).cast("string").alias("unit"))
    return joined.select(*rows.columns, "value", "unit").unionByName(plain_)


def normalized_or_given(rows: DataFrame, raw: str, given_value: str, given_unit: str, field: str) -> DataFrame:
    """:func:`normalized_by_value`, but a value and unit given beside the raw text stay: only the unit's symbol is made uniform
    and no length is converted.  They count when both aren't blank and the value isn't just the raw text with its unit.
    An empty raw text keeps what is given, an empty text for no value."""
    text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    value, unit = F.trim(F.col(given_value)), F.trim(F.col(given_unit))
    with_unit = F.exists(F.array(*map(F.lit, K.GIVEN_UNIT_ENDINGS)), lambda u: value.endswith(u))
    given = (F.coalesce(value, F.lit("")) != "") & (F.coalesce(unit, F.lit("")) != "") & ((value != text) | ~with_unit)
    x = normalized_by_value(rows, raw, field)
    words = F.filter(F.split(F.lower(unit), r"\s+"), lambda w: ~w.isin(*K.NOISE_WORDS) & (w != ""))
    x = resolved(x.withColumn("_asked", F.coalesce(F.array_join(words, " "), F.lit(""))), "_asked", "_unit_name")
    angular = F.col(field).rlike(K.ANGULAR_FIELDS) & F.col("_asked").isin(*K.ANGULAR_TOKENS)
    symbol = F.when(angular, F.lit("deg")).otherwise(F.coalesce(F.try_element_at(literal_map(SYMBOLS | K.GIVEN_LENGTHS), F.col("_unit_name")), unit))
    x = x.withColumns({
        "value": F.when(given, value).when(text == "", F.coalesce(F.col(given_value), F.lit(""))).otherwise(F.col("value")),
        "unit": F.when(given, symbol).when(text == "", F.col(given_unit)).otherwise(F.col("unit")),
    })
    return x.select(*rows.columns, "value", "unit")
