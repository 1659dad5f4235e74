"""Header mapping, row cleaning and identity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.functions import constants as K


def placeholder_free(x: Column) -> Column:
    """Trimmed; null for what only stands for a missing value."""
    return F.when(~F.lower(F.trim(x)).isin(*K.PLACEHOLDERS), F.trim(x))


def clean_maker(x: Column) -> Column:
    """A maker's name without one trailing code in brackets; "Unknown" for none."""
    bare = F.trim(F.regexp_replace(placeholder_free(x), r"\s*\([^)]*\)$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Unknown"))


def sku(maker: Column, part: Column) -> Column:
    return F.concat_ws("-", F.replace(F.trim(maker), F.lit(" "), F.lit("_")), F.replace(F.trim(part), F.lit(" "), F.lit("_")))


def api_sku(maker: Column, part: Column) -> Column:
    return F.concat_ws("-", first_filled([maker], "UNKNOWN"), first_filled([part], "PART"))


def first_filled(cells: Sequence[Column], default: str | None) -> Column:
    """The first cell that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cells], F.lit(default))


def normalized_rows(rows: DataFrame, position: str = "row_id") -> DataFrame:
    """Maps headers by alias and cleans the cells: row_id, manufacturer, mfg_part_number, raw_description, category, sku_id,
    raw_headers and status.  The first alias present decides, even where its cell is empty; of headers that
    normalise alike the last one counts."""
    by_name = {re.sub(r"[\s_]", "", c.lower()): c for c in rows.columns}
    picked = {}
    for field, aliases in K.HEADER_ALIASES.items():
        found = next((by_name[a.replace("_", "")] for a in aliases if a.replace("_", "") in by_name), None)
        cell = F.col(f"`{found}`").cast("string") if found else F.lit(None).cast("string")
        picked[field] = clean_maker(cell) if field == "manufacturer" else F.coalesce(placeholder_free(cell), F.lit(K.HEADER_DEFAULTS[field]))
    raw = F.map_filter(F.create_map(*[x for c in rows.columns if c != position for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda _, v: v.isNotNull())
    return rows.select(F.col(position).alias("row_id"), *[c.alias(f) for f, c in picked.items()], sku(picked["manufacturer"], picked["mfg_part_number"]).alias("sku_id"), raw.alias("raw_headers"), F.lit("ROW_READY").alias("status"))
