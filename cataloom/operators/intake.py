"""Rows as the service takes them in: identity by header aliases, requests, places in files, text of a row's sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cataloom.functions import constants as K
from cataloom.operators.rows import first_filled

BUCKET = 100_000


def _bare(header: str) -> str:
    return re.sub("[^a-z0-9]", "", header.strip().lower())


def api_cell(rows: DataFrame, aliases: Sequence[str], default: str | None = "") -> Column:
    """The first cell of the aliases, in their order, that isn't blank.  Headers are compared by their letters and digits;
    of headers that agree so the last one counts."""
    found = {_bare(c): c for c in rows.columns}
    cells = [F.col(f"`{found[_bare(a)]}`").cast("string") for a in aliases if _bare(a) in found]
    return first_filled(cells, default)


def api_requests(rows: DataFrame, position: str = "row_id") -> DataFrame:
    """row_id, manufacturer_name, part_number, raw_description, category, status and error of every row.

    Missing makers and parts are empty texts, a missing description is null, a missing category is General.  A category that
    isn't one of the closed list makes its row an error; the other rows go on."""
    maker = F.trim(F.regexp_replace(api_cell(rows, K.API_ALIASES["manufacturer_name"]), r"\s*\([^)]*\)$", ""))
    category = api_cell(rows, K.API_ALIASES["category"], "General")
    x = rows.select(
        F.col(position).alias("row_id"),
        maker.alias("manufacturer_name"),
        api_cell(rows, K.API_ALIASES["part_number"]).alias("part_number"),
        api_cell(rows, K.API_ALIASES["raw_description"], None).alias("raw_description"),
        category.alias("category"),
    )
    known = F.col("category").isin(*K.CATEGORIES)
    error = F.when(~known, F.concat(F.lit("category: "), "category", F.lit(" is none of " + ", ".join(K.CATEGORIES))))
    return x.withColumns({"status": F.when(known, "pending").otherwise("error"), "error": error})


def positional_ids(rows: DataFrame, file: str, position: str) -> DataFrame:
    """Adds ``row_id``, 1 for the first row, by file and place in it; places may have gaps.

    Rows are counted by ranges of places; only these counts are summed up in order, and rows are ranked within their range.
    So ``rows`` are read twice: places that a plan makes anew each time (monotonically_increasing_id) must be written first."""
    bucket = F.floor(F.col(position) / BUCKET)
    x = rows.withColumn("_bucket", bucket)
    counts = x.groupBy(F.col(file).alias("_file"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_file", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = x.withColumn("_place", F.row_number().over(W.partitionBy(file, "_bucket").orderBy(position)))
    joined = ranked.join(before, F.col(file).eqNullSafe(F.col("_file")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place")).alias("row_id"))


def texts_of_rows(rows: DataFrame, texts: DataFrame, key: str = "row_id", text: str = "raw_content") -> DataFrame:
    """Every row with the text found for it, an empty one for none."""
    return rows.join(texts.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def combined_sources(description: Column, contents: Column) -> Column:
    """The description and the sources' contents that aren't blank, trimmed, a blank line between them."""
    chunks = F.transform(F.concat(F.array(description), F.coalesce(contents, F.array().cast("array<string>"))), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(chunks, lambda c: c != ""), "\n\n")
