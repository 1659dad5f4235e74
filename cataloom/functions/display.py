"""Prompts for external models, quote cleaning and display formats, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cataloom.functions import constants as K


def quotes_as_units(text: Column) -> Column:
    """Feet and inch marks after numbers written out: 6' becomes 6 ft and 1 1/2" becomes 1 1/2 in."""
    number = r"(\d+(?:\.\d+)?(?:\s+\d+/\d+|/\d+)?)"
    return F.regexp_replace(F.regexp_replace(text, number + r"\s*'", "$1 ft"), number + r"\s*\"", "$1 in")


def without_quotes(text: Column) -> Column:
    return F.regexp_replace(quotes_as_units(text), "[\"']", "")


def search_query(maker: Column, part: Column) -> Column:
    return F.concat_ws(" ", maker, part, F.lit("technical specifications"))


def category_of(text: Column) -> Column:
    """The first category one of whose words the text contains; General for none."""
    low, out = F.lower(text), None
    for name, words in K.CATEGORY_WORDS.items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("General")


def extraction_prompt(maker: Column, part: Column, category: Column, description: Column, context: Column) -> Column:
    """The request to the small model; the context is cut to its budget."""
    cut = F.substring(F.coalesce(context, F.lit("")), 1, K.CONTEXT_CHARS)
    return F.concat(F.lit("Manufacturer: "), maker, F.lit("\nPart number: "), part, F.lit("\nCategory: "), category, F.lit("\nDescription: "), F.coalesce(description, F.lit("")), F.lit("\nContext:\n"), cut)


def request_prompt(category: Column, source_url: Column, document: Column) -> Column:
    """The request for a whole document; the document is cut to its cap."""
    return F.concat(F.lit("Category: "), category, F.lit("\nSource URL: "), F.coalesce(source_url, F.lit("")), F.lit("\n\nProduct document text:\n"), F.substring(F.coalesce(document, F.lit("")), 1, K.INPUT_CHARS))


def repair_prompt(prompt: Column, previous: Column, flags: Column, completeness: Column) -> Column:
    """The request to the large model: the first one with what was found (a map) and what was wrong with it."""
    return F.concat(prompt, F.lit("\nPrevious values: "), F.to_json(previous), F.lit("\nFlags: "), F.array_join(flags, "; "), F.lit("\nCompleteness: "), F.format_number(completeness, 2))


def evidence(context: Column, description: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(context, F.lit("")), description), 1, 100)


def _fixed(x: Column, places: int) -> Column:
    """A number with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", x.cast("double"))


def _shown(x: Column, text: Column) -> Column:
    """A dash for a missing number."""
    return F.when(x.isNull(), F.lit("—")).otherwise(text)


def percent(x: Column) -> Column:
    return _shown(x, F.concat(_fixed(x * 100, 1), F.lit("%")))


def duration(ms: Column) -> Column:
    return _shown(ms, F.when(ms < 1000, F.concat(_fixed(F.floor(ms + 0.5), 0), F.lit("ms"))).otherwise(F.concat(_fixed(ms / 1000, 2), F.lit("s"))))


def currency(x: Column) -> Column:
    return _shown(x, F.concat(F.lit("$"), F.when(x < 0.01, _fixed(x, 6)).otherwise(_fixed(x, 2))))


def tone(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "neutral").when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def file_size(x: Column) -> Column:
    """Bytes in B, KB, MB or GB; one decimal below ten units, none for bytes; a dash for null."""
    out = None
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        n = x / 1024**i
        shown = F.concat(F.when((n >= 10) | F.lit(i == 0), F.format_string("%.0f", F.round(n, 0))).otherwise(F.format_string("%.1f", F.round(n, 1))), F.lit(f" {unit}"))
        small = F.lit(True) if unit == "GB" else n < 1024
        out = F.when(small, shown) if out is None else out.when(small, shown)
    return F.when(x.isNull(), F.lit("—")).otherwise(out)


def page_buttons(current: Column, total: Column) -> Column:
    """The page numbers that are offered: all of up to five, else the first three, the last, and the current one with its neighbours."""
    every = F.sequence(F.lit(1), F.greatest(total, F.lit(1)))
    wanted = F.array(F.lit(1), F.lit(2), F.lit(3), total, current - 1, current, current + 1)
    return F.when(total <= 5, every).otherwise(F.filter(every, lambda p: F.array_contains(wanted, p)))
