"""Text expressions: HTML cleaning, sentences and their scores, response cleaning and repair, keys, retry hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cataloom.functions import constants as K
from cataloom.functions.markup import text_nodes


def html_clean(html: Column) -> Column:
    """Script and style bodies and tags removed, four entities decoded, lines trimmed and blank lines dropped."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return kept_lines(t)


def page_text(html: Column) -> Column:
    """A fetched page's text, one text node a line: noise elements go with all they hold, then comments and tags.

    Reads and keeps a fixed number of characters, as the feature asks; null gives an empty text."""
    page = F.substring(F.coalesce(html, F.lit("")), 1, K.PAGE_CHARS_READ)
    return F.substring(kept_lines(F.array_join(text_nodes(page), "\n")), 1, K.PAGE_CHARS_KEPT)


def kept_lines(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _pattern(pattern: str, ascii_only: bool) -> str:
    """A pattern whose classes and word borders know all letters, or only those of ASCII (as RE2, the engine of the SQL, has them)."""
    if not ascii_only:
        return "(?U)" + pattern
    word = "[0-9A-Za-z_]"
    border = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    # Before a digit, a border is where no word character comes before.
    return pattern.replace(r"\b(\d", rf"(?<!{word})(\d").replace(r"\b", border).replace(r"\s", r"[\t\n\f\r ]").replace(r"\d", "[0-9]")


def sentences(text: Column, ascii_only: bool = False) -> Column:
    return F.split(text, _pattern(r"(?<=[.!?])\s+|\n+", ascii_only))


def sentence_score(sentence: Column, maker: Column, part: Column, ascii_only: bool = False) -> Column:
    """Specification density: 3 a unit, 2 for a colon, 1 a keyword, 2 each for maker and part number; boilerplate is -5.

    A unit ends before any letter; with ``ascii_only`` only before ASCII ones, so "12 inß" counts."""
    low = F.lower(sentence)
    units = _pattern(K.SPEC_UNITS, ascii_only)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    named = lambda x: F.coalesce((F.coalesce(x, F.lit("")) != "") & low.contains(F.lower(x)), F.lit(False))
    names = F.when(named(maker), 2.0).otherwise(0.0) + F.when(named(part), 2.0).otherwise(0.0)
    score = 3.0 * F.size(F.regexp_extract_all(low, F.lit(units), F.lit(0)))
    score = score + F.when(sentence.contains(":"), 2.0).otherwise(0.0) + F.size(F.array_intersect(words, F.array(*map(F.lit, K.SPEC_KEYWORDS)))) + names
    # Most sentences have nothing to count: one search tells that.
    countable = low.rlike(units + "|:|" + "|".join(K.SPEC_KEYWORDS))
    boilerplate = "|".join(K.BOILERPLATE)
    boilerplate = _pattern(boilerplate, True) if ascii_only else boilerplate
    return F.when(F.length(F.trim(sentence)) < 10, 0.0).when(low.rlike(boilerplate), -5.0).when(~countable, names).otherwise(score).cast("double")


def response_text(raw: Column) -> Column:
    """A model's answer without its thoughts and code fences."""
    t = F.regexp_replace(F.substring_index(F.coalesce(raw, F.lit("")), "</think>", -1), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def json_repaired(raw: Column) -> Column:
    """Near-JSON to JSON: wrapper tags and text around the braces go, "=" becomes ":", keys get quotes, trailing commas go."""
    steps = ((r"(?is)</?(?:function|tool)[^>]*>", ""), (r"(?s)^[^{\[]*", ""), (r"(?s)[^}\]]*$", ""), (r'([{,]\s*"?[A-Za-z_]\w*"?)\s*=\s*', "$1:"), (r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":'), (r",\s*([}\]])", "$1"))
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, response_text(raw))


ATTRIBUTES = "array<struct<field_name:string,raw_value:string,normalized_value:string,unit:string,confidence:string,confidence_score:string>>"


def null_text(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*K.NULL_TEXTS), F.trim(x))


def parsed_attributes(raw: Column, default: float = 0.95) -> Column:
    """Attributes of a model's answer: an array, or an object's "attributes", else "tasks"; confidence clamped to [0, 1]."""
    t = response_text(raw)
    wrapped = F.from_json(t, f"struct<attributes:{ATTRIBUTES},tasks:{ATTRIBUTES}>")
    items = F.when(t.startswith("["), F.from_json(t, ATTRIBUTES)).otherwise(F.coalesce(wrapped["attributes"], wrapped["tasks"]))

    def coerced(a: Column) -> Column:
        sure = F.coalesce(a["confidence"].try_cast("double"), a["confidence_score"].try_cast("double"), F.lit(default))
        return F.struct(null_text(a["field_name"]).alias("field_name"), null_text(a["raw_value"]).alias("raw_value"), null_text(a["normalized_value"]).alias("normalized_value"), null_text(a["unit"]).alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))

    return F.filter(F.transform(F.coalesce(items, F.array().cast(ATTRIBUTES)), coerced), lambda a: a["field_name"].isNotNull() & a["raw_value"].isNotNull())


def cache_key(maker: Column, part: Column, description: Column, version: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (maker, part, description, version)]).cast("binary"))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed_host(name: Column, blocked: tuple[str, ...] = tuple(K.BLOCKED_DOMAINS), allowed: tuple[str, ...] = ()) -> Column:
    """Neither missing nor a blocked domain or below one; where there is a list of allowed domains, one of them or below one."""
    among = lambda domains: F.exists(F.array(*map(F.lit, domains)), lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d)))
    fine = name.isNotNull() & ~among(blocked) if blocked else name.isNotNull()
    return fine & among(allowed) if allowed else fine


def relevant_url(url: Column, maker: Column, part: Column) -> Column:
    named = lambda x: (F.coalesce(F.trim(x), F.lit("")) != "") & F.lower(url).contains(F.lower(F.trim(x)))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PATH"))).endswith(".pdf"), F.lit(False)) | named(part) | named(maker)


def retry_seconds(message: Column) -> Column:
    """Seconds of "try again in", "retry in" or "in" with optional minutes; 0 where none is said."""
    minutes = F.coalesce(F.nullif(F.regexp_extract(message, K.RETRY_HINT, 1), F.lit("")).cast("double"), F.lit(0.0))
    return minutes * 60 + F.coalesce(F.nullif(F.regexp_extract(message, K.RETRY_HINT, 2), F.lit("")).cast("double"), F.lit(0.0))


def retry_after(headers: Column, message: Column) -> Column:
    """Seconds to wait: the retry-after header (a map; its name in any case) if it is a number, else what the message says; null for neither."""
    told = F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "retry-after"), F.lit(0))["value"].try_cast("double")
    return F.coalesce(told, F.when(message.rlike(K.RETRY_HINT), retry_seconds(message)))


def clean_lines(text: Column) -> Column:
    """Lines with runs of white space made one space, trimmed, blank ones dropped."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def daily_limit(message: Column) -> Column:
    """Whether a message says that the day's tokens are used up."""
    return F.lower(message).contains("tokens per day") | F.lower(message).contains("tpd")


def buffered_wait(seconds: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(F.least(seconds * 1.25 + 0.5, F.lit(30.0)))


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def key_list(text: Column) -> Column:
    """Keys of a comma-separated setting, without blanks and quotes around them; empty ones go."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda k: F.regexp_replace(k, r"^[\s\"']+|[\s\"']+$", ""))
    return F.filter(keys, lambda k: k != "")


def label(name: Column) -> Column:
    """A field's name for display: one unit suffix gone, words apart and capitalised after every non-letter."""
    suffix = "(?i)_(?:" + "|".join(K.LABEL_SUFFIXES) + ")$"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), suffix, ""), "_", " "))
    parts = F.regexp_extract_all(bare, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")
