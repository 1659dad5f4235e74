"""Fetched pages as a table, and the cache of what was made of them, by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.functions import constants as K, text as T
from cataloom.operators.attributes import reduced_context


def url_hash(url: Column) -> Column:
    """The key of a URL in the cache; blanks around it don't count."""
    return F.md5(F.trim(F.coalesce(url, F.lit(""))).cast("binary"))


def fetched(pages: DataFrame, content_type: Column | None = None, failed: Column | None = None, pdf_text: Column | None = None) -> DataFrame:
    """Adds ``raw_content`` and ``outcome`` to pages (url, html): the text of a page, or of a document if ``pdf_text`` has it,
    at most CONTENT_CHARS characters; an empty one for a fetch that failed or brought nothing.

    outcome: failed, pdf (by the end of the URL's path or the content type), or html.  A failed page never fails the table.
    """
    kind = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    pdf = F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("PATH"))).endswith(".pdf"), F.lit(False)) | kind.contains("application/pdf")
    broken = F.col("html").isNull() | (F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False))
    outcome = F.when(broken, "failed").when(pdf, "pdf").otherwise("html")
    content = F.when(outcome == "html", T.page_text(F.col("html"))).when(outcome == "pdf", F.coalesce(pdf_text, F.lit("")) if pdf_text is not None else F.lit("")).otherwise(F.lit(""))
    return pages.withColumns({"raw_content": F.substring(content, 1, K.CONTENT_CHARS), "outcome": outcome})


def reduced_by_url(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's reduced page text, and the cache as it is afterwards.

    ``rows``: row_id, url, maker, part, raw_content; ``cache``: url_hash, cleaned_text.  A URL in the cache gives its text as it
    stands.  Any other is reduced once, with the maker and part of the first row that brings it with a text; every row
    of the URL gets that text, and the cache gains it.  Rows without URL are reduced for themselves and never cached.  Returns
    (row_id, cleaned_text, from_cache) and (url_hash, cleaned_text).
    """
    named = F.coalesce(F.trim("url"), F.lit("")) != ""
    keyed = rows.withColumn("url_hash", F.when(named, url_hash(F.col("url"))))
    known = cache.groupBy("url_hash").agg(F.max("cleaned_text").alias("known"))
    # One text a URL is shuffled, chosen before the shuffle; the text itself is reduced once.
    fresh = keyed.where("url_hash is not null").join(known, "url_hash", "left_anti")
    first = fresh.groupBy("url_hash").agg(F.min_by(F.struct("maker", "part", "raw_content"), F.struct(F.coalesce(F.col("raw_content"), F.lit("")) == "", "row_id")).alias("f"))
    new = first.select("url_hash", reduced_context(F.col("f.raw_content"), F.col("f.maker"), F.col("f.part")).alias("new"))
    out = keyed.join(known, "url_hash", "left").join(new, "url_hash", "left")
    own = F.when(F.col("url_hash").isNull(), reduced_context(F.col("raw_content"), F.col("maker"), F.col("part")))
    texts = out.select("row_id", F.coalesce("known", "new", own).alias("cleaned_text"), F.col("known").isNotNull().alias("from_cache"))
    after = known.select("url_hash", F.col("known").alias("cleaned_text")).unionByName(new.select("url_hash", F.col("new").alias("cleaned_text")).where("cleaned_text <> ''"))
    return texts, after
