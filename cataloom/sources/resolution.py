"""Where the products come from: the first source of a chain that holds any, and the literal relations at its end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.functions import constants as K, text as T
from cataloom.functions.display import category_of


def data_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a path's data files, by the file system's listing alone; 0 where there is none."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    total, files = 0, fs.listFiles(folder, True)
    while files.hasNext():
        status = files.next()
        if status.getPath().getName()[:1] not in "._":
            total += status.getLen()
    return total


def resolved(spark: SparkSession, chain: Sequence[tuple[str, str | None, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The name and rows of the first source of (name, path, reader) that holds rows; ValueError if none does.

    A source whose path is missing or holds no bytes is never opened.  One with bytes counts if one row can be read; a Parquet file's
    footer tells that without its data.  A path of None is a source that needs no file."""
    for name, path, reader in chain:
        if path is not None and not data_bytes(spark, path):
            continue
        rows = reader()
        if path is None or rows.select(F.lit(1)).limit(1).count():
            return name, rows
    raise ValueError("no source holds any rows")


def sample_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SAMPLE_PRODUCTS, "sku_id string, category string, manufacturer_name string, part_number string, overall_confidence double, processing_time_ms double, estimated_cost_usd double, attribute_count int").withColumn("pos", F.monotonically_increasing_id())


def sample_attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SAMPLE_ATTRIBUTES, "sku_id string, field_name string, raw_value string, normalized_value string, unit string, confidence_score double, source_url string").withColumn("pos", F.monotonically_increasing_id())


def starter_clues(rows: DataFrame) -> DataFrame:
    """Adds ``source_url`` and ``raw_content``, the template lines of the category that a row's maker and part name.

    For tests and demonstrations only: the scheme tells made-up text from fetched text.  The templates are a relation of one row a
    category, joined by it."""
    spark = rows.sparkSession
    maker, part = F.trim(F.coalesce("manufacturer", F.lit(""))), F.trim(F.coalesce("mfg_part_number", F.lit("")))
    templates = spark.createDataFrame([(c, list(lines)) for c, lines in K.CLUE_LINES.items()], "_category string, _lines array<string>")
    named = F.concat(maker, F.lit(" "), part)
    x = rows.withColumn("_category", category_of(named)).join(F.broadcast(templates), "_category")  # one row a category
    filled = F.transform("_lines", lambda line: F.replace(F.replace(line, F.lit("{manufacturer}"), F.coalesce(F.nullif(maker, F.lit("")), F.lit("UNKNOWN"))), F.lit("{part_number}"), F.coalesce(F.nullif(part, F.lit("")), F.lit("PART"))))
    return x.select(*rows.columns, F.concat(F.lit("mock://fallback/"), T.slug(named)).alias("source_url"), F.array_join(filled, "\n").alias("raw_content"))
