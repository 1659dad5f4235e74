"""Checkpoints and caches as Parquet tables: probes, upserts that replace a table whole, and resuming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which all executors share; where that is unset, a temporary one in
    local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cataloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cataloom/{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and returns a DataFrame that reads it, so that later plans start from there."""
    path = f"{work_folder(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def probe(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the cache holds, and the rest."""
    keys = cache.select(key)
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], replaced: Sequence[str] | None = None, version: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: the last write by ``version`` of a key wins; with ``replaced``, only these
    columns of a known key change."""
    keys = list(keys)
    if version:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_v"), *rest)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])
    if replaced is None:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    fresh = new.join(old.select(*keys), keys, "left_anti")
    changed = old.join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in replaced]), keys, "left")
    return changed.select(*[F.coalesce(f"_{c}", c).alias(c) if c in replaced else F.col(c) for c in old.columns]).unionByName(fresh)


def enrichment_cached(old: DataFrame, records: DataFrame) -> DataFrame:
    """The enrichment cache (cache_key, sku_id, attributes_json, created_at) after ``records`` are kept in it.

    Records without attributes are passed over; of a known key only the attributes change.  Of records that share a key the last by created_at counts."""
    empty = F.coalesce(F.regexp_replace("attributes_json", r"\s", ""), F.lit("")).isin("", "{}", "[]", "null")
    fresh = records.where(F.col("cache_key").isNotNull() & ~empty).groupBy("cache_key").agg(F.max(F.struct("created_at", "sku_id", "attributes_json")).alias("r"))
    fresh = fresh.select("cache_key", "r.sku_id", "r.attributes_json", "r.created_at")
    return upserted(old.select("cache_key", "sku_id", "attributes_json", "created_at"), fresh, ["cache_key"], replaced=["attributes_json"])


def resumed(rows: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed records as they were stored, and the rows still to do."""
    done = checkpoints.where("status = 'COMPLETED'")
    return done.join(rows.select("row_id"), "row_id", "left_semi"), rows.join(done.select("row_id"), "row_id", "left_anti")


def decoded(checkpoints: DataFrame, schema: str, column: str = "record_json") -> DataFrame:
    """The records of completed checkpoints; those whose JSON is broken are passed over."""
    done = checkpoints.where("status = 'COMPLETED'").select("row_id", F.from_json(column, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return done.where(F.col("r").isNotNull() & F.col("r._broken").isNull()).select("row_id", "r.*").drop("_broken")


class Table:
    """A Parquet table of numbered versions under one folder; the last one that was written to its end is current, so a reader never sees a half-written state.

    One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def write(self, df: DataFrame) -> None:
        versions = self._versions()
        df.write.parquet(f"{self.path}/v{versions[-1] + 1 if versions else 0}")

    def upsert(self, new: DataFrame, keys: Sequence[str], **options) -> None:
        old = self.read()
        self.write(new if old is None else upserted(old, new, keys, **options))
