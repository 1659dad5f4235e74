"""Run metrics, rollups, and the analysis of call limits and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def snapshot(transitions: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """One row of measures over (row_id, status, sources array, cache_hit, tokens, ms); sums count every transition.

    With ``elapsed_seconds`` also rows_per_second and elapsed_seconds, which then is at least a millisecond."""
    done = F.col("status") == "COMPLETED"
    has = lambda *s: F.arrays_overlap("sources", F.array(*map(F.lit, s)))
    kind = F.when(has("llm_70b_fallback"), "70b").when(has("llm_8b"), "8b").when(has("enrichment_cache", "scrape_cache") | F.col("cache_hit"), "cache").otherwise("deterministic")
    count = lambda c: F.count_if(c).cast("long")
    x = transitions.agg(
        F.countDistinct("row_id").alias("total_rows"), count(done).alias("completed"), count(F.col("status") == "FAILED").alias("failed"), count(F.col("status") == "MANUAL_REVIEW").alias("manual_review"),
        count(done & (kind == "deterministic")).alias("deterministic"), count(done & (kind == "cache")).alias("cache_hits"), count(done & (kind == "8b")).alias("small_model"), count(done & (kind == "70b")).alias("large_model"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("_ms"),
    )
    some = F.greatest(F.col("completed"), F.lit(1))
    if elapsed_seconds is not None:
        seconds = max(0.001, elapsed_seconds)
        x = x.withColumns({"rows_per_second": F.round(F.col("completed") / seconds, 2), "elapsed_seconds": F.lit(round(seconds, 2))})
    return x.withColumns({"bypass_rate": F.round((F.col("deterministic") + F.col("cache_hits")) / some, 4), "average_ms": F.round(F.col("_ms") / some, 2)}).drop("_ms")


def source_breakdown(records: DataFrame, column: str = "enrichment_source") -> DataFrame:
    return records.groupBy(F.coalesce(column, F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def job_rollup(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Counts of a batch job and the mean confidence of its successes, 0 if there are none."""
    good = F.col("status") == "success"
    return results.groupBy(job).agg(
        F.count("*").alias("completed"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.round(F.coalesce(F.avg(F.when(good, F.coalesce("confidence", F.lit(0.0)))), F.lit(0.0)), 4).alias("avg_confidence")
    )


def chunked(rows: DataFrame, size: int = 4, keys: int = 3, position: str = "row_id") -> DataFrame:
    """Adds the chunk of a 1-based position and the chunk's key in turn."""
    chunk = F.floor((F.col(position) - 1) / size).cast("long")
    return rows.withColumns({"chunk": chunk, "key_index": F.pmod(chunk, F.lit(keys)).cast("long")})


def contiguous_shards(rows: DataFrame, position: str, n: int, k: int) -> DataFrame:
    """Adds ``shard``: runs of ceil(n / k) rows by a dense 1-based ``position``; no rows when k is not positive."""
    if k <= 0:
        return rows.where(F.lit(False)).withColumn("shard", F.lit(0).cast("long"))
    return rows.withColumn("shard", F.floor((F.col(position) - 1) / max(-(-n // k), 1)).cast("long"))


def sliding_load(calls: DataFrame, ts: str, tokens: Column, within: str | None = None, seconds: int = 60, span: int = 3600) -> DataFrame:
    """Adds calls and tokens of the ``seconds`` before each call, itself included; the far end is exclusive.

    Time is cut into ranges of ``span`` seconds, and calls of the last ``seconds`` before a range are also given to it, so no task orders
    more than a range's calls.  With ``within`` each key has its own window."""
    if span < seconds:
        raise ValueError("a range must be at least as long as the window")
    micros, width, reach = F.unix_micros(F.col(ts).cast("timestamp")), span * 1_000_000, seconds * 1_000_000
    x = calls.withColumns({"_us": micros, "_tokens": tokens})
    own = F.floor(F.col("_us") / width)
    late = (own + 1) * width - F.col("_us") < reach
    shared = F.struct((own + 1).alias("_range"), F.lit(True).alias("_guard"))
    mine = F.struct(own.alias("_range"), F.lit(False).alias("_guard"))
    dealt = x.select("*", F.inline(F.when(late, F.array(mine, shared)).otherwise(F.array(mine))))
    frame = W.partitionBy(*([within] if within else []), "_range").orderBy("_us").rangeBetween(-(reach - 1), 0)
    loaded = dealt.withColumns({"rpm": F.count("*").over(frame), "tpm": F.sum("_tokens").over(frame)})
    return loaded.where("not _guard").drop("_us", "_tokens", "_range", "_guard")


def backoff(calls: DataFrame, order: list[str], failed: Column, within: str, base: float = 2.0) -> DataFrame:
    """Adds the number of failures in a row and the wait base * 2 ** (n - 1) that follows; a success resets it."""
    along = W.partitionBy(within).orderBy(*order)
    x = calls.withColumn("_f", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_f")).over(along))
    x = x.withColumn("failures", F.sum("_f").over(W.partitionBy(within, "_run").orderBy(*order)))
    return x.withColumn("wait", F.when(F.col("_f") == 1, base * F.pow(F.lit(2.0), F.col("failures") - 1)).otherwise(0.0)).drop("_f", "_run")


def tokens_small(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 150).cast("long")


def tokens_large(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 200).cast("long")


def tokens_api(text: Column) -> Column:
    return (F.floor(F.least(F.length(text), F.lit(25000)) / 3) + 400).cast("long")


def cost(text: Column, attributes: Column) -> Column:
    return F.round((F.length(text) / 4 + 40 * attributes) * 6e-7, 6)


def usable_keys(keys: Column, depleted: Column) -> Column:
    """Keys that aren't depleted; all of them when none is left."""
    left = F.array_except(keys, depleted)
    return F.when(F.size(left) == 0, keys).otherwise(left)


def depleted_keys(failures: DataFrame, now: Column) -> DataFrame:
    """Keys whose latest expiry lies ahead, from (api_key, expires)."""
    return failures.groupBy("api_key").agg(F.max("expires").alias("expires")).where(F.col("expires") > now)
