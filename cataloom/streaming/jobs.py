"""Streaming: batch jobs with pollable progress, and admission under call limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cataloom.functions.rules import gated


_RESULT = "row_id long, job_id string, status string, confidence double, batch int"
_PROGRESS = "job_id string, rows long, succeeded long, failed long, confidence_sum double, created_at timestamp, batch int"


def run_batch_job(spark: SparkSession, source: str, schema: str, job_id: str, folder: str, checkpoint: str, files_per_trigger: int = 1) -> StreamingQuery:
    """Enriches the files that arrive in ``source`` (row_id, raw_description, category) into ``folder``; see :func:`job_results`, :func:`job_progress`.

    A micro-batch writes a partition of its own and one row of counts, whatever came before, so its cost doesn't grow with the job.
    One that runs again after a failure replaces its own partition.  A job without an id leaves results but no progress."""

    def step(batch: DataFrame, n: int) -> None:
        done = gated(batch.dropDuplicates(["row_id"])).select(F.col("row_id").cast("long"), F.lit(job_id).alias("job_id"), F.when(F.col("status") == "COMPLETED", "success").otherwise("error").alias("status"), F.col("coverage_ratio").cast("double").alias("confidence"))
        path = f"{folder}/results/batch={n}"
        done.write.mode("overwrite").parquet(path)
        if not job_id.strip():
            return
        good = F.col("status") == "success"
        counts = spark.read.parquet(path).agg(F.lit(job_id).alias("job_id"), F.count("*").alias("rows"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("confidence_sum"), F.current_timestamp().alias("created_at"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_results(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, job_id, status and confidence: of a row that came in several batches, what the last one made of it."""
    rows = spark.read.schema(_RESULT).parquet(f"{folder}/results")
    last = rows.groupBy("row_id").agg(F.max(F.struct("batch", "job_id", "status", "confidence")).alias("x"))
    return last.select("row_id", "x.job_id", "x.status", "x.confidence")


def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row per job, folded from its batches' counts: completed, succeeded, failed, avg_confidence, batches, created_at, updated_at.

    A row that comes again in a later batch counts again.  created_at is the first batch's and stays."""
    rows = spark.read.schema(_PROGRESS).parquet(f"{folder}/progress")
    mean = F.coalesce(F.try_divide(F.sum("confidence_sum"), F.sum("succeeded")), F.lit(0.0))
    return rows.groupBy("job_id").agg(F.sum("rows").alias("completed"), F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"), F.round(mean, 4).alias("avg_confidence"), F.count("*").alias("batches"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def admitted(calls: DataFrame, key: str = "user_id", rpm: int = 2, tpm: int = 300, seconds: float = 60.0) -> DataFrame:
    """When each call (key, call_id, at: seconds, tokens) may start under a limit of calls and tokens per sliding window.

    Admission depends on the admissions before it, so a key's calls run in order; keys are spread over tasks.  A call of more
    tokens than the limit waits for none."""

    def admit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, window, clock = None, [], 0.0
        for frame in frames:
            starts = []
            for k, at, tokens in zip(frame[key], frame["at"], frame["tokens"], strict=True):
                if k != held:
                    held, window, clock = k, [], 0.0
                now = max(at, clock)
                while True:
                    window = [w for w in window if w[0] > now - seconds]
                    if len(window) < rpm and (tokens > tpm or sum(w[1] for w in window) + tokens <= tpm):
                        break
                    now = window[0][0] + seconds if window else now
                    if not window:
                        break
                window.append((now, tokens))
                clock = now
                starts.append(now)
            yield frame.assign(start=starts, waited=[s - a for s, a in zip(starts, frame["at"], strict=True)])

    ordered = calls.repartition(key).sortWithinPartitions(key, "at", "call_id")
    return ordered.mapInPandas(admit, f"{key} long, call_id long, at double, tokens long, start double, waited double")
