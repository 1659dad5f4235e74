"""The whole enrichment as one plan: rules, cache, small model, gate, large model, gate.

Models are outside: their answers come as tables (row_id, response), or from an ``Extractor`` that is called per
batch of rows, and whose failures stay with the rows that cause them.  Each costly step only sees the rows that the cheaper ones left open.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cataloom.functions import constants as K, rules, text as T
from cataloom.operators import attributes as A
from cataloom.operators.answers import with_error
from cataloom.operators.store import kept, probe


class Extractor(Protocol):
    """Answers a batch of prompts, one text each; may raise, for the whole batch or because of one prompt in it."""

    def extract(self, prompts: list[str]) -> list[str]: ...


def _asked(extractor: Extractor, prompts: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(answer, class of the error, its message) of every prompt.

    A call that raises, or brings another number of answers than prompts, is halved until the prompts that fail stand alone; one that
    fails among n costs some 2 log2(n) more calls.
    """
    out: list = [None] * len(prompts)
    todo = [(0, len(prompts))] if prompts else []
    while todo:
        low, high = todo.pop()
        try:
            answers = list(extractor.extract(prompts[low:high]))
            if len(answers) != high - low:
                raise ValueError(f"{len(answers)} answers to {high - low} prompts")
        except Exception as error:  # noqa: BLE001  an outside service may fail in any way
            if high - low == 1:
                out[low] = "", type(error).__name__, str(error)
            else:
                middle = (low + high) // 2
                todo += [(middle, high), (low, middle)]
        else:
            out[low:high] = [(a, None, None) for a in answers]
    return out


def answered(rows: DataFrame, extractor: Extractor, prompt: str = "prompt") -> DataFrame:
    """(row_id, response) for every row's prompt; a row whose own prompt fails answers nothing, and others go on."""
    return answered_or_failed(rows, extractor, prompt).drop("errors")


def answered_or_failed(rows: DataFrame, extractor: Extractor, prompt: str = "prompt", stage: str = "LLM") -> DataFrame:
    """row_id, response and errors (type, message, stage) for every row's prompt.

    A row whose own prompt fails has an empty response and one error; all others are answered, whatever batch they share with it.
    A null prompt is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = _asked(extractor, ["" if p is None else p for p in frame[prompt]])
            yield pd.DataFrame({"row_id": frame["row_id"], "response": [f[0] for f in found], "_type": [f[1] for f in found], "_message": [f[2] for f in found]})

    key = rows.schema["row_id"].dataType.simpleString()
    out = rows.select("row_id", prompt).mapInPandas(run, f"row_id {key}, response string, _type string, _message string")
    none = F.array().cast("array<struct<type:string,message:string,stage:string>>")
    return out.select("row_id", "response", F.when(F.col("_type").isNull(), none).otherwise(with_error(none, F.col("_type"), F.col("_message"), F.lit(stage))).alias("errors"))


def _told(responses: DataFrame, source: str) -> DataFrame:
    """Attributes of answers, the last of a repeated field."""
    items = responses.select("row_id", F.posexplode(T.parsed_attributes(F.col("response"))).alias("pos", "a")).select("row_id", "pos", "a.field_name", F.coalesce("a.normalized_value", "a.raw_value").alias("value"), "a.confidence")
    return A.last_wins(items).withColumn("source", F.lit(source)).select("row_id", "field_name", "value", "confidence", "source")


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    return A.quality_gate(rows, found.withColumns({"normalized_value": F.col("value"), "raw_value": F.col("value")}))


def enriched(rows: DataFrame, cache: DataFrame, small: DataFrame, large: DataFrame, version: str = "1.0.0", strict_review: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records (row_id, category, status, via, validity, completeness, overall_confidence) and attributes (row_id, field_name, value,
    confidence, source).  ``rows``: row_id, manufacturer, mfg_part_number, raw_description, category; ``cache``: cache_key, field_name, value,
    confidence, source; ``small`` and ``large``: row_id, response.

    Rows, cache and small answers are read at once, what follows when the results are.  Rows that the rules or the cache complete never meet the gate and stay unvalidated, so a review finds them all; with
    ``strict_review`` they keep their status but get the gate's measures, and a review finds those that it faults."""
    key = T.cache_key(F.col("manufacturer"), F.col("mfg_part_number"), F.col("raw_description"), F.lit(version))
    # Written once, since every later step starts from the rules' values, and from the answers: else each step works them out again.
    gated = kept(rules.gated(rows.withColumn("cache_key", key)).select("row_id", "category", "cache_key", "status", *[f for f, _ in rules.FIELDS]), "gated")
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f, _ in rules.FIELDS])
    by_rule = gated.select("row_id", F.inline(F.filter(values, lambda x: x["value"].isNotNull()))).withColumns({"confidence": F.lit(K.RULE_CONFIDENCE), "source": F.lit("regex")})
    complete, rest = gated.where("status = 'COMPLETED'"), gated.where("status <> 'COMPLETED'")
    hits, missed = [kept(x.select("row_id", "category", "cache_key"), name) for x, name in zip(probe(rest, cache.select("cache_key").distinct(), "cache_key"), ("hits", "missed"), strict=True)]
    cached = hits.select("row_id", "cache_key").join(cache, "cache_key").select("row_id", "field_name", "value", "confidence", "source")
    told = kept(_told(small.join(missed.select("row_id"), "row_id", "left_semi"), "llm_8b"), "told")
    none = told.where(F.lit(False))
    first = A.merged_by_stage(by_rule, cached, told, none)
    tried = _judged(missed, first.join(missed.select("row_id"), "row_id", "left_semi"))
    failed = tried.where("status = '70B_PENDING'").select("row_id")
    repaired = _told(large.join(failed, "row_id", "left_semi"), "llm_70b_fallback")
    final = A.merged_by_stage(by_rule, cached, told, repaired)
    again = _judged(missed, final.join(missed.select("row_id"), "row_id", "left_semi")).withColumnRenamed("status", "gate").drop("validation_flags")
    judged = missed.select("row_id", "category").join(again, "row_id").select("row_id", "category", F.when(F.col("gate") == "PROVENANCE_MERGE", "COMPLETED").otherwise("MANUAL_REVIEW").alias("status"), F.lit("model").alias("via"), "validity", "completeness", "overall_confidence")
    unjudged = lambda df, via: df.select("row_id", "category", F.lit("COMPLETED").alias("status"), F.lit(via).alias("via"), F.lit(False).alias("validity"), F.lit(0.0).alias("completeness"), F.lit(0.0).alias("overall_confidence"))
    if strict_review:
        early = complete.select("row_id", "category", F.lit("rules").alias("via")).unionByName(hits.select("row_id", "category", F.lit("cache").alias("via")))
        gate = _judged(early, A.merged_by_stage(by_rule, cached, none, none).join(early.select("row_id"), "row_id", "left_semi")).drop("status", "validation_flags")
        checked = early.join(gate, "row_id").select("row_id", "category", F.lit("COMPLETED").alias("status"), "via", "validity", "completeness", "overall_confidence")
        return checked.unionByName(judged), final
    return unjudged(complete, "rules").unionByName(unjudged(hits, "cache")).unionByName(judged), final
