"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cataloom.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def held_out() -> Column:
    """Rows that a classifier must not learn from: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.quality import fit, scored

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.toxicity import fit, scored

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.line_dedup import deduplicated

    out = deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "n_near", F.array_join("dropped", ",").alias("dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.html_text import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.secrets import labelled_samples, secrets, train

    docs = _table(spark, sf_dir, "documents")
    found = secrets(docs, train(labelled_samples(spark, docs)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    everything = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(everything).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.licenses import licenses

    found = licenses(_table(spark, sf_dir, "documents"))
    starts, base_labels = F.transform("base", lambda b: b["start"]), F.transform("base", lambda b: b["label"])
    every = F.concat(base_labels, F.coalesce(F.transform("notices", lambda n: n["label"]), F.array().cast("array<string>")))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base_labels).alias("base_labels"), joined(every).alias("labels"), "score"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.fingerprints import fingerprinted

    return fingerprinted(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.resampling import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm.lexical import ranked

    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_html_text": op5_html_text,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
    "op11_fingerprints": op11_fingerprints,
    "op12_resampling": op12_resampling,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": oracles.OP1,
    "op2_line_dedup": oracles.OP2,
    "op4_embedding_dedup": oracles.OP4,
    "op10_decontaminate": oracles.OP10,
    "op13_lexical_search": oracles.OP13,
}
