"""Secret scans in DataFrame operations only: fixed patterns, and character Markov models for the rest.

Two first-order Markov models over characters are trained, one on labelled random strings and one on labelled
ordinary identifiers; a long token whose log-likelihood ratio favours the random model becomes a further span.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The base patterns and the least lengths of what they must catch.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Tokens of at least so many characters of the alphabet are compared by the models.
MIN_TOKEN = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{" + str(MIN_TOKEN) + ",}"

# Marks set around a match.  Where a text holds these characters itself they count as another one of the
# same length, which no pattern matches.
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"


def _marked_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches, in code points."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_OPEN + "$0" + _CLOSE)), _OPEN)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def step(state: Column, piece: Column) -> Column:
        match = F.substring_index(piece, _CLOSE, 1)
        start = state["at"]
        span = F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))
        return F.struct((start + F.length(piece) - 1).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    begin = F.struct(F.length(F.get(pieces, 0)).cast("bigint").alias("at"), empty.alias("spans"))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1))
    return F.aggregate(rest, begin, step, lambda s: s["spans"])


def _kept(text: Column, pattern: str, quick: str, kind: str, keep) -> Column:
    """Spans as (start, rank of the kind, end, kind, match); ``quick`` is cheap to test and true of every text with a span."""
    rank = F.lit(KINDS.index(kind))
    spans = F.transform(F.filter(_marked_spans(text, pattern), keep), lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,match:string>>")
    return F.when(text.rlike(quick), spans).otherwise(none)


@dataclass
class MarkovModels:
    """log P(b | a, random) - log P(b | a, ordinary) for every pair of characters, row by row of the alphabet."""

    ratios: list[float]

    def mean_ratio(self, token: Column) -> Column:
        table, size = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>"), len(ALPHABET)
        codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        n = F.length(token) - 1
        steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(table, a * size + b))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / n


def labelled_samples(spark: SparkSession, docs: DataFrame, max_docs: int = 2000, random_strings: int = 4000) -> DataFrame:
    """(token, random): random strings drawn from hashes in four alphabets, and the ordinary words of a bounded
    sample of ``docs`` (the first ``max_docs`` by a hash of doc_id), alone and joined to identifiers."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    packed = F.base64(F.unhex(digest))
    drawn = spark.range(random_strings).select(F.explode(F.array(packed, F.translate(packed, "+/", "-_"), digest, F.upper(F.substring(F.regexp_replace(packed, "[^A-Za-z0-9]", ""), 1, 30)))).alias("token"), F.lit(True).alias("random"))
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi")  # bounded by max_docs
    words = F.regexp_extract_all("text", F.lit(r"\b([A-Za-z][a-z]{3,})\b"), F.lit(1))
    named = sample.select(words.alias("w"))
    joined = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 3)), lambda i: F.concat_ws("_", F.lower(F.get("w", i)), F.lower(F.get("w", i + 1)), F.lower(F.get("w", i + 2))))
    camel = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 3)), lambda i: F.concat(F.lower(F.get("w", i)), F.initcap(F.get("w", i + 1)), F.initcap(F.get("w", i + 2))))
    ordinary = named.where(F.size("w") > 2).select(F.explode(F.concat("w", joined, camel)).alias("token"), F.lit(False).alias("random"))
    return drawn.unionByName(ordinary)


def train(samples: DataFrame) -> MarkovModels:
    """Counts character pairs of labelled tokens; what reaches the driver is bounded by the alphabet squared."""
    chars = F.filter(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = samples.where("token is not null").withColumn("c", chars).where(F.size("c") > 1)
    pairs = pairs.select("random", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    ratios = []
    for a in ALPHABET:
        sums = {side: sum(counts.get((side, a + b), 0) for b in ALPHABET) for side in (True, False)}
        for b in ALPHABET:
            chance = [(counts.get((side, a + b), 0) + 0.5) / (sums[side] + 0.5 * len(ALPHABET)) for side in (True, False)]
            ratios.append(math.log(chance[0] / chance[1]))
    return MarkovModels(ratios)


def secrets(docs: DataFrame, models: MarkovModels, min_ratio: float = 0.75) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and added (tokens that the models call random and no base span
    overlaps), as arrays of (start, rank, end, kind, match) in code points, by start, then kind.

    ``docs`` needs doc_id and text; other columns are left out.  A token is random if its mean log-likelihood ratio per pair of
    characters is ``min_ratio`` or more.  Null and empty texts have no spans.  One row per input row.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    safe = F.when(raw.contains(_OPEN) | raw.contains(_CLOSE), F.translate(raw, _OPEN + _CLOSE, _OTHER * 2)).otherwise(raw)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), safe.alias("t"))
    t = F.col("t")
    assign = _kept(t, ASSIGN, r"(?i)(?:passw|secret|token|api_?key)", "assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_ASSIGN)
    access = _kept(t, ACCESS, "AKIA", "access", lambda s: F.length(s["match"]) >= MIN_ACCESS)
    # A run of 24 or more is the same match whether or not shorter runs are found and dropped.
    run = "[0-9a-f]{" + str(MIN_HEX) + ",}"
    hexes = _kept(t, run, run, "hex", lambda s: F.length(s["match"]) >= MIN_HEX)
    out = out.withColumns({"assign": assign, "access": access, "hex": hexes})
    out = out.select("doc_id", "t", F.array_sort(F.concat("assign", "access", "hex")).alias("base"))
    tokens = _kept(t, CANDIDATE, CANDIDATE, "random", lambda s: models.mean_ratio(s["match"]) >= min_ratio)
    free = F.filter(tokens, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select("doc_id", "base", free.alias("added"))
