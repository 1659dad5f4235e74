"""Target-distribution importance resampling by external sort-count.

Every document's hashed features are written once, as a packed stream of 16-bit bucket numbers with document
offsets.  Counts come from sorting and run-length encoding the streams piece by piece; weights gather the
buckets' gains along the streams and add them up between the offsets.  Texts are read once, streams twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cataloom.llm.storage import stored
from cataloom.llm.terms import crc32s
from cataloom.llm.words import slices

STREAMS = "ids array<long>, words array<long>, offsets binary, stream binary"


def _streamer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in slices(batch.column(1)):
                one, two, where = crc32s(data, at)
                n_words = np.diff(where)
                n_pairs = np.maximum(n_words - 1, 0)
                # A document's single words, then its pairs.
                offsets = np.concatenate(([0], np.cumsum(n_words + n_pairs)))
                stream = np.empty(offsets[-1], np.uint16)
                owner = np.repeat(np.arange(len(n_words)), n_words)
                place = np.arange(len(one)) - where[owner]
                stream[offsets[owner] + place] = one % np.uint32(buckets)
                paired = place < n_pairs[owner]
                stream[(offsets[owner] + n_words[owner] + place)[paired]] = two[paired] % np.uint32(buckets)
                ids = batch.column(0).slice(first, last - first).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64())), pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([stream.astype("<u2").tobytes()], pa.binary())],
                    names=["ids", "words", "offsets", "stream"],
                )

    return run


def streams(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed streams of (doc_id, text): ids and words (numbers of words) of some documents, offsets (one more than documents) and stream."""
    return texts.mapInArrow(_streamer(buckets), STREAMS)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                ordered = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                if len(ordered):
                    edges = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
                    totals[ordered[edges[:-1]]] += np.diff(edges)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    return run


def counted(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all streams: each task sorts and run-length encodes its own, at most ``buckets`` rows a task are added up."""
    return packed.select("stream").mapInArrow(_counter(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Of every bucket floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) in doubles, with B ``buckets``; as many numbers as buckets."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    totals = both.agg(F.sum("s"), F.sum("t")).first()
    S, T = (F.lit(float(x or 0) + buckets) for x in totals)
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0.0)) for c in ("s", "t"))
    gain = F.floor(1000 * F.log(((t + 1) * S) / ((s + 1) * T))).cast("long")
    out = np.zeros(buckets, np.int64)
    for bucket, value in every.select("bucket", gain).collect():  # ``buckets`` rows, whatever the data
        out[bucket] = value
    return out


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, packed_offsets, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                offsets = np.frombuffer(packed_offsets.as_buffer(), "<i8")
                each = np.diff(offsets)
                full = np.flatnonzero(each)
                sums = np.zeros(len(each), np.int64)
                if len(full):
                    sums[full] = np.add.reduceat(gain[np.frombuffer(packed.as_buffer(), "<u2")], offsets[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(each), pa.array(sums // np.maximum(each, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Adds rank: 1, 2, 3, ... of the drawn rows by falling score and rising doc_id, null for the others.

    Scores are whole numbers of a bounded range (some 200,000 values at most: weights lie between extreme gains, draws between
    -4,000 and 23,000), so the rows above a score come from a histogram and only rows of equal score are ordered together.
    """
    levels = scored.where("drawable").groupBy("score").agg(F.count("*").alias("n")).withColumn("level", F.floor(F.col("score") / 512))
    levels = stored(levels, "levels")
    total = levels.agg(F.sum("n")).first()[0] or 0
    quota = percent * total // 100
    coarse = levels.groupBy("level").agg(F.sum("n").alias("n"))  # a few hundred rows
    falling = W.partitionBy(F.lit(0)).orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("level", F.coalesce(F.sum("n").over(falling), F.lit(0)).alias("over"))
    within = W.partitionBy("level").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    above = levels.join(F.broadcast(coarse), "level").select("score", (F.col("over") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("above"))
    placed = scored.join(F.broadcast(above.where(F.col("above") < quota)), "score", "left")  # at most one row a score
    ties = W.partitionBy("score", "drawable").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    rank = F.col("above") + F.row_number().over(ties)
    return placed.withColumn("rank", F.when(F.col("drawable") & (rank <= quota), rank).cast("long"))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Draws ``percent`` of the documents with ``min_words`` or more words, the likelier the more their features are those of ``target``.

    ``docs`` needs doc_id and text, ``target`` needs text; other columns are left out.  Returns doc_id, n_words, n_features,
    weight, score and rank, all long, one row per input row; rank is null for rows that aren't drawn.  Null and empty texts have
    no features and weight 0.  Rows without doc_id draw as if it were empty and come last among equal scores; repeated rows
    count and draw each for itself.  An empty table gives an empty result; an empty target gives features equal gains but for their own counts.
    Any text is taken whole; ``buckets`` is at most 65,536.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers have 16 bits")
    packed = stored(streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), buckets), "streams")
    aim = streams(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), buckets)
    gain = gains(counted(packed, buckets), counted(aim, buckets), buckets)
    weighed = packed.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = stored(weighed.withColumn("score", F.col("weight") + draw).withColumn("drawable", F.col("n_words") >= min_words), "scores")
    return _ranked(scored, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
