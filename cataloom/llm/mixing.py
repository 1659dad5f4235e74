"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are a water filling: sources share the mix by weight, none above ``cap`` times its own words.
The mix is cut into blocks of equal numbers of words, and blocks go to the sources, then to each
source's shards, by highest quotients target / (2 * won + 1).  A shard lays its documents out in a
seeded order and takes its quota of blocks from the front, going round again for repeats.
Shards bound the number of words that meet in one task, also for a source with a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cataloom.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"


def apportioned(cells: DataFrame, within: Sequence[str], order: str, weight: Column, seats: Column) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats of each cell among the cells of the same ``within``.

    The highest-quotient rule equals rounding weight * m for the m that fills all seats.  With n cells and
    N seats m lies within 1 +- n / 2N, so every cell starts from the rounded lower end and only the
    quotients up to the upper end, about three per cell, are ranked for what is left.
    Ties go to the lesser ``order``; cells without weight win nothing.
    """
    all_ = W.partitionBy(*within)
    x = cells.withColumn("_w", weight.cast("double")).withColumn("_seats", seats.cast("long"))
    x = x.withColumns({"_n": F.count("*").over(all_), "_sum": F.sum("_w").over(all_)})
    x = x.withColumn("_x", F.coalesce(F.try_divide(F.col("_w") * F.col("_seats"), F.col("_sum")), F.lit(0.0)))
    x = x.withColumn("_spread", F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("_seats")), F.lit(0.0)))
    x = x.withColumn("_base", F.greatest(F.lit(0), F.floor(F.col("_x") * (1 - F.col("_spread") / 2) + 0.5)).cast("long"))
    x = x.withColumn("_left", F.col("_seats") - F.sum("_base").over(all_))
    more = F.explode(F.sequence(F.lit(0), (F.floor(F.col("_x") * F.col("_spread")) + 1).cast("int")))
    bids = x.where("_w > 0 and _left > 0").select(*within, order, "_left", "_w", "_base", more.alias("_k"))
    bids = bids.withColumn("_q", F.col("_w") / (2 * (F.col("_base") + F.col("_k")) + 1))
    rank = F.row_number().over(all_.orderBy(F.desc("_q"), order, "_k"))
    won = bids.withColumn("_rank", rank).where("_rank <= _left").groupBy(*within, order).agg(F.count("*").alias("_won"))
    out = x.join(won, [*within, order], "left")
    return out.select(*cells.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _laid(docs: DataFrame, weights: Sequence[float], share: float, cap: float, block_words: int, shard_words: int, seed: int, with_text: bool) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, key, shard, and ``pieces``, the parts of blocks
    that the mix takes of it; with its text if ``with_text``.

    A shard's documents in their order, repeated, are one stream of words.  Block b is the words from b * ``block_words`` on;
    a piece is what a document gives to a block: block, place (its first word's in the block), first_word (its first
    word's number in the document, from 0), words.
    """
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *([text.alias("text")] if with_text else []))
    sized = sized if with_text else stored(sized, "sizes")

    # One row per source from here: '~' sorts after every 's...', so null is last.
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    everything, by_key = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("key")
    sources = sources.withColumn("weight", F.get(pattern, (F.row_number().over(by_key) - 1) % len(weights)))
    sources = sources.withColumns({"limit": cap * F.col("source_size"), "mix": share * F.sum("source_size").over(everything)})
    filling = everything.orderBy(F.col("limit") / F.col("weight"), "key")
    before = F.sum("limit").over(filling.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("limit")
    rest = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    sources = sources.withColumn("level", (F.col("mix") - before) / rest).withColumn("level", F.max("level").over(everything))
    sources = sources.withColumn("target", F.least(F.col("limit"), F.col("level") * F.col("weight"))).withColumn("all", F.lit(0))
    blocks = F.round(F.sum("target").over(everything) / block_words)
    sources = apportioned(sources.withColumn("blocks", blocks), ["all"], "key", F.col("target"), F.col("blocks"))
    sources = stored(sources.select("key", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("shards")), "sources")

    placed = sized.join(sources, "key").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))
    shards = placed.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = stored(apportioned(shards, ["key"], "shard", F.col("shard_size"), F.col("source_quota")), "shards")
    words = F.least(F.col("quota") * block_words, F.floor(cap * F.col("shard_size"))).cast("long")
    shards = shards.select("key", "shard", "shard_size", words.alias("words"))
    laid = W.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.withColumn("start", F.sum("size").over(laid) - F.col("size")).join(shards, ["key", "shard"])
    # What of each round of the stream falls on the document, as [low, high), then cut at the blocks' ends.
    n, begin = F.col("shard_size"), F.col("start")
    last = F.when((F.col("size") > 0) & (F.col("words") > begin), F.floor((F.col("words") - begin - 1) / n).cast("int"))
    rounds = F.coalesce(F.sequence(F.lit(0), last), F.array().cast("array<int>"))
    runs = F.transform(rounds, lambda r: F.struct((r * n + begin).alias("low"), F.least(r * n + begin + F.col("size"), F.col("words")).alias("high")))

    def cut(run: Column) -> Column:
        def piece(block: Column) -> Column:
            low = F.greatest(run["low"], block * block_words)
            words = F.least(run["high"], (block + 1) * block_words) - low
            return F.struct(block.alias("block"), (low - block * block_words).alias("place"), (low - run["low"]).alias("first_word"), words.alias("words"))

        return F.transform(F.sequence(F.floor(run["low"] / block_words), F.floor((run["high"] - 1) / block_words)), piece)

    out = out.withColumn("pieces", F.flatten(F.transform(runs, cut)))
    return out.select("doc_id", "source", "size", "source_size", "target", "key", "shard", "pieces", *(["text"] if with_text else []))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 16, shard_words: int = 250_000, seed: int = 20240607) -> DataFrame:
    """The blocks that a mix of ``share`` times all words takes of each document.

    ``docs`` needs doc_id, source and text; other columns are left out.  Sources in code point order, null
    last, weigh ``weights`` in turn.  Returns doc_id, source, size (words), source_size, target (the source's, in words),
    taken (words, repeats counted, at most ``cap`` times size), shard and pieces (block, place, first_word, words: see _laid),
    one row per input row.  Null and empty texts have size 0 and nothing is taken; a source without words has
    target 0.  Repeated rows count each for itself.  :func:`mixed_texts` has the words themselves.
    """
    out = _laid(docs, weights, share, cap, block_words, shard_words, seed, False)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shard", "pieces")


def mixed_texts(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 16, shard_words: int = 250_000, seed: int = 20240607) -> DataFrame:
    """The mix itself: source, shard, block, words and text, one row per selected block; repeats are blocks of their own.

    Takes what :func:`mixed` takes.  White space within a document stays as it was; documents in one block are parted
    by a newline.  Texts are shuffled once, to their shards.
    """
    out = _laid(docs, weights, share, cap, block_words, shard_words, seed, True)
    gap = r"\x20\x09-\x0D"
    words = F.regexp_extract_all("text", F.lit(f"(?:^[{gap}]+)?[^{gap}]+[{gap}]*"), F.lit(0))
    out = out.select("source", "key", "shard", F.when(F.size("pieces") > 0, words).alias("tokens"), "pieces").where("size(pieces) > 0")
    cut = F.transform("pieces", lambda p: F.struct(p["block"].alias("block"), p["place"].alias("place"), p["words"].alias("words"), F.array_join(F.slice(F.col("tokens"), (p["first_word"] + 1).cast("int"), p["words"].cast("int")), "").alias("text")))
    rows = out.select("source", "key", "shard", F.explode(cut).alias("p")).select("source", "key", "shard", "p.*")
    parts = F.sort_array(F.collect_list(F.struct("place", "text")))  # a block has at most block_words parts
    whole = rows.groupBy("key", "shard", "block").agg(F.any_value("source").alias("source"), F.sum("words").alias("words"), parts.alias("parts"))
    return whole.select("source", "shard", "block", "words", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
