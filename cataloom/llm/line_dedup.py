"""Line dedup: a deletion-neighbourhood join in DataFrame operations only.

Two lines are duplicates when they are equal or within one edit (insertion, deletion or substitution of one
character); the earliest in order of doc_id and line number stays.  Equal lines are found first, by two
64-bit hashes, so that a line with a million occurrences goes on as one row.

For the distinct lines, variants with one character deleted are joined as hashed keys:

* a substitution leaves equal variants at the same place of lines of equal length (key: variant, place, length);
* an insertion makes one line a variant of the other (key: variant, joined to whole lines).

Every key costs constant time: the characters' hashes with their places (or, where a deletion shifts places,
the hashes of adjacent pairs) are summed once per line, and a variant's sum follows by subtraction.  Each bucket sends
one edge per line to its earliest line, and edges are verified by edit distance on the texts.

Lines within one edit agree on their first or last half, so only lines that share a half with another line of
about their length emit variants; this leaves out no pair.  Few lines do: their texts are read again
at their first occurrence, and key filters keep all other lines and keys out of the shuffles.  Whole texts are
shuffled once, to meet the numbers of the lines that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.llm.filters import KeyFilter
from cataloom.llm.storage import discard, stored

#: Lines of fewer characters are left alone: by default only the empty ones, which are layout.
MIN_CHARS = 1


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.length("line") >= min_chars)


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def _half_keys(line: Column) -> Column:
    """Keys of the first and last half of a line.

    Lines of 2k and 2k + 1 characters have keys for halves of k, and one of 2k also for halves of k - 1, to meet
    those of 2k - 1.  So any two lines whose lengths differ by one or not at all have keys for the same length of half,
    which is half the shorter one's.
    """
    n, k = F.length(line), F.floor(F.length(line) / 2).cast("int")

    def pair(half: Column) -> list[Column]:
        return [F.xxhash64(half, F.lit("first"), F.substring(line, F.lit(1), half)), F.xxhash64(half, F.lit("last"), F.substring(line, n - half + 1, half))]

    return F.when(n % 2 == 0, F.array(*pair(k), *pair(k - 1))).otherwise(F.array(*pair(k)))


def _small(hashed: Column) -> Column:
    """40 bits of a hash: sums over any text stay far inside a long."""
    return F.shiftrightunsigned(hashed, 24)


def _summed(lines: DataFrame) -> DataFrame:
    """Per line the hashes of its characters with their places, of adjacent pairs, of the pairs that a deletion
    joins, and the sums of the first two.  Stored, so that no later expression computes an array again per element."""
    c = F.filter(F.split("line", ""), lambda x: x != "")
    hashed = lambda x, y: _small(F.xxhash64(x, y))
    edge = F.array(F.lit(""))
    all_but_one = F.length("line") - 1
    at = F.transform(c, hashed)
    pairs = F.zip_with(F.concat(edge, c), F.concat(c, edge), hashed)
    bridges = F.zip_with(F.concat(edge, F.slice(c, F.lit(1), all_but_one)), F.concat(F.slice(c, F.lit(2), all_but_one), edge), hashed)
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    return stored(lines.select("h1", F.length("line").alias("n"), at.alias("at"), pairs.alias("pairs"), bridges.alias("bridges"), total(at).alias("at_sum"), total(pairs).alias("pair_sum")), "sums")


def _variant_keys(sums: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(h1, key) of all variants with their place, of all variants, and of the lines themselves."""
    places = F.transform("at", lambda x, i: F.xxhash64(F.col("at_sum") - x, i, F.col("n")))
    removed = F.zip_with(F.slice("pairs", F.lit(1), F.col("n")), F.slice("pairs", F.lit(2), F.col("n")), lambda x, y: x + y)
    variants = F.zip_with(removed, "bridges", lambda gone, joined: F.xxhash64(F.col("pair_sum") - gone + joined, F.col("n") - 1))
    return sums.select("h1", F.explode(places).alias("key")), sums.select("h1", F.explode(variants).alias("key")), sums.select(F.col("h1").alias("other"), F.xxhash64("pair_sum", "n").alias("key"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, near) of every line that an earlier line makes redundant; near: it has an edit's difference
    from an earlier line and isn't the first of its own wording, or is the first and has such an earlier line."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = _lines(docs, min_chars)
    where = F.struct("doc_id", "line_no")
    distinct = lines.select(where.alias("at"), *_hashes(), _half_keys(F.col("line")).alias("halves"))
    distinct = stored(distinct.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.any_value("halves").alias("halves")), "lines")

    halves = distinct.select("h1", F.explode("halves").alias("key"))
    # A line has a key once, so a key that counts twice has two lines (or two of equal h1).
    shared = stored(halves.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key"), "shared")
    sharing = KeyFilter(shared).may_hold(halves, F.col("key")).join(shared, "key").select("h1").distinct()
    likely = stored(distinct.select("h1", "h2", "first").join(sharing, "h1", "left_semi"), "likely")

    # The texts of these lines, read again at their first occurrence.
    spot = F.xxhash64("doc_id", "line_no")
    wanted = likely.select(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "h1", "h2", "first")
    texts = KeyFilter(wanted.select(spot.alias("spot"))).may_hold(_lines(docs, min_chars), spot).select("doc_id", "line_no", "line", *_hashes())
    known = stored(texts.join(wanted, ["doc_id", "line_no", "h1", "h2"]).select("h1", "h2", "first", "line").distinct(), "texts")

    sums = _summed(known)
    places, variants, entire = _variant_keys(sums)
    # Few variants are shared: they are found by narrow rows first, and only they meet their lines' places.
    met_places = stored(places.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"), "places")
    firsts = known.select("h1", "first")
    swapped = places.join(met_places, "key").join(firsts, "h1")
    earliest = swapped.groupBy("key").agg(F.min("first").alias("low"))
    swaps = swapped.join(earliest, "key").where("first <> low").select(F.col("low").alias("a"), F.col("first").alias("b"))
    gaps = stored(variants.join(entire, "key").where("h1 <> other").select("h1", "other").distinct(), "gaps")
    met_gaps = gaps.join(firsts, "h1").join(firsts.withColumnsRenamed({"h1": "other", "first": "second"}), "other")
    edges = stored(swaps.union(met_gaps.select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))).distinct(), "edges")
    left, right = known.select(F.col("first").alias("a"), F.col("line").alias("line_a")), known.select(F.col("first").alias("b"), F.col("line").alias("line_b"), "h1", "h2")
    near = edges.join(left, "a").join(right, "b").where(F.levenshtein("line_a", "line_b", 1) == 1).select("h1", "h2", F.col("b").alias("first"), F.lit(True).alias("near"))

    repeated = distinct.where("first <> last").select("h1", "h2", "first", F.lit(False).alias("near"))
    judged = stored(repeated.unionByName(near).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("near").alias("near")), "judged")
    for done in (distinct, shared, likely, known, sums, met_places, gaps, edges):
        discard(done)
    met = lines.select("doc_id", "line_no", *_hashes()).join(judged, ["h1", "h2"])
    return met.where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first"))).select("doc_id", "line_no", "near")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns; text without its redundant lines, and the numbers of the lines that went.

    Adds n_lines, dropped (line numbers from 0, ascending, as array) and n_near (those with an edit's difference), in place of
    columns of these names.  Lines are cut at newlines.  Null texts stay null with no lines; an empty text has one empty line,
    which stays; rows without doc_id stay as they are.  Rows that repeat a doc_id lose the same line numbers.  A document that
    loses every line has an empty text.
    """
    own = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any name of docs
    gone = dropped_lines(docs, min_chars).groupBy(F.col("doc_id").alias(f"{own}id"))
    gone = gone.agg(F.sort_array(F.collect_set("line_no")).alias(f"{own}gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias(f"{own}near"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == F.col(f"{own}id"), "left").withColumn(f"{own}lines", F.split("text", "\n"))
    lines, gone_list = F.col(f"{own}lines"), F.coalesce(f"{own}gone", F.array().cast("array<int>"))
    # What stays are the runs between the lines that go; each is cut out once, so a text costs time in proportion to its lines.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), f"{own}gone"), F.concat(f"{own}gone", F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, F.greatest(F.lit(0), b - a - 1)))
    text = F.when(F.col(f"{own}gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    extra = {"n_lines": n_lines, "dropped": gone_list, "n_near": F.coalesce(f"{own}near", F.lit(0)).cast("long")}
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in extra], *[v.alias(k) for k, v in extra.items()])
