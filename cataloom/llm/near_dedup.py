"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives each document its shingle count, a 128-bit digest of its shingle set and
   its band keys.  One sort of the set's hashes serves as the permutation: the high bits of a hash name
   its bin and the first hash in a bin is the bin's minimum.  Empty bins copy a non-empty bin in an order
   that is fixed for each bin (optimal densification), so short texts keep unbiased signatures.
2. Documents with equal sets form a class; only the class's least id goes on, so a thousand copies cost as
   much as one.
3. In every bucket one member is the centre and every other member gets one edge to it: a bucket of n
   makes n - 1 candidates.  The centre is the member that shares buckets with the most others: it differs least
   from what the group was copied from, so it is the likeliest partner of every member.
4. Candidates, and the members of a class, are confirmed on the full sets of the whole texts.
5. A bucket's members outside its largest component may be linked to a member that wasn't its centre.  They
   are compared with all members of that component on full sets, in blocks, and only links leave a block.

Texts travel only for documents that share a bucket or a class, once per star they lie in; a star of many members
is cut into parts, each with its own copy of the centre's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cataloom.llm.components import connected_components
from cataloom.llm.filters import KeyFilter, salted_join
from cataloom.llm.storage import discard, stored
from cataloom.llm.words import U64, mix, sets_of, shingle_sets, slices

#: With 32 bands of 4 bins, two sets of Jaccard similarity 0.8 share no band with probability 5e-8.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Rows of a block of the second comparison and of a part of a star.
BLOCK = 512
#: Columns of the 0/1 matrices that count shared shingles.
_COLUMNS = 4096
_BIN_BITS = BINS.bit_length() - 1

_draw = np.random.default_rng(20240607)
#: For each bin the order in which it looks for a non-empty bin to copy.
_PROBES = np.argsort(_draw.random((BINS, BINS)), axis=1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures (sets x bins) of non-empty sorted sets of hashes, densified."""
    out = np.zeros((len(sets), BINS), U64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> U64(64 - _BIN_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        out[i, bins[first]] = s[first]
        full[i, bins[first]] = True
    rows, empty = np.nonzero(~full)
    for step in range(BINS):
        if not len(rows):
            break
        source = _PROBES[empty, step]
        found = full[rows, source]
        out[rows[found], empty[found]] = out[rows[found], source[found]]
        rows, empty = rows[~found], empty[~found]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band; keys of different bands differ."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * U64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return out.view(np.int64)


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last, data, at in slices(texts):
                sets = list(shingle_sets(data, at, k))
                sizes = np.array([len(s) for s in sets], np.int64)
                low = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], U64).view(np.int64)
                high = np.array([np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], U64).view(np.int64)
                keys = np.zeros((len(sets), BANDS), np.int64)
                some = np.flatnonzero(sizes)
                if len(some):
                    keys[some] = band_keys(signatures([sets[i] for i in some]))
                lists = pa.ListArray.from_arrays(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(sizes), pa.array(low), pa.array(high), lists], names=["doc_id", "n_shingles", "low", "high", "keys"])

    return sketch


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _confirmer(k: int, percent: int):
    """Rows of a part of a star come together: first its centre (no b), then its members."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centres = None, []
        for batch in batches:
            part = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            member = batch.column(2).to_pylist()
            keep = np.zeros(len(part), bool)
            for i, own in enumerate(sets_of(batch.column(3), k)):
                if held != part[i]:
                    held, centres = part[i], []
                if member[i] is None:
                    centres.append(own)  # more than one only where rows repeat a doc_id
                else:
                    keep[i] = any(_alike(c, own, percent) for c in centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(keep))

    return confirm


def _confirmed(edges: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The edges (a, b) of stars around a that hold on the full sets."""
    sizes = edges.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = salted_join(edges, sizes, "a", "b").withColumn("part", F.pmod(F.xxhash64("b", F.lit(4)), F.col("parts")).cast("int"))
    dealt = stored(dealt.select("a", "part", "b"), "stars")
    members = dealt.join(bodies.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(bodies.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    together = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = stored(together.mapInArrow(_confirmer(k, percent), "a long, b long").distinct(), "confirmed")
    discard(dealt)
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    each = [(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])) for sets in (left, right)]
    both = np.intersect1d(each[0][0], each[1][0])
    for at in range(0, len(both), _COLUMNS):
        columns = both[at : at + _COLUMNS]
        marks = []
        for (values, row), sets in zip(each, (left, right), strict=True):
            place = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            hit = columns[place] == values
            mark = np.zeros((len(sets), len(columns)), np.float32)
            mark[row[hit], place[hit]] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out


def _edges(members: DataFrame) -> DataFrame:
    """An edge from every member of a bucket to the bucket's centre, the member of most weight."""
    centres = members.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("doc_id").alias("draw"), "doc_id")).alias("top")).select("key", F.col("top.doc_id").alias("centre"))
    met = members.join(centres, "key").where("doc_id <> centre")
    return met.select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()


def _outsider_comparer(k: int, percent: int):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, outside, block = (table.column(n).to_numpy(zero_copy_only=False) for n in ("group", "outside", "block"))
        low, high, mixed = (table.column(n)[0].as_py() for n in ("low", "high", "mixed"))
        sets = list(sets_of(table.column("text"), k))
        sizes = np.array([len(s) for s in sets], np.float32)
        left = np.flatnonzero(outside & (block == low))
        right = np.flatnonzero(~outside & (block == high)) if mixed else np.flatnonzero(outside & (block == high))
        both = _shared([sets[i] for i in left], [sets[i] for i in right])  # exact: sets are far smaller than 2 ** 24
        linked = (both > 0) & (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both))
        i, j = np.nonzero(linked & (group[left][:, None] != group[right][None, :]))
        pairs = np.unique(np.stack((group[left[i]], group[right[j]]), 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return compare


def _missed(members: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b: groups) that the stars passed over.

    A pair that shares a bucket and lies in two groups has at least one document outside the bucket's largest
    group.  For every group these outsiders are compared with its members and with each other on full sets, in blocks of
    some ``BLOCK`` rows.  Only links leave a block.
    """
    largest = members.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.count("*").alias("groups"))
    opened = largest.where("groups > 1").select("key", F.col("top.group").alias("main"))
    outsiders = stored(salted_join(members, opened, "key", "doc_id").where("group <> main").select("main", "doc_id", "group").distinct(), "outsiders")
    insiders = salted_join(members.select(F.col("group").alias("main"), "doc_id", "group").distinct(), outsiders.select("main").distinct(), "main", "doc_id")
    rows = stored(outsiders.withColumn("outside", F.lit(True)).unionByName(insiders.withColumn("outside", F.lit(False))), "compared")
    # An outsider and a group of one have met as a bucket's centre and member unless there are more outsiders.
    sizes = rows.groupBy("main").agg(F.count_if("outside").alias("o"), F.count_if(~F.col("outside")).alias("m")).where("o > 1 or m > 1")
    sizes = sizes.select("main", F.ceil(F.col("o") / BLOCK).cast("int").alias("out_blocks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("in_blocks"))
    placed = salted_join(rows, sizes, "main", "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("outside"), F.col("out_blocks")).otherwise(F.col("in_blocks"))).cast("int"))
    among = F.sequence(F.lit(0), F.col("out_blocks") - 1)
    unit = lambda low, high, mixed: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(mixed).alias("mixed"))
    mine = F.col("block")
    own = F.concat(F.transform(among, lambda x: unit(F.least(mine, x), F.greatest(mine, x), False)), F.transform(F.sequence(F.lit(0), F.col("in_blocks") - 1), lambda y: unit(mine, y, True)))
    units = F.when(F.col("outside"), own).otherwise(F.transform(among, lambda x: unit(x, mine, True)))
    spread = placed.join(bodies, "doc_id").select("main", "doc_id", "group", "outside", "block", "text", F.explode(units).alias("u")).select("*", "u.*").drop("u")
    return spread.groupBy("main", "mixed", "low", "high").applyInArrow(_outsider_comparer(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = 80) -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs doc_id and text; other columns are left out.  Returns doc_id, n_shingles, component_id
    (the least doc_id reachable by links) and kept (doc_id = component_id), one row per input row.  Null, empty and
    blank texts have no shingles and link with nothing.  Repeated rows form one class.  Rows without doc_id
    are returned with no component and kept.  An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(texts.mapInArrow(_sketcher(shingle_words), "doc_id long, n_shingles long, low long, high long, keys array<long>"), "sketches")
    usable = sketched.where("doc_id is not null and n_shingles > 0")
    classes = stored(usable.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("rep")), "classes")
    same = ["doc_id", "n_shingles", "low", "high"]
    leaders = usable.join(classes.withColumnRenamed("rep", "doc_id"), same, "left_semi").select("doc_id", F.explode("keys").alias("key")).distinct()
    leaders = stored(leaders, "buckets")
    copies = usable.join(classes, same[1:]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    copies = stored(copies.distinct(), "copies")
    # Only buckets and classes of two or more documents matter from here on, and only their texts are read again.
    shared = stored(leaders.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = stored(KeyFilter(shared.select("key")).may_hold(leaders, F.col("key")).join(shared, "key"), "members")
    weights = members.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    weighted = stored(members.join(weights, "doc_id").select("key", "doc_id", F.col("doc_id").alias("group"), "weight"), "weighted")
    for done in (leaders, shared, members):
        discard(done)
    wanted = stored(weighted.select("doc_id").union(copies.select("a")).union(copies.select("b")).distinct(), "wanted")
    bodies = stored(KeyFilter(wanted).may_hold(texts, F.col("doc_id")).join(wanted, "doc_id", "left_semi"), "bodies")

    equal = _confirmed(copies, bodies, shingle_words, percent)
    links = _confirmed(stored(_edges(weighted), "edges"), bodies, shingle_words, percent)
    parts = stored(connected_components(links), "components")
    named = parts.withColumnsRenamed({"node": "doc_id", "component": "of"})
    grouped = stored(weighted.join(named, "doc_id", "left").select("key", "doc_id", F.coalesce("of", "doc_id").alias("group"), "weight"), "members")
    missed = stored(_missed(grouped, bodies, shingle_words, percent), "missed")
    final = connected_components(missed).withColumnsRenamed({"node": "of", "component": "to"})
    for done in (classes, copies, weighted, wanted, bodies, links, grouped):
        discard(done)
    known = sketched.select("doc_id", "n_shingles").join(equal.select(F.col("b").alias("doc_id"), F.col("a").alias("rep")), "doc_id", "left")
    joined = known.withColumn("rep", F.coalesce("rep", "doc_id")).join(parts.withColumnsRenamed({"node": "rep", "component": "of"}), "rep", "left")
    joined = joined.withColumn("of", F.coalesce("of", "rep")).join(final, "of", "left").withColumn("of", F.coalesce("to", "of"))
    component = F.when(F.col("n_shingles") > 0, F.col("of")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
