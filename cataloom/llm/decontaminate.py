"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by the size n of their shingle set, into classes between powers of two.  Every class has sketches of
its own length: the item's k least hashes (a bottom-k MinHash), where k is twice what a document with a share t of the class's
largest items can lack, and one more.  A document that holds a share t of an item lacks at most (1 - t) * n of its hashes, so at least
k - (1 - t) * n of its sketch are among the document's: items whose sketches show that much are candidates, and
the bound loses none, however long the document is.  (Banded Jaccard buckets can't do this: 30 shingles inside a
document of 20,000 have a Jaccard similarity near 0.001.)  Candidates are verified by exact containment of the
full sets.

Items are hashed in tasks and stored; the documents are read once, whatever the number of items, and never shuffled.  Items
travel to the tasks as broadcast blocks of at most ``BLOCK_HASHES`` hashes (or one item); documents pass the
blocks one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from cataloom.llm.storage import stored
from cataloom.llm.words import rolling, slices, word_hashes

#: The bound of what one broadcast block holds: 16 MB of hashes.
BLOCK_HASHES = 2_000_000
_PREFIX_BITS = 20


@dataclass
class _Class:
    """Items of one size class and shingle length: sketch hashes, sorted, and whose they are."""

    length: int
    key: np.ndarray
    owner: np.ndarray
    marked: np.ndarray
    sketch_sizes: np.ndarray

    def candidates(self, shingles: np.ndarray, where: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(row, item) of texts that hold enough of an item's sketch."""
        hit = np.flatnonzero(self.marked[(shingles >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)])
        place = np.searchsorted(self.key, shingles[hit])
        hit = hit[(place < len(self.key)) & (self.key[np.minimum(place, len(self.key) - 1)] == shingles[hit])]
        row = np.searchsorted(where, hit, side="right") - 1
        inside = hit + self.length <= where[row + 1]  # not across the end of a text
        hit, row = hit[inside], row[inside]
        for r in np.unique(row):
            found = np.isin(self.key, shingles[hit[row == r]])
            items, held = np.unique(self.owner[found], return_counts=True)
            for n in items[held >= self.sketch_sizes[items] - sizes[items] * (100 - percent) // 100]:
                yield int(r), int(n)


class _Block:
    """Full shingle sets of some items, and their sketches by size class."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], percent: int):
        self.ids = np.array([i for i, _, _ in items], np.int64)
        self.percent = percent
        self.sets = [s for _, _, s in items]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        groups: dict[tuple[int, int], list[int]] = {}
        for n, (_, length, s) in enumerate(items):
            groups.setdefault((length, len(s).bit_length()), []).append(n)
        self.classes = []
        for (length, bits), members in sorted(groups.items()):
            k = 2 * (((1 << bits) - 1) * (100 - percent) // 100) + 1
            sketches = [self.sets[n][:k] for n in members]  # sets are sorted: the least hashes
            sketch_sizes = np.zeros(len(items), np.int64)
            sketch_sizes[members] = [len(s) for s in sketches]
            key, owner = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
            order = np.argsort(key, kind="stable")
            marked = np.zeros(1 << _PREFIX_BITS, bool)
            marked[(key >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)] = True
            self.classes.append(_Class(length, key[order], owner[order], marked, sketch_sizes))

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item's place, shingles shared) for every row of ``texts`` that contains an item."""
        for first, _, data, at in slices(texts):
            words, where = word_hashes(data, at)
            rolled: dict[int, np.ndarray] = {}
            for part in self.classes:
                shingles = rolled.setdefault(part.length, rolling(words, part.length))
                row, own = -1, shingles
                for r, n in part.candidates(shingles, where, self.sizes, self.percent):
                    if r != row:
                        row, own = r, np.unique(shingles[where[r] : where[r + 1] - part.length + 1])
                    shared = int(np.isin(self.sets[n], own, assume_unique=True).sum())
                    if 100 * shared >= self.percent * self.sizes[n]:
                        yield first + r, n, shared


def _item_hasher(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, sets = [], [], []
            for first, _, data, at in slices(batch.column(1)):
                hashed, where = word_hashes(data, at)
                for i in range(len(at) - 1):
                    own = hashed[where[i] : where[i + 1]]
                    if len(own):
                        ids.append(batch.column(0)[first + i].as_py())
                        lengths.append(min(len(own), words))
                        sets.append(np.unique(rolling(own, lengths[-1])).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "length", "hashes"])

    return run


def _blocks(items: DataFrame, words: int, percent: int) -> Iterator[Broadcast]:
    """Items in blocks, read through an iterator: the driver's Python holds one block at a time.

    An item of fewer than ``words`` words counts as one shingle of its own length; items without id or words are passed over."""
    context = items.sparkSession.sparkContext
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    hashed = stored(rows.mapInArrow(_item_hasher(words), "item_id long, length int, hashes array<long>"), "items")
    held, size = [], 0
    for item_id, length, hashes in hashed.toLocalIterator():
        own = np.array(hashes, np.int64).view(np.uint64)
        if held and size + len(own) > BLOCK_HASHES:
            yield context.broadcast(_Block(held, percent))
            held, size = [], 0
        held.append((item_id, length, own))
        size += len(own)
    if held:
        yield context.broadcast(_Block(held, percent))


def leaks(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of documents and benchmark items whose shingles the document contains to ``percent`` or more.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are left out.  Returns doc_id, item_id,
    n_item (the item's distinct shingles), n_shared and containment; a pair for every row of ``docs``.  Null and
    empty texts and items match nothing; an empty table on either side gives no rows.
    """
    hit = "array<struct<item_id:bigint,n_item:bigint,n_shared:bigint>>"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.array().cast(hit).alias("hits"))
    for block in _blocks(items, shingle_words, percent):

        def pairs(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in batches:
                hits = batch.column(2).to_pylist()
                for row, n, shared in own.search(batch.column(1)):
                    hits[row].append({"item_id": int(own.ids[n]), "n_item": int(own.sizes[n]), "n_shared": shared})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, batch.schema.field(2).type)], schema=batch.schema)

        found = found.mapInArrow(pairs, found.schema)
    found = found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, without the rows that contain an item (see :func:`leaks`).  No shuffle."""
    for block in _blocks(items, shingle_words, percent):

        def clean(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[list({row for row, _, _ in own.search(batch.column("text").cast(pa.string()))})] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
