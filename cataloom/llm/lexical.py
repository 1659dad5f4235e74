"""Ranked lexical search by inverted treaps.

Documents are cut into shards.  In a shard every term has a treap of its postings: a search tree by document and a heap by
impact, so the root of any part of a treap bounds what that part can score.  A query walks its terms' treaps together:
a state is an interval of documents with the root of each term's treap in it; states whose summed roots can't reach the top
are pruned, of others one document is scored and the interval is parted around it.  States of all queries are walked
as numpy columns, the most promising first, and a task carries its queries' best scores from shard to shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cataloom.llm.storage import stored
from cataloom.llm.terms import hashes, runs
from cataloom.llm.words import U64, slices

#: Texts of one shard have so many bytes together, or are one longer text.
SHARD_BYTES = 4_000_000
#: Distinct (query, term) pairs that are searched at once; of 24 bytes each, they are what a pass broadcasts.
BLOCK_TERMS = 200_000
#: Entries (a state's terms) that are walked at once.
WALKED = 200_000
#: A missing doc_id, which comes last among equal scores.
NO_ID = np.iinfo(np.int64).max

SHARD = "ids array<long>, lengths binary, terms binary, begins binary, docs binary, tfs binary"


def _packed(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _shard(ids: list, lengths: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
    """One row: documents by rising id, and the postings of every term by rising document."""
    order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
    n = np.concatenate(lengths)
    ordinal = np.empty(len(ids), np.int64)
    ordinal[order] = np.arange(len(ids))
    term, doc = np.concatenate(found), np.repeat(ordinal, n)
    by = np.lexsort((doc, term))
    term, doc = term[by], doc[by]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    posting = np.flatnonzero(fresh)
    tfs = np.diff(np.append(posting, len(term)))
    term, doc = term[posting], doc[posting]
    terms, begins = np.unique(term, return_index=True)
    columns = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), _packed(n[order], "<i8"), _packed(terms, "<u8"), _packed(np.append(begins, len(term)), "<i8"), _packed(doc, "<u4"), _packed(tfs, "<u4")]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "terms", "begins", "docs", "tfs"])


def _indexer(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, held = [], [], [], 0
        for batch in batches:
            for first, last, data, at in slices(batch.column(1)):
                if ids and held + len(data) > shard_bytes:
                    yield _shard(ids, lengths, found)
                    ids, lengths, found, held = [], [], [], 0
                starts, stops, where = runs(data, at)
                ids += batch.column(0).slice(first, last - first).to_pylist()
                lengths.append(np.diff(where))
                found.append(hashes(data, starts, stops) if len(data) else np.zeros(0, U64))
                held += len(data)
        if ids:
            yield _shard(ids, lengths, found)

    return run


def indexed(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of (doc_id, text): every document and every term; postings are packed arrays."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_indexer(shard_bytes), SHARD)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = terms = 0
    for batch in batches:
        for lengths in batch.column(0):
            n = np.frombuffer(lengths.as_buffer(), "<i8")
            held, terms = held + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([terms])], names=["held", "terms"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, begins in zip(batch.column(0), batch.column(1), strict=True):
            own, df = np.frombuffer(terms.as_buffer(), "<i8"), np.diff(np.frombuffer(begins.as_buffer(), "<i8"))
            for k in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 50_000]), pa.array(df[k : k + 50_000])], names=["term", "df"])


def _asker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in slices(batch.column(1)):
            starts, stops, where = runs(data, at)
            own = hashes(data, starts, stops).view(np.int64) if len(data) else np.zeros(0, np.int64)
            for i in range(last - first):
                term, times = np.unique(own[where[i] : where[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), batch.column(0)[first + i].as_py())), pa.array(term), pa.array(times)], names=["query", "term", "times"])


def _blocker(table: pa.Table) -> pa.Table:
    """One row per block: its terms and their weights, and its queries as runs of (place among the terms, times)."""
    table = table.combine_chunks().sort_by([("query", "ascending"), ("term", "ascending")])
    query, term, times, weight = (table.column(c).to_numpy() for c in ("query", "term", "times", "weight"))
    terms, first, place = np.unique(term.view(U64), return_index=True, return_inverse=True)
    queries, begins = np.unique(query, return_index=True)
    columns = {"queries": (queries, "<i8"), "starts": (np.append(begins, len(query)), "<i8"), "place": (place, "<i8"), "times": (times, "<i8"), "vocabulary": (terms, "<u8"), "weights": (weight[first], "<i8")}
    return pa.table({"block": table.column("block").slice(0, 1)} | {name: _packed(*x) for name, x in columns.items()})


BLOCK = "block long, queries binary, starts binary, place binary, times binary, vocabulary binary, weights binary"


class Treaps:
    """The treaps of some terms' postings in one shard.

    Postings are numbered term by term, by rising document.  ``left`` and ``right`` are a posting's children (-1: none), ``roots``
    each term's root.  Among equal impacts the earlier document is nearer to the root.
    """

    def __init__(self, begins: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        n = len(doc)
        self.doc, self.impact = doc, impact
        self.term = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        self.key = (self.term << 32) | doc
        low, high = begins[self.term], begins[self.term + 1]
        # The nearest posting on either side that stands higher: what lies between is lower than both ends, so pointers may
        # follow pointers, all at once.
        before, after = np.arange(n) - 1, np.arange(n) + 1
        todo = np.arange(n)
        while len(todo):
            todo = todo[before[todo] >= low[todo]]
            todo = todo[impact[before[todo]] < impact[todo]]
            before[todo] = before[before[todo]]
        todo = np.arange(n)
        while len(todo):
            todo = todo[after[todo] < high[todo]]
            todo = todo[impact[after[todo]] <= impact[todo]]
            after[todo] = after[after[todo]]
        has_before, has_after = before >= low, after < high
        at_left = np.where(has_before, impact[np.maximum(before, 0)], -1)
        at_right = np.where(has_after, impact[np.minimum(after, n - 1)], -1) if n else at_left
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        # The parent is the lower of the two; of equals the later stands lower.
        under_after = has_after & (~has_before | (at_right <= at_left))
        under_before = has_before & ~under_after
        self.left[after[under_after]] = np.flatnonzero(under_after)
        self.right[before[under_before]] = np.flatnonzero(under_before)
        top = np.flatnonzero(~has_before & ~has_after)
        self.roots = np.full(len(begins) - 1, -1)
        self.roots[self.term[top]] = top

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of what the treaps at ``node`` hold of documents from ``low`` to before ``high``; -1 for nothing."""
        node = node.copy()
        todo = np.flatnonzero(node >= 0)
        while len(todo):
            at = node[todo]
            doc = self.doc[at]
            below, beyond = doc < low[todo], doc >= high[todo]
            off = below | beyond
            todo = todo[off]
            node[todo] = np.where(below[off], self.right[at[off]], self.left[at[off]])
            todo = todo[node[todo] >= 0]
        return node


class _Best:
    """The best ``k`` scores above 0 of each query, highest first, with doc_ids; equal scores by rising doc_id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.zeros((queries, k), np.int64)
        self.doc = np.full((queries, k), NO_ID)

    def least(self) -> np.ndarray:
        """What a document must reach to be among the best."""
        return np.maximum(self.score[:, -1], 1)

    def take(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        some = score >= self.least()[query]
        query, score, doc = query[some], score[some], doc[some]
        own = np.unique(query)
        query = np.concatenate((query, np.repeat(own, self.k)))
        score, doc = np.concatenate((score, self.score[own].ravel())), np.concatenate((doc, self.doc[own].ravel()))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.score[query[kept], rank[kept]], self.doc[query[kept], rank[kept]] = score[kept], doc[kept]


def _spread(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the chosen states, and where each state's begin among them."""
    lengths = (starts[1:] - starts[:-1])[chosen]
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(starts[chosen] - begins[:-1], lengths) + np.arange(begins[-1]), begins


def walk(treaps: Treaps, ids: np.ndarray, starts: np.ndarray, term: np.ndarray, times: np.ndarray, best: _Best) -> int:
    """Searches one shard for queries, whose terms (numbers of treaps) and their times begin at ``starts``; returns how many
    (query, document) pairs were scored."""
    query = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    lengths = np.bincount(query, minlength=len(starts) - 1)
    asked = np.flatnonzero(lengths)
    bounds = np.zeros(len(asked), np.int64), np.full(len(asked), len(ids), np.int64)
    stack = [(asked, *bounds, np.concatenate(([0], np.cumsum(lengths[asked]))), treaps.roots[term], times)]
    scored = 0
    while stack:
        query, low, high, starts, node, times = stack.pop()
        if not len(query):
            continue
        most = treaps.impact[node] * times
        bound = np.add.reduceat(most, starts[:-1])
        alive = np.flatnonzero(bound >= best.least()[query])
        if len(node) > WALKED and len(alive) > 1:  # the more promising half first
            alive = alive[np.argsort(-bound[alive], kind="stable")]
            half = len(alive) // 2
            for part in (alive[half:], alive[:half]):
                entries, begins = _spread(starts, part)
                stack.append((query[part], low[part], high[part], begins, node[entries], times[entries]))
            continue
        if not len(alive):
            continue
        entries, starts = _spread(starts, alive)
        query, low, high, node, times, most = query[alive], low[alive], high[alive], node[entries], times[entries], most[entries]
        state = np.repeat(np.arange(len(query)), np.diff(starts))
        # The document that the highest root stands for.
        top = np.flatnonzero(most == np.maximum.reduceat(most, starts[:-1])[state])
        top = top[np.searchsorted(state[top], np.arange(len(query)))]
        doc = treaps.doc[node[top]]
        wanted = (treaps.term[node] << 32) | doc[state]
        place = np.minimum(np.searchsorted(treaps.key, wanted), len(treaps.key) - 1)
        score = np.add.reduceat(np.where(treaps.key[place] == wanted, treaps.impact[place] * times, 0), starts[:-1])
        scored += len(query)
        best.take(query, score, ids[doc])
        parts = []
        for lower, upper in ((doc + 1, high), (low, doc)):
            inner = treaps.within(node, lower[state], upper[state])
            kept = np.flatnonzero(inner >= 0)
            lengths = np.bincount(state[kept], minlength=len(query))
            some = np.flatnonzero(lengths)
            parts.append((query[some], lower[some], upper[some], lengths[some], inner[kept], times[kept]))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        joined[3] = np.concatenate(([0], np.cumsum(joined[3])))
        stack.append(tuple(joined))
    return scored


def _impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _searcher(documents: int, terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for ids, *packed in zip(*batch.columns, strict=True):
                kinds = "<i8", "<u8", "<i8", "<u4", "<u4", "<i8", "<i8", "<i8", "<i8", "<u8", "<i8"
                lengths, own, begins, docs, tfs, queries, starts, place, times, vocabulary, weights = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, kinds, strict=True))
                best = best or _Best(len(queries), k)
                # The postings of the queries' terms in this shard.
                at = np.minimum(np.searchsorted(own, vocabulary), max(len(own) - 1, 0))
                there = np.flatnonzero(own[at] == vocabulary) if len(own) else at[:0]
                chosen, inner = _spread(begins, at[there])
                doc, tf = docs[chosen].astype(np.int64), tfs[chosen].astype(np.int64)
                m = 100 - 75 + (75 * lengths * documents) // max(terms, 1)
                treaps = Treaps(inner, doc, _impacts(np.repeat(weights[there], np.diff(inner)), tf, m[doc]))
                number = np.full(len(vocabulary) + 1, -1)
                number[there] = np.arange(len(there))
                kept = np.flatnonzero(number[place] >= 0)
                asked = np.searchsorted(kept, starts)
                walk(treaps, pa.compute.fill_null(ids.values, NO_ID).to_numpy(), asked, number[place[kept]], times[kept], best)
        if best is not None:
            row, column = np.nonzero(best.score > 0)
            doc = best.doc[row, column]
            yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[row, column])], names=["query", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank (from 1), doc_id, score.

    ``docs`` needs doc_id and text, ``items`` needs item_id and text; other columns are left out.  Scores are whole numbers;
    equal ones rank by rising doc_id, a missing doc_id last.  Null and empty texts have no terms: such a document is never found,
    such an item finds nothing, and so does any item where there are no documents.  Repeated rows are documents and items of
    their own.  Items are searched in blocks of about ``block_terms`` of their distinct terms, each in a pass over the index.
    """
    spark = docs.sparkSession
    index = stored(indexed(docs, shard_bytes), "index")
    documents, terms = index.select("lengths").mapInArrow(_totals, "held long, terms long").agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    read = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    read = stored(read, "queries")
    asked = stored(read.select("query", "text").mapInArrow(_asker, "query long, term long, times long"), "asked")
    found = index.select("terms", "begins").mapInArrow(_frequencies, "term long, df long")
    df = found.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = asked.join(df.select("term", weight.alias("weight")), "term")
    blocks = max(1, -(-asked.count() // block_terms))
    placed = weighed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    blocked = stored(placed.groupBy("block").applyInArrow(_blocker, BLOCK), "blocks")
    best = None
    for number in range(blocks):
        one = blocked.where(F.col("block") == number)  # one row of some 24 bytes a term
        both = index.withColumn("block", F.lit(number).cast("long")).join(F.broadcast(one), "block").drop("block")
        here = stored(both.mapInArrow(_searcher(documents, terms, k), "query long, doc_id long, score long"), "best")
        best = here if best is None else best.unionByName(here)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return first.join(read.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
