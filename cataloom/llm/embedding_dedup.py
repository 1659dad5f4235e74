"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Every tree halves the vectors again and again by a random direction at the median of a bounded sample; vectors near
a cut go to both sides.  The driver fits as many levels as its sample carries; for more vectors, each of the leaves reached gets a tree of
its own, fitted in a task on a sample of that leaf, so leaves stay as small however many vectors there are.  Vectors of one leaf are compared by cosine in blocks of at most ``BLOCK`` rows, so
a dense leaf is many tasks.  A pair that meets in several leaves counts in the first of them only, and a block returns each
vector's number of links and the components among its rows, never the pairs themselves: a dense group of
n vectors costs n rows.  Equal vectors go through the forest once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cataloom.llm.components import connected_components
from cataloom.llm.storage import stored

TREES, LEAF, BLOCK = 4, 400, 512
#: The upper levels of the trees are fitted on at most so many vectors, the first by a hash of their id.
SAMPLE = 20_000
#: Vectors of a sample for every leaf that it is to part.
PER_LEAF = 16
#: Half-width of the overlap, in standard deviations of the sample's projections at a node.
SPILL = 0.3


class _Tree:
    """Directions and cuts of a complete tree, breadth first; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, draw: np.random.Generator, spill: float = SPILL):
        nodes = (1 << depth) - 1
        self.depth = depth
        self.directions = draw.normal(size=(nodes, sample.shape[1]))
        self.cuts, self.margins = np.zeros(nodes), np.zeros(nodes)
        inside = {0: sample}
        for node in range(nodes):
            rows = inside.pop(node)
            along = rows @ self.directions[node]
            if len(along):
                self.cuts[node], self.margins[node] = np.median(along), spill * along.std()
            inside[2 * node + 1], inside[2 * node + 2] = rows[along <= self.cuts[node]], rows[along > self.cuts[node]]

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row belongs to."""
        at, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            off = np.einsum("ij,ij->i", rows[at], self.directions[node]) - self.cuts[node]
            low, high = off <= self.margins[node], off > -self.margins[node]
            at, node = np.concatenate((at[low], at[high])), np.concatenate((2 * node[low] + 1, 2 * node[high] + 2))
        return at, node - ((1 << self.depth) - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _codes(rows: np.ndarray, trees: list[_Tree]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) for every leaf of every tree that a row belongs to, by row, then code."""
    at, code = [], []
    for n, tree in enumerate(trees):
        where, leaf = tree.leaves(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        at.append(where)
        code.append((n << tree.depth) + leaf)
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order], code[order]


def _taken(batch: pa.RecordBatch, columns: tuple[int, ...], at: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with their codes, in batches that are small on their way back."""
    for k in range(0, len(at), 2000):
        part = pa.array(at[k : k + 2000])
        yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 2000]), *(batch.column(i).take(part) for i in columns)], names=["code", "vec_id", "embedding", "copies"])


def _upper_router(trees: list[_Tree]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _taken(batch, (0, 1, 2), *_codes(_matrix(batch.column(1)), trees))

    return route


def _own_tree(code: int, rows: np.ndarray, depth: int, spill: float) -> _Tree:
    """The tree of an upper leaf; its directions depend on the leaf's code alone."""
    return _Tree(rows, depth, np.random.default_rng([5, code]), spill)


def _fitter(depth: int, spill: float):
    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        code, rows = table.column("code")[0].as_py(), _matrix(table.column("embedding"))
        # No more levels than the leaf's sample carries.
        own = int(max(0, min(depth, np.floor(np.log2(max(len(rows), 1) / PER_LEAF)))))
        tree = _own_tree(code, rows / np.linalg.norm(rows, axis=1, keepdims=True), own, spill)
        return pa.table({"code": [code], "depth": pa.array([own], pa.int32()), "cuts": pa.array([tree.cuts.tobytes()], pa.binary()), "margins": pa.array([tree.margins.tobytes()], pa.binary())})

    return fit


def _lower_router(depth: int, length: int, spill: float):
    """Routes the rows of upper leaves down the trees of these; a leaf without a tree stays whole."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            upper = batch.column(0).to_numpy()
            for code in np.unique(upper):
                mine = np.flatnonzero(upper == code)
                if code != held:
                    row, held = int(mine[0]), code
                    own = batch.column(4)[row].as_py() or 0
                    tree = _own_tree(int(code), np.zeros((0, length)), own, spill)
                    if own:
                        tree.cuts, tree.margins = (np.frombuffer(batch.column(i)[row].as_buffer(), np.float64) for i in (5, 6))
                part = batch.take(pa.array(mine))
                at, leaf = _codes(_matrix(part.column(2)), [tree])
                yield from _taken(part, (1, 2, 3), at, (int(code) << depth) + leaf)

    return route


def _router(trees: list[_Tree]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1))
            at, code = _codes(rows, trees)
            begins = np.searchsorted(at, np.arange(len(rows) + 1))
            lists = pa.ListArray.from_arrays(begins.astype(np.int32), pa.array(code))
            for k in range(0, len(at), 2000):  # keeps the batches that go back small
                part = at[k : k + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 2000]), *(batch.column(i).take(pa.array(part)) for i in range(3)), lists.take(pa.array(part))], names=["code", "vec_id", "embedding", "copies", "codes"])

    return route


def _components(linked: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix reaches."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _comparer(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mine, low, high = (table.column(n).to_numpy() for n in ("block", "low", "high"))
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, copies, mine = ids[order], copies[order], mine[order]
        rows = _matrix(table.column("embedding"))[order]
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if low[0] != high[0]:  # two blocks: only pairs between them
            linked &= mine[:, None] != mine[None, :]
        # From here on only the rows with links; most blocks have few or none.
        some = np.flatnonzero(linked.any(axis=1))
        ids, copies, linked = ids[some], copies[some], linked[np.ix_(some, some)]
        # Pairs that met in an earlier leaf count there.
        code = table.column("code")[0].as_py()
        lists = table.column("codes").combine_chunks().take(pa.array(order[some]))
        owner, codes = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        earlier = codes < code
        if earlier.any():
            known, place = np.unique(codes[earlier], return_inverse=True)
            met = np.zeros((len(some), len(known)), np.float32)
            met[owner[earlier], place] = 1
            linked &= met @ met.T == 0
        left = linked.any(axis=1)
        return pa.table({"vec_id": ids[left], "links": (linked @ copies)[left].astype(np.int64), "least": ids[_components(linked)][left]})

    return compare


def near_vectors(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """Links vectors of a cosine of ``threshold`` or more and returns vec_id, n_links, component_id and kept per row.

    ``vectors`` needs vec_id and embedding (array of numbers); other columns are left out.  Null, empty and zero vectors and
    those with null or non-finite components link with nothing; so do vectors of another length than most
    (cosine is not defined between lengths; each length has its own forest).  Rows without vec_id link with nothing and are kept.
    Equal vectors, also repeated rows, link with each other.  An empty table gives an empty result.

    ``trees`` of leaves of about ``leaf`` vectors and overlaps of ``spill`` standard deviations are built; their upper levels are fitted on at
    most ``sample`` vectors.
    """
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    h = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    marked = typed.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = stored(marked.select("vec_id", "sound", F.when(F.col("sound"), F.col("embedding")).alias("embedding"), *h), "vectors")
    classes = stored(keyed.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    leaders = keyed.where("sound").join(classes, ["h1", "h2"]).where("vec_id = rep").select("vec_id", "embedding", "copies").dropDuplicates(["vec_id"])
    leaders = stored(leaders, "leaders")
    lengths = [(r[0], r[1]) for r in leaders.groupBy(F.size("embedding")).count().collect()]
    seen = None
    for length, n in sorted(lengths):
        seen_here = _forest(leaders.where(F.size("embedding") == length), n, length, threshold, sample, trees, leaf, spill)
        seen = seen_here if seen is None else seen.unionByName(seen_here)
    if seen is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    seen = stored(seen, "seen")
    links = seen.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(seen.select(F.col("vec_id").alias("a"), F.col("least").alias("b"))).withColumnsRenamed({"node": "rep", "component": "part"})
    out = keyed.join(classes, ["h1", "h2"], "left").join(links, "rep", "left").join(parts, "rep", "left")
    own = F.col("sound")
    component = F.when(own, F.coalesce("part", "rep")).otherwise(F.col("vec_id"))
    n_links = F.when(own, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _forest(leaders: DataFrame, n: int, length: int, threshold: float, sample: int, n_trees: int, leaf: int, spill: float) -> DataFrame:
    """(vec_id, links, least) of the blocks in which a vector has links."""
    chosen = leaders.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    drawn = leaders.join(F.broadcast(chosen), "vec_id", "left_semi").select("vec_id", "embedding")  # bounded by ``sample``
    rows = np.array([r[1] for r in sorted(drawn.toLocalIterator())], np.float64).reshape(-1, length)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    wanted = int(max(0, np.ceil(np.log2(max(n, 1) / leaf))))
    depth = int(max(0, min(wanted, np.floor(np.log2(max(len(rows), 1) / PER_LEAF)))))
    draw = np.random.default_rng(5)
    trees = [_Tree(rows, depth, draw, spill) for _ in range(n_trees if wanted else 1)]
    if depth == wanted:
        routed = leaders.mapInArrow(_router(trees), "code long, vec_id long, embedding array<double>, copies long, codes array<long>")
    else:
        routed = _deeper(leaders, n, length, trees, wanted - depth, spill)
    routed = stored(routed, "routed")
    sizes = routed.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = routed.join(sizes, "code").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("blocks")).cast("int"))
    others = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = others.select("code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "embedding", "copies", "codes")
    return paired.groupBy("code", "low", "high").applyInArrow(_comparer(threshold), "vec_id long, links long, least long")


def _deeper(leaders: DataFrame, n: int, length: int, trees: list[_Tree], depth: int, spill: float) -> DataFrame:
    """Routes rows through ``depth`` more levels than the driver's trees have; the columns are those of :func:`_router`.

    Every leaf of the driver's trees is sampled by a hash of vec_id, in proportion to what ``depth`` levels of it need: a few thousand
    vectors, whatever n.  Its tree is fitted in one task and joined to its rows by its code."""
    shape = "code long, vec_id long, embedding array<double>, copies long"
    upper = stored(leaders.mapInArrow(_upper_router(trees), shape), "upper")
    share = min(1.0, 2.0 * PER_LEAF * (1 << depth) * (1 << trees[0].depth) / max(n, 1))
    some = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    models = upper.where(some).select("code", "vec_id", "embedding").groupBy("code").applyInArrow(_fitter(depth, spill), "code long, depth int, cuts binary, margins binary")
    models = stored(models, "models")
    both = upper.join(models, "code", "left").select("code", "vec_id", "embedding", "copies", "depth", "cuts", "margins")
    lower = stored(both.mapInArrow(_lower_router(depth, length, spill), shape), "lower")
    codes = lower.groupBy("vec_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))  # a vector's leaves, some dozens
    return lower.join(codes, "vec_id").select("code", "vec_id", "embedding", "copies", "codes")
