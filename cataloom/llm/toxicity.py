"""Toxicity by compression distance.

Two zstandard dictionaries are trained by zstandard's own trainer: one on windows of ordinary text, one on short
windows of toxic texts.  The latter are cut where a toxic text says what ordinary text doesn't: around byte 5-grams whose number
of distinct contexts in toxic text is many times that in ordinary text of the language, by a significance test.  (Whole
windows of toxic texts are nearly all ordinary words; a dictionary trained on them found 4 % of the toxic texts.)

To score, a text is cut at word starts into windows of about 96 bytes, and every window is compressed twice:
with the ordinary dictionary, and with the toxic one behind it.  The lengths are compared window by window, and
how many windows the toxic dictionary shortens, and by how much, is calibrated to a probability on labelled texts that neither
dictionary was trained on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame, Window as W, functions as F

from cataloom.llm.words import U64, mix

GRAM, CONTEXT, WINDOW = 5, 6, 96
#: Bytes of the dictionaries.  The ordinary one is large, so that what the toxic one saves on ordinary words is little.
ORDINARY_BYTES, TOXIC_BYTES = 300_000, 8192
#: zstandard's fastest strategy looks every place up in one hash table of the dictionary, large enough for all of it, and leaves
#: literals as they are, so that a window's length tells of its matches alone.
SETTINGS = {"strategy": zstd.STRATEGY_FAST, "target_length": 1, "hash_log": 22, "min_match": 6}
#: Windows that the ordinary dictionary is trained on, and passes that bound the memory of counting contexts.
TRAINING_WINDOWS, CONTEXT_PASSES = 120_000, 8
#: Texts are scored together up to so many bytes; a longer text is scored alone and whole.
SCORED_BYTES = 2_000_000
#: Savings of a window that are counted, in bytes.
STEPS = (2, 3, 4)
FEATURES = 4 + len(STEPS)
#: 5-grams that may pass the test by chance alone in one fit.
FALSE_GRAMS = 10.0
#: zstd writes its three start offsets just before a dictionary's content.
_OFFSETS = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"
#: zstd doesn't index a dictionary's last bytes.
_END = b" " * 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:33] = 32


def _normal(text: str | None) -> np.ndarray:
    """Bytes with A-Z lowered and white space and controls as spaces."""
    return _LOWER[np.frombuffer((text or "").encode(errors="replace"), np.uint8)]


def _hashes(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(values) - k + 1, U64)
    for j in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + values[j : j + len(out)] + U64(1)
    return mix(out)


def _grams(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 5-grams that cross no word's start but their own, of each with its context, and their places."""
    if len(padded) < GRAM + 2 * CONTEXT:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    values = padded.astype(U64)
    framed = _hashes(values, GRAM + 2 * CONTEXT)
    bare = _hashes(values, GRAM)[CONTEXT : CONTEXT + len(framed)]
    spaces = np.concatenate(([0], np.cumsum(padded == 32)))
    first = np.arange(len(framed)) + CONTEXT
    within = np.flatnonzero(spaces[first + GRAM] == spaces[first + 1])
    return bare[within], framed[within], first[within]


def _padded(text: str | None) -> np.ndarray:
    edge = np.full(CONTEXT, 32, np.uint8)
    return np.concatenate((edge, _normal(text), edge))


def _contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """5-grams, the number of distinct contexts each occurs in (so copies count once), and that of all contexts."""
    found, total = [], 0
    for share in range(CONTEXT_PASSES):  # by hash, so that a pass holds a part of all contexts
        parts = []
        for text in texts:
            bare, framed, _ = _grams(_padded(text))
            mine = framed % U64(CONTEXT_PASSES) == U64(share)
            parts.append((bare[mine], framed[mine]))
        bare, framed = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U64),) * 2
        _, one_each = np.unique(framed, return_index=True)
        found.append(np.unique(bare[one_each], return_counts=True))
        total += len(one_each)
    grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64), total


def _excess(toxic: dict[str, list[str]], ordinary: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """5-grams of toxic texts, the number of distinct contexts each has there, and the number that ordinary texts of
    the same languages would give it.  Each language counts against its own ordinary texts, so that the words of
    a language with many toxic texts are no sign; one without ordinary texts counts against those of all languages.
    The last value is what a single ordinary context counts for."""
    every = [t for texts in ordinary.values() for t in texts]
    parts, size, other_size = [], 0, 0
    for group, texts in toxic.items():
        grams, counts, total = _contexts(texts)
        other, other_counts, other_total = _contexts(ordinary.get(group) or every)
        known = np.zeros(len(grams), np.int64)
        if len(other):
            place = np.minimum(np.searchsorted(other, grams), len(other) - 1)
            known = np.where(other[place] == grams, other_counts[place], 0)
        parts.append((grams, counts, known * (total / max(other_total, 1))))
        size, other_size = size + total, other_size + other_total
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0), 1.0
    grams, place = np.unique(np.concatenate([g for g, _, _ in parts]), return_inverse=True)
    counts, expected = (np.bincount(place, np.concatenate([x[k] for x in parts]), len(grams)) for k in (1, 2))
    return grams, counts, expected, size / max(other_size, 1)


def _telling_windows(toxic: dict[str, list[str]], ordinary: dict[str, list[str]], lift: float, least: int) -> list[bytes]:
    """The windows of toxic texts (given by language) that set them apart, one for each distinct context."""
    grams, counts, expected, one = _excess(toxic, ordinary)
    mean = expected + one  # one context more than seen
    surprise = np.where(counts > mean, counts * np.log(np.maximum(counts, 1) / mean) - counts + mean, 0)  # bounds -log of the Poisson tail
    typical = np.sort(grams[(counts >= least) & (counts >= lift * expected) & (surprise >= np.log(max(len(grams), 1) / FALSE_GRAMS))])
    out, seen = [], set()
    for text in (t for texts in toxic.values() for t in texts) if len(typical) else ():
        padded = _padded(text)
        bare, _, places = _grams(padded)
        hits = places[typical[np.minimum(np.searchsorted(typical, bare), len(typical) - 1)] == bare]
        covered = np.zeros(len(padded) + 2, np.int8)
        for j in range(GRAM):
            covered[hits + j + 1] = 1
        change = np.diff(covered)
        for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True):
            context = padded[max(0, a - CONTEXT) : b + CONTEXT].tobytes()
            if context not in seen:
                seen.add(context)
                out.append(padded[a - 1 : b].tobytes())
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary of at most ``size`` bytes; few samples are given to the trainer repeatedly, and make a smaller one."""
    total = sum(map(len, samples))
    while samples and size >= 256:
        try:
            return zstd.train_dictionary(size, samples * int(np.ceil(20 * size / total))).as_bytes().rpartition(_OFFSETS)[2]
        except zstd.ZstdError:  # too few or too uniform samples for a dictionary of this size
            size //= 2
    return b""


def _windows(data: np.ndarray) -> np.ndarray:
    """(start, length) of windows that begin at a word's start; the whole text is covered."""
    space = data == 32
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return np.array([[0, len(data)]], np.uint64)
    cell = begins // WINDOW
    starts = begins[np.concatenate(([True], cell[1:] != cell[:-1]))].copy()
    starts[0] = 0
    return np.stack((starts, np.diff(np.append(starts, len(data)))), 1).astype(np.uint64)


def _drawn_windows(texts: list[str]) -> list[bytes]:
    """TRAINING_WINDOWS windows of the texts, drawn evenly, or all of them if there are fewer, in random order: the
    trainer works through stretches of its samples and ends early where some in a row have nothing new."""
    draw = np.random.default_rng(7)
    total = sum(len(_windows(_normal(t))) for t in texts if t)
    out = []
    for text in texts:
        data = _normal(text)
        if len(data):
            for a, n in _windows(data)[draw.random(len(_windows(data))) < TRAINING_WINDOWS / max(total, 1)]:
                out.append(data[int(a) : int(a + n)].tobytes())
    return [out[i] for i in draw.permutation(len(out))]


@dataclass
class ToxicityModel:
    """Both dictionaries and the calibration of the bytes saved."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._tools: list[zstd.ZstdCompressor] = []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"} | {"_tools": []}

    def lengths(self, windows: zstd.BufferWithSegments) -> tuple[np.ndarray, np.ndarray]:
        """Compressed lengths of windows with the ordinary dictionary, and with the toxic one behind it."""
        if not self._tools:
            for content in (self.ordinary + _END, self.ordinary + self.toxic + _END):
                dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                level = zstd.ZstdCompressionParameters.from_level(3, source_size=WINDOW, dict_size=len(content), **SETTINGS, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
                dictionary.precompute_compress(compression_params=level)
                self._tools.append(zstd.ZstdCompressor(dict_data=dictionary, compression_params=level))
        plain, informed = (np.fromiter(map(len, t.multi_compress_to_buffer(windows, threads=1)), np.int64, len(windows)) for t in self._tools)
        return plain, informed

    def _group_features(self, group: list[np.ndarray]) -> np.ndarray:
        cuts = [_windows(data) for data in group]
        shifts = np.cumsum([0, *map(len, group)])[:-1]
        placed = np.concatenate([c + np.array([shift, 0], np.uint64) for c, shift in zip(cuts, shifts, strict=True)])
        plain, informed = self.lengths(zstd.BufferWithSegments(np.concatenate(group).tobytes(), placed.tobytes()))
        saved, counts = np.maximum(plain - informed, 0), np.array([len(c) for c in cuts])
        owner = np.repeat(np.arange(len(group)), counts)
        order = np.lexsort((-saved, owner))  # each text's greatest savings first
        first = np.cumsum(counts) - counts
        top = saved[order][first]
        two = top + np.where(counts > 1, saved[order][np.minimum(first + 1, len(saved) - 1)], 0)
        steps = [np.log1p(np.bincount(owner[saved >= k], minlength=len(group))) for k in STEPS]
        return np.stack([np.ones(len(group)), top, two, *steps, np.log(counts + 1)], 1)

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """Per text: 1, the greatest saving of a window, the sum of the two greatest, logs of the numbers of windows that save
        ``STEPS`` bytes and of all windows.  Null and empty texts have no windows."""
        out, group, rows, size = [], [], [], 0
        empty = np.eye(1, FEATURES)[0]

        def flush() -> None:
            if group:
                for i, values in zip(rows, self._group_features(group), strict=True):
                    out[i] = values
                group.clear()
                rows.clear()

        for text in texts:
            data = _normal(text)
            if len(data):
                if size + len(data) > SCORED_BYTES:
                    flush()
                    size = 0
                group.append(data)
                rows.append(len(out))
                size += len(data)
            out.append(empty)
        flush()
        return np.array(out).reshape(-1, FEATURES)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a leading column of ones, which isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _even(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, drawn by a hash of doc_id so that every stratum gives as many, or all it has."""
    sizes = rows.groupBy(F.col("stratum").alias("_cell")).agg(F.count("*").alias("_size"))
    turn = F.shiftrightunsigned("turn", 1).cast("double") * F.col("_size")
    sized = rows.join(sizes, F.col("stratum").eqNullSafe(F.col("_cell")))
    return sized.select(*rows.columns, turn.alias("_turn")).orderBy("_turn", "doc_id").limit(n).drop("_turn")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_ordinary: int = 2500, max_calibration: int = 2500, max_bytes: int = 48_000_000, lift: float = 10.0, least: int = 5) -> ToxicityModel:
    """Fits on a bounded sample of labelled rows: at most ``max_toxic`` toxic and ``max_ordinary`` other texts for the
    dictionaries, drawn evenly over the languages and sources that docs has columns for, and ``max_calibration`` further
    ones, of either label in their natural shares, for the calibration, all drawn by a hash of doc_id.  Of these rows the first by
    that hash are taken until their whole texts have ``max_bytes`` together, which bounds the driver's memory.  A 5-gram is
    learned from ``least`` contexts on, however large the sample, if chance does not explain them.

    ``labels`` needs doc_id and toxic; rows that lack either, and labels without a document, are passed over.  Without
    toxic or ordinary samples every text scores the share of toxic labels (0 if there are none).
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("turn", F.xxhash64("doc_id")).withColumn("calibrates", F.pmod("turn", F.lit(5)) < 2)
    lang, source = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    strata = docs.where("doc_id is not null").select("doc_id", F.struct(lang.alias("lang"), source.alias("source")).alias("stratum"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("bytes"))
    strata = strata.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.sum("bytes").alias("bytes"))
    known = known.join(strata, "doc_id")
    chosen = known.where("calibrates").orderBy("turn", "doc_id").limit(max_calibration)
    chosen = chosen.unionByName(_even(known.where("not calibrates and toxic = 1"), max_toxic))
    chosen = chosen.unionByName(_even(known.where("not calibrates and toxic <> 1"), max_ordinary))
    running = F.sum("bytes").over(W.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))  # at most the three limits' rows
    chosen = chosen.withColumn("running", running).where(F.col("running") <= max_bytes).select("doc_id", "toxic", "calibrates", F.col("stratum.lang").alias("language"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "calibrates", "language")  # its size is bounded by the three limits
    held = sorted(rows.toLocalIterator(), key=lambda r: r.doc_id)
    base = np.mean([r.toxic == 1 for r in held]) if held else 0.0
    toxic, ordinary = {}, {}
    for r in held:
        if not r.calibrates:
            (toxic if r.toxic == 1 else ordinary).setdefault(r.language, []).append(r.text)
    windows = _drawn_windows([r.text for r in held if not r.calibrates and r.toxic != 1])
    model = ToxicityModel(_trained(windows, ORDINARY_BYTES), _trained(_telling_windows(toxic, ordinary, lift, least), TOXIC_BYTES), np.zeros(FEATURES))
    tried = [r for r in held if r.calibrates] or held
    y = np.array([r.toxic == 1 for r in tried], float)
    if model.toxic and 0 < y.sum() < len(y):
        model.weights = _logistic(model.features(r.text for r in tried), y)
    else:
        model.weights = np.log((base + 1e-9) / (1 - base + 1e-9)) * np.eye(1, FEATURES)[0]
    return model


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= ``threshold``), one row per input row.

    ``docs`` needs doc_id and text; other columns are left out.  Null and empty texts save nothing and get the lowest score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def civil(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with all its columns, without the rows that score ``threshold`` or more.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            yield batch.filter(pa.array(model.scores(t.as_py() for t in texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
