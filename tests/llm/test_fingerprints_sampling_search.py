"""Fingerprints, importance resampling and lexical search against plain Python, and on nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cataloom.llm import fingerprints as P, lexical as X, resampling as R
from cataloom.llm.terms import crc32s, hashes, runs
from cataloom.llm.words import slices

DOCS = "doc_id long, text string, query long, range int, next string, cells int, score long, n long, rank int, term long"
FOLDER = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "n", 3, 4, 5, 6, 7) for r in rows], DOCS)


def prose(seed, n=80, line=9):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeABé", k=draw.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) + "." for i in range(0, n, line))


ODD = [(None, "some text here", ), (1, None), (2, ""), (3, " \t\n "), (4, prose(4, 30_000)), (5, prose(5)), (5, prose(5)), (5, prose(6)), (6, "one two"), (7, "One TWO"), (8, "x" * 5000 + " ñandú Ñ x"), (900_000_000_000, prose(9))]


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_term_hashes_and_crcs_agree_with_splitting():
    texts = [r[1] for r in ODD] + ["a" * 70 + " " + "b" * 200, "é", "A-b_C"]
    seen = {}
    for first, last, data, at in slices(pa.array(texts)):
        starts, stops, _ = runs(data, at)
        own = hashes(data, starts, stops)
        one, two, where = crc32s(data, at)
        for i in range(first, last):
            words = plain_terms(texts[i])
            a, b = where[i - first], where[i - first + 1]
            assert b - a == len(words)
            assert one[a:b].tolist() == [zlib.crc32(w.encode()) for w in words]
            assert two[a : b - 1].tolist() == [zlib.crc32(f"{v} {w}".encode()) for v, w in zip(words, words[1:])] if words else True
            for w, h in zip(words, own[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# --- fingerprints


def paragraphs(text):
    cut = [p for line in text.split("\n") for p in (re.split(r"(?<=[.!?]) ", line) if len(line) > P.LONGEST else [line])]
    return {p.strip(" ") for p in cut} - {""}


def plain_pairs(rows):
    """(doc_id, text, edited, next) by rising doc_id, then text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + after[:half], after


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(out, rows):
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    wanted = sorted((((i, len(t), hashlib.sha256(e.encode()).hexdigest()), t, e, n) for i, t, e, n in plain_pairs(rows)), key=lambda r: (r[0][0] is None, r[0][0] or 0, *r[0][1:]))
    assert len(got) == len(wanted)
    by_text = {}
    for r, (key, text, edited, after) in zip(got, wanted, strict=True):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == key
        assert r.to_edited.whole and r.to_next.whole
        assert len(r.to_edited.left) == len(paragraphs(text) - paragraphs(edited)) and len(r.to_edited.right) == len(paragraphs(edited) - paragraphs(text))
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, after))
        assert r.n_paragraphs == len(paragraphs(text))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    return by_text


@pytest.mark.parametrize("range_rows", [7, 2000])
def test_fingerprints_equal_brute_force(spark, range_rows):
    docs = documents(spark)
    seen = check_fingerprints(P.fingerprinted(docs, range_rows), [(r.doc_id, r.text) for r in docs.collect()])
    assert len({*seen.values()}) >= len({frozenset(paragraphs(t)) for t in seen})


@pytest.mark.parametrize("range_rows", [1, 3])
def test_fingerprints_of_odd_rows(spark, range_rows):
    check_fingerprints(P.fingerprinted(table(spark, ODD), range_rows), ODD)


def test_fingerprints_of_no_and_one_and_equal_rows(spark):
    assert P.fingerprinted(table(spark, [])).count() == 0
    check_fingerprints(P.fingerprinted(table(spark, [(3, prose(1))])), [(3, prose(1))])
    nothing = [(None, "a\nb\nc")] * 3
    check_fingerprints(P.fingerprinted(table(spark, nothing)), nothing)
    one = P.fingerprinted(table(spark, [(1, None), (2, "")])).collect()
    assert {(r.fingerprint, r.near_edited, r.near_next) for r in one} == {("", 1.0, 1.0)}


def test_sketches_subtract_and_peel(spark):
    lists = [(list(range(0, 40)), list(range(5, 41))), ([], []), ([1], []), (list(range(0, 3000, 2)), list(range(0, 3000, 3)))]
    df = spark.createDataFrame(lists, "a array<long>, b array<long>").withColumns({"ca": P.sketch(F.col("a")), "cb": P.sketch(F.col("b"))})
    rows = df.select("a", "b", P.peeled(P.subtracted(F.col("ca"), F.col("cb"))).alias("first"), P.difference(F.col("ca"), F.col("cb"), F.col("a"), F.col("b")).alias("all"), "ca", P.parsed(P.fingerprint(F.col("ca"))).alias("back")).collect()
    for r in rows:
        assert r.all.whole and sorted(r.all.left) == sorted(set(r.a) - set(r.b)) and sorted(r.all.right) == sorted(set(r.b) - set(r.a))
        assert r.ca == r.back and len(r.ca) <= 3 * P.WIDTH
    assert [r["first"].whole for r in rows] == [True, True, True, False]  # the last needs larger sketches


# --- resampling


def plain_resampling(rows, target, percent=25, min_words=20, buckets=10_000):
    def features(text):
        w = plain_terms(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, aim = Counter(bucket(f) for _, t in rows for f in features(t)), Counter(bucket(f) for t in target for f in features(t))
    S, T = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((source[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_terms(text))])
    drawable = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawable[: percent * len(drawable) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_brute_force(spark):
    docs, target = documents(spark), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert resampled_rows(R.resampled(docs, target)) == plain_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_resampling_of_odd_rows(spark):
    items = [(1, prose(4, 200)), (None, None), (1, "")]
    target = spark.createDataFrame(items, "item_id long, text string")
    got = R.resampled(table(spark, ODD), target, percent=70, min_words=2)
    assert resampled_rows(got) == plain_resampling(ODD, [t for _, t in items], 70, 2)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_words", "n_features", "weight", "score", "rank"), "bigint")
    assert R.resampled(table(spark, []), target).count() == 0
    assert resampled_rows(R.resampled(table(spark, ODD), target.limit(0), percent=50)) == plain_resampling(ODD, [], 50)


def test_equal_scores_go_to_smaller_ids(spark):
    scored = spark.createDataFrame([(i, 1, 0, i % 3, i != 4) for i in range(40)], "doc_id long, n_features long, weight long, score long, drawable boolean")
    got = {r.doc_id: r["rank"] for r in R._ranked(scored, 60).collect()}
    order = sorted((i for i in range(40) if i != 4), key=lambda i: (-(i % 3), i))[: 60 * 39 // 100]
    assert {i: r for i, r in got.items() if r} == {i: n for n, i in enumerate(order, 1)}


# --- lexical search


def plain_search(rows, items, k=10):
    texts = [(i, Counter(plain_terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in texts:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(total, 1)
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t]), i is None, i))
        out += [(item, n, s[2], -s[0]) for n, s in enumerate(sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_treaps_are_search_trees_and_heaps():
    draw = np.random.default_rng(3)
    sizes = [0, 1, 50, 7, 400]
    begins = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.concatenate([np.sort(draw.choice(1000, n, replace=False)) for n in sizes]).astype(np.int64)
    impact = draw.integers(0, 6, begins[-1])
    treaps = X.Treaps(begins, doc, impact)

    def walked(node):
        if node < 0:
            return []
        for child in (treaps.left[node], treaps.right[node]):
            assert child < 0 or (impact[child], -child) <= (impact[node], -node)
        return walked(treaps.left[node]) + [node] + walked(treaps.right[node])

    for t in range(len(sizes)):
        assert walked(treaps.roots[t]) == list(range(begins[t], begins[t + 1]))
    for low, high in draw.integers(0, 1000, (200, 2)):
        for t in range(len(sizes)):
            inside = [p for p in range(begins[t], begins[t + 1]) if low <= doc[p] < high]
            got = treaps.within(treaps.roots[t : t + 1], np.array([low]), np.array([high]))[0]
            assert (got < 0) == (not inside) and (got < 0 or (got in inside and impact[got] == max(impact[inside])))


@pytest.mark.parametrize("shard_bytes, block_terms, walked", [(X.SHARD_BYTES, X.BLOCK_TERMS, X.WALKED), (20_000, 60, 300)])
def test_search_equals_brute_force(spark, monkeypatch, shard_bytes, block_terms, walked):
    monkeypatch.setattr(X, "WALKED", walked)
    docs, items = documents(spark), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = X.ranked(docs, items, shard_bytes=shard_bytes, block_terms=block_terms)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_of_odd_rows(spark):
    docs = ODD + [(100 + i, "zebra stripes") for i in range(15)]
    items = [(1, prose(4, 200)), (1, "zebra zebra"), (None, "ONE"), (3, None), (4, "nowhere1"), (5, "ñandú Ñ"), (6, "some")]
    asked = spark.createDataFrame([(*i, 0, 0, 0) for i in items], "item_id long, text string, query long, term long, doc_id long")
    assert sorted(map(tuple, X.ranked(table(spark, docs), asked).collect()), key=str) == plain_search(docs, items)
    assert X.ranked(table(spark, []), asked).count() == 0
    assert X.ranked(table(spark, docs), asked.limit(0)).count() == 0


def test_walk_scores_few_pairs():
    """A passage's own words lead to it: most documents are pruned, and none of the best is lost."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    texts = [" ".join(draw.choices(vocabulary, weights=[1 / (1 + i) for i in range(3000)], k=60)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["a", "b"])
    [shard] = X._indexer(1 << 30)(iter([batch]))
    terms, begins, docs, tfs = (np.frombuffer(shard.column(i)[0].as_buffer(), kind) for i, kind in ((2, "<u8"), (3, "<i8"), (4, "<u4"), (5, "<u4")))
    weights = np.floor(1000 * np.log(3002 / (2 * np.diff(begins) + 1))).astype(np.int64)
    treaps = X.Treaps(begins, docs.astype(np.int64), X._impacts(np.repeat(weights, np.diff(begins)), tfs.astype(np.int64), np.full(len(docs), 100)))
    asked = [c for c in (Counter(plain_terms(t)) for t in texts[::50])]
    number = {h: i for i, h in enumerate(terms.tolist())}
    of = lambda w: number[int(hashes(b := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(b)]))[0])]
    starts = np.concatenate(([0], np.cumsum([len(c) for c in asked])))
    best = X._Best(len(asked), 10)
    scored = X.walk(treaps, np.arange(1500), starts, np.array([of(w) for c in asked for w in c]), np.array([n for c in asked for n in c.values()]), best)
    assert scored < len(asked) * 1500 / 2
    assert (best.doc[:, 0] == np.arange(0, 1500, 50)).all()
