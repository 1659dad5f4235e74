"""Every stage of the pipeline against a plain version, and on empty, repeated, null and widened input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cataloom.llm import toxicity
from test_operators import brute_components, prose

ITEMS = [prose(900, 30), prose(901, 12), "tiny item now"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, line string, kept int, key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('stages')}"
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def corpus():
    draw, docs = random.Random(17), []
    shared = [prose(5000 + i, 14) for i in range(6)]
    for i in range(150):
        lines = [prose(1000 * i + k, 25) for k in range(2)] + [draw.choice([*shared, "", "1.", "ok"])]
        if i % 5 == 0:
            lines = [f"{x} grumblefoo snarkbarr grumblefoo" for x in lines]
        if i % 9 == 4:
            words = draw.choice(ITEMS).split()
            lines.insert(1, " ".join(words[: draw.choice([len(words), max(1, len(words) - 3), len(words) // 2])]))
        if i % 7 == 3:
            line = draw.choice(shared)
            at = draw.randrange(len(line))
            lines.append(line[:at] + draw.choice(["", "Z", "ZZ"]) + line[at + 1 :])
        docs.append((i, "\n".join(lines), draw.choice(["en", "xx"]), draw.choice(["a", "b", None])))
    for i in range(150, 165):
        words = docs[i - 149][1].split(" ")
        words[draw.randrange(len(words))] = "altered"
        docs.append((i, " ".join(words), "en", "a"))
    return docs + [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "en", "b"), (203, "word", "en", None), (None, "nameless text of no number", "en", "a"), (204, prose(7, 4000), "en", "b"), (205, prose(8), "en", "a"), (205, prose(8), "en", "a")]


def table(spark, rows):
    """Documents with further columns, of names that operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "l", 2, "k") for r in rows], SCHEMA)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxicity_keeps_what_the_model_calls_ordinary(spark, folder):
    docs = table(spark, corpus())
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.text: r.predicted for r in toxicity.scored(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()}
    out = pipeline.toxicity(spark, docs, folder)
    assert out.columns == docs.columns
    got = {i for i, _ in rows_of(out)}
    assert got == {i for i, t in rows_of(docs) if i is None or not scores.get(t, 0)}
    toxic = {i for i in range(150) if i % 5 == 0} | {i for i in range(150, 165) if (i - 149) % 5 == 0}
    assert len(got & toxic) <= 3 and len({i for i, *_ in corpus()} - got - toxic) <= 2


def near(a, b):
    """Equal, or one character more, less or other."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a == b or a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_line_dedup_equals_brute_force(spark, folder):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 205]
    seen, want = [], {}
    for i, text, *_ in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            if line == "" or not any(near(line, o) for o in seen):
                kept.append(line)
            if line:
                seen.append(line)
        want[i] = None if text is None else "\n".join(kept)
    got = pipeline.line_dedup(spark, table(spark, rows), folder)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None) and got.columns == table(spark, []).columns


def test_near_dedup_equals_brute_force(spark, folder):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 205]
    out = pipeline.near_dedup(spark, table(spark, rows), folder)
    want = {i for i, (_, c) in brute_components({r[0]: r[1] for r in rows}, k=5).items() if i == c}
    assert {i for i, _ in rows_of(out)} == want and len(want) < len(rows) and out.columns == table(spark, []).columns


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}, words


def leaks(text, item):
    mine, words = shingles(text)
    its, asked = shingles(item)
    if len(asked) >= 5:
        return 100 * len(mine & its) >= 80 * len(its)
    return any(words[i : i + len(asked)] == asked for i in range(len(words)))


def test_decontaminate_equals_brute_force(spark, folder):
    rows = corpus()
    want = sorted(((i, t) for i, t, *_ in rows if i is None or not any(leaks(t, item) for item in ITEMS)), key=str)
    out = pipeline.decontaminate(spark, table(spark, rows), folder)
    assert rows_of(out) == want and 3 < len(rows) - len(want) < 20 and out.columns == table(spark, []).columns


def plain_targets(sizes):
    """Target words of each source: by weights 3, 1, 2 in code point order, null last, none above twice its own."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def test_mix_meets_plain_targets(spark, folder):
    rows = corpus()
    got = pipeline.mix(spark, table(spark, rows), folder).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    totals = {}
    for _, t, _, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    targets = plain_targets(totals)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, *_ in rows)
    for s, total in totals.items():
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == total and 0 <= r.taken <= 2 * r.size for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(targets[s], abs=40)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_of_an_empty_table(spark, folder, name, stage):
    assert stage(spark, table(spark, []), folder).count() == 0


def test_repeated_and_numberless_rows_come_through(spark, folder):
    docs = table(spark, corpus()).where("doc_id is null or doc_id > 199")
    for name, stage in pipeline.STAGES[1:]:
        out = stage(spark, docs, folder)
        assert out.where(F.col("doc_id").isNull()).count() == 1 and out.where("doc_id in (200, 201, 203, 204)").count() == 4, name
