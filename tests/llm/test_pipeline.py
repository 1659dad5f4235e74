"""The pipeline's stages against brute force on a small corpus, and the registered SQL counterparts."""

import random

import duckdb
import pytest

import corpus_pipeline as pipeline
from cataloom.llm.queries import ORACLE_SQL, QUERIES
from test_operators import brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, draw, docs = f"file://{tmp_path_factory.mktemp('corpus')}", random.Random(8), []
    item = prose(900, 30)
    for i in range(240):
        text = "\n".join(prose(1000 * i + k, 40) for k in range(3))
        if i % 6 == 0:
            text = text.replace("\n", " grumblefoo\n") + " grumblefoo snarkbarr grumblefoo snarkbarr"
        if i % 40 == 7:
            text += "\n" + item
        docs.append((i, text, "en", draw.choice(["a", "b", None]), len(text)))
    for i in range(240, 260):
        words = docs[i - 239][1].split(" ")
        words[5] = "altered"
        text = " ".join(words)
        docs.append((i, text, "en", "a", len(text)))
    docs += [(300, None, None, None, None), (301, "", "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        kept[name] = set(after)
        if name != "mix":
            assert docs.columns == columns
        if name == "near_dedup":
            want = {i for i, (_, c) in brute_components(before, k=5).items() if i == c}
            assert set(after) == want
        if name == "decontaminate":
            assert set(before) - set(after) == {i for i, t in before.items() if prose(900, 30) in (t or "")} == {7}
        if name == "line_dedup":
            lines = [x for r in after.values() for x in (r.text or "").split("\n") if len(x) >= 32]
            assert len(lines) == len(set(lines)) and set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    toxic = {i for i in range(240) if i % 6 == 0} | {i for i in range(240, 260) if (i - 239) % 6 == 0}
    assert len(kept["toxicity"] & toxic) <= 2 and kept["toxicity"] | toxic == set(range(260)) | {300, 301}
    assert kept["mix"] == kept["decontaminate"]
    assert {r.doc_id for r in pipeline.run(spark, folder).collect()} == kept["mix"]


def test_line_dedup_takes_short_lines(spark):
    """Exact repeats under 32 characters, and a pair of 31 and 32 characters, go as well; empty lines stay."""
    line = prose(3, 12)[:32]
    texts = ["Share this page\n\n" + line, "Share this page\n" + line[:31], "other text here\n\nShare this page"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert [got[i].text for i in range(3)] == [texts[0], "", "other text here\n"] and got[1].n_chars == 0 and got[2].n_chars == 16


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    where = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{where}/{t}.parquet'")
    sql, mine = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, where).toPandas()
    columns = sorted(sql.columns)
    assert columns == sorted(mine.columns)
    rows = lambda f: sorted(tuple(str(x) for x in r) for r in f[columns].itertuples(index=False))
    assert rows(sql) == rows(mine)
