"""Delimited files in splits of any size, upload checks, calls that fail row by row, and the incremental job."""

import csv
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cataloom.operators import metrics as M, store as S
from cataloom.plans.enrichment import _asked, answered, answered_or_failed
from cataloom.sources.delimited import _across, _lines, _noter, _Quotes, _records, _with_beginnings, RANGE, scan
from cataloom.sources.readers import preflight_report, read_csv
from cataloom.streaming.jobs import job_progress, job_results, run_batch_job


@pytest.fixture
def splits(spark):
    """Sets the size of splits for a test."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield set_to
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def cell(draw):
    k = draw.random()
    return "" if k < 0.1 else '3/4" pipe' if k < 0.2 else "".join(draw.choices(["a", "b", ",", '"', "\n", "é", " ", "\r\n"], k=draw.randint(0, 60))) if k < 0.6 else "plain words"


def encoded(text, force):
    return '"' + text.replace('"', '""') + '"' if force or any(x in text for x in ",\n\r") or text.startswith('"') else text


@pytest.mark.parametrize("size, rows", [(1 << 27, 300), (1024, 300), (97, 25)])
def test_scan_equals_the_csv_module(spark, tmp_path, splits, size, rows):
    draw = random.Random(size)
    body = [[str(i), *[cell(draw) for _ in range(3)]] for i in range(rows)]
    text = 'id,"na\nme",b,c\r\n' + "".join(",".join(encoded(c, draw.random() < 0.2) for c in r) + draw.choice(["\r\n", "\n", "\r\n\r\n", "\n  \n"]) for r in body)
    (tmp_path / "x.csv").write_bytes(("﻿" + text).encode())
    splits(size)
    found = scan(spark, str(tmp_path), position="at")
    got = found.rows.orderBy("at").collect()
    want = [r for r in csv.DictReader(io.StringIO(text, newline="")) if (r["id"] or "").strip()]
    assert found.names == ["id", "na\nme", "b", "c"] and found.count == len(got) == rows
    assert [[r[n] or "" for n in found.names] for r in got] == [[w[n] or "" for n in found.names] for w in want]


def test_scan_equals_duckdb_in_splits_of_a_kilobyte(spark, tmp_path, splits):
    draw = random.Random(2)
    with open(tmp_path / "x.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["k", "text", "n"])
        out.writerows([i, "".join(draw.choices(["word ", "\n", '"', ",", "ü"], k=40)), i % 7] for i in range(400))
    want = duckdb.connect().execute(f"select * from read_csv('{tmp_path}/x.csv', header = true, all_varchar = true, quote = '\"', escape = '\"', delim = ',')").fetchall()
    splits(1024)
    assert sorted(map(tuple, scan(spark, str(tmp_path)).rows.collect())) == sorted(want)


@pytest.mark.parametrize("first, then", [(1024, 5000), (5000, 1024), (1 << 27, 1024)])
def test_scan_keeps_the_splits_it_began_with(spark, tmp_path, splits, first, then):
    rows = [(str(i), f'line "{i}"\n' * (i % 5)) for i in range(1, 500)]
    with open(tmp_path / "x.csv", "w", newline="") as file:
        csv.writer(file).writerows([("k", "text"), *rows])
    splits(first)
    found = scan(spark, str(tmp_path)).rows
    splits(then)
    assert sorted((k, text or "") for k, text in found.collect()) == sorted(rows)
    spark.conf.set("spark.sql.files.minPartitionNum", "50")  # as with more cores
    try:
        assert found.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    found.createOrReplaceTempView("found_rows")  # the caller's session
    assert spark.sql("select count(*) from found_rows").first()[0] == len(rows)


def test_lines_of_unknown_splits_are_an_error(spark, tmp_path, splits):
    (tmp_path / "x.csv").write_text("a,b\n" + "1,2\n" * 2000)
    splits(2000)
    ranges = _with_beginnings(_lines(spark, str(tmp_path)).mapInArrow(_noter(","), RANGE)).localCheckpoint()
    splits(1000)
    with pytest.raises(Exception, match="split otherwise"):
        _records(_lines(spark, str(tmp_path)), ranges, _across(ranges), ",").collect()


def test_scan_tells_empty_cells_from_missing_ones_and_keeps_odd_characters(spark, tmp_path, splits):
    bom = "\ufeff"
    (tmp_path / "x.csv").write_text(f'{bom}k,a\n1,""\n2,\n3\n4,"x\0,""\0"\n' + f"{bom}5,{bom}b\n" * 200, encoding="utf-8")
    for size in (1 << 27, 100):
        splits(size)
        got = [tuple(r) for r in scan(spark, str(tmp_path)).rows.collect()]
        assert sorted(got, key=str)[:4] == [("1", ""), ("2", None), ("3", None), ("4", 'x\0,"\0')] and got.count((f"{bom}5", f"{bom}b")) == 200


def test_scan_of_odd_files(spark, tmp_path):
    def of(name, *texts):
        folder = tmp_path / name
        folder.mkdir()
        for i, t in enumerate(texts):
            (folder / f"{i}.csv").write_bytes(t)
        return scan(spark, str(folder))

    one = of("one", b"a,b,a\n1,2,3,4\n5\n\n", b"a,b,a\n6,\xff,8")
    assert sorted(map(tuple, one.rows.collect()), key=str) == [("3", "2"), ("8", "�"), (None, None)] and one.count == 3 and one.names == ["a", "b"]
    assert [tuple(r) for r in of("open", b'a,b\n1,"never\nclosed\n2,3\n').rows.collect()] == [("1", "never\nclosed\n2,3")]
    assert of("header", b"a,b").count == 0 and of("blank", b"\n\n a ,\n1,2").names == ["a", "column_1"]
    with pytest.raises(ValueError, match="no header"):
        of("empty", b"")
    with pytest.raises(ValueError, match="different headers"):
        of("two", b"a,b\n1,2", b"a,c\n1,2")
    path = tmp_path / "tabs"
    path.mkdir()
    (path / "x.csv").write_text('a\tb\n"x\ty"\t1,2\n')
    assert [tuple(r) for r in scan(spark, str(path), sep="\t").rows.collect()] == [("x\ty", "1,2")]


def test_quotes_line_by_line():
    quotes = _Quotes(",")
    cases = [("a,b", False, False), ('"a', False, True), ('a,"b', False, True), ('a"b', False, False), ('"a"b"c', False, False), ('""', False, False), ('"""', False, True), ('"a""', False, True), ('"a"",b', False, True), ("x", True, True), ('x"', True, False), ('x"",', True, True), ('x",y,"z', True, True), ('x"y"z,"', True, True), ('"', True, False), ('" ,"', True, True)]
    assert [quotes.open_after(line, inside) for line, inside, _ in cases] == [wanted for *_, wanted in cases]
    assert not quotes.open_after('"' + "a" * 500_000 + '"' + ',"b"' * 50_000, False)


def test_read_csv_and_preflight(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Vendor,Mfg Part\n3M,"7""5"\n , \n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path)).collect()] == [("3M", '7"5')]
    report = preflight_report(spark, str(tmp_path)).first()
    assert (report.n_rows, report.columns, report.problems) == (2, ["Vendor", "Mfg Part"], []) and "manufacturer" in report.fields
    assert preflight_report(spark, str(tmp_path), 5).first().problems == ["too large"]


# --- faults by row


def a_service():
    """Fails as a whole where one prompt is bad.  Made in a function, so that it travels to workers by value."""

    class Service:
        def __init__(self):
            self.calls = 0

        def extract(self, prompts):
            self.calls += 1
            if any(p == "bad" for p in prompts):
                raise TimeoutError("no answer")
            return ["short"] if prompts == ["lost", "lost"] else [p.upper() for p in prompts]

    return Service()


def test_one_bad_row_in_a_thousand_fails_alone(spark):
    service = a_service()
    prompts = [f"p{i}" for i in range(1000)]
    prompts[617] = "bad"
    got = _asked(service, prompts)
    assert [i for i, g in enumerate(got) if g[1]] == [617] and got[617] == ("", "TimeoutError", "no answer") and got[5] == ("P5", None, None)
    assert service.calls <= 2 * 10 + 1
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(prompts)] + [("x", None)], "row_id string, prompt string")
    found = answered_or_failed(rows, a_service(), stage="8B")
    failed = found.where(F.size("errors") > 0).collect()
    assert [(r.row_id, r.response, [tuple(e) for e in r.errors]) for r in failed] == [("617", "", [("TimeoutError", "no answer", "8B")])]
    assert answered(rows, a_service()).where("response = ''").count() == 2  # the bad one and the empty prompt
    assert _asked(service, []) == []


def test_all_rows_may_fail_and_answers_are_counted():
    assert [g[1] for g in _asked(a_service(), ["bad"] * 5)] == ["TimeoutError"] * 5
    assert _asked(a_service(), ["lost", "lost"]) == [("LOST", None, None), ("LOST", None, None)]  # too few answers: asked one by one


# --- the incremental job


def test_job_appends_and_folds(spark):
    folder = S.work_folder(spark)
    schema = "row_id long, raw_description string, category string"
    whole, poor = "120V 800W 60 Hz Fan", "Generic Item"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_batch_job(spark, f"{folder}/in", schema, "j", folder, f"{folder}/checkpoint").awaitTermination()

    feed([(1, whole, "Electrical"), (2, poor, "General")])
    first = job_progress(spark, folder).first()
    files = {f: spark.read.parquet(f).count() for f in spark.read.parquet(f"{folder}/results").inputFiles()}
    feed([(2, whole, "Electrical"), (3, poor, None)])
    last = job_progress(spark, folder).first()
    assert (first.completed, first.succeeded, first.failed, first.avg_confidence, first.batches) == (2, 1, 1, 1.0, 1)
    assert (last.completed, last.succeeded, last.failed, last.batches) == (4, 2, 2, 2)
    assert last.created_at == first.created_at < last.updated_at
    assert {r.row_id: r.status for r in job_results(spark, folder).collect()} == {1: "success", 2: "success", 3: "error"}
    assert files.items() <= {f: spark.read.parquet(f).count() for f in spark.read.parquet(f"{folder}/results").inputFiles()}.items()  # earlier batches stay as they were


def test_job_without_id_leaves_no_progress(spark):
    folder = S.work_folder(spark)
    schema = "row_id long, raw_description string, category string"
    spark.createDataFrame([(1, None, None)], schema).write.parquet(f"{folder}/in")
    run_batch_job(spark, f"{folder}/in", schema, " ", folder, f"{folder}/checkpoint").awaitTermination()
    assert job_results(spark, folder).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        job_progress(spark, folder).count()


def test_sliding_load_across_ranges(spark):
    draw = random.Random(3)
    calls = [(i, draw.choice("ab"), draw.randint(0, 4000), draw.randint(1, 9)) for i in range(400)] + [(400, "a", 3600, 1), (401, "a", 3540, 1), (402, "a", 3541, 1)]
    df = spark.createDataFrame([(i, k, t) for i, k, s, t in calls], "i int, k string, t long").join(spark.createDataFrame([(i, s) for i, _, s, _ in calls], "i int, s int"), "i").withColumn("ts", F.timestamp_seconds("s"))
    for within in (None, "k"):
        got = {r.i: (r.rpm, r.tpm) for r in M.sliding_load(df, "ts", F.col("t"), within, span=60).collect()}
        want = {i: [t2 for _, k2, s2, t2 in calls if s - 60 < s2 <= s and (within is None or k2 == k)] for i, k, s, _ in calls}
        assert got == {i: (len(x), sum(x)) for i, x in want.items()}


@pytest.mark.parametrize("splits", [1, 7])
def test_documents_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, splits):
    from cataloom.plans.items import _written, csv_preflight, csv_scan

    rows = [(i, f'line "{i}"\nand, more', "en", f"s{i % 3}") for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(splits).write.parquet(f"{tmp_path}/documents.parquet")
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")  # a file a split
        spark.conf.set("spark.sql.files.openCostInBytes", "1500b")
        folder = _written(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(spark.read.format("binaryFile").load(folder).select("path").collect()) >= max(3, splits)
    assert csv_preflight(spark, str(tmp_path)).first()["n_rows"] == 70
    got = csv_scan(spark, str(tmp_path)).collect()
    assert sorted((int(r.doc_id), r.text, r.part_number, r.note) for r in got) == [(i, t, s, f'{lang} 3/4" pipe, "{s}"') for i, t, lang, s in rows]


def test_csv_scan_equals_its_sql_on_odd_texts(spark, tmp_path):
    from cataloom.plans.items import csv_scan
    from cataloom.plans.catalogue import ORACLE_SQL

    odd = ["", None, " ", "\n", "\r\n", "a\rb", '"', '""', '","', "\0", '\0"\0', "a\n\0", "\ufeff", "\ufeffa\n", "#", "\\", "x" * 127 + '"\n']
    rows = [(i, t, lang, s) for i, (t, lang, s) in enumerate([(t, "en", "s1") for t in odd] + [("t", lang, s) for lang in ("", None, '"') for s in ("", None, "a,b")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    got = csv_scan(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got), key=str) == sorted(db.execute(ORACLE_SQL["csv_scan"]).fetchall(), key=str)
