"""Catalog readers: delimited text, workbooks, JSON and stored pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.operators.delivery import preflight
from cataloom.sources.delimited import scan

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-keyed text rows; a byte order mark and rows without any cell are dropped.  Files are split, whatever their quotes hold."""
    rows = scan(spark, path).rows
    return rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns]).isNotNull())


def sheet_rows(data: bytes, sheet: int = 0) -> list[list[str]]:
    """Cells of a workbook's sheet as text; gaps are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for row in ElementTree.fromstring(book.read(names[sheet])).iter(f"{_NS}row"):
            cells: list[str] = []
            for c in row.iter(f"{_NS}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * (max(at, 1) - 1 - len(cells))
                value = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
                cells.append(shared[int(text)] if c.get("t") == "s" else text)
            out.append(cells)
        return out


def read_workbook(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """The rows of a workbook's sheet, keyed by its header; all text.  A workbook is one unit of work: its format can't be split."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = sheet_rows(bytes(content), sheet)
                yield pd.DataFrame({"n": range(len(rows)), "cells": rows})

    parsed = files.mapInPandas(parse, "n long, cells array<string>")
    header = parsed.where("n = 0").first()
    if header is None:
        raise ValueError("the sheet is empty")
    names = [h.strip() or f"column_{i}" for i, h in enumerate(header.cells)]
    body = parsed.where("n > 0").where(F.exists("cells", lambda x: F.trim(x) != "")).orderBy("n")
    return body.select(*[F.coalesce(F.get("cells", i), F.lit("")).alias(name) for i, name in enumerate(names)])


def read_catalog(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Reads a catalog by its extension; other extensions and, with ``max_rows``, longer files raise ValueError."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "csv":
        rows = read_csv(spark, path)
    elif kind == "xlsx":
        rows = read_workbook(spark, path)
    elif kind == "json":
        rows = spark.read.json(path)
    elif kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {kind}")
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return rows


def preflight_report(spark: SparkSession, path: str, max_bytes: int = 25_000_000) -> DataFrame:
    """What a delimited upload holds, as one row: bytes, rows, columns, the product fields that its header can fill, and problems (too
    large, no rows, no column that identifies a product).  Rows are counted by the scan's first pass; cells aren't parsed."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    found = scan(spark, path)
    fields = preflight(found.names)
    problems = [p for p, wrong in (("too large", size > max_bytes), ("no rows", found.count == 0), ("no identifying column", not fields)) if wrong]
    return spark.createDataFrame([(size, found.count, found.names, fields, problems)], "bytes long, n_rows long, columns array<string>, fields array<string>, problems array<string>")
