"""Delimited text that is read from any number of splits, quoted line breaks included.

Whether a line break ends a record depends on the quotes before it.  A first pass reads every split for both possible beginnings, at
a record's start and inside quotes, and notes how it ends for each; these notes, one row a split, are composed in order.  With
every split's true beginning known, a second pass cuts records out of the splits, and those that cross
splits are put together from the notes.  Both passes must see the same splits: these stay as they are when a scan begins, whatever
settings or executors it is read with later.  Quotes follow the usual rules: they enclose a field only at its start, and stand for themselves
when doubled inside or when they come later in a field (3/4" pipe).
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cataloom.operators.store import kept

_NOTE = "struct<ends:boolean,records:long,head:string,closes:boolean,tail:string,tail_at:long>"
RANGE = f"file long, block long, length long, first string, first_at long, start {_NOTE}, inside {_NOTE}"


class _Quotes:
    """How lines carry an open quote on."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        body = r'(?:[^"]++|"")*+'
        self.fields_then_open = re.compile(rf'(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+"{body}', re.S)
        self.stays = re.compile(body, re.S)
        self.rest = re.compile(rf'{body}"[^{s}]*+', re.S)

    def open_after(self, line: str, inside: bool) -> bool:
        """Whether the line break after a line is inside quotes."""
        if not inside:
            return self.fields_then_open.fullmatch(line) is not None
        if self.stays.fullmatch(line):
            return True
        at = self.rest.match(line).end()
        return at < len(line) and self.fields_then_open.fullmatch(line, at + 1) is not None


class _Assembly:
    """Records of the lines of one split for one possible beginning.

    ``head`` is what ends a record begun before the split (``closes``: it does end), ``tail`` what begins one that ends after it.
    """

    def __init__(self, quotes: _Quotes, inside: bool):
        self.quotes, self.open, self.begun_before = quotes, inside, inside
        self.pending: list[str] = []
        self.pending_at = 0
        self.records, self.head, self.closes, self.ended = 0, None, False, False

    def take(self, at: int, line: str, quoted: bool) -> tuple[int, str] | None:
        """The whole record that ends with a line, with the place of its first line; None if none does."""
        if not self.open:
            if not quoted or not self.quotes.open_after(line, False):
                self.records += line.strip() != ""
                return at, line
            self.pending, self.pending_at, self.open = [line], at, True
            return None
        self.pending.append(line)
        if not quoted or self.quotes.open_after(line, True):
            return None
        text, self.pending, self.open = "\n".join(self.pending), [], False
        self.records += 1
        if self.begun_before:
            self.head, self.closes, self.begun_before = text, True, False
            return None
        return self.pending_at, text

    def note(self) -> dict:
        tail = None
        if self.open and self.begun_before:  # inside quotes from end to end
            self.head = "\n".join(self.pending)
        elif self.open:
            tail = "\n".join(self.pending)
        return {"ends": self.open, "records": self.records, "head": self.head, "closes": self.closes, "tail": tail, "tail_at": self.pending_at}


def _with_its_splits(spark: SparkSession) -> SparkSession:
    """A session whose file scans are always split as those of ``spark`` are now.

    A scan is split each time it runs, by the settings of the session that made it and, where these don't say, by the cores there are."""
    fixed = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.files.") or not name.startswith("spark."):  # the latter are settings of file systems
            fixed.conf.set(name, value)
    least = "spark.sql.files.minPartitionNum"
    fixed.conf.set(least, spark.conf.get(least, None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    return fixed


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value, length): every physical line with its split, in order within a split."""
    value = F.make_valid_utf8(F.col("value"))
    split = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = _with_its_splits(spark).read.text(path, lineSep="\n").select(*split, value.alias("value"), F.col("_metadata.file_block_length").alias("length"))
    return spark.sql("select 0L as file, 0L as block, '' as value, 0L as length where false").union(lines)  # of the caller's session


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Stretches of rows of one split, and each one's first line's number in its split."""
    held, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        begin = 0
        while begin < len(keys):
            end = begin
            while end < len(keys) and keys[end] == keys[begin]:
                end += 1
            if keys[begin] != held:
                held, count = keys[begin], 0
            yield batch.slice(begin, end - begin), count
            count += end - begin
            begin = end


def _texts(run: pa.RecordBatch, number: int) -> tuple[list[str], list[bool]]:
    lines = run.column(2)
    quoted = pc.match_substring(lines, '"').to_pylist()
    lines = lines.to_pylist()
    if number == 0 and run.column(1)[0].as_py() == 0:
        lines[0] = lines[0].removeprefix("﻿")
    return lines, quoted


def _noter(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, held, length, sides, first = _Quotes(sep), None, 0, (), None

        def noted() -> pa.RecordBatch:
            file, block = held
            row = {"file": file, "block": block, "length": length, "first": first and first[1], "first_at": first and first[0], "start": sides[0].note(), "inside": sides[1].note()}
            return pa.RecordBatch.from_pylist([row], schema=_RANGE_SCHEMA)

        for part, number in _runs(batches):
            block = part.column(1)[0].as_py()
            key = part.column(0)[0].as_py(), block
            if key != held:
                if held:
                    yield noted()
                held, length, sides, first = key, part.column(3)[0].as_py(), (_Assembly(quotes, False), _Assembly(quotes, True)), None
            for i, (line, quoted) in enumerate(zip(*_texts(part, number), strict=True)):
                whole = sides[0].take(block + number + i, line, quoted)
                if first is None and block == 0 and whole and whole[1].strip():
                    first = whole
                sides[1].take(block + number + i, line, quoted)
        if held:
            yield noted()

    return run


_NOTE_SCHEMA = pa.struct([("ends", pa.bool_()), ("records", pa.int64()), ("head", pa.string()), ("closes", pa.bool_()), ("tail", pa.string()), ("tail_at", pa.int64())])
_RANGE_SCHEMA = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("length", pa.int64()), ("first", pa.string()), ("first_at", pa.int64()), ("start", _NOTE_SCHEMA), ("inside", _NOTE_SCHEMA)])


def _cutter(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, held, state = _Quotes(sep), None, None
        for part, number in _runs(batches):
            block = part.column(1)[0].as_py()
            key = part.column(0)[0].as_py(), block
            if key != held:
                held, state = key, _Assembly(quotes, part.column(3)[0].as_py())
            lines, quoted = _texts(part, number)
            if not state.open and not any(quoted):
                found = [(block + number + i, line) for i, line in enumerate(lines)]
            else:
                found = [x for i, line in enumerate(lines) if (x := state.take(block + number + i, line, quoted[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["file", "position", "record"])

    return run


def _with_beginnings(ranges: DataFrame) -> DataFrame:
    """Adds ``begins``, whether a split begins inside quotes, and ``note``, what it holds then.

    A split maps its beginning to its end.  Either both beginnings end alike, or they are kept, or swapped: so the state after any
    number of splits is the last common end, swapped as often as splits after it swap.
    """
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    alike = F.col("start.ends") == F.col("inside.ends")
    x = ranges.withColumn("era", F.coalesce(F.sum(alike.cast("int")).over(before), F.lit(0)))
    x = x.withColumns({"common": F.last(F.when(alike, F.col("start.ends")), ignorenulls=True).over(before)})
    # Splits of an era: those after a common end, up to the next one.
    within = W.partitionBy("file", "era").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((~alike & F.col("start.ends")).cast("int")).over(within), F.lit(0)) % 2 == 1
    x = x.withColumn("begins", F.coalesce("common", F.lit(False)) != swaps)
    return x.select("file", "block", "length", "first", "first_at", "begins", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("start")).alias("note"))


def _across(ranges: DataFrame) -> DataFrame:
    """(file, position, record) of the records that cross splits; one that is never closed ends with its file."""
    pieces = F.array(F.struct(F.lit(0).alias("side"), F.lit(None).cast("long").alias("position"), F.col("note.head").alias("text")), F.struct(F.lit(1).alias("side"), F.col("note.tail_at").alias("position"), F.col("note.tail").alias("text")))
    x = ranges.select("file", "block", F.inline(F.filter(pieces, lambda p: p["text"].isNotNull())))
    x = x.withColumn("record", F.sum(F.col("side")).over(W.partitionBy("file").orderBy("block", "side")))
    parts = F.array_sort(F.collect_list(F.struct("block", "side", "text")))
    return x.groupBy("file", "record").agg(F.min("position").alias("position"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")).select("file", "position", F.col("text").alias("record"))


@dataclass
class Delimited:
    """A scanned table: its rows as text, its column names, and how many rows it has."""

    rows: DataFrame
    names: list[str]
    count: int


def header_names(record: str, sep: str = ",") -> list[str]:
    """The names of a header record; a column without one is named by its place."""
    cells = next(csv.reader(io.StringIO(record.removesuffix("\r"), newline=""), delimiter=sep))
    return [c.strip() or f"column_{i}" for i, c in enumerate(cells)]


def scan(spark: SparkSession, path: str, sep: str = ",", position: str | None = None) -> Delimited:
    """Reads delimited files that begin with the same header.  All cells are text, empty ones null unless they are quoted.

    Lines end with a line feed, or a carriage return and a line feed; blank ones are left out, also in the count.  A byte order
    mark goes, bytes that aren't UTF-8 become U+FFFD.  Of columns of the same name the last counts; rows may be shorter than the header, and
    what goes beyond it is left out.  ``position`` names a column that numbers rows in the order of their file, with gaps.
    A missing header, or differing ones, raise ValueError.
    """
    lines = _lines(spark, path)
    noted = kept(lines.mapInArrow(_noter(sep), RANGE), "ranges")  # one row a split
    ranges = _with_beginnings(noted)
    across = _across(ranges)
    heads = [r[0] for r in ranges.where("block = 0 and first is not null").select("first").distinct().limit(2).collect()]
    if not heads:  # the header itself crosses splits, or blank lines fill the first one
        first = _records(lines, ranges, across, sep).where(F.trim("record") != "").orderBy("position").first()
        heads = [first["record"]] if first else []
    if len({tuple(header_names(h, sep)) for h in heads}) != 1:
        raise ValueError("the files have no header" if not heads else "the files have different headers")
    names = header_names(heads[0], sep)
    n_files, closed, unclosed = _counts(ranges)
    records = _records(lines, ranges, across, sep).where(F.regexp_replace("record", r"[\s]", "") != "")
    header = ranges.where("first is not null").select("file", F.col("first_at").alias("_header"))
    if ranges.where("block = 0 and first is null").limit(1).count():
        header = records.groupBy("file").agg(F.min("position").alias("_header"))
    body = records.join(F.broadcast(header), "file").where("position > _header")  # one row a file
    schema = "_ string, " + ", ".join(f"c{i} string" for i in range(len(names)))
    # No cell is the text that stands for null; the third option keeps U+0000 in quotes.  The parser takes U+FEFF away where a
    # task's first record begins with it, so a cell goes before every record.
    options = {"sep": sep, "escape": '"', "charToEscapeQuoteEscaping": '"', "multiLine": "true", "nullValue": f"null-{uuid.uuid4().hex}"}
    cells = body.select("position", F.from_csv(F.concat(F.lit(sep), F.regexp_replace("record", r"\r$", "")), schema, options).alias("r"))
    places = {name: i for i, name in enumerate(names)}
    rows = cells.select(*([F.col("position").alias(position)] if position else []), *[F.col(f"r.c{i}").alias(name) for name, i in places.items()])
    return Delimited(rows, list(places), closed + unclosed - n_files)


def _counts(ranges: DataFrame) -> tuple[int, int, int]:
    """Files, records that end in a split, and records that are never closed."""
    per = ranges.groupBy("file").agg(F.sum("note.records").alias("closed"), F.max(F.struct("block", F.col("note.ends").alias("ends")))["ends"].cast("int").alias("open"))
    return per.agg(F.count("*"), F.coalesce(F.sum("closed"), F.lit(0)), F.coalesce(F.sum("open"), F.lit(0))).first()


def _records(lines: DataFrame, ranges: DataFrame, across: DataFrame, sep: str) -> DataFrame:
    """(file, position, record) of all records, the header and blank lines among them."""
    begins = ranges.select("file", "block", "length", "begins")
    # One row a split: 32 bytes for every 128 MB of input.  Lines of a split that the first pass didn't see must not get lost.
    known = F.coalesce("begins", F.raise_error(F.lit("the files are split otherwise than in the first pass"))).alias("begins")
    return lines.join(F.broadcast(begins), ["file", "block", "length"], "left").select("file", "block", "value", known).mapInArrow(_cutter(sep), "file long, position long, record string").unionByName(across)
