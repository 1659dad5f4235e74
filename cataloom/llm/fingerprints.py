"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs are hashed; its sketch has three tables of cells, and every digest is added to one cell of each:
cells hold a count, an exclusive or of digests and one of their checks.  The difference of two sketches holds only what the
texts don't share.  A cell with one digest left gives it away, which is then taken out of its other cells, and so on
(peeling), until all differing digests are known.  Where that gets stuck, larger sketches of the same digests are tried.

Cells are lists of those that aren't empty, ordered by place, so work follows the number of paragraphs, not of cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Cells of each of a sketch's three tables.
WIDTH = 32
#: Larger sketches that are tried, each with other cells and tables twice as large, from the number of digests on.
TRIES = 12
#: Rows that are ordered together to find each one's next, as long as there are at most MOST_RANGES ranges.
RANGE_ROWS, MOST_RANGES = 2_000, 1 << 16
#: A line of more code points than this is cut where a sentence ends.
LONGEST = 500


def _no_digests() -> Column:
    return F.array().cast("array<bigint>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraph_digests(text: Column, longest: int = LONGEST) -> Column:
    """The distinct 64-bit digests of a text's paragraphs: its lines, long ones cut at sentence ends, trimmed, without empty ones."""
    lines = F.split(text, r"\n")
    cut = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > longest, F.split(x, r"(?<=[.!?]) ")).otherwise(F.array(x))))
    return F.array_distinct(F.transform(F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(17)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(place: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), n.cast("int").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def _cells(digests: Column, sign: int, salt: Column, width: Column) -> Column:
    """Each digest in its three cells, by itself."""
    return F.flatten(F.transform(digests, lambda d: F.array(*[_cell(width * t + F.pmod(F.xxhash64(d, salt, F.lit(t)), width), F.lit(sign), d, _check(d)) for t in range(3)])))


def _summed(cells: Column) -> Column:
    """Cells of the same place added up; what comes out empty is left out."""

    def add(a: Column, b: Column) -> Column:
        return _cell(a["place"], a["n"] + b["n"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"]))

    def of_sorted(x: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["place"] != F.get(x, i - 1)["place"]))

        def total(begin: Column, k: Column, begins: Column) -> Column:
            end = F.coalesce(F.get(begins, k + 1), F.size(x)) - 1
            return F.aggregate(F.sequence(begin, end), _cell(F.get(x, begin)["place"], F.lit(0), F.lit(0), F.lit(0)), lambda a, i: add(a, F.get(x, i)))

        sums = _let(fresh, lambda begins: F.transform(begins, lambda begin, k: total(begin, k, begins)))
        return F.when(F.size(x) == 0, x).otherwise(F.filter(sums, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)))

    return _let(F.array_sort(cells), of_sorted)


def _sketch(digests: Column, salt: Column, width: Column) -> Column:
    return _summed(_cells(digests, 1, salt, width))


def sketch(digests: Column) -> Column:
    """The cells (place, n, key, check) of a sketch of fixed size, 3 * WIDTH cells; empty ones are left out."""
    return _sketch(digests, F.lit(0), F.lit(WIDTH))


def fingerprint(cells: Column) -> Column:
    """A sketch as text: place:n:key:check of each cell, the last two in hexadecimal, joined by semicolons."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["place"], c["n"], F.hex(c["key"]), F.hex(c["check"]))), ";")


def parsed(text: Column) -> Column:
    """The sketch that a fingerprint is the text of."""

    def cell(field: Column) -> Column:
        parts = F.split(field, ":")
        # conv gives unsigned numbers; a decimal of 20 digits holds them before they are turned back.
        key = F.conv(parts[2], 16, 10).cast("decimal(20,0)")
        signed = F.when(key > (1 << 63) - 1, key - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(key)
        return _cell(parts[0], parts[1], signed, F.conv(parts[3], 16, 10))

    return F.transform(F.filter(F.split(text, ";"), lambda field: field != ""), cell)


def subtracted(left: Column, right: Column) -> Column:
    """What is left of one sketch when another of its size is taken away."""
    return _summed(F.concat(left, F.transform(right, lambda c: _cell(c["place"], -c["n"], c["key"], c["check"]))))


def peeled(cells: Column, salt: Column | None = None, width: Column | None = None) -> Column:
    """(left, right, whole) of a difference of sketches: the digests that only one side has, and whether they are all."""
    salt, width = F.lit(0) if salt is None else salt, F.lit(WIDTH) if width is None else width

    def state(cells: Column, left: Column, right: Column, done: Column) -> Column:
        return F.struct(cells.alias("cells"), left.alias("left"), right.alias("right"), done.alias("done"))

    def alone(cells: Column, n: int) -> Column:
        """The digests that are the only ones of a cell, on one side."""
        return F.array_distinct(F.transform(F.filter(cells, lambda c: (c["n"] == n) & (c["check"] == _check(c["key"]))), lambda c: c["key"]))

    def step(s: Column, _: Column) -> Column:
        def take(found: Column) -> Column:
            left, right = F.get(found, F.lit(0)), F.get(found, F.lit(1))
            rest = _summed(F.concat(s["cells"], _cells(left, -1, salt, width), _cells(right, 1, salt, width)))
            more = state(rest, F.concat(s["left"], left), F.concat(s["right"], right), F.lit(False))
            return F.when(F.size(left) + F.size(right) == 0, state(s["cells"], s["left"], s["right"], F.lit(True))).otherwise(more)

        return F.when(s["done"], s).otherwise(_let(F.array(alone(s["cells"], 1), alone(s["cells"], -1)), take))

    def end(s: Column) -> Column:
        return F.struct(s["left"].alias("left"), s["right"].alias("right"), (F.size(s["cells"]) == 0).alias("whole"))

    # Every round empties a cell for good, so there are at most as many as cells.
    return _let(cells, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c)), state(c, _no_digests(), _no_digests(), F.lit(False)), step, end))


def _again(left: Column, right: Column) -> Column:
    """(left, right, whole) by larger and larger sketches of two lists of digests, until one gives away all differences."""
    nothing = F.struct(_no_digests().alias("left"), _no_digests().alias("right"), F.lit(False).alias("whole"))

    def attempt(s: Column, n: Column) -> Column:
        def solved(width: Column) -> Column:
            return peeled(_summed(F.concat(_cells(left, 1, n, width), _cells(right, -1, n, width))), n, width)

        size = (F.greatest(F.lit(WIDTH), F.size(left) + F.size(right)) * F.pow(F.lit(2), n - 1)).cast("int")
        return F.when(s["whole"], s).otherwise(_let(size, solved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), nothing, attempt)


def difference(left_cells: Column, right_cells: Column, left: Column, right: Column) -> Column:
    """(left, right, whole): the digests that only one of two texts has, from their sketches, or from larger ones of their
    digests ``left`` and ``right`` where those are too small.  whole is false if every try got stuck, which doesn't happen in practice."""
    return _let(peeled(subtracted(left_cells, right_cells)), lambda d: F.when(d["whole"], d).otherwise(_again(left, right)))


def likeness(n_left: Column, n_right: Column, differing: Column) -> Column:
    """Shared digests over all digests of two texts; 1 for two texts without paragraphs."""
    n = F.size(differing["left"]) + F.size(differing["right"])
    return F.when(n == 0, F.lit(1.0)).otherwise((n_left + n_right - n) / (n_left + n_right + n))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, W]:
    """(doc_id, text, range, guard) and a window in which every row but guards is followed by the next by rising doc_id.

    Rows are cut into ranges of doc_id of about ``range_rows`` rows, or MOST_RANGES ranges.  The first row of a range is also the
    last of the one before, as a guard; the first of all comes last of all.  Rows of equal doc_id follow each other by
    text, rows without one come after all others.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, least = read.agg(F.count("*"), F.min("doc_id")).first()
    ranges = min(max(1, n // range_rows), MOST_RANGES)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = read.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] if shares else None  # MOST_RANGES numbers at most
    bounds = sorted(set(bounds or ()) - {least})
    begins = F.array(*[F.lit(b) for b in bounds]) if bounds else _no_digests()
    steps = max(1, len(bounds)).bit_length()

    def ranged(begins: Column) -> Column:
        """How many of the bounds a doc_id has reached, by bisection; rows without doc_id are in the last range."""

        def step(found: Column, k: Column) -> Column:
            after = found + F.call_function("shiftleft", F.lit(1), (F.lit(steps - 1) - k))
            return F.when(F.get(begins, after - 1) <= F.col("doc_id"), after).otherwise(found)

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), step)

    own = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(_let(begins, ranged))
    placed = read.withColumn("own", own)
    first = F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))
    opens = F.get(begins, F.col("own") - 1) == F.col("doc_id")
    none = F.lit(None).cast("int")
    rows = F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("guard")), F.struct(F.when(opens, F.col("own") - 1).otherwise(none).alias("range"), F.lit(1).alias("guard")), F.struct(F.when(first, F.lit(len(bounds))).otherwise(none).alias("range"), F.lit(2).alias("guard")))
    out = placed.select("doc_id", "text", F.inline(F.filter(rows, lambda r: r["range"].isNotNull())))
    return out, W.partitionBy("range").orderBy((F.col("guard") == 2), F.asc_nulls_last("doc_id"), "text")


def fingerprinted(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last half replaced by the first half as many code points of the next
    document's by rising doc_id (the last's next is the first).

    ``docs`` needs doc_id and text; other columns are left out.  Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, n_paragraphs (distinct), to_edited and to_next (left, right: digests of paragraphs that only one of the two
    texts has; whole), near_edited and near_next (shared paragraphs over all; 1 for two texts without any), one row per
    input row.  Null texts count as empty; an empty text's sketch has empty cells only.  Rows that repeat a doc_id follow each other
    by text; rows without one come last.  A single row is its own next.  Texts are shuffled once.
    """
    rows, ordered = with_next(docs, range_rows)
    rows = rows.withColumn("next", F.lead("text").over(ordered)).withColumn("digests", paragraph_digests(F.col("text"))).withColumn("cells", sketch(F.col("digests")))
    rows = rows.withColumns({"next_cells": F.lead("cells").over(ordered), "next_digests": F.lead("digests").over(ordered)}).where("guard = 0")
    half = (F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    rows = rows.withColumn("edited_digests", paragraph_digests(F.col("edited"))).withColumn("edited_cells", sketch(F.col("edited_digests")))
    rows = rows.withColumn("to_edited", difference(F.col("cells"), F.col("edited_cells"), F.col("digests"), F.col("edited_digests"))).withColumn("to_next", difference(F.col("cells"), F.col("next_cells"), F.col("digests"), F.col("next_digests")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("cells")).alias("fingerprint"),
        fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
        F.size("digests").cast("long").alias("n_paragraphs"),
        "to_edited",
        "to_next",
        likeness(F.size("digests"), F.size("edited_digests"), F.col("to_edited")).alias("near_edited"),
        likeness(F.size("digests"), F.size("next_digests"), F.col("to_next")).alias("near_next"),
    )
