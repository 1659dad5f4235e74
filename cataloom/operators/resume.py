"""Resuming by content: stored results count for a file only as far as its rows are what they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RANGE_ROWS = 10_000


def file_guard(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(range, n, h1, h2): a fingerprint of each range of ``range_rows`` row_ids (1-based).

    Every row is hashed with its row_id and all its cells, so the exclusive or over a range depends on the order of the file and is
    combined before the shuffle.  Columns count by name, whatever their order; a null differs from an empty text."""
    cells = [F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string")) for c in sorted(rows.columns) if c != "row_id"]
    names = F.lit("\n".join(sorted(rows.columns)))
    hashed = rows.select(F.floor((F.col("row_id") - 1) / range_rows).alias("range"), F.xxhash64("row_id", names, *cells).alias("h1"), F.xxhash64(F.lit(1), "row_id", names, *cells).alias("h2"))
    return hashed.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))


def unchanged_through(rows: DataFrame, guard: DataFrame, range_rows: int = RANGE_ROWS) -> int:
    """The row_id up to which a file is as it was when ``guard`` was taken, by whole ranges; 0 for none.

    A file that was only added to is unchanged through its old last row: its last range is compared as far as it went."""
    last = guard.agg(F.max("range")).first()[0]
    if last is None:
        return 0
    old_rows = guard.agg(F.sum("n")).first()[0]
    now = file_guard(rows.where(F.col("row_id") <= old_rows), range_rows).withColumnsRenamed({"n": "n2", "h1": "h3", "h2": "h4"})
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("h1").eqNullSafe(F.col("h3")) & F.col("h2").eqNullSafe(F.col("h4"))
    changed = guard.join(now, "range", "full").where(~same).agg(F.min("range")).first()[0]
    return old_rows if changed is None else changed * range_rows


def resumed_by_content(rows: DataFrame, checkpoints: DataFrame, guard: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Completed records that still belong to their rows, and the rows still to do.

    ``rows`` with dense row_ids from 1; ``checkpoints`` with row_id and status; ``guard`` is the :func:`file_guard` taken when
    they were written.  Everything from the first changed range on is done again."""
    limit = unchanged_through(rows, guard, range_rows)
    done = checkpoints.where((F.col("status") == "COMPLETED") & (F.col("row_id") <= limit))
    return done.join(rows.select("row_id"), "row_id", "left_semi"), rows.join(done.select("row_id"), "row_id", "left_anti")
