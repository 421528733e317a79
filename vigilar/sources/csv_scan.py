"""Parallel scan of CSV files whose quoted fields hold line breaks.

Spark's own reader takes such a file in one task, as a split may begin inside a field. Here a file
is read as lines, in as many splits as it has blocks, with two light passes:

1. Every split counts its lines and quotes. Running sums over the splits of a file tell the number
   of the first line of each split, and whether it begins inside a quoted field: with quotes doubled
   inside fields (RFC 4180), that is the parity of all quotes before.
2. Every split joins its lines to records and numbers them by their first line. A record that goes
   over the edge of a split comes out in pieces, at most two a split, which are put together.

A row's id is made of the number of its file (by path) and of its first line, so it is the same on
any cluster, whatever the splits are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilar.session import small_side, stable

LINE_BITS = 40  # lines a file may have, as a power of two
MAX_BLOCK_ROWS = 1_000_000
_BLOCK = ["file", "block"]
_WHOLE, _OPEN, _INNER, _CLOSE = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, split, and order inside it."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Both passes must cut files alike, also if executors come or go between them.
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.option("lineSep", "\n").text(path)
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return lines.select(*where, "value", F.monotonically_increasing_id().alias("place"))


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, file_no, first_line, inside) of every split; a row each."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"), F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"first_line": F.coalesce(F.sum("n").over(before), F.lit(0)), "inside": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1}
    files = counted.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)  # a row a file
    return counted.withColumns(sums).join(files, "file").select(*_BLOCK, "file_no", "first_line", "inside")


def _pieces_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_no, line, kind, text): whole records, and the pieces of those that a split cuts."""
    key, held, held_line, number, inside, entered = None, [], 0, 0, False, False
    names = ["file_no", "line", "kind", "text"]

    def out(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=names)

    def cut() -> list[tuple[int, int, int, str]]:
        """What is open where a split ends."""
        return [(key[2], held_line, _INNER if entered else _OPEN, "\n".join(held))] if held else []

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        block, file = batch.column("block").to_numpy(), batch.column("file")
        same = np.ones(n, dtype=bool)
        same[1:] = (block[1:] == block[:-1]) & pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(~same).tolist()]
        quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            head = (file[a].as_py(), int(block[a]), batch.column("file_no")[a].as_py())
            if head != key:
                if key:
                    yield out(cut())
                if batch.column("inside")[a].as_py() is None:
                    raise ValueError(f"{head[0]} was cut in other places by the second pass")
                key, held, number, inside = head, [], batch.column("first_line")[a].as_py(), bool(batch.column("inside")[a].as_py())
                entered = inside
            odd = np.cumsum(quotes[a:b]) % 2 == 1
            after = odd ^ inside
            alone = ~after
            alone[1:] &= ~after[:-1]
            alone[0] &= not inside and not held
            values = batch.column("value").slice(a, b - a)
            if alone.any():
                at = np.flatnonzero(alone)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[2])), pa.array(number + at), pa.array(np.full(len(at), _WHOLE, dtype=np.int32)), values.take(pa.array(at))], names=names)
            rows = []
            for i in np.flatnonzero(~alone).tolist():
                if not held:
                    held_line = number + i
                held.append(values[i].as_py())
                if not after[i]:
                    rows.append((key[2], held_line, _CLOSE if entered else _WHOLE, "\n".join(held)))
                    held, entered = [], False
            if rows:
                yield out(rows)
            inside, number = bool(after[-1]), number + b - a
    if key:
        yield out(cut())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, line, text) for every record of the files below ``path``, headers included, in as many tasks as there are splits."""
    lines = _lines(spark, path)
    blocks = stable(_blocks(lines))
    dealt = small_side(blocks, MAX_BLOCK_ROWS)  # a row for 128 MB of input
    joined = lines.join(dealt, _BLOCK, "left").select(*_BLOCK, "place", "file_no", "first_line", "inside", "value")
    if dealt is blocks:
        joined = joined.sortWithinPartitions("file", "block", "place")
    pieces = joined.drop("place").mapInArrow(_pieces_of_lines, "file_no long, line long, kind int, text string")
    cut = pieces.where(F.col("kind") != _WHOLE)
    # A piece that opens a record starts a group; inner and closing pieces follow it.
    group = F.count_if(F.col("kind") == _OPEN).over(Window.partitionBy("file_no").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    mended = cut.withColumn("g", group).groupBy("file_no", "g").agg(F.min("line").alias("line"), parts.alias("parts"))
    mended = mended.select("file_no", "line", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return pieces.where(F.col("kind") == _WHOLE).drop("kind").unionByName(mended)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the first line of a file."""
    return spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path).columns


def read_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """All columns as text, and ``row_id``; like Spark's multi-line reader with a header, quotes doubled.

    Every file has the header as its first record, on one line. Empty lines are no rows. Quotes must be
    balanced; a field with quotes inside is quoted itself.
    """
    header = header_of(spark, path) if header is None else header
    records = csv_records(spark, path).where(F.col("line") > 0).withColumn("text", F.regexp_replace("text", "\r$", ""))
    records = records.where(F.col("text") != "")
    row_id = F.shiftleft("file_no", LINE_BITS).bitwiseOR(F.col("line"))
    parsed = F.from_csv("text", _ddl(header), {"escape": '"', "multiLine": "true"})
    return records.select(row_id.alias("row_id"), parsed.alias("_row")).select("row_id", *[F.col("_row").getField(c).alias(c) for c in header])


def _ddl(header: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
