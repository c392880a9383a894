"""Quoted CSV whose cells hold line breaks, read by many tasks per file.

Spark's line reader splits files at any line, also inside a quoted cell. Whether a line begins
inside one follows from the number of quotes before it: doubled quotes do not change whether
that is odd. A first pass counts quotes by block (the part of a file that one task reads); the
blocks' counts give each block's beginning, one entry for a block, as Spark itself keeps one.
A second pass parses each block's whole records. What begins in one block and ends in another is
put together by the number of the block it began in; such pieces are at most two for a block.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

csv.field_size_limit(1 << 30)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, value)``; a block is named by its first byte."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The lines of a task in pieces that belong to one block, in order."""
    for batch in batches:
        names = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        values = batch.column("value").to_pylist()
        at = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[at]:
                yield names[at], values[at:i]
                at = i


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block whether its quotes are odd, and whether a line ends after an odd number of them."""
    odd: dict[tuple[str, int], bool] = {}
    flips: dict[tuple[str, int], bool] = {}
    for name, lines in _by_block(batches):
        own = odd.get(name, False)
        for line in lines:
            own ^= line.count('"') % 2 == 1
            flips[name] = flips.get(name, False) or own
        odd[name] = own
    if odd:
        files, blocks = zip(*odd)
        yield pa.RecordBatch.from_arrays(
            [pa.array(files), pa.array(blocks, pa.int64()), pa.array(odd.values()), pa.array([flips[n] for n in odd])], names=["file", "block", "odd", "flips"]
        )


def _beginnings(counted: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """Whether a block begins inside a record, and the block where that record began."""
    out, file, inside, began = {}, None, False, 0
    for r in sorted(counted, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, began = r["file"], False, r["block"]
        out[r["file"], r["block"]] = (inside, began)
        # Without a line that ends outside, the whole block is the middle of one record.
        if not inside or r["flips"]:
            began = r["block"]
        inside ^= r["odd"]
    return out


def _cells(records: list[str]) -> list[list[str]]:
    return [row for record in records for row in csv.reader([record], strict=False) if record]


_PARSED = "file string, began long, block long, text string, cells array<string>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "began", "block", "text", "cells"])


def _parsed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, outer, first = None, [], False, False, False

        def piece() -> list[tuple]:
            """The beginning of a record that goes on in the next block, or the middle of one."""
            began = shared.value[now][1] if outer else now[1]
            return [(now[0], began, now[1], "\n".join(held), None)] if held else []

        for name, lines in _by_block(batches):
            out: list[tuple] = []
            if name != now:
                out += piece() if now else []
                now, held = name, []
                inside = outer = shared.value[name][0]
                first = name[1] == 0
            records: list[str] = []
            for line in lines:
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    if outer:  # the end of a record from an earlier block
                        out += piece()
                        outer = False
                    elif first:
                        first = False  # the header
                    else:
                        records.append("\n".join(held))
                    held = []
            out += [(None, None, None, None, row) for row in _cells(records)]
            if out:
                yield _batch(out)
        if now and held:
            yield _batch(piece())

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _cells(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["cells"])


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the CSV files at ``path`` by ``schema``; each file has a header.

    Missing cells and empty ones are empty texts, or null where the type is another. Empty lines
    are none. A quote that is never closed makes one record of the rest of its file.
    """
    lines = _lines(spark, path)
    blocks = lines.mapInArrow(_counted, "file string, block long, odd boolean, flips boolean").collect()  # a row for each block
    shared = spark.sparkContext.broadcast(_beginnings(blocks))
    parsed = stored(lines.mapInArrow(_parsed(shared), _PARSED), "csv")
    # Pieces of records: at most two for each block.
    pieces = parsed.filter("text IS NOT NULL").groupBy("file", "began").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    cells = parsed.filter("cells IS NOT NULL").select("cells").unionByName(pieces.select("text").mapInArrow(_joined, "cells array<string>"))

    def column(i: int, f: T.StructField) -> Column:
        cell = F.get("cells", F.lit(i))
        return (F.coalesce(cell, F.lit("")) if f.dataType == T.StringType() else F.nullif(cell, F.lit("")).try_cast(f.dataType)).alias(f.name)

    return cells.select(*[column(i, f) for i, f in enumerate(schema.fields)])
