"""Product codes of vectors: eight codebooks of sixteen entries, found by equal-average search.

All arithmetic is on whole numbers, so the codebooks are the same however the rows are dealt.
A round is one pass: every task assigns its rows' parts and adds them up by entry, tasks' sums
meet in a grouped sum, and the new codebooks (16 entries of each part, whatever the input) go
out with the next pass.

The nearest entry is looked for outward from the place of the part's component sum among the
entries' sums. By Cauchy-Schwarz a squared distance is at least the squared gap of the sums over
the number of components; a side is done once that exceeds the best distance, and only then, so
that ties still reach the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgrade.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components beyond this are set to it: sums of any number of rows fit into 38 digits.
MOST = 1 << 80
#: Rows whose parts are searched at once.
BLOCK = 1 << 14
LONGEST = (1 << 63) - 1


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """``floor(4096 * x)`` of finite components: 64-bit where that is exact, else Python integers."""
    wide = flat.astype(np.float64)
    if np.abs(wide).max(initial=0.0) < 1 << 40:
        return np.floor(wide * SCALE).astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 1 << 60 else int(x) * SCALE for x in wide.tolist()]
    out = np.empty(len(exact), object)
    out[:] = [max(-MOST, min(MOST, x)) for x in exact]
    return out


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest row of ``book`` (ties to the lower index) and its squared distance."""
    n, width = vectors.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    top = max(int(np.abs(vectors).max()), int(np.abs(book).max()))
    kind = np.int64 if top * width < 1 << 30 else object  # squared sums' gaps stay below 2**62
    vectors, book = vectors.astype(kind), book.astype(kind)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    book, sums = book[order], sums[order]
    own = vectors.sum(axis=1)
    below = np.searchsorted(sums, own) - 1  # the next entry on each side
    above = below + 1
    best = np.full(n, -1, kind)
    index = np.full(n, len(book), np.int64)
    live = np.arange(n)
    while len(live):
        low, high = below[live], above[live]
        gap_low, gap_high = own[live] - sums[np.maximum(low, 0)], sums[np.minimum(high, len(book) - 1)] - own[live]
        down = (low >= 0) & ((high >= len(book)) | (gap_low <= gap_high))
        gap = np.where(down, gap_low, gap_high)
        bound = best[live] * width
        go = ((low >= 0) | (high < len(book))) & ((best[live] < 0) | (gap * gap <= bound))
        live, down = live[go], down[go]
        at = np.where(down, below[live], above[live])
        away = vectors[live] - book[at]
        distance = (away * away).sum(axis=1)
        old, name = best[live], order[at]
        better = (old < 0) | (distance < old) | ((distance == old) & (name < index[live]))
        best[live[better]], index[live[better]] = distance[better], name[better]
        below[live[down]] -= 1
        above[live[~down]] += 1
    return index, best


def _assigned(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of every part: rows by parts."""
    width = vectors.shape[1] // PARTS
    index = np.zeros((len(vectors), PARTS), np.int64)
    far = np.zeros((len(vectors), PARTS), object)
    for p, book in enumerate(books):
        index[:, p], far[:, p] = nearest(vectors[:, p * width : (p + 1) * width], book)
    return index, far


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows a block at a time, with their vectors as whole numbers, shorter ones filled with zeros."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            lists = part.column("vector")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = whole_numbers(lists.flatten().to_numpy(zero_copy_only=False))
            if (sizes == width).all():
                yield part, flat.reshape(len(sizes), width)
                continue
            out = np.zeros((len(sizes), width), flat.dtype)
            out[np.arange(width) < sizes[:, None]] = flat
            yield part, out


def _sums(books: list[np.ndarray], width: int):
    """A task's sums: for each part and entry in use its components as decimal texts, and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = width // PARTS
        total = [np.zeros(book.shape, object) for book in books]
        count = np.zeros((PARTS, len(books[0])), np.int64)
        for _, vectors in _blocks(batches, width):
            index, _ = _assigned(vectors, books)
            for p in range(PARTS):
                own = vectors[:, p * each : (p + 1) * each]
                count[p] += np.bincount(index[:, p], minlength=len(books[0]))
                for e in np.unique(index[:, p]):
                    total[p][e] += own[index[:, p] == e].sum(axis=0)
        rows = [(p, e, int(count[p, e]), [str(x) for x in total[p][e]]) for p in range(PARTS) for e in range(len(books[0])) if count[p, e]]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "entry", "n", "total"])

    return run


def train(rows: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over all of ``rows`` (``key``, ``vector``)."""
    # Repeated ids go by their vectors, and a missing id comes last.
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(ENTRIES).select(F.col("vector").cast("array<double>")).collect()
    if not first:
        return []
    seeds = np.array([whole_numbers(np.array([*r[0], *[0.0] * (width - len(r[0]))])).astype(object) for r in first]).reshape(len(first), width)
    each = width // PARTS
    books = [seeds[:, p * each : (p + 1) * each] for p in range(PARTS)]
    added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(each)]
    for _ in range(rounds):
        partial = rows.select("vector").mapInArrow(_sums(books, width), "part int, entry int, n long, total array<string>")
        books = [book.copy() for book in books]
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # at most PARTS * ENTRIES rows
            books[r["part"]][r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(each)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()


def _coded(books: list[np.ndarray], width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _blocks(batches, width):
            index, far = _assigned(vectors, books)
            code = index.astype(np.uint8).tobytes().hex()
            error = [min(LONGEST, int(x)) for x in far.sum(axis=1)]
            codes = [code[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(vectors))]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=names
            )

    return run


def usable(vector: Column) -> Column:
    """Neither the vector nor a component is null, and all components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, code, error, label_error, codebooks_sha256 of every usable vector.

    Rows with a null vector, or one that holds null or a component that is not finite, are left
    out. Vectors of unlike lengths count as filled up with zeros to the longest, and that to a
    multiple of eight parts. Fewer than sixteen vectors give as many entries. A null key comes
    last among the first entries, repeated keys go by their vectors. An error beyond 64 bits is
    the largest long; scaled components beyond 2**80 are set to that. An empty table gives no
    rows. Other columns are not read.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")).filter(usable(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = train(rows, width)
    schema = T.StructType([
        rows.schema["key"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    if books:
        coded = stored(rows.mapInArrow(_coded(books, width, schema.names), schema), "codes")
    else:
        coded = rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    # A row for each label, whatever its vectors; a join on a frequent label is one that Spark splits.
    label_sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error"))
    named = label_sums.select(F.col("label").alias("of_label"), "label_error")
    return coded.join(named, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
