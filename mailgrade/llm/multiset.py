"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

Each paragraph (a line that isn't empty) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo 2**16 in each lane. The order of
paragraphs doesn't matter; a paragraph is inserted by adding its vector and deleted by
subtracting it (``combine``). The first ``EXACT`` lanes are a digest of the whole paragraph and
serve equality. The other ``LANES`` add +1 or -1 for each three-word shingle inside the
paragraph: the squared distance of two such vectors estimates how many shingles differ, which
gives ``likeness`` from fingerprints alone (standard error about ``sqrt(2 / LANES)``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrade.llm.common import once, parts, text_key

EXACT = 16
LANES = 128
SHINGLE = 3
MODULUS = 1 << 16

_PAIR = 0x0000000100000001  # two counters in a long, 32 bits each


def _sums(digest: str, first: str, shingle: str) -> list[Column]:
    """Lane totals over rows of one shingle each; a paragraph's digest counts at its first shingle."""
    exact = [
        F.sum(F.when(F.col(first), F.shiftrightunsigned(F.xxhash64(digest, F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(F.lit(MODULUS - 1)))).alias(f"e{i}")
        for i in range(EXACT)
    ]
    one = F.col(shingle)
    word = lambda k: one if k == 0 else F.when(one.isNotNull(), F.xxhash64(one, F.lit(k)))
    pairs = [
        F.sum(F.shiftrightunsigned(word(k), j).bitwiseAND(F.lit(_PAIR))).alias(f"p{k}_{j}")
        for k in range(LANES // 64)
        for j in range(32)
    ]
    return [*exact, *pairs, F.count(shingle).alias("n")]


def _lanes() -> Column:
    """The fingerprint as an array of EXACT + LANES numbers below MODULUS."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    exact = [zero(F.col(f"e{i}")) for i in range(EXACT)]
    ones = [
        F.shiftrightunsigned(zero(F.col(f"p{k}_{j}")), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        for k in range(LANES // 64)
        for half in range(2)
        for j in range(32)
    ]
    signed = [F.lit(2) * x - F.col("n") for x in ones]
    return F.array(*[x.bitwiseAND(F.lit(MODULUS - 1)) for x in [*exact, *signed]])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together, or of ``a`` without ``b`` for ``sign`` -1."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(MODULUS - 1)))


def as_text(lanes: Column) -> Column:
    """Four hex digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the squared distance of the shingle lanes over the sum of their squares; equal is 1."""
    half = MODULUS // 2
    square = lambda v: F.aggregate(
        v, F.lit(0.0), lambda t, x: t + F.pow((F.pmod(x + half, F.lit(MODULUS)) - half).cast("double"), F.lit(2.0))
    )
    lanes = lambda v: F.slice(v, EXACT + 1, LANES)
    apart = square(F.zip_with(lanes(a), lanes(b), lambda x, y: x - y))
    whole = square(lanes(a)) + square(lanes(b))
    like = F.when(whole > 0, 1 - apart / whole).otherwise(F.lit(1.0))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), like)))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` (unique, holding the partitioning) and lanes; an empty text has all lanes 0."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda p: p != "")
    paragraphs = rows.select(*keys, F.explode_outer(lines).alias("p"))
    worded = once(paragraphs, words=F.split("p", " +")).select(*keys, F.xxhash64("p").alias("digest"), "words")
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(SHINGLE)]),
    )
    cut = worded.select(*keys, "digest", F.posexplode_outer(F.when(F.col("words").isNotNull(), shingles)).alias("at", "shingle"))
    marked = cut.withColumn("first", F.col("at") == 0)
    return marked.groupBy(*keys).agg(*_sums("digest", "first", "shingle")).select(*keys, _lanes().alias("lanes"))


def _share(borders: list[int]) -> Column:
    """How many of the sorted borders are at or below doc_id, by halving; null ids are below all."""
    if not borders:
        return F.lit(0)
    values = F.array(*[F.lit(b) for b in borders])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """share, nth, doc_id, text, next_text, extra: each row beside the next one by id, the last beside the first.

    Ids are dealt to as many ranges as there are shuffle partitions. Each range gets the first
    row of the following one as an extra row at its end, so no row needs more than its own
    range. To the driver go the range borders and each range's first key. Rows with equal ids
    follow in the order of their text's hash. Null texts are empty.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = parts(docs.sparkSession)
    cuts = given.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("c")).first()["c"]
    placed = given.select(_share(sorted(set(cuts or []))).alias("share"), "doc_id", text_key(F.col("text")).alias("key"), "text")
    firsts = sorted(placed.groupBy("share").agg(F.min(F.struct("doc_id", "key")).alias("f")).collect(), key=lambda r: r["share"])
    before = {r["share"]: firsts[k - 1]["share"] for k, r in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame(
        [(r["share"], r["f"]["doc_id"], r["f"]["key"], before[r["share"]]) for r in firsts],
        f"at int, head {given.schema['doc_id'].dataType.simpleString()}, head_key long, previous int",
    )
    # One row for each range, as many as there are partitions.
    is_head = (F.col("share") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("key") == F.col("head_key"))
    extra = placed.join(F.broadcast(heads), is_head).dropDuplicates(["at"])
    rows = placed.withColumn("extra", F.lit(False)).unionByName(
        extra.select(F.col("previous").alias("share"), "doc_id", "key", "text", F.lit(True).alias("extra"))
    )
    order = Window.partitionBy("share").orderBy("extra", "doc_id", "key")
    return rows.select(
        "share", F.row_number().over(order).alias("nth"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "extra"
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and how alike they and the next document are.

    The edited text has the last half of the code points replaced by the beginning of the next
    document. Returns doc_id, n_chars, edited_sha256, lanes, edited_lanes, near_edited, near_next.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edit = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = once(with_next(docs), edited=edit)
    facts = ["share", "nth", "doc_id", "extra", "n_chars", "edited_sha256"]
    both = rows.select(
        "share", "nth", "doc_id", "extra", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"),
    )
    # The next row's text is null for the extra rows alone; only their own fingerprint is needed.
    texts = both.select(*facts, "x.kind", "x.text").filter(~F.col("extra") | (F.col("kind") == 0))
    prints = fingerprints(texts, [*facts, "kind"])
    wide = prints.groupBy(*facts).agg(
        F.first(F.when(F.col("kind") == 0, F.col("lanes")), ignorenulls=True).alias("lanes"),
        F.first(F.when(F.col("kind") == 1, F.col("lanes")), ignorenulls=True).alias("edited_lanes"),
    )
    ahead = wide.withColumn("next_lanes", F.lead("lanes").over(Window.partitionBy("share").orderBy("nth")))
    return ahead.filter(~F.col("extra")).select(
        "doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes",
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
