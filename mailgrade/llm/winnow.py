"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every run of ``SPAN - GRAM + 1`` consecutive word k-grams the least hash is kept (the last
one on a tie). Two texts that share ``SPAN`` words share such a run, so they share a kept
fingerprint at the same place of it. Fingerprints of documents and items are joined; each
match names an alignment, and the alignment is extended word by word: only runs of equal words
that hold a whole window of the item count as hits.

An item of fewer than ``SPAN`` words is one window. Its own length is then both gram and span,
which keeps every gram, so each length below ``SPAN`` that occurs among the items costs one
more pass over the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrade.llm.common import once, stored, text_key

SPAN = 10
GRAM = 5
#: Benchmark fingerprints (24 bytes each) and item words up to which the benchmark side is broadcast; beyond, both are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_WORDS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A kept value holds the hash above and the place, counted down, below.
_PLACE_BITS = 28
_PLACES = (1 << _PLACE_BITS) - 1


def words(text: Column) -> Column:
    """A-Z in lower case, then runs of digits, letters and everything beyond ASCII; null has no words."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _BETWEEN), "")


def fingerprints(rows: DataFrame, keys: list[str], span: int, gram: int) -> DataFrame:
    """``keys``, fp and place (of a gram's first word, from 0) of the kept grams; ``rows`` has words."""
    n = F.size("words")
    hashed = F.transform(
        F.sequence(F.lit(0), n - gram),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(gram)])
        .bitwiseAND(F.lit(~_PLACES))
        .bitwiseOR(F.lit(_PLACES) - i.cast("long")),
    )
    width = span - gram + 1
    kept = once(rows.filter(n >= span).select(*keys, "words"), grams=hashed).select(*keys, "grams")
    if width > 1:
        least = F.transform(
            F.sequence(F.lit(0), F.size("grams") - width),
            lambda i: F.least(*[F.get("grams", i + j) for j in range(width)]),
        )
        kept = once(kept, least=least).select(*keys, F.array_distinct("least").alias("grams"))
    return kept.select(*keys, F.explode("grams").alias("v")).select(
        *keys,
        F.shiftright("v", _PLACE_BITS).alias("fp"),
        (F.lit(_PLACES) - F.col("v").bitwiseAND(F.lit(_PLACES))).cast("int").alias("place"),
    )


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def alignments(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """doc_id, text_key, item_id, item, span, shift: where an item may lie in a document.

    ``docs`` has doc_id, text_key, words; ``items`` has item_id, words and the row's own number item.
    """
    marks = stored(fingerprints(items, ["item"], span, gram).withColumnRenamed("place", "at"), "marks")
    marks = _small(marks, marks.count(), BROADCAST_ROWS)
    met = fingerprints(docs, ["doc_id", "text_key"], span, gram).join(marks, "fp")
    return met.select(
        "doc_id", "text_key", "item", F.lit(span).alias("span"), (F.col("place") - F.col("at")).alias("shift")
    ).distinct()


def _extended(found: DataFrame) -> DataFrame:
    """The alignments' hit word places: those within ``span`` or more equal words in a row."""
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item_words"), F.size("words") - F.col("shift"))  # first item word beyond
    same = F.transform(
        F.sequence(low, high - 1), lambda j: F.get("item_words", j) == F.get("words", j + F.col("shift"))
    )
    lined = once(found.filter(high - low >= F.col("span")).select("*", low.alias("low")), same=same)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("same") - F.col("span")),
        lambda s: F.forall(F.slice("same", s + 1, F.col("span")), lambda x: x),
    )
    full = once(lined.drop("words", "item_words"), starts=starts).filter(F.size("starts") > 0)
    places = F.flatten(
        F.transform("starts", lambda s: F.sequence(s + F.col("low") + F.col("shift"), s + F.col("low") + F.col("shift") + F.col("span") - 1))
    )
    return full.select("doc_id", "text_key", "item_id", F.array_distinct(places).alias("places"))


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_hit, item_ids (sorted strings) of the documents that hold a window of an item.

    Items with equal ids count once. Null and wordless texts and items never match. A null
    item_id matches but has no place in item_ids.
    """
    given = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    worded = once(given, words=words(F.col("text"))).drop("text")
    bench = stored(
        once(items.select("item_id", "text").distinct(), words=words(F.col("text")))
        .filter(F.size("words") > 0)
        .select("item_id", F.xxhash64("item_id", "text").alias("item"), "words"),
        "items",
    )
    facts = bench.agg(F.sum(F.size("words")).alias("n"), F.collect_set(F.when(F.size("words") < span, F.size("words"))).alias("short")).first()
    passes = [(span, gram, F.size("words") >= span)] + [(n, n, F.size("words") == n) for n in sorted(facts["short"])]
    found = stored(reduce(DataFrame.union, [alignments(worded, bench.filter(own), s, g) for s, g, own in passes]), "alignments")
    texts = _small(bench.withColumnRenamed("words", "item_words"), facts["n"] or 0, BROADCAST_WORDS)
    # One row per document, so that its words are taken apart once; alignments fan out below.
    fans = found.groupBy(F.col("doc_id").alias("own_doc"), F.col("text_key").alias("own_key")).agg(
        F.collect_set(F.struct("item", "span", "shift")).alias("all")
    )
    lined = given.join(fans, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("text_key") == F.col("own_key")))
    lined = once(lined, words=words(F.col("text"))).select("doc_id", "text_key", "words", F.explode("all").alias("x"))
    lined = lined.select("doc_id", "text_key", "words", "x.item", "x.span", "x.shift").join(texts, "item")
    seen = _extended(lined)
    return seen.groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, item_ids for every row of ``docs``; repeated rows stay repeated."""
    found = hits(docs, items, span, gram)
    every = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hit = found.select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), "n_hit", "item_ids")
    both = every.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")), "left")
    return both.select(
        "doc_id", "text_key", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
