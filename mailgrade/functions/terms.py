"""Words, bigrams and accent folding as column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import let

# What separates words, and which words count.
SEPARATOR = r"[^a-z0-9_\p{L}\p{N}]+"
WORD = "^[a-zA-Z][a-zA-Z0-9]+$"
COMPACT_MIN = 2


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """``(from, to, dropped, longer)``: how compatibility folding changes characters.

    Derived from the Unicode data, not typed in: each character is decomposed and
    its combining marks removed. Characters that fold to one other character are
    paired in ``from``/``to``, marks that vanish are in ``dropped``, and
    ``longer`` holds those that fold to several characters and can thereby change
    a word.
    """
    single_from, single_to, dropped, longer = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        elif any(c.isascii() and c.isalnum() for c in folded) or (
            char.isalnum() and not folded.isalnum()
        ):
            longer.append((char, folded))
    return "".join(single_from), "".join(single_to), "".join(dropped), tuple(longer)


def _covering_class(chars: Iterable[str]) -> str:
    """A short character class that covers the given characters (and some between them)."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= 64:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    inner = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)
    # The outer range turns most characters away at the first comparison.
    return rf"[\x{{{ranges[0][0]:x}}}-\x{{{ranges[-1][1]:x}}}&&[{inner}]]"


NOT_ASCII = r"[^\x00-\x7F]"


def _fold(text: Column) -> Column:
    """Compatibility folding of a whole text."""
    single_from, single_to, dropped, longer = accent_table()
    pairs = F.from_json(
        F.lit(_json_pairs(longer)), "array<struct<char:string,folded:string>>"
    )
    expanded = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["char"], p["folded"]))
    rare = _covering_class(char for char, _ in longer)
    spelled = F.when(text.rlike(rare), expanded).otherwise(text)
    return F.translate(spelled, single_from + dropped, single_to)


def _in_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


@lru_cache(maxsize=1)
def _moves_boundaries() -> str:
    """Class of the characters whose folding can join or split words."""
    single_from, single_to, dropped, longer = accent_table()
    moved = [a for a, b in zip(single_from, single_to) if _in_word(a) != _in_word(b)]
    return _covering_class([*moved, *dropped, *(char for char, _ in longer)])


def folded_words(value: Column) -> Column:
    """Split into words with accents folded.

    ASCII text, by far the most, is only split. Folding the accents of a text
    that has some is costly per character, so it is done on the words that hold
    any, unless the text has one of the rare characters that move word
    boundaries; then the whole text is folded first.
    """
    single_from, single_to, dropped, _ = accent_table()

    def split(text: Column) -> Column:
        by_word = F.transform(
            F.split(text, SEPARATOR),
            lambda w: F.when(
                w.rlike(NOT_ASCII), F.translate(w, single_from + dropped, single_to)
            ).otherwise(w),
        )
        return (
            F.when(~text.rlike(NOT_ASCII), F.split(text, SEPARATOR))
            .when(text.rlike(_moves_boundaries()), F.split(_fold(text), SEPARATOR))
            .otherwise(by_word)
        )

    return let(value, split)


def _json_pairs(pairs) -> str:
    return json.dumps([{"char": char, "folded": folded} for char, folded in pairs])


def words(value: Column, compact: bool = False) -> Column:
    """Words of a text in order.

    Default: accents folded, a letter followed by letters or digits. Compact: any
    run of two or more word characters, accents kept.
    """
    if compact:
        return F.filter(F.split(F.lower(value), SEPARATOR), lambda w: F.length(w) >= COMPACT_MIN)
    return F.filter(folded_words(F.lower(value)), lambda w: w.rlike(WORD))


@lru_cache(maxsize=1)
def _folded_by_word() -> str:
    """Class of the characters that only a word's own folding treats right: Java may not know the newest letters yet."""
    single_from, single_to, dropped, longer = accent_table()
    moved = [a for a, b in zip(single_from, single_to) if ord(a) > 0xFFFF or 0xA7F2 <= ord(a) <= 0xA7F4 or _in_word(a) != _in_word(b)]
    return _covering_class([*moved, *dropped, *(char for char, _ in longer)])


def word_text(value: Column, compact: bool = False) -> Column:
    """A text in which an ASCII pattern finds the words of :func:`words` (:mod:`.wordcounts`).

    An ASCII text is its small letters. In others accents are folded, and letters that stay beyond
    ASCII become ``_``, which is in no narrow word; where that could move the borders of words, and
    for compact words, which keep their accents, the words are joined by blanks.
    """
    single_from, single_to, _, _ = accent_table()

    def plain(low: Column) -> Column:
        joined = F.array_join(words(low, compact), " ")
        if compact:
            return F.when(~low.rlike(NOT_ASCII), low).otherwise(joined)
        folded = F.regexp_replace(F.translate(low, single_from, single_to), r"[\p{L}\p{N}&&[^\x00-\x7F]]+", "_")
        return F.when(~low.rlike(NOT_ASCII), low).when(low.rlike(_folded_by_word()), joined).otherwise(folded)

    return let(F.lower(value), plain)


def words_and_bigrams(tokens: Column) -> Column:
    """The words followed by each pair of neighbours, joined with a blank."""
    size = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(size - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, pairs)
