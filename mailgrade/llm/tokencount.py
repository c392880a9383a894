"""Token counts by a sentencepiece vocabulary: Arrow functions that return lengths only.

A batch is worked through in steps of about equal bytes. Inside a text the vocabulary allows a
safe cut before every run of spaces: no piece has a space mark after another character, so no
merge crosses the cut and the counts of the segments add up to the count of the whole. Each
different segment of a step is encoded once. A worker remembers counts of up to ``REMEMBERED``
segments and then starts afresh.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from mailgrade.llm.common import pieces
from mailgrade.llm.vocabulary import sentence_pieces

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
REMEMBERED = 300_000
#: Longer segments are counted but not remembered.
LONG = 64

_SPACE = "▁"  # the mark that stands for a space
_SEGMENT = re.compile(r" +[^ ]*|[^ ]+")
_COUNTS: dict[str, dict[str, int]] = {}
_SAFE: dict[str, bool] = {}


def cuts_are_safe(library) -> bool:
    """Whether no piece of the vocabulary has a space mark after another character."""
    inside = re.compile(f"[^{_SPACE}]{_SPACE}")
    return not any(inside.search(library.id_to_piece(i)) for i in range(library.get_piece_size()))


def segments(text: str) -> list[str]:
    """The text cut before each run of spaces; each is given without the space the library puts in front."""
    if _SPACE in text:
        text = text.replace(_SPACE, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [s[1:] for s in _SEGMENT.findall(" " + text)]


def counts(texts: list[str], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each whole text, without begin, end or other added tokens."""
    library = sentence_pieces(vocabulary)
    if not _SAFE.setdefault(vocabulary, cuts_are_safe(library)):
        return [len(x) for x in library.encode(texts, num_threads=1)]
    known = _COUNTS.setdefault(vocabulary, {})
    if len(known) > REMEMBERED:
        known.clear()
    cut = [segments(t) for t in texts]
    new = [s for s in set().union(*cut) if s not in known]
    # An empty segment stands for one space mark before another run; alone it is the mark itself.
    sizes = dict(zip(new, (len(x) for x in library.encode([s if s else " " for s in new], num_threads=1))))
    if "" in sizes:
        sizes[""] = 1
    for s, n in sizes.items():
        if len(s) <= LONG:
            known[s] = n
    lookup = known if all(len(s) <= LONG for s in new) else known | sizes
    return [sum(map(lookup.__getitem__, c)) for c in cut]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row; a null text has no tokens, repeated rows stay."""
    given = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                text = pc.fill_null(part.column("text"), "")
                n = np.array(counts(text.to_pylist(), vocabulary), np.int64)
                sizes = pc.binary_length(text).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
