"""Main text of web pages: markup says what may be article, host suffix arrays take out what repeats.

A page that declares an article (article or main element, or their usual roles and classes)
offers that element's blocks without menus, forms, notices, comments and the like inside it; any
other page offers its blocks outside chrome that are not mostly links.

Both are judged by repetition on the host. A task joins token streams host by host (a separator of
its own after each), sorts their suffixes to a depth of ``DEPTH`` tokens, and reports classes of
suffixes with ``DEPTH`` common tokens; classes of all tasks are merged by a hash of host and
tokens. Pages count as distinct by their whole streams, so that copies of a page do not condemn it.

* Outside declared articles a stream is a page, and a class on two distinct pages is boilerplate.
* Inside them articles quote and copy each other, so a stream is a block, only runs that begin
  at a multiple of ``DEPTH`` tokens of a block count, and a class is boilerplate if it is on half
  of the host's distinct articles and on ``ARTICLES`` at least. An article that would lose half
  of its tokens or more is a copy and stays whole.

A block goes if boilerplate covers half of its tokens or more. A host may hold any share of the
pages: its suffixes are merged by content, not by host.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrade.llm import markup
from mailgrade.llm.common import parts, pieces, stored

DEPTH = 8
#: Distinct articles of a host that boilerplate inside articles is on at least.
ARTICLES = 3
#: A block with this share of its characters in links is a menu.
LINKS = 0.6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _stream(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for t in texts for w in t.split()), np.uint64)


def _padded(text: str, depth: int) -> np.ndarray:
    """A block's tokens, filled up with ends to a multiple of ``depth``, so that a short one is a run too."""
    tokens = _stream([text])
    return np.r_[tokens, np.full(-len(tokens) % depth, np.uint64(0))]


def suffix_classes(streams: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, stream, place) of every suffix with at least ``depth`` tokens, by prefix doubling over the joined streams.

    Classes are numbered in suffix order; suffixes of a class have ``depth`` tokens in common.
    """
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    if not lengths.sum():
        return (np.empty(0, np.int64),) * 3
    ends = np.cumsum(lengths + 1) - 1  # each stream's separator
    joined = np.zeros(int((lengths + 1).sum()), np.int64)
    inside = np.ones(len(joined), bool)
    inside[ends] = False
    tokens = np.unique(np.concatenate(streams), return_inverse=True)[1]
    joined[inside] = tokens + len(streams)
    joined[ends] = np.arange(len(streams))
    rank, h, n = joined, 1, len(joined)
    while h < depth:
        step = min(h, depth - h)
        ahead = rank[np.minimum(np.arange(n) + step, n - 1)]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
        h += step
    stream = np.repeat(np.arange(len(streams)), lengths + 1)
    place = np.arange(n) - (ends - lengths)[stream]
    whole = place + depth <= lengths[stream]
    return rank[whole], stream[whole], place[whole]


def _keys(host: str, streams: list[np.ndarray], which: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """A hash of host and the first ``depth`` tokens of the given suffixes, the same in every task."""
    flat = np.concatenate(streams) if streams else np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    at = (np.cumsum(lengths) - lengths)[which] + place
    h = np.full(len(at), np.uint64(xxhash.xxh64_intdigest(host)))
    for k in range(depth):
        h = (h ^ flat[at + k]) * _ODD
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


#: What a page's markup makes of a block: not wanted, wanted if no boilerplate, part of the declared article.
_OUT, _OPEN, _ARTICLE, _LIST = "0", "1", "2", "3"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page's blocks, a line each (no block holds a line feed), and a letter for what each is."""
    for batch in batches:
        for part in pieces(batch, "html", 8 << 20):
            texts, kinds = [], []
            for page in part.column("html").to_pylist():
                found = markup.blocks(page or "")
                article = markup.declared_article(found)
                if article is None:
                    own = [_OPEN if b.role == markup.OPEN and b.linked < LINKS * len(b.text) else _OUT for b in found]
                else:
                    regions = {b.region for b in article}
                    own = [_OUT if b.role != markup.ARTICLE else _ARTICLE if b.region in regions else _LIST for b in found]
                texts.append("\n".join(b.text for b in found))
                kinds.append("".join(own))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(kinds, pa.string())], names=["page_id", "url", "blocks", "kinds"])


def _pages(part: pa.RecordBatch) -> Iterator[tuple[str, list[str], str]]:
    for url, blocks, kinds in zip(*(part.column(c).to_pylist() for c in ("url", "blocks", "kinds"))):
        yield host_of(url), blocks.split("\n") if kinds else [], kinds


def _page_hashes(streams: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in streams), np.uint64, len(streams)).view(np.int64)


def _evidence(depth: int):
    """key, least, greatest: suffix classes outside articles of a task's pages, with the pages' own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "blocks", 4 << 20):
                hosts: dict[str, list[np.ndarray]] = {}
                for host, texts, kinds in _pages(part):
                    hosts.setdefault(host, []).append(_stream([t for t, k in zip(texts, kinds) if k in _OUT + _OPEN]))
                keys, least, greatest = [], [], []
                for host, streams in hosts.items():
                    own = _page_hashes(streams)
                    rank, which, place = suffix_classes(streams, depth)
                    if not len(rank):
                        continue
                    code, unique = pd.factorize(rank)
                    first = np.empty(len(unique), np.int64)
                    first[code[::-1]] = np.arange(len(code))[::-1]
                    low, high = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
                    np.minimum.at(low, code, own[which])
                    np.maximum.at(high, code, own[which])
                    keys.append(_keys(host, streams, which[first], place[first], depth))
                    least.append(low)
                    greatest.append(high)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (keys, least, greatest)], names=["key", "least", "greatest"]
                    )

    return run


def _host_key(host: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(host)).view(np.int64))


def _inner_evidence(depth: int):
    """key, host, own: each suffix class at a tile of a block, once for each article of a task; the host's own key once too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "blocks", 4 << 20):
                hosts: dict[str, tuple[list, list, list]] = {}
                for host, texts, kinds in _pages(part):
                    blocks = [_padded(t, depth) for t, k in zip(texts, kinds) if k == _ARTICLE]
                    if blocks:
                        streams, pages, owner = hosts.setdefault(host, ([], [], []))
                        owner += [len(pages)] * len(blocks)
                        pages.append(np.concatenate(blocks))
                        streams += blocks
                found = []
                for host, (streams, pages, owner) in hosts.items():
                    rank, which, place = suffix_classes(streams, depth)
                    tile = place % depth == 0
                    rank, which, place = rank[tile], which[tile], place[tile]
                    # A class once for each article that holds it.
                    page = np.array(owner)[which]
                    first = np.unique(rank * len(pages) + page, return_index=True)[1]
                    own = _page_hashes(pages)
                    name = _host_key(host)
                    key = _keys(host, streams, which[first], place[first], depth)
                    found.append((np.r_[key, np.full(len(own), name)], np.full(len(key) + len(own), name), np.r_[own[page[first]], own]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["key", "host", "own"])

    return run


def _suffixes(depth: int):
    """row, place, key: what is looked up of a page; tiles inside a declared article, all suffixes of other pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "blocks", 1 << 20):
                rows, places, keys = [], [], []
                for row, (host, texts, kinds) in zip(part.column("row").to_pylist(), _pages(part)):
                    if _ARTICLE in kinds:
                        stream = np.concatenate([_padded(t, depth) for t, k in zip(texts, kinds) if k == _ARTICLE])
                        place = np.arange(0, len(stream), depth)
                    else:
                        stream = _stream(texts)
                        place = np.arange(max(0, len(stream) - depth + 1))
                    rows.append(np.full(len(place), row))
                    places.append(place)
                    keys.append(_keys(host, [stream], np.zeros(len(place), np.int64), place, depth))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(rows), pa.int64()), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(keys), pa.int64())],
                        names=["row", "place", "key"],
                    )

    return run


def _covered(places: list[int], size: int, depth: int) -> np.ndarray:
    """Running count of covered tokens, from 0."""
    covered = np.zeros(size + depth, np.int64)
    for at in places:
        covered[at : at + depth] = 1
    return np.r_[0, np.cumsum(covered)]


def _uncovered(depth: int):
    """The text of every page, given the places of its suffixes that are boilerplate."""

    def text(blocks: str, kinds: str, places: list[int]) -> str:
        if not kinds:
            return ""
        article = _ARTICLE in kinds
        texts = [t for t, k in zip(blocks.split("\n"), kinds) if k == _ARTICLE or not article]
        wanted = [True] * len(texts) if article else [k == _OPEN for k in kinds]
        if places:
            sizes = np.array([len(t.split()) for t in texts])
            room = sizes + -sizes % depth if article else sizes  # a block of an article is filled up
            begin = np.cumsum(room) - room
            before = _covered(places, int(room.sum()), depth)
            gone = before[begin + sizes] - before[begin] >= 0.5 * sizes
            if not article or 2 * sizes[gone].sum() < sizes.sum():
                wanted = [w and not g for w, g in zip(wanted, gone)]
        return "\n".join(t for t, w in zip(texts, wanted) if w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text(b, k, p or []) for b, k, p in zip(*(batch.column(c).to_pylist() for c in ("blocks", "kinds", "places")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def main_text(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; a null or empty page has an empty text.

    Blocks are joined by one line feed, with single spaces inside. Repeated rows stay repeated.
    A null url is a host of its own name, the empty one.
    """
    given = pages.select("page_id", "url", "html")
    kind = given.schema["page_id"].dataType.simpleString()
    parsed = stored(given.mapInArrow(
        _parsed, f"page_id {kind}, url string, blocks string, kinds string"
    ).withColumn("row", F.monotonically_increasing_id()), "blocks")
    outer = parsed.mapInArrow(_evidence(depth), "key long, least long, greatest long")
    boilerplate = outer.groupBy("key").agg(F.min("least").alias("low"), F.max("greatest").alias("high")).filter("low <> high").select("key")
    # Written, so that joins know their sizes: where little repeats, neither suffixes nor pages are shuffled.
    boilerplate = stored(boilerplate, "boilerplate")
    # Partitioned by key alone, both groupings need no further shuffle.
    inner = parsed.mapInArrow(_inner_evidence(depth), "key long, host long, own long").repartition(parts(pages.sparkSession), "key")
    inner = inner.distinct().groupBy("key", "host").agg(F.count("*").alias("n"))
    inner = stored(inner.filter(F.col("n") >= ARTICLES), "articles")
    sizes = inner.filter("key = host").select("host", F.col("n").alias("size"))
    repeated = stored(inner.filter("key <> host").join(sizes, "host").filter("2 * n >= size").select("key"), "repeated")
    # Declared articles are looked up in what repeats inside articles, other pages in what repeats outside.
    inside = F.contains("kinds", F.lit(_ARTICLE))
    covers = "row long, place int, key long"
    covered = parsed.filter(~inside).mapInArrow(_suffixes(depth), covers).join(boilerplate, "key").unionByName(
        parsed.filter(inside).mapInArrow(_suffixes(depth), covers).join(repeated, "key")
    )
    covered = stored(covered.groupBy(F.col("row").alias("of")).agg(F.collect_list("place").alias("places")), "covered")
    judged = parsed.join(covered, F.col("row") == F.col("of"), "left").select("page_id", "url", "blocks", "kinds", "places")
    return judged.mapInArrow(_uncovered(depth), f"page_id {kind}, url string, text string, n_chars long")
