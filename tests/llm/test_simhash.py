import numpy as np
import pytest
import xxhash

from mailgrade.llm import components, simhash
from tests.llm.helpers import awkward, docs, prose


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    texts = awkward() + [prose(9, 200)] + [prose(9, 200) + f" {w}" for w in "abcdefgh"]
    ids = list(range(len(texts)))
    ids[3] = None
    got = sorted(simhash.near_duplicates(docs(spark, texts, ids)).collect(), key=str)
    fps = [plain(t) for t in texts]
    want = brute(fps, ids, 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == sorted(zip(ids, signed, want), key=str)


def test_spark_hash_is_the_contracts(spark):
    assert spark.sql("select xxhash64('ab cd ef') h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"ab cd ef", 42)


@pytest.mark.parametrize(("distance", "group"), [(2, 8192), (2, 3), (3, 8192), (4, 3)])
def test_links_connect_all_within_distance(spark, distance, group):
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            flips = r.choice(64, int(r.integers(1, 5)), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in components.components(simhash.links(frame, distance, group)).collect()}
    want = brute(fps, list(range(len(fps))), distance)
    have = [roots.get(f, ("alone", f)) for f in fps]
    assert {tuple(i for i, x in enumerate(want) if x == y) for y in set(want)} == {tuple(i for i, x in enumerate(have) if x == y) for y in set(have)}


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)], "a long, b long")
    assert {r["root"] for r in components.components(links).collect()} == {0}
