import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from mailgrade.llm import codes

ROW = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    T.StructField("code", T.StringType()), T.StructField("key", T.StringType()), T.StructField("vector", T.StringType()),
])


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "k", "v") for r in rows], ROW)


def plain(rows):
    """Rounds over all entries in Python's whole numbers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    last = lambda r: (r[0] is None, r[0] or 0, r[1])
    whole = [[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda j: last(kept[j]))[:16]
    each = width // 8
    cut = lambda v, p: v[p * each : (p + 1) * each]
    books = [[cut(whole[j], p) for j in order] for p in range(8)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(6):
        told = [[nearest(v, p)[1] for p in range(8)] for v in whole]
        for p in range(8):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, t in zip(whole, told) if t[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, label), v in zip(kept, whole):
        told = [nearest(v, p) for p in range(8)]
        out.append((i, "".join("%02x" % e for _, e in told), sum(d for d, _ in told), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=repr)


def got(spark, rows):
    found = codes.compressed(table(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_nearest_is_exact_with_ties_to_the_lower_index():
    r = np.random.default_rng(1)
    for t in range(200):
        width, scale = int(r.integers(1, 9)), int(r.choice([1, 2, 5, 500]))
        v, b = r.integers(-scale, scale + 1, (40, width)), r.integers(-scale, scale + 1, (16, width))
        if t % 10 == 0:
            v, b = v.astype(object) * 10**22, b.astype(object) * 10**22
        index, far = codes.nearest(v, b)
        each = ((v.astype(object)[:, None] - b.astype(object)[None]) ** 2).sum(axis=2)
        assert [(min(x), list(x).index(min(x))) for x in each] == list(zip(far.tolist(), index.tolist()))


@pytest.mark.parametrize("width", [8, 24])
def test_same_as_plain_rounds(spark, width):
    r = random.Random(width)
    rows = [(i, [r.choice([-0.5, 0.25, 0.0003, r.gauss(0, 1)]) for _ in range(width)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(0, list(rows[5][1]), 1), (None, list(rows[6][1]), 2), (None, [9.0] * width, None), (300, [1e12] * width, 3), (301, [-1e12] + [0.0] * (width - 1), 3)]
    r.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_unusable_vectors_unlike_lengths_and_few_rows(spark):
    bad = [(90, None, 1), (91, [1.0] * 7 + [None], 1), (92, [math.nan] * 8, 1), (93, [math.inf] * 8, 1), (94, [-math.inf] + [0.0] * 7, 1)]
    few = [(1, [1.0, 2.0, 3.0], None), (2, [], None), (3, [0.5] * 11, 4)]
    assert got(spark, bad + few) == plain(few)
    assert got(spark, bad) == [] and got(spark, []) == []
    assert got(spark, [(1, [], 1)]) == plain([(1, [], 1)])


def test_huge_components_stay_defined(spark):
    rows = got(spark, [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), *[(i, [0.0] * 8, 1) for i in range(3, 40)]])
    assert len(rows) == 39 and all(0 <= r[2] <= codes.LONGEST and 0 <= r[3] <= codes.LONGEST for r in rows)
