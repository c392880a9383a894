import hashlib
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from mailgrade.llm import intervals, periods
from tests.llm.helpers import awkward, docs


def plain_runs(x):
    """Every stretch of every period, the smallest period of each."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    top = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    told = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *told, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(kept))


def made(r, n, letters):
    """Words over a small alphabet with planted, sometimes broken and nested, repetitions."""
    x = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n > 8:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            part = x[a : a + p]
            if r.random() < 0.5:
                own = max(1, len(part) // 3)
                part = [part[i % own] for i in range(len(part))]
                part[-1] = r.choice([part[-1], 9])
            stop = r.randint(a, n)
            x[a:stop] = [part[i % len(part)] for i in range(stop - a)]
    return x


def test_runs_are_those_of_brute_force():
    r, total = random.Random(5), 0
    for _ in range(400):
        batch = [made(r, r.randint(0, 140), r.randint(1, 4)) for _ in range(r.randint(1, 4))]
        lengths = np.array([len(x) for x in batch])
        b, e, q = periods.runs(np.array([c for x in batch for c in x], np.int64), lengths)
        want, at = [], 0
        for x in batch:
            want += [(s + at, z + at, p) for s, z, p in plain_runs(x)]
            at += len(x)
        assert list(zip(b.tolist(), e.tolist(), q.tolist())) == want
        total += len(want)
    assert total > 500


def test_successor_and_extensions():
    r = np.random.default_rng(3)
    values = r.permutation(500)
    w = intervals.Wavelet(values, 9)
    low = r.integers(0, 500, 200)
    high = low + r.integers(0, 500 - low + 1)
    limit = r.integers(0, 500, 200)
    below = w.below(low, high, limit)
    for a, z, x, n in zip(low, high, limit, below):
        inside = np.sort(values[a:z])
        assert n == (inside < x).sum()
        if n < len(inside):
            assert w.nth(np.array([a]), np.array([z]), np.array([n]))[0] == inside[n]
    x = r.integers(0, 2, 300)
    names = intervals.Suffixes(x, np.array([120, 180]))
    pairs = [(i, j) for i, j in r.integers(0, 300, (300, 2)) if i < j and (i < 120) == (j < 120)]
    i, j = np.array(pairs).T
    ahead, behind = names.ahead(i, j), names.behind(i, j)
    for a, b, f, g in zip(i, j, ahead, behind):
        end, start = (120, 0) if a < 120 else (300, 120)
        n = 0
        while b + n < end and x[a + n] == x[b + n]:
            n += 1
        m = 0
        while a - m > start and x[a - m - 1] == x[b - m - 1]:
            m += 1
        assert (f, g) == (n, m)


def texts():
    r = random.Random(8)
    repeated = [" ".join(f"w{c}" for c in made(r, r.randint(1, 200), 3)) for _ in range(120)]
    return awkward() + repeated + ["a " * 5, "a " * 6, "a b c " * 4, "a b c " * 3 + "a b", "x y\u00a0z " * 9, "la " * 30000]


def test_whole_rows(spark):
    given = texts()
    got = {r["doc_id"]: tuple(r) for r in periods.periodic_runs(docs(spark, given), tails=True).collect()}
    assert len(got) == len(given)
    assert sum(crc32(str(i).encode()) % 10 == 0 for i in got) > 5
    for i, text in enumerate(given):
        # One period of one word needs no search over all periods.
        if len(text or "") < 50_000:
            assert got[i] == plain_row(i, text)
    assert got[len(given) - 1][1:6] in {(1, 0, 30000, 1, 30_000_000)}


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = docs(spark, ["a b " * 20] * 3, ids=[None, 7, 7])
    got = sorted(map(tuple, periods.periodic_runs(rows, tails=True).collect()), key=repr)
    assert got == sorted([plain_row(None, "a b " * 20), *[plain_row(7, "a b " * 20)] * 2], key=repr)
    assert periods.periodic_runs(docs(spark, [])).count() == 0


def test_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") < 5000)
    got = {r["doc_id"]: tuple(r) for r in periods.periodic_runs(rows, tails=True).collect()}
    for r in rows.collect():
        assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])
