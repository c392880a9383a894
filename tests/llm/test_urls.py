import math
import re

import pytest
from pyspark.sql import functions as F

from mailgrade.llm import urls
from mailgrade.llm.queries import RULES

ROWS = [
    None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.Net/en/1?x=1#y", "http://example.net/fr/", "http://badexample.net/en/", "x://net/", "x://net",
    "https://a.b.example.com/de/q/r.html", "https://example.com.de/de/", "http://é.org/fr/ü?a&b&c", "http://org/fr", "a://b://c.net/", "x://user@example.net:80/en/",
    "http://example.net?/en/", "http://example.net#/en/", "http://a.net/\n/en/", "http://" + "a" * 200_000 + ".net/" + "/x" * 200_000, "http://example.net/en/", "http://example.net/en/",
]


def plain(url):
    """Host, path and the longest fitting rule, in Python."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.place), default=None)
    return host, path, best and best.place, best and best.action


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(ROWS)], "page_id long, url string, host string, n string, rule string")


def test_rules_hosts_and_paths(spark, pages):
    got = {r["page_id"]: r for r in urls.judge(pages, RULES).collect()}
    assert len(got) == len(ROWS)
    for i, url in enumerate(ROWS):
        host, path, rule, action = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == action if action else got[i]["verdict"] in ("allow", "block")


def test_nothing_or_one_label_to_learn_from(spark, pages):
    assert urls.judge(pages.limit(0), RULES).count() == 0
    none = pages.filter("url IS NULL OR url = ''")
    assert {r["verdict"] for r in urls.judge(none, RULES).collect()} == {"allow"}
    rest = spark.createDataFrame([(1, "x://a.b/"), (2, "x://c.net/")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(rest, RULES).collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge(rest, []).collect()} == {"allow"}


def test_features(spark):
    text = "https://www.a-b.example.com/x/yy//z9?k=1&l=22&m#t"
    row = urls.described(spark.createDataFrame([(text,)], "url string"), "url").first()
    shares = [text.count(c) / len(text) for c in set(text)]
    assert row["entropy_milli"] == math.floor(-1000 * sum(p * math.log2(p) for p in shares))
    assert (row["depth"], row["params"], row["labels"], row["hyphens"]) == (3, 3, 4, 1)
    assert row["digit_milli"] == 1000 * 4 // len(text)
    assert (row["suffix"], row["suffix2"]) == ("com", "example.com")


def plain_tree(rows):
    """One tree over (bins, blocked, copies, margin) by trying every split."""
    tree = urls.Tree()
    grades = []
    for bins, y, n, m in rows:
        p = 1 / (1 + math.exp(-m))
        grades.append((bins, round((p - y) * urls.UNIT) * n, round(p * (1 - p) * urls.UNIT) * n))
    score = lambda g, h: (g / urls.UNIT) ** 2 / (h / urls.UNIT + urls.PENALTY)

    def grow(node, own, depth):
        whole_g, whole_h = sum(x[1] for x in own), sum(x[2] for x in own)
        tree.values[node] = round(-urls.RATE * whole_g / (whole_h + urls.PENALTY * urls.UNIT), 9)
        best = (1e-9, None)
        for f in range(len(urls.FEATURES)) if depth < urls.DEPTH else ():
            for last in sorted({x[0][f] for x in own})[:-1]:
                left = [x for x in own if x[0][f] <= last]
                g, h = sum(x[1] for x in left), sum(x[2] for x in left)
                won = score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h)
                if min(h, whole_h - h) >= urls.LEAST_WEIGHT * urls.UNIT and won > best[0]:
                    best = (won, (f, last))
        if best[1]:
            f, last = best[1]
            tree.splits[node] = (urls.FEATURES[f], last)
            grow(2 * node + 1, [x for x in own if x[0][f] <= last], depth + 1)
            grow(2 * node + 2, [x for x in own if x[0][f] > last], depth + 1)

    grow(0, grades, 0)
    return tree


def test_a_tree_is_that_of_brute_force(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.col("url").rlike("en/[0-9]*[13579]").alias("blocked"))
    sample = urls.described(given.withColumn("blocked", F.col("blocked").cast("long")), "url")
    model = urls.Model([], {f: [] for f in urls.FEATURES}, {}, 0.5)
    for f in urls.NUMERIC:
        model.cuts[f] = sorted(set(sample.agg(F.percentile(f, F.array(*[F.lit(k / 8) for k in range(1, 8)])).alias("p")).first()["p"]))
    wide = sample.withColumns({f: F.lit(0).cast("long") for f in urls.FEATURES if f not in urls.NUMERIC})
    rows = urls.binned(wide.select("blocked", *urls.FEATURES), model).withColumns({"n": F.lit(2), "margin": F.col("depth") / 4 - 0.3})
    plain_rows = [([r[f] for f in urls.FEATURES], r["blocked"], r["n"], r["margin"]) for r in rows.collect()]
    got, want = urls._tree(rows), plain_tree(plain_rows)
    assert got.splits == want.splits and len(got.splits) > 2
    assert all(abs(got.values[k] - v) < 1e-8 for k, v in want.values.items())


def test_held_out_accuracy_and_order_of_rows(spark):
    """A label that follows from the address, on addresses that training never saw."""
    made = [(f"https://{h}{i}.example.{t}/{'1' * (i % 9)}/{i}", h == "bet-" or t == "biz") for i in range(250) for h in ("bet-", "news") for t in ("com", "biz", "org")]
    rows = spark.createDataFrame(made, "url string, blocked boolean").withColumn("held", F.crc32(F.col("url").cast("binary")) % 3 == 1)
    train = rows.filter("NOT held").drop("held")
    held = rows.filter("held").withColumn("page_id", F.monotonically_increasing_id())
    got = urls.judge(held, [], labelled=train).join(held, "page_id")
    right = got.filter((F.col("verdict") == "block") == F.col("blocked")).count()
    assert right >= 0.95 * held.count()
    a, b = urls.train(train.repartition(3)), urls.train(train.repartition(7))
    assert a.trees == b.trees and a.cuts == b.cuts
    assert len(a.trees) == urls.ROUNDS


def test_main_path_has_no_python(spark, sf_dir):
    plan = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
