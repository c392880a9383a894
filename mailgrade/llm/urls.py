"""URL verdicts: host and path rules, and boosted trees on lexical features for what no rule decides.

The trees learn from labelled URLs, here those that a rule decides. Everything is DataFrame
functions. A bounded, hash-drawn sample of distinct labelled URLs is cut into bins; after that a
tree level is one grouped sum of gradients by (node, feature, bin), of which the driver sees at
most nodes x features x bins rows. Gradients are whole numbers, so the trees do not depend on
how the rows are dealt. Scoring is a projection: trees are CASE expressions over bins.

Features: lengths, depth, digit share, entropy of the bytes, parameters, labels and hyphens of the
host, and for its last one and last two labels how often they were seen and the share that was
blocked. In training these two come from the other folds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrade.llm.common import once, stored

#: Distinct labelled URLs that are learned from, about.
SAMPLE = 20_000
ROUNDS, DEPTH, RATE, PENALTY, LEAST_WEIGHT = 20, 3, 0.3, 1.0, 1.0
BINS, FOLDS, SMOOTHING = 16, 5, 5
#: Gradients are counted in steps of this.
UNIT = 1 << 20
#: Rounds after which margins are written, so that no plan holds more trees.
WRITTEN = 5

BLOCK, ALLOW = "block", "allow"
NUMERIC = ("url_chars", "host_chars", "path_chars", "depth", "digit_milli", "entropy_milli", "params", "labels", "hyphens")
SUFFIXES = ("suffix", "suffix2")
#: Suffix statistics are coarse, so that a fold's own counts can't be told from them.
STEPS = 20
FEATURES = (*NUMERIC, *(f"{s}_{what}" for s in SUFFIXES for what in ("seen", "blocked")))


@dataclass(frozen=True)
class Rule:
    """``place`` is a host and the path's beginning, such as ``example.com/de/``."""

    action: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return self.place[len(self.host):]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def split(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and query of a URL; empty where there are none, or no ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.char_length(host) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substr(after, F.char_length(path) + 1), r"^\?([^#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path, query


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct of place and action (ties: the first by text), or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,action:string>")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.place), r.place)):
        told = F.struct(F.lit(r.place).alias("rule"), F.lit(r.action).alias("action"))
        out = F.when(r.fits(host, path), told) if out is None else out.when(r.fits(host, path), told)
    return out


def entropy(text: Column) -> Column:
    """Bits per byte of the UTF-8 bytes of ``text``; 0 for an empty text."""
    # One character stands for one byte, so there are at most 256 different ones.
    wide = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    n = F.char_length(wide)
    times = lambda c: (n - F.char_length(F.replace(wide, c, F.lit("")))).cast("double")
    seen = F.filter(F.array_distinct(F.split(wide, "")), lambda c: c != "")
    total = F.aggregate(F.transform(seen, times), F.lit(0.0), lambda a, x: a + x * F.log2(x))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def described(urls: DataFrame, url: str) -> DataFrame:
    """Adds host, path, the numeric features and the host's last one and last two labels."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path, query = split(F.col(url))
    cut = once(urls, _cut=F.struct(host.alias("host"), path.alias("path"), query.alias("query")))
    cut = cut.select(*urls.columns, "_cut.host", "_cut.path", "_cut.query")
    digits = F.char_length(text) - F.char_length(F.translate(text, "0123456789", ""))
    count = lambda column, c: F.char_length(column) - F.char_length(F.replace(column, F.lit(c), F.lit("")))
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    columns = {
        "url_chars": F.char_length(text),
        "host_chars": F.char_length(host),
        "path_chars": F.char_length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "digit_milli": F.floor(1000 * digits / F.greatest(F.char_length(text), F.lit(1))),
        "entropy_milli": F.floor(1000 * entropy(text)),
        "params": F.when(F.char_length(query) > 0, count(query, "&") + 1).otherwise(0),
        "labels": F.when(F.char_length(host) > 0, count(host, ".") + 1).otherwise(0),
        "hyphens": count(host, "-"),
        "suffix": F.substring_index(host, ".", -1),
        "suffix2": F.substring_index(host, ".", -2),
    }
    kinds = {c: v if c in SUFFIXES else v.cast("long") for c, v in columns.items()}
    return cut.select(*urls.columns, "host", "path", *[v.alias(c) for c, v in kinds.items()])


# ---------------------------------------------------------------- learning


@dataclass
class Tree:
    """A heap of splits (feature, last bin that goes left; None for a leaf) and the values of its leaves."""

    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, at: int = 0) -> Column:
        """The node that a row of bins has come to."""
        if at not in self.splits:
            return F.lit(at)
        feature, last = self.splits[at]
        return F.when(F.col(feature) <= last, self.node(2 * at + 1)).otherwise(self.node(2 * at + 2))

    def value(self, at: int = 0) -> Column:
        if at not in self.splits:
            return F.lit(self.values[at])
        feature, last = self.splits[at]
        return F.when(F.col(feature) <= last, self.value(2 * at + 1)).otherwise(self.value(2 * at + 2))


@dataclass
class Model:
    """Trees over bins, the bins' borders, and the suffixes of the sample (as many rows at most)."""

    trees: list[Tree]
    cuts: dict[str, list[float]]
    suffixes: dict[str, DataFrame]
    share: float

    def margin(self) -> Column:
        return sum((t.value() for t in self.trees), F.lit(0.0))


def _sampled(labelled: DataFrame, url: str, wanted: int) -> DataFrame:
    """About ``wanted`` distinct URLs at most, by a hash; a URL with both labels counts as blocked."""
    n = labelled.count()
    low = float(-(2**63))
    share = min(1.0, wanted / n) if n else 0.0
    drawn = labelled.filter(F.xxhash64(F.col(url), F.lit(11)).cast("double") - low < share * 2.0**64)
    return drawn.groupBy(F.col(url).alias("url")).agg(F.max(F.col("blocked").cast("long")).alias("blocked"))


def _rates(rows: DataFrame, suffix: str, *more: str) -> DataFrame:
    return rows.groupBy(F.col(suffix).alias("of_suffix"), *more).agg(F.count("*").alias("n"), F.sum("blocked").alias("bad"))


def _with_rates(rows: DataFrame, suffix: str, n: Column, bad: Column, share: float) -> DataFrame:
    blocked = F.round(STEPS * (bad + SMOOTHING * share) / (n + SMOOTHING)).cast("long")
    return rows.withColumns({f"{suffix}_seen": F.floor(F.log2(n + 1)).cast("long"), f"{suffix}_blocked": blocked})


def train(labelled: DataFrame, url: str = "url", wanted: int = SAMPLE) -> Model:
    """Fit on ``labelled`` (a URL column and a boolean ``blocked``)."""
    sample = stored(described(_sampled(labelled, url, wanted).coalesce(4), "url"), "url-sample")
    first = sample.agg(F.count("*").alias("n"), F.avg("blocked").alias("share")).first()
    share = first["share"] or 0.0
    model = Model([], {f: [] for f in FEATURES}, {s: _rates(sample, s) for s in SUFFIXES}, share)
    if not 0 < share < 1:
        if share:  # all labelled URLs are blocked
            model.trees.append(Tree(values={0: 1.0}))
        return model
    rows = sample.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(12)), F.lit(FOLDS)))
    for s in SUFFIXES:
        own = _rates(rows, s, "fold").select(F.col("of_suffix").alias("own_suffix"), F.col("fold").alias("own_fold"), F.col("n").alias("own_n"), F.col("bad").alias("own_bad"))
        joined = rows.join(F.broadcast(model.suffixes[s]), F.col(s) == F.col("of_suffix"))
        joined = joined.join(F.broadcast(own), (F.col(s) == F.col("own_suffix")) & (F.col("fold") == F.col("own_fold")))
        n = F.floor((F.col("n") - F.col("own_n")) * FOLDS / (FOLDS - 1))  # as many as all folds would give
        rows = _with_rates(joined, s, n, F.floor((F.col("bad") - F.col("own_bad")) * FOLDS / (FOLDS - 1)), share).drop("of_suffix", "n", "bad", "own_suffix", "own_fold", "own_n", "own_bad")
    rows = rows.select("blocked", *FEATURES)
    steps = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = rows.agg(*[F.percentile(f, steps).alias(f) for f in FEATURES]).first()
    model.cuts = {f: sorted(set(found[f])) for f in FEATURES}
    rows = binned(rows, model).groupBy("blocked", *FEATURES).agg(F.count("*").alias("n")).coalesce(4)
    rows = stored(rows.withColumn("margin", F.lit(0.0)), "url-bins")
    waiting: list[Tree] = []
    for _ in range(ROUNDS):
        tree = _tree(rows.withColumn("margin", F.col("margin") + sum((t.value() for t in waiting), F.lit(0.0))))
        model.trees.append(tree)
        waiting.append(tree)
        if len(waiting) == WRITTEN:
            rows = stored(rows.withColumn("margin", F.col("margin") + sum((t.value() for t in waiting), F.lit(0.0))), "url-bins")
            waiting = []
    return model


def binned(rows: DataFrame, model: Model) -> DataFrame:
    """Each feature's value replaced by the number of borders below it."""
    def place(f):
        return sum(((F.col(f) > c).cast("int") for c in model.cuts[f]), F.lit(0)).alias(f)

    return rows.select(*[c for c in rows.columns if c not in FEATURES], *[place(f) for f in FEATURES])


def _tree(rows: DataFrame) -> Tree:
    """One tree; a level is one grouped sum."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    grades = rows.withColumns({
        "g": F.round((p - F.col("blocked")) * UNIT).cast("long") * F.col("n"),
        "h": F.round(p * (1 - p) * UNIT).cast("long") * F.col("n"),
    })
    tree, open_nodes = Tree(), [0]
    gain = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + PENALTY)
    for level in range(DEPTH):
        each = F.posexplode(F.array(*FEATURES)).alias("feature", "bin")
        sums = grades.select(tree.node().alias("node"), "g", "h", each).filter(F.col("node").isin(open_nodes))
        sums = sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        parts: dict[int, dict[int, list]] = {}
        for r in sorted(sums, key=lambda r: (r["node"], r["feature"], r["bin"])):
            parts.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
        more = []
        for node, features in parts.items():
            whole_g, whole_h = (sum(x[i] for x in features[0]) for i in (1, 2))
            tree.values[node] = round(-RATE * whole_g / (whole_h + PENALTY * UNIT), 9)
            best = (1e-9, None)
            for number, bins in features.items():
                g = h = 0
                for last, own_g, own_h in bins[:-1]:
                    g, h = g + own_g, h + own_h
                    if min(h, whole_h - h) >= LEAST_WEIGHT * UNIT:
                        won = gain(g, h) + gain(whole_g - g, whole_h - h) - gain(whole_g, whole_h)
                        if won > best[0]:
                            best = (won, (FEATURES[number], last, g, h))
            if best[1]:
                feature, last, g, h = best[1]
                tree.splits[node] = (feature, last)
                # A last level's sums are known from its split; others are read again with their own bins.
                for child, (cg, ch) in ((2 * node + 1, (g, h)), (2 * node + 2, (whole_g - g, whole_h - h))):
                    tree.values[child] = round(-RATE * cg / (ch + PENALTY * UNIT), 9)
                    more.append(child)
        open_nodes = more
        if not open_nodes:
            break
    return tree


# ---------------------------------------------------------------- verdicts


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", labelled: DataFrame | None = None, wanted: int = SAMPLE) -> DataFrame:
    """``key``, host, path, rule, verdict for every row.

    A rule fits its host and all subdomains where the path begins with the rule's; the longest
    wins. Where none fits, the trees decide: blocked if more likely than not. They learn from
    ``labelled`` (the URL column and a boolean ``blocked``), or from the rows that a rule decides.
    Without a labelled URL everything is allowed; if all are of one label, that is the verdict.
    Null, empty and scheme-less URLs have an empty host and path and are judged like any other
    text. Repeated rows stay repeated; ties between rules of one length go to the first by text.
    Rules are part of the query's text and should be few. Other columns are not read.
    """
    given = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    if labelled is None:
        host, path, _ = split(F.col("url"))
        cut = once(given.select("url"), _cut=F.struct(host.alias("host"), path.alias("path")))
        told = cut.select("url", ruled(F.col("_cut.host"), F.col("_cut.path"), rules).alias("told")).filter(F.col("told").isNotNull())
        labelled = told.select("url", (F.col("told.action") == BLOCK).alias("blocked"))
    else:
        labelled = labelled.select(F.col(url).alias("url"), "blocked").dropna()
    model = train(labelled, "url", wanted)
    rows = described(given, "url")
    for s in SUFFIXES:
        # At most a row for each URL of the sample.
        rates = F.broadcast(model.suffixes[s])
        joined = rows.join(rates, F.col(s) == F.col("of_suffix"), "left")
        rows = _with_rates(joined, s, F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0)), model.share).drop("of_suffix", "n", "bad")
    rows = binned(rows, model).withColumn("told", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("told.action"), F.when(model.margin() > 0, BLOCK).otherwise(ALLOW))
    return rows.select(F.col("key").alias(key), "host", "path", F.col("told.rule").alias("rule"), verdict.alias("verdict"))
