"""Fits that share their passes, against plain versions of the same."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailgrade.operators import blocks, logistic, neighbours, smote, training, trees
from mailgrade.plans import catalog, lifecycle

CLASSES, FITS = 3, 3


@pytest.fixture(scope="module")
def table(spark):
    """Sparse rows with one large raw column, and weights of a whole fit and two folds."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        columns = np.sort(rng.choice(12, rng.integers(0, 7), replace=False))
        values = np.round(rng.normal(size=len(columns)), 2)
        x = dict(zip(columns.tolist(), values.tolist())) | {12: float(rng.integers(0, 3000))}
        score = [x.get(0, 0) * 2 + x.get(3, 0), x[12] / 1500 - 1, x.get(5, 0)]
        rows.append((i, int(np.argmax(score + 0.3 * rng.normal(size=3))), Vectors.sparse(13, x), [1.0, float(i % 2), float((i + 1) % 2)]))
    return spark.createDataFrame(rows, ["id", "priority", "features", "weights"]).repartition(5)


@pytest.fixture(scope="module")
def dense(table):
    rows = sorted(table.collect(), key=lambda r: r["id"])
    return np.array([r["features"].toArray() for r in rows]), np.array([r["priority"] for r in rows]), np.array([r["weights"] for r in rows])


@pytest.fixture(scope="module")
def packed(table):
    return blocks.packed(table, "id", "priority", "weights")


@pytest.mark.parametrize("c", [1.0, 5.0])
def test_all_regressions_are_at_their_minimum(packed, dense, c):
    x, y, w = dense
    for f, found in enumerate(logistic.fit_all(packed, 13, FITS, CLASSES, c)):
        z = x @ found[:-1] + found[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        slope = np.vstack([x.T @ (p * w[:, [f]]) + found[:-1] / c, (p * w[:, [f]]).sum(axis=0)])
        scale = np.sqrt(np.r_[(w[:, [f]] * x**2).sum(axis=0), w[:, f].sum()] * w[:, f].sum())
        assert np.abs(slope / scale[:, None]).max() < 1e-6


def test_uneven_shares_do_not_ask_for_many_passes(spark, monkeypatch):
    """Rows that are nearly parted have far less curvature than its bound; a column that only one fit holds stays at zero in the other."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        x = {int(c): float(v) for c, v in zip(rng.choice(30, 6, replace=False), rng.random(6))} | {30: float(rng.integers(1, 3000))} | ({31: 1.0} if i % 9 == 0 else {})
        rows.append((i, int(x.get(0, 0) + x.get(1, 0) > 0.3) + int(x[30] > 1500), Vectors.sparse(32, x), [1.0, float(i % 9 > 0)]))
    own = blocks.packed(spark.createDataFrame(rows, ["id", "priority", "features", "weights"]).repartition(3), "id", "priority", "weights")
    passes = []
    monkeypatch.setattr(logistic, "summed", lambda *a, plain=logistic.summed, **k: passes.append(1) or plain(*a, **k))
    found = logistic.fit_all(own, 32, 2, CLASSES, 1000.0)
    assert len(passes) < 110
    x, y, w = np.array([r[2].toArray() for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    for f in range(2):
        z = x @ found[f][:-1] + found[f][-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        slope = np.vstack([x.T @ (p * w[:, [f]]) + found[f][:-1] / 1000, (p * w[:, [f]]).sum(axis=0)])
        scale = np.sqrt(np.maximum(np.r_[(w[:, [f]] * x**2).sum(axis=0), w[:, f].sum()], 1e-12) * w[:, f].sum())
        assert np.abs(slope / scale[:, None]).max() < 1e-6
    assert not found[1][31].any()


def test_regression_is_a_spark_model(spark, table, packed, tmp_path):
    found = logistic.fit_all(packed, 13, FITS, CLASSES)[0]
    model = logistic.as_model(spark, found)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    row = table.first()
    z = row["features"].toArray() @ found[:-1] + found[-1]
    shares = training.predict(again, table.filter(F.col("id") == row["id"])).first()["probability"]
    assert shares == pytest.approx((np.exp(z) / np.exp(z).sum()).tolist())


# --- trees ---------------------------------------------------------------------------------------


def test_bins_hold_values_up_to_their_border(table, dense):
    x = dense[0]
    bins = trees.find_bins(table, 13)
    for column in range(13):
        own = bins.borders[bins.first[column] : bins.first[column + 1]]
        assert 0.0 in own and bins.zero[column] == np.searchsorted(own, 0.0)
        found = bins.of(np.full(len(x), column), x[:, column])
        assert (found == np.searchsorted(own, x[:, column])).all()


def _matrix(bins, x):
    return np.stack([bins.of(np.full(len(x), c), x[:, c]) for c in range(x.shape[1])], axis=1).astype(int)


def plain_boosting(bins, x, y, w, ids, how):
    """Every split of every node of every tree tried, one after another."""
    binned = _matrix(bins, x)
    margins, grown = np.zeros((len(y), FITS, CLASSES)), []
    for number in range(how.rounds):
        p = np.exp(margins - margins.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        sampled = trees.drawn(ids, how.seed + 7919 * (number + 1)) < how.rows
        for f in range(FITS):
            for k in range(CLASSES):
                t = f * CLASSES + k
                allowed = trees.drawn(np.arange(13), how.seed * 1_000_003 + number * 1009 + t) < how.columns
                g, h = p[:, f, k] - (y == k), np.maximum(2 * p[:, f, k] * (1 - p[:, f, k]), 1e-16)
                inside = (w[:, f] > 0) & sampled

                def grow(rows, depth):
                    mine = rows & inside
                    total = g[mine].sum(), h[mine].sum()
                    best = (1e-6, None)
                    for c in np.flatnonzero(allowed) if depth < how.depth else ():
                        for last in sorted(set(binned[mine, c]))[:-1]:
                            left = mine & (binned[:, c] <= last)
                            a, b = g[left].sum(), h[left].sum()
                            if min(b, total[1] - b) >= how.least_weight:
                                score = lambda s, q: s * s / (q + how.penalty)
                                gain = round((score(a, b) + score(total[0] - a, total[1] - b) - score(*total)) / 2, 9)
                                if gain > best[0]:
                                    best = (gain, (c, last))
                    if best[1] is None:
                        margins[rows, f, k] += -how.rate * total[0] / (total[1] + how.penalty)
                        return 1
                    c, last = best[1]
                    splits.append((int(c), int(last)))
                    return 1 + grow(rows & (binned[:, c] <= last), depth + 1) + grow(rows & (binned[:, c] > last), depth + 1)

                splits = []
                grow(np.ones(len(y), bool), 0)
                grown.append(sorted(splits))
    return grown, margins


@pytest.mark.parametrize("small", [0, 60, 4096])
def test_boosting_is_that_of_plain_trees(spark, table, packed, dense, monkeypatch, small):
    monkeypatch.setattr(trees, "SMALL", small)
    monkeypatch.setattr(trees, "WRITTEN", 2)
    x, y, w = dense
    ids = np.array([r["h"] for r in table.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    bins, how = trees.find_bins(table, 13), trees.Boosting(rounds=5, depth=3, rate=0.3)
    found = trees.boost(packed, bins, FITS, CLASSES, how)
    want, margins = plain_boosting(bins, x, y, w, ids, how)
    got = [sorted((c, b) for c, b in zip(t.column, t.last) if c >= 0) for r in range(5) for f in range(FITS) for t in found[f][r * CLASSES : (r + 1) * CLASSES]]
    assert got == want and sum(map(len, got)) > 100
    model = trees.TreesModel.of(found[1], True, 13, CLASSES)
    rows = sorted(training.predict(model, table).collect(), key=lambda r: r["id"])
    e = np.exp(margins[:, 1])
    assert np.allclose([r["probability"] for r in rows], e / e.sum(axis=1, keepdims=True), atol=1e-6)


def _nested(tree, node=0):
    """Splits and values of a tree, whatever the order its nodes were opened in."""
    if tree.column[node] < 0:
        return tree.value[node]
    child = tree.left[node]
    return tree.column[node], tree.last[node], tree.border[node], _nested(tree, child), _nested(tree, child + 1)


def test_boosting_of_a_held_table_takes_no_pass_for_a_level(spark, table, packed, monkeypatch):
    bins, how, found, levels = trees.find_bins(table, 13), trees.Boosting(rounds=2, depth=3, rate=0.3), [], []
    monkeypatch.setattr(trees, "SMALL", 30)
    monkeypatch.setattr(trees, "_boosted_level", lambda *a, plain=trees._boosted_level: levels.append(1) or plain(*a))
    for held in (0, 1 << 20):
        monkeypatch.setattr(trees, "HELD_ROWS", held, raising=False)
        found.append([[_nested(t) for t in own] for own in trees.boost(packed, bins, FITS, CLASSES, how)])
        assert bool(levels) == (not held)
        levels.clear()
    assert found[0] == found[1]


def plain_forest(bins, x, y, w, ids, weights, how):
    """Trees as nested splits, each node with the columns it is meant to look at."""
    binned, wanted, grown = _matrix(bins, x), max(1, int(np.sqrt(13))), []
    gini = lambda n: n.sum() - (n**2).sum() / max(n.sum(), 1e-300)
    for t in range(FITS * how.trees):
        f = t // how.trees
        copies = trees._copies(ids, t, how.seed) * (w[:, f] > 0)
        count = lambda rows: np.bincount(y[rows], copies[rows], CLASSES)
        splits, asked, names = [], {0: (np.flatnonzero(copies), 0)}, 1
        while asked:  # a node that finds no split asks again beside the next level
            later = {}
            for node, (rows, attempt) in sorted(asked.items()):
                counts, best = count(rows), (-1, None)
                if (counts > 0).sum() < 2 or len(rows) < how.least_split:
                    continue
                for c in trees._columns_of(13, wanted, t, node, attempt, how.seed):
                    for last in sorted(set(binned[rows, c]))[:-1]:
                        left = rows[binned[rows, c] <= last]
                        if how.least_leaf <= len(left) <= len(rows) - how.least_leaf:
                            a = count(left)
                            gain = round(gini(counts * weights[f]) - gini(a * weights[f]) - gini((counts - a) * weights[f]), 9)
                            if gain > best[0]:
                                best = (gain, (int(c), int(last), left))
                if best[1]:
                    c, last, left = best[1]
                    splits.append((c, last))
                    for child in (left, np.setdiff1d(rows, left)):
                        if (count(child) > 0).sum() > 1:
                            later[names] = (child, 0)
                        names += 1
                elif wanted << attempt < 13:
                    later[node] = (rows, attempt + 1)
            asked = later
        grown.append(sorted(splits))
    return grown


def test_forest_is_that_of_plain_trees(table, packed, dense):
    x, y, w = dense
    ids = np.array([r["h"] for r in table.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    bins, how = trees.find_bins(table, 13), trees.Forest(trees=4, depth=30)
    weights = np.array([[1.0, 2.0, 0.5]] * FITS)
    found, importance = trees.plant(packed, bins, FITS, CLASSES, weights, how)
    want = plain_forest(bins, x, y, w, ids, weights, how)
    got = [sorted((c, b) for c, b in zip(t.column, t.last) if c >= 0) for own in found for t in own]
    assert got == want and sum(map(len, got)) > 100
    assert np.allclose(importance.sum(axis=1), 1)
    for own in found:
        for t in own:
            leaves = [v for c, v in zip(t.column, t.value) if c < 0]
            assert np.allclose(np.sum(leaves, axis=1), 1)


def test_whole_trees_of_a_task_are_those_of_passes(table, packed, monkeypatch):
    bins, how, found = trees.find_bins(table, 13), trees.Forest(trees=5), []
    passes = []
    monkeypatch.setattr(trees, "_best_forest", lambda *a, plain=trees._best_forest: passes.append(1) or plain(*a))
    for cells in (0, 1 << 20):
        monkeypatch.setattr(trees, "FOREST_CELLS", cells, raising=False)
        grown, importance = trees.plant(packed, bins, FITS, CLASSES, np.array([[1.0, 2.0, 0.5]] * FITS), how)
        found.append((grown, importance.tolist()))
        assert bool(passes) == (not cells)
        passes.clear()
    assert found[0] == found[1] and sum(len(t.column) for own in found[0][0] for t in own) > 100


def test_forest_draws_columns_once_and_looks_cells_up_either_way(table, packed, dense, monkeypatch):
    bins, how, found = trees.find_bins(table, 13), trees.Forest(trees=2), []
    own, = [trees.Binned(np.arange(240), dense[1].astype(np.int32), dense[2], np.cumsum(np.r_[0, (m != bins.zero).sum(axis=1)]),
                         np.concatenate([(np.flatnonzero(r != bins.zero) << 8 | r[r != bins.zero]).astype(np.int32) for r in m]), m.astype(np.uint8)) for m in [_matrix(bins, dense[0])]]
    tree = trees.Tree(value=[[0.0] * CLASSES])
    children = tree.split(0, 12, int(np.median(own.bins[:, 12])), 0.0)
    attempt = np.array([-1, 0, 0])
    drawn, known = [], {}
    monkeypatch.setattr(trees, "_columns_of", lambda *a, plain=trees._columns_of: drawn.append(a) or plain(*a))
    for few in (0, 16):
        monkeypatch.setattr(trees, "_FEW", few)
        found.append([b.to_pylist() for b in trees._forest_cells(own, trees.Grove.of([tree]), attempt, [0], bins, CLASSES, 3, how, known)])
    assert found[0] == found[1] and len(found[0][0]) > 10
    assert len(drawn) == len(children)


def test_trees_are_saved_and_loaded(table, packed, tmp_path):
    bins = trees.find_bins(table, 13)
    found, importance = trees.plant(packed, bins, 1, CLASSES, np.ones((1, CLASSES)), trees.Forest(trees=3))
    model = trees.TreesModel.of(found[0], False, 13, CLASSES, importance[0])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = trees.TreesModel.load(str(tmp_path / "m"))
    pick = lambda m: sorted((r["id"], tuple(r["probability"])) for r in training.predict(m, table).collect())
    assert pick(model) == pick(again)
    assert again.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_order_of_rows_does_not_matter(table):
    fits = []
    for n in (2, 7):
        own = blocks.packed(table.repartition(n), "id", "priority", "weights")
        bins = trees.find_bins(table, 13)
        fits.append((trees.boost(own, bins, 1, CLASSES, trees.Boosting(rounds=2, depth=2)), trees.plant(own, bins, 1, CLASSES, np.ones((1, 3)), trees.Forest(trees=2))[0]))
    assert fits[0] == fits[1]


# --- measuring -----------------------------------------------------------------------------------


@pytest.mark.parametrize("recipe", [training.logistic_regression(), training.random_forest(5, 6), training.boosted_trees(3, 2)], ids=["lr", "rf", "gbt"])
def test_measured_models_beat_chance(table, recipe):
    model, summary = training.train_and_measure("m", recipe, table.drop("weights"), smote=True, folds=3)
    row = summary.first()
    assert row["accuracy"] > 0.45 and row["cv_accuracy_mean"] > 0.45 and row["model"] == "m"
    assert training.cross_validate(recipe, table.drop("weights"), 3).count() == 3


def test_published_settings():
    lr, rf, gbt = (r for _, r, _ in lifecycle.CANDIDATES)
    assert (lr, rf, gbt) == (training.logistic_regression(c=5.0), training.random_forest(), training.boosted_trees())
    assert training.logistic_regression() == training.Logistic(1.0, 1000)
    assert rf.how == trees.Forest(200, 30, 5, 2) and rf.balanced
    assert gbt.how == trees.Boosting(300, 6, 0.1, 0.8, 0.8, 1.0, 1.0)
    assert [smoted for _, _, smoted in lifecycle.CANDIDATES] == [False, True, True]
    assert training.feature_pipeline().getStages()[1].getOrDefault("maxTerms") == 5000
    assert catalog.QUERIES["train_gbt"]


# --- neighbours ----------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [0.0, 5.0], ids=["no telling column", "one telling column"])
def test_neighbours_are_exact(spark, spread):
    rng = np.random.default_rng(2)
    rows, whole = [], np.zeros((300, 21))
    for i in range(300):
        columns = np.sort(rng.choice(20, rng.integers(0, 6), replace=False))
        values = np.round(rng.random(len(columns)), 1)
        if spread:
            columns, values = np.r_[columns, 20], np.r_[values, spread * rng.integers(0, 60)]
        whole[i, columns] = values
        rows.append((i, int(rng.integers(0, 2)) if i < 297 else 2, columns.tolist(), values.tolist()))
    given = spark.createDataFrame(rows, "_row long, _class int, _i array<int>, _v array<double>")
    got = {r["_row"]: [n["other"] for n in r["_near"]] for r in neighbours.nearest(given, 5, F.col("_row"), block=16).collect()}
    kind = np.array([r[1] for r in rows])
    far = np.round(((whole[:, None] - whole[None]) ** 2).sum(axis=2), 6)
    for i in range(300):
        order = [j for j in np.lexsort((np.arange(300), far[i])) if j != i and kind[j] == kind[i]]
        assert got[i] == order[:5]


def test_synthetic_rows_lie_next_to_their_origin(spark):
    rng = np.random.default_rng(9)
    rows = [(f"r{i}", 0 if i < 90 else 1, Vectors.dense(rng.normal(size=3))) for i in range(130)]
    given = spark.createDataFrame(rows, ["id", "priority", "features"])
    made = smote.synthetic(given, block=8).collect()
    assert len(made) == 50 and {r["priority"] for r in made} == {1}
    points = {r[0]: r[2].toArray() for r in rows if r[1] == 1}
    for r in made:
        base = points[r["id"].split("+")[0]]
        step = r["features"].toArray() - base
        near = sorted(np.linalg.norm(p - base) for k, p in points.items() if k != r["id"].split("+")[0])[4]
        assert np.linalg.norm(step) <= near + 1e-9
        assert any(np.linalg.norm(np.cross(step, p - base)) < 1e-9 for p in points.values())


def _visits(spark, monkeypatch, rows, k, block):
    """Neighbours of ``rows``, and how many rows went to another block."""
    visits = spark.sparkContext.accumulator(0)
    whole = neighbours._visiting

    def counted(*given):
        run = whole(*given)

        def told(batches):
            for batch in run(batches):
                visits.add(sum(len(x) // 4 for x in batch.column("place").to_pylist()))
                yield batch

        return told

    monkeypatch.setattr(neighbours, "_visiting", counted)
    given = spark.createDataFrame(rows, "_row long, _class int, _i array<int>, _v array<double>")
    return {r["_row"]: [n["other"] for n in r["_near"]] for r in neighbours.nearest(given, k, F.col("_row"), block=block).collect()}, visits.value


def test_a_widest_column_of_few_values_does_not_ask_for_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    place = np.round(rng.random(2000) * 1000, 3)
    rows = [(i, 0, [0, 1], [float(i % 2) * 5000, float(place[i])]) for i in range(2000)]
    got, visits = _visits(spark, monkeypatch, rows, 5, 16)
    for i in range(0, 2000, 40):
        far = np.round((place - place[i]) ** 2, 6)
        assert got[i] == [j for j in np.lexsort((np.arange(2000), far)) if j != i and j % 2 == i % 2][:5]
    assert visits < 10 * len(rows)


def test_copies_meet_the_first_of_their_kind_only(spark, monkeypatch):
    rows = [(i, 0, [0, 1], [1.0, 2.0]) if i < 1500 else (i, 0, [0], [float(i)]) for i in range(1600)]
    got, visits = _visits(spark, monkeypatch, rows, 5, 16)
    assert all(got[i] == [j for j in range(6) if j != i][:5] for i in range(1500))
    assert visits < 10 * len(rows)
