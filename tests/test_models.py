"""Boosting, logistic grids and variational sequence models against brute force and Spark ML."""

import itertools
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.operators import boost, forest, hmm, learn, logistic, sums
from regionflow.plans import adapter as ad


# --- boosting


def plain_trees(bins, y, row, p):
    """Trees of the same bins, grown node by node over all rows at once."""
    n, feats = bins.shape
    margin, out = np.zeros(n), []
    soft = lambda g: math.copysign(max(abs(g) - p["reg_alpha"], 0), g)
    for nth in range(p["n_estimators"]):
        prob = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, p["scale_pos_weight"], 1.0)
        g, h = (prob - y) * w, prob * (1 - prob) * w
        used = boost.drawn(row, nth, p["seed"]) < p["subsample"] if p["subsample"] < 1 else np.ones(n, bool)
        columns = boost.columns_of(nth, feats, p)
        value, queue, splits = np.zeros(n), [(np.ones(n, bool), 0)], []
        while queue:
            rows, depth = queue.pop(0)
            at = rows & used
            G, H = g[at].sum(), h[at].sum()
            best = None
            if depth < p["max_depth"]:
                for f in columns:
                    for cut in range(1, int(bins.max()) + 1):
                        for missing in (False, True):
                            left = np.where(bins[:, f] == 0, missing, bins[:, f] <= cut)
                            gl, hl = g[at & left].sum(), h[at & left].sum()
                            gr, hr = g[at & ~left].sum(), h[at & ~left].sum()
                            if min(hl, hr) < p["min_child_weight"] or min(hl, hr) <= 1e-12:
                                continue
                            gain = soft(gl) ** 2 / (hl + p["reg_lambda"]) + soft(gr) ** 2 / (hr + p["reg_lambda"]) - soft(G) ** 2 / (H + p["reg_lambda"])
                            if gain > max(p["gamma"], 1e-6) and (best is None or gain > best[0] + 1e-9 * max(1, gain)):
                                best = (gain, f, cut, missing, left)
            if best:
                splits.append(best[1:4])
                queue += [(rows & best[4], depth + 1), (rows & ~best[4], depth + 1)]
            else:
                value[rows] = -p["eta"] * soft(G) / (H + p["reg_lambda"])
        margin += value
        out.append((splits, margin.copy()))
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c = rng.gauss(0, 1), rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([float("nan"), rng.random()])
        rows.append((i, a, b, c, int(a + (b or 0.5) + rng.gauss(0, 0.7) > 1)))
    return spark.createDataFrame([*rows, (400, 0.0, 0.0, 0.0, None)], "id long, a double, b double, c double, y int").repartition(3)


POINTS = [
    {"n_estimators": 4, "max_depth": 3, "eta": 0.3},
    {"n_estimators": 3, "max_depth": 2, "eta": 0.5, "reg_alpha": 0.5, "min_child_weight": 5, "scale_pos_weight": 2.5},
    {"n_estimators": 5, "max_depth": 4, "eta": 0.1, "subsample": 0.6, "colsample_bytree": 0.6, "gamma": 0.2, "seed": 3},
]


@pytest.mark.parametrize("rest", [100, 1])
def test_boosting_equals_brute_force(spark, mixed, monkeypatch, rest):
    monkeypatch.setattr(boost, "REST", rest)
    kept = []

    def keep(df):
        out = ad.kept(df)
        kept.append((out, out.toPandas()))
        return out

    models = boost.boost_fits(mixed, ["a", "b", "c"], "y", POINTS, keep, bins=8)
    rows = kept[0][1].sort_values("row")
    assert not any(os.path.exists(t.stored_at.removeprefix("file:")) for t, _ in kept)  # nothing is left behind
    bins = np.stack([np.frombuffer(b, np.uint8) for b in rows["bins"]]).astype(int)
    assert len(rows) == 400 and (len(kept) > 2) == (rest == 1)
    for m, p in zip(models, POINTS):
        assert len(m.trees) == p["n_estimators"]
        total = np.zeros(len(bins))
        for tree, (splits, margin) in zip(m.trees, plain_trees(bins, rows["y"].to_numpy(), rows["row"].to_numpy(), m.params)):
            assert [(f, c, w) for f, c, w in zip(tree.feature, tree.cut, tree.missing_left) if f >= 0] == splits
            total += np.array(tree.value)[tree.node_of(bins)]
            assert total == pytest.approx(margin, abs=1e-9)
    again = boost.Boosted.from_json(models[0].to_json())
    scored = {r["id"]: r for r in again.predicted(mixed).collect()}
    assert len(scored) == 401 and np.mean([r["pred"] == r["y"] for r in scored.values() if r["y"] is not None]) > 0.8


def test_only_sums_of_bins_reach_the_driver(spark, mixed, monkeypatch):
    seen = []
    own = boost.level

    def level(rows, growing, asked, rested, width):
        out = own(rows, growing, asked, rested, width)
        seen.append((out.size, len(asked)))
        return out

    monkeypatch.setattr(boost, "level", level)
    boost.boost_fits(mixed, ["a", "b", "c"], "y", POINTS, ad.kept, bins=8)
    # nodes x features x bins (and missing, and the last one) x two sums, whatever the rows
    assert all(size <= nodes * 3 * 9 * 2 for size, nodes in seen)
    # levels of all points share a job: as many as the longest takes alone, at most
    assert len(seen) <= 5 * 5


@pytest.mark.parametrize("small", [0, 120])
def test_small_nodes_grow_in_one_job(spark, mixed, monkeypatch, small):
    """The same trees, whichever nodes a task finishes; it gets no more rows than it may."""
    whole, jobs, own, level = boost.boost_fits(mixed, ["a", "b", "c"], "y", POINTS, ad.kept, bins=8), [], boost.grown_below, boost.level

    def below(rows, growing, asked, *rest):
        jobs.append([growing[m].rows[n] for m, n in asked])
        return own(rows, growing, asked, *rest)

    levels = []
    monkeypatch.setattr(boost, "grown_below", below)
    monkeypatch.setattr(boost, "level", lambda *a: levels.append(1) or level(*a))
    boost.boost_fits(mixed, ["a", "b", "c"], "y", POINTS, ad.kept, bins=8)
    assert len(jobs) == 5 and not levels  # a job a tree, not one a level
    jobs.clear()
    monkeypatch.setattr(boost, "SMALL", small)
    again = boost.boost_fits(mixed, ["a", "b", "c"], "y", POINTS, ad.kept, bins=8)
    assert levels and bool(jobs) == bool(small) and all(n <= small for job in jobs for n in job)
    for a, b in zip(whole, again):
        for s, t in zip(a.trees, b.trees):
            assert (s.feature, s.cut, s.missing_left, s.left, s.right) == (t.feature, t.cut, t.missing_left, t.left, t.right)
            assert s.value == pytest.approx(t.value, abs=1e-9)
    one_by_one = learn.sums_of_f1([m.predicted for m in whole], mixed, "y")
    assert learn.scores_of(boost.confusions(whole, mixed, "y"), len(whole)) == one_by_one


def test_boosting_without_rows(mixed):
    m = boost.boost_fit(mixed.where("y > 5"), ["a", "b"], "y", {"n_estimators": 2}, ad.kept)
    assert {r["probability"] for r in m.predicted(mixed.limit(5)).collect()} == {0.5}


# --- logistic grid


def test_logistic_grid_agrees_with_spark_ml(spark, mixed):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = mixed.where("y IS NOT NULL").fillna(0.3).withColumn("weight", F.when(F.col("y") == 1, 1.5).otherwise(0.75))
    points = [{"regParam": r, "elasticNetParam": e} for r in (0.001, 0.03, 0.3) for e in (0.0, 0.5, 1.0)]
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()
    for p, m in zip(points, logistic.lr_grid(df, ["a", "b", "c"], "y", points)):
        want = LogisticRegression(labelCol="y", weightCol="weight", maxIter=500, tol=1e-12, **p).fit(rows)
        own = [b / d for b, d in zip(m.coefficients[1:], m.deviations)]
        assert own == pytest.approx(want.coefficients.toArray().tolist(), abs=2e-4)
        assert m.coefficients[0] - sum(b * x for b, x in zip(own, m.means)) == pytest.approx(want.intercept, abs=2e-4)
        scored = m.predicted(df).select("id", "pred").collect()
        assert np.mean([r["pred"] == int(w["prediction"]) for r, w in zip(sorted(scored), sorted(want.transform(rows).select("id", "prediction").collect()))]) > 0.99
    rows.unpersist()


def test_sums_by_either_way(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 7)

    def add(batches):
        out = np.zeros(30)
        for b in batches:
            np.add.at(out, b.column(0).to_numpy() % 23, 1.0)
        return out

    want = [44.0] * 11 + [43.0] * 12 + [0.0] * 7
    assert sums.summed(rows, 7, 30, add).tolist() == want
    monkeypatch.setattr(sums, "PIECE", 4)
    monkeypatch.setattr(sums, "DIRECT", 0)
    assert sums.summed(rows, 7, 30, add).tolist() == want
    assert sums.summed(rows.limit(0), 1, 30, add).tolist() == [0.0] * 30


def test_points_cost_no_jobs(spark, mixed):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"grid{n}", "")
        points = [{"regParam": 0.01 * (i + 1), "elasticNetParam": 0.0} for i in range(n)]
        logistic.lr_grid(mixed.withColumn("weight", F.lit(1.0)), ["a", "b"], "y", points, passes=4, tol=0.0)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid{n}"))

    assert jobs(1) == jobs(9)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# --- variational sequence models


def plain_sums(x, p):
    """Log of the weight of all paths of one sequence, and expected sums."""
    k, n = len(p["mean"]), len(x)
    total, sums = 0.0, np.zeros(k + k * k + 3 * k)
    dens = lambda j, v: math.exp(p["bias"][j] - (v - p["mean"][j]) ** 2 / 2 / p["var"][j]) / math.sqrt(2 * math.pi * p["var"][j])
    for path in itertools.product(range(k), repeat=n):
        w = p["start"][path[0]] * math.prod(dens(s, v) for s, v in zip(path, x)) * math.prod(p["trans"][a][b] for a, b in zip(path, path[1:]))
        one = np.zeros_like(sums)
        one[path[0]] += 1
        for a, b in zip(path, path[1:]):
            one[k + a * k + b] += 1
        for s, v in zip(path, x):
            one[[k + k * k + s, 2 * k + k * k + s, 3 * k + k * k + s]] += [1, v, v * v]
        total, sums = total + w, sums + w * one
    return math.log(total), sums / total


@pytest.mark.parametrize("k", [1, 2, 3])
def test_variational_fit_against_all_paths(spark, k):
    rng = np.random.default_rng(k)
    seqs = [[float(rng.normal((0.0, 2.0)[(t + i) % 2], 0.5)) for t in range(rng.integers(1, 6))] for i in range(14)]
    df = spark.createDataFrame([(s,) for s in seqs] + [([],), (None,)], "x array<double>").repartition(3)
    m = hmm.hmm_fit(df, "x", k, 6, 2, variational=True, tol=-1.0)
    flat = [v for s in seqs for v in s]
    row = df.select(F.explode("x").alias("x")).agg(F.percentile_approx("x", [i / 20 for i in range(1, 20)], 1000).alias("q"), F.stddev_pop("x").alias("sd")).first()
    paths = []
    for r in range(2):
        prior = hmm.prior_of(k, float(np.mean(flat)))
        q = hmm.first_posterior(hmm.start_params({"quantiles": row["q"], "sd": row["sd"]}, k, r, 0), prior, len(flat))
        path = []
        for _ in range(7):
            p = hmm.expected_model(q)
            ll, sums = 0.0, 0
            for x in seqs:
                one, s = plain_sums(x, p)
                ll, sums = ll + one, sums + s
            path.append(ll - hmm.divergence(q, prior))
            start, xi, n, x, xx = np.split(sums, np.cumsum([k, k * k, k, k]))
            q = hmm.posterior_of({"start": start, "xi": xi.reshape(k, k), "n": n, "x": x, "xx": xx}, prior)
        paths.append(path)
    best = max(paths, key=lambda p: p[-1])
    assert m["path"] == pytest.approx(best, rel=1e-7) and m["bound"] == m["path"][-1]
    # the bound never falls
    assert all(b >= a - 1e-9 * abs(a) for p in paths for a, b in zip(p, p[1:]))


def test_bound_never_falls_and_planted_states_are_found(spark):
    rng = np.random.default_rng(5)
    seqs = []
    for _ in range(60):
        s, x = int(rng.integers(2)), []
        for _ in range(int(rng.integers(2, 40))):
            x.append(float(rng.normal((-1.0, 2.0)[s], 0.4)))
            s = s if rng.random() < 0.9 else 1 - s
        seqs.append((x,))
    m = hmm.hmm_fit(spark.createDataFrame(seqs, "x array<double>"), "x", 2, 40, 3, variational=True)
    assert all(b >= a - 1e-8 * abs(a) for a, b in zip(m["path"], m["path"][1:]))
    assert m["mean"] == pytest.approx([-1.0, 2.0], abs=0.1) and m["trans"][0][0] == pytest.approx(0.9, abs=0.05)
    assert m["bound"] < m["loglik"] and len(m["path"]) < 41  # it settled
    # states without use get no more than their prior's weight
    wide = hmm.hmm_fit(spark.createDataFrame(seqs, "x array<double>"), "x", 4, 60, 1, variational=True)
    assert wide["n"] == m["n"] and all(v > 0 for v in wide["var"])


def test_digamma():
    assert hmm.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert hmm.digamma([0.5, 7.0, 100.0]) == pytest.approx([-1.9635100260214235, 1.872784335098467, 4.600161852738087], abs=1e-11)


def test_settled_restarts_leave_the_passes(spark, monkeypatch):
    asked = []
    own = hmm.pass_over

    def passes(rows, tasks, models):
        asked.append(set(models))
        return own(rows, tasks, models)

    monkeypatch.setattr(hmm, "pass_over", passes)
    df = spark.createDataFrame([([0.0, 0.1, 3.0, 3.1] * 5,)] * 20, "x array<double>")
    m = hmm.hmm_fits(df, "x", [1, 2, 3], 30, 3)
    assert asked[0] == {(k, r) for k in (1, 2, 3) for r in range(3)} and all(b <= a for a, b in zip(asked, asked[1:])) and len(asked[-1]) < 9
    assert [x["k"] for x in m] == [1, 2, 3] and all(x["loglik"] == x["path"][-1] for x in m)


def test_tasks_of_a_pass_follow_the_states(spark, monkeypatch):
    """Many states make a task's share of the values smaller, whatever partitions the sequences come in."""
    asked, own = [], hmm.pass_over
    monkeypatch.setattr(hmm, "pass_over", lambda rows, tasks, models: asked.append(tasks) or own(rows, tasks, models))
    monkeypatch.setattr(hmm, "TASK_CELLS", 1200)
    df = spark.createDataFrame([([0.0, 0.1, 3.0, 3.1],)] * 100, "x array<double>").coalesce(1)
    one, many = hmm.hmm_fits(df, "x", [2], 3, 1), hmm.hmm_fits(df, "x", [2, 4], 3, 2)
    assert asked[0] == 1 and asked[-1] == 4 and one[0]["loglik"] == pytest.approx(many[0]["loglik"], abs=0.5)


def plain_decode(x, m):
    k = len(m["mean"])
    emit = lambda v, j: -0.5 * math.log(2 * math.pi * m["var"][j]) - (v - m["mean"][j]) * (v - m["mean"][j]) / (2 * m["var"][j])
    log = lambda v: math.log(max(v, 1e-300))
    v, back = [log(m["start"][j]) + emit(x[0], j) for j in range(k)], []
    for value in x[1:]:
        came = [[v[i] + log(m["trans"][i][j]) for i in range(k)] for j in range(k)]
        back.append([c.index(max(c)) for c in came])
        v = [max(c) + emit(value, j) for j, c in enumerate(came)]
    path = [v.index(max(v))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_decoding(spark):
    rng = random.Random(9)
    m = {"start": [0.4, 0.4, 0.2], "trans": [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.0, 0.5, 0.5]], "mean": [0.0, 0.0, 1.0], "var": [0.5, 0.5, 0.2]}
    seqs = [[rng.choice([0.0, 0.5, 1.0]) for _ in range(rng.choice([1, 2, 3, 5, 5, 5, 5, 17]))] for _ in range(60)] + [[], None]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, x array<double>").withColumn("a.b", F.lit(1)).repartition(2)
    got = {r["id"]: r["hidden_states"] for r in hmm.hmm_decode(df, "x", m).collect()}
    assert got == {i: plain_decode(s, m) if s else [] for i, s in enumerate(seqs)}  # ties to the lower state


def test_long_sequences_are_linear(spark):
    import time

    n = 2_000_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i % 1000 > 500).cast("double")).alias("x"))
    m = {"start": [0.5, 0.5], "trans": [[0.9, 0.1], [0.1, 0.9]], "mean": [0.0, 1.0], "var": [0.1, 0.1]}
    began = time.time()
    r = hmm.hmm_state_features(hmm.hmm_decode(df, "x", m), "hidden_states", 2).select("n_changes", "state_0_count", "dwell_1_mean").first()
    assert tuple(r) == (2 * n // 1000 - 1, 501 * n // 1000, 499.0) and time.time() - began < 90


# --- searches


def test_grids_and_leaks():
    assert math.prod(len(v) for v in learn.GRIDS["rf"].values()) == 2970
    assert math.prod(len(v) for v in learn.GRIDS["gbt"].values()) == 11 * 15 * 3 * 3 * 5 * 3 * 4
    points = learn.draws(learn.GRIDS["gbt"], 50, 0)
    assert len({json.dumps(p, sort_keys=True) for p in points}) == 50 and points == learn.draws(learn.GRIDS["gbt"], 50, 0)
    assert learn.allowed(["a", *learn.LEAKS]) == ["a"]
    assert len(learn.draws({"x": [1, 2], "y": [3]}, 9, 0)) == 2


def test_learning_finds_a_plain_rule(spark, tmp_path):
    rows = [(float(i % 10), float(i % 7), None if i % 11 == 0 else float(i % 3), int(i % 10 >= 5), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, part int").withColumn("asm_not_corrected", F.col("y"))
    train, val, test = (df.where(f"part = {k}") for k in range(3))
    feats = ["a", "b", "c", "asm_not_corrected"]
    forest = learn.rf_fit(train, feats, "y")
    assert learn.sum_f1(forest, test, "y") > 1.9 and "asm_not_corrected" not in forest.stages[0].getInputCols()
    boosted = learn.gbt_fit(train, feats, "y", {"n_estimators": 5}, ad.kept)
    assert learn.sums_of_f1([boosted.predicted], test, "y")[0] > 1.9 and boosted.feats == ["a", "b", "c"]
    found = learn.lr_search(train, val, feats, "y", (0.01, 1.0, 100.0), ("l1", "l2"))
    assert len(found) == 6 and found[0][2] == max(s for _, _, s in found) > 1.9 and found[0][1].feats == ["a", "b", "c"]
    for kind, grid in (("rf", {"n_estimators": [2, 5], "max_depth": [1, 3, None]}), ("gbt", {"n_estimators": [2, 5], "max_depth": [1, 3, None]})):
        found = learn.random_search(train, val, kind, feats, "y", grid, 3, keep=ad.kept)
        assert len(found) == 3 and [s for _, s in found] == sorted((s for _, s in found), reverse=True) and all(p in learn.draws(grid, 9, 0) for p, _ in found)
        _, row = learn.refit_and_test(train.union(val), test, kind, feats, "y", found[0][0], ad.kept, str(tmp_path / kind))
        r = row.first()
        assert (tmp_path / kind).exists() and r["tn"] + r["fp"] + r["fn"] + r["tp"] == test.count() == r["class_0_support"] + r["class_1_support"]
        assert json.loads(r["params"]) == found[0][0] and r["sum_f1"] == pytest.approx(r["class_0_f1"] + r["class_1_f1"], abs=2e-3) and r["model"] == kind


def test_models_of_few_rows_are_one_job(spark, mixed, monkeypatch):
    """All trees of all boosted points, however many, with the trees that levels give."""
    points = [p | {"n_estimators": 7} for p in POINTS]
    monkeypatch.setattr(boost, "FEW", 99)
    by_tree = boost.boost_fits(mixed, ["a", "b", "c"], "y", points, ad.kept, bins=8)
    monkeypatch.undo()
    monkeypatch.setattr(boost, "grown_below", None)  # a job a tree
    monkeypatch.setattr(boost, "level", None)  # a job a level
    whole = boost.boost_fits(mixed, ["a", "b", "c"], "y", points, ad.kept, bins=8)
    for a, b in zip(by_tree, whole):
        assert len(a.trees) == len(b.trees) == 7
        for s, t in zip(a.trees, boost.Boosted.from_json(b.to_json()).trees):
            assert (s.feature, s.cut, s.missing_left, s.left, s.right) == (t.feature, t.cut, t.missing_left, t.left, t.right)
            assert s.value == pytest.approx(t.value, abs=1e-9)


def plain_gini(bins, y, weights, least, depth, rows):
    """The share of class 1 that a tree over all features gives each row, node by node."""
    c = np.bincount(y[rows], minlength=2) * weights
    gini = lambda c: c.sum() - (c**2).sum() / max(c.sum(), 1e-300)
    best = None
    for f in range(bins.shape[1]) if depth else ():
        for cut in range(1, int(bins.max()) + 1):
            left = bins[rows, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = gini(c) - sum(gini(np.bincount(y[part], minlength=2) * weights) for part in (rows[left], rows[~left]))
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, rows[left], rows[~left]
    out = np.zeros(len(y))
    if best:
        return sum((plain_gini(bins, y, weights, least, depth - 1, part) for part in best[1:]), out)
    out[rows] = c[1] / c.sum()
    return out


def test_trees_of_forests_equal_brute_force():
    rng = np.random.default_rng(4)
    bins = rng.integers(1, 9, (300, 4)).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 2] + rng.normal(0, 2, 300) > 10).astype(np.int64)
    for least, depth in ((1, 3), (5, 8)):
        p = {"n_estimators": 1, "max_depth": depth, "least": least}
        tree = forest.tree_of(bins, y, np.ones(300, np.int64), [0.7, 1.9], 10, p, np.random.default_rng(0))
        got = boost.unpacked(boost.packed([tree]), 1)[0]
        assert got.value[got.node_of(bins)] == pytest.approx(plain_gini(bins, y, np.array([0.7, 1.9]), least, depth, np.arange(300)), abs=1e-9)


def test_forests_of_few_rows_are_one_job(spark, mixed, monkeypatch):
    """All forests of a search grow together, as good as Spark ML's of the same points."""
    df = mixed.where("y IS NOT NULL")
    train, val = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    grid = {"n_estimators": [15, 25], "max_depth": [3, None], "min_samples_split": [2, 10], "bootstrap": [True, False]}
    search = lambda: learn.random_search(train, val, "rf", ["a", "b", "c"], "y", grid, 16)
    monkeypatch.setattr(boost, "SMALL", 0)
    theirs = dict((json.dumps(p), s) for p, s in search())
    monkeypatch.undo()
    monkeypatch.setattr(learn, "forest", None)  # a fit of Spark ML
    own = dict((json.dumps(p), s) for p, s in search())
    assert own.keys() == theirs.keys() and len(own) == 16
    assert all(abs(own[p] - theirs[p]) < 0.15 for p in own) and abs(np.mean([own[p] - theirs[p] for p in own])) < 0.05


@pytest.mark.parametrize("many", [0, 40, 1 << 30])
def test_nodes_of_many_and_few_rows_are_counted_alike(monkeypatch, many):
    monkeypatch.setattr(forest, "MANY", many)
    monkeypatch.setattr(forest, "STEP", max(100, min(many, 300)))
    monkeypatch.setattr(forest, "CELLS", 200)
    rng = np.random.default_rng(6)
    bins = rng.integers(1, [3, 9, 5, 4], (300, 4)).astype(np.uint8)
    y = (bins[:, 1] + bins[:, 2] + rng.normal(0, 2, 300) > 7).astype(np.int64)
    tree = forest.tree_of(bins, y, np.ones(300, np.int64), [0.7, 1.9], 10, {"n_estimators": 1, "max_depth": 6, "least": 2}, np.random.default_rng(0))
    assert tree.value[tree.node_of(bins)] == pytest.approx(plain_gini(bins, y, np.array([0.7, 1.9]), 2, 6, np.arange(300)), abs=1e-9)


def test_packs_of_features_give_the_trees_of_each(monkeypatch):
    """Sums of packs, added up to those of their features, are those that features have alone; so are splits by width."""
    rng = np.random.default_rng(8)
    bins = np.stack([rng.integers(low, high, 3000) for low, high in ((0, 2), (1, 3), (0, 3), (1, 2), (0, 9), (1, 33), (0, 33), (1, 3), (0, 5))], 1).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 4] / 4 + bins[:, 6] / 16 + rng.normal(0, 1, 3000) > 3.2).astype(float)
    p = boost.DEFAULTS | {"n_estimators": 3, "max_depth": 8, "subsample": 0.8, "colsample_bytree": 0.9, "reg_alpha": 0.1}
    grown = lambda: list(boost.trees_of(bins, np.arange(3000), y, 35, p))
    packed, held = grown(), [len(x) for x in boost.packs_of([2, 3, 3, 2, 9, 33, 33, 3, 5], 64)]
    assert sum(held) == 9 and max(held) > 2
    monkeypatch.setattr(boost, "PACKS", (1, 2))
    monkeypatch.setattr(boost, "WIDTHS", ())
    for s, t in zip(packed, grown(), strict=True):
        assert len(s.feature) > 20 and (s.feature, s.cut, s.missing_left, s.left, s.right) == (t.feature, t.cut, t.missing_left, t.left, t.right)
        assert s.value == pytest.approx(t.value, abs=1e-9)


def test_points_are_scored_where_they_grow(mixed):
    """The counts that a task returns are those of the models that levels give."""
    learned, held = mixed.where("id % 3 > 0"), mixed.where("id % 3 = 0")
    models = boost.boost_fits(learned, ["a", "b", "c"], "y", POINTS, ad.kept, bins=8)
    counts = lambda df: sorted(tuple(r) for r in df.select("point", "tn", "fp", "fn", "tp").collect())
    found, _ = boost.grown_and_scored(learned, held, ["a", "b", "c"], "y", POINTS, bins=8)
    assert counts(found) == counts(boost.confusions(models, held, "y")) and found.where("trees IS NOT NULL").count() == 0


def test_searches_send_no_tree_to_the_driver(spark, monkeypatch):
    """More rows than the 65,536 of which all trees went to the driver; forests were Spark ML's, boosted trees a job or more each."""
    df = spark.range(70_000).selectExpr("id % 10 AS a", "id % 7 AS b", "id % 3 AS c", "cast((id % 10 >= 5) != (id % 41 = 0) AS int) AS y", "id")
    for module, name in ((learn, "forest"), (boost, "boost_fits"), (boost, "unpacked"), (forest, "unpacked"), (boost, "level"), (boost, "grown_below")):
        monkeypatch.setattr(module, name, None)
    for kind in ("rf", "gbt"):
        found = learn.random_search(df, df.where("id % 10 < 9"), kind, ["a", "b", "c"], "y", {"n_estimators": [5, 7], "max_depth": [2, 4]}, 4)
        assert len(found) == 4 and found[0][1] > 1.9


def test_refits_are_one_job_and_keep_their_model(spark, mixed, monkeypatch, tmp_path):
    """Neither Spark ML's levels nor a job a tree; the saved model gives the counts of the row."""
    monkeypatch.setattr(learn, "rf_fit", None)
    monkeypatch.setattr(learn, "gbt_fit", None)
    df = mixed.where("y IS NOT NULL").repartition(2)
    learned, test, feats = df.where("id % 3 > 0"), df.where("id % 3 = 0"), ["a", "b", "c"]
    y = np.array([r["y"] for r in test.select("id", "y").orderBy("id").collect()])
    x = test.orderBy("id").select(*feats).toPandas().astype(float).to_numpy()
    counts = lambda pred: np.bincount(2 * y + pred, minlength=4).tolist()
    for kind, params in (("gbt", {"n_estimators": 9, "max_depth": 3}), ("rf", {"n_estimators": 25, "max_depth": 6})):
        path = str(tmp_path / kind)
        r = learn.refit_and_test(learned, test, kind, feats, "y", params, ad.kept, path)[1].first()
        lines = [t["value"] for t in spark.read.text(path).collect()]
        if kind == "gbt":
            model = boost.Boosted.from_json(lines[0])
            pred = (model.margin(binned_of(x, model.cuts)) > 0).astype(int)
            assert len(lines) == 1 and len(model.trees) == 9
        else:
            known, trees = json.loads(lines[0]), [t for line in lines for t in forest.trees_from(line)]
            x = np.where(np.isnan(x), np.array(known["means"]), x)
            bins = binned_of(x, known["cuts"])
            pred = (sum(t.value[t.node_of(bins)] for t in trees) > 12.5).astype(int)
            assert len(trees) == 25 and known["feats"] == feats
        assert [r[c] for c in ("tn", "fp", "fn", "tp")] == counts(pred)


def binned_of(x, cuts):
    return np.stack([np.where(np.isnan(v), 0, np.searchsorted(np.array(q), v) + 1) for v, q in zip(x.T, cuts)], 1).astype(np.uint8)


def test_logistic_steps_are_exact():
    """Nearly collinear features: coordinate descent of 200 rounds is far from the minimum, of which every slope is a condition."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 40))
    x[:, 20:] = x[:, :20] + 0.05 * x[:, 20:]
    x[:, 0], x[:, 38], x[:, 39] = 1.0, x[:, 5] + x[:, 6], 0.0  # an intercept, a sum of others, a constant
    y = (x[:, 1] - x[:, 2] + rng.normal(size=1000) > 0.5) * 1.0
    b = np.r_[0.0, rng.normal(size=37), 0.0, 0.0]
    p = 1 / (1 + np.exp(-x @ b))
    grad, hess = x.T @ (p - y) / 1000, x.T @ (x * (p * (1 - p))[:, None]) / 1000
    for l1, l2 in ((0.1, 0.0), (1e-3, 0.0), (1e-6, 0.0), (0.0, 0.1), (0.0, 1e-6), (1e-3, 1e-3)):
        new = logistic.newton_step(b, grad, hess, l1, l2)
        free = np.r_[0.0, np.ones(39)]
        slope = grad + hess @ (new - b) + l2 * free * new
        moved = new != 0
        assert np.abs(slope + l1 * free * np.sign(new))[moved].max() < 1e-8
        assert (np.abs(slope[~moved]) <= l1 + 1e-8).all()


def test_logistic_points_are_scored_in_one_pass(mixed):
    df = mixed.where("y IS NOT NULL")
    points = logistic.grid((0.01, 1.0, 100.0), ("l1", "l2"), 400)
    models = learn.lr_fit(df, ["a", "b", "c"], "y", points)
    assert learn.scores_of(logistic.confusions(models, mixed, "y"), 6) == learn.sums_of_f1([m.predicted for m in models], mixed, "y")
