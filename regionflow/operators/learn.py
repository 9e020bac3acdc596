"""Class-weighted classifiers on region features: fitted, searched over grids, and evaluated."""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import io
from . import boost, logistic
from . import forest as fo
from .reports import classification_report, confusion_matrix

#: Columns that define the label, so no model may see them.
LEAKS = ("read_asm_effect", "wilcoxon_pvalue", "corrected_wilcoxon_pvalue", "total_sig_cpgs", "consecutive_sig_cpgs", "asm", "asm_not_corrected")

# The grids of the searches.  None is no bound on the depth; Spark ML's forests take 30 at most, and
# have no least number of rows to split, so that its values 2, 5, 10 act through the least number of rows in a leaf.
GRIDS = {
    "rf": {
        "max_depth": [*range(10, 110, 10), None],
        "n_estimators": list(range(10, 160, 10)),
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "bootstrap": [True, False],
    },
    "gbt": {
        "max_depth": [*range(1, 20, 2), None],
        "n_estimators": list(range(10, 160, 10)),
        "eta": [0.001, 0.01, 0.1],
        "min_child_weight": [1, 5, 10],
        "subsample": [0.2, 0.4, 0.6, 0.8, 1.0],
        "colsample_bytree": [0.6, 0.8, 1.0],
        "reg_alpha": [0, 0.001, 0.01, 0.1],
    },
}


def weighted(df: DataFrame, label: str) -> DataFrame:
    """df with weight: balanced over the classes of the label."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_t"))
    rows = df.join(F.broadcast(counts), F.col(label) == F.col("_l")).join(F.broadcast(total))
    return rows.withColumn("weight", F.col("_t") / (F.col("_n") * 2.0)).drop("_l", "_n", "_t")


#: Rows that are worth a task of a forest's passes: each task adds up all nodes of a level, however few rows it has.
TASK = 8192


def few_tasks(df: DataFrame) -> DataFrame:
    """df in as many partitions as its rows are worth."""
    return df.coalesce(max(1, -(-df.count() // TASK)))


def allowed(feats: list[str]) -> list[str]:
    return [c for c in feats if c not in LEAKS]


def forest(label: str, params: dict) -> RandomForestClassifier:
    """A forest of a point of the grid, in Spark ML's parameters."""
    p = forest_point(params)
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", seed=1, numTrees=p["n_estimators"], maxDepth=min(p["max_depth"] or boost.DEEPEST, boost.DEEPEST), minInstancesPerNode=p["least"], bootstrap=p["bootstrap"], maxMemoryInMB=512)


def forest_point(params: dict) -> dict:
    """A forest's parameters, with least: the rows of a leaf."""
    p = {"n_estimators": 20, "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 1, "bootstrap": True} | params
    return p | {"least": max(p["min_samples_leaf"], p["min_samples_split"] // 2)}


def assembled(df: DataFrame, feats: list[str], label: str, fitted=None):
    """Rows with a vector of features, missing ones at their mean, and the fitted stages."""
    filled = [f"_{c}" for c in feats]
    stages = fitted or Pipeline(stages=[Imputer(inputCols=feats, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]).fit(df)
    return stages, stages.transform(df).drop(*filled)


def rf_fit(df: DataFrame, feats: list[str], label: str, params: dict | None = None):
    """A fitted pipeline; the weighted rows are read by each of its stages, so they're kept meanwhile."""
    feats = allowed(feats)
    rows = weighted(few_tasks(df.select(*[F.col(c).cast("double").alias(c) for c in feats], label)), label).persist()
    try:
        filled = [f"_{c}" for c in feats]
        return Pipeline(stages=[Imputer(inputCols=feats, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), forest(label, params or {})]).fit(rows)
    finally:
        rows.unpersist()


def gbt_fit(df: DataFrame, feats: list[str], label: str, params: dict | None = None, keep=None) -> boost.Boosted:
    """Second-order boosting; the positive class weighs what balances it unless params say otherwise."""
    return gbt_fits(df, feats, label, [params or {}], keep)[0]


def gbt_points(df: DataFrame, label: str, points: list[dict]) -> list[dict]:
    row = df.agg(F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones")).first()
    ratio = row["zeros"] / row["ones"] if row["ones"] else 1.0
    return [{"scale_pos_weight": ratio} | p for p in points]


def gbt_fits(df: DataFrame, feats: list[str], label: str, points: list[dict], keep) -> list[boost.Boosted]:
    return boost.boost_fits(df, allowed(feats), label, gbt_points(df, label, points), keep)


def held_by_a_task(*parts: DataFrame) -> bool:
    """Whether a task can hold the rows of each part."""
    return all(df.count() <= boost.SMALL for df in parts)


def lr_fit(df: DataFrame, feats: list[str], label: str, points: list[dict] | None = None) -> list[logistic.Logistic]:
    """Logistic regressions of all points of a grid (regParam, elasticNetParam), on balanced rows."""
    return logistic.lr_grid(weighted(df, label), allowed(feats), label, points or [{"regParam": 0.01, "elasticNetParam": 0.0}])


def lr_search(train: DataFrame, val: DataFrame, feats: list[str], label: str, cs, penalties) -> list[tuple]:
    """(C, penalty), model and sum of f1 on val of each point of the grid, best first; all points are fitted, and scored, together."""
    names = [(float(c), p) for c in cs for p in penalties]
    n = train.where(F.col(label).isNotNull()).count()
    models = lr_fit(train, feats, label, logistic.grid(cs, penalties, n))
    scores = scores_of(logistic.confusions(models, val, label), len(models))
    return sorted(zip(names, models, scores), key=lambda x: -x[2])


def predicted(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("pred", F.col("prediction").cast("int"))


def sums_of_f1(predict: list, df: DataFrame, label: str) -> list[float]:
    """The sum of both classes' f1 of each prediction of df, in one job."""
    parts = [f(df).select(F.lit(i).alias("point"), F.col(label).alias("_l"), "pred") for i, f in enumerate(predict)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    is_ = lambda a, b: F.count_if((F.col("_l") == a) & (F.col("pred") == b))
    cm = every.groupBy("point").agg(is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(1, 1).alias("tp"))
    return scores_of(cm, len(predict))


def scores_of(cm: DataFrame, n: int) -> list[float]:
    """The sum of both classes' f1 of n points, from their confusions."""
    rows = classification_report(cm, "point").where("class = 'sum f1'").collect()  # one number a point
    found = {r["point"]: float(r["f1"]) for r in rows}
    return [found.get(i, 0.0) for i in range(n)]


def sum_f1(model, df: DataFrame, label: str) -> float:
    return sums_of_f1([lambda rows: predicted(model, rows)], df, label)[0]


def draws(grid: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different points of a grid, or all of a smaller one."""
    sizes = [len(v) for v in grid.values()]
    total = math.prod(sizes)
    points = []
    for number in random.Random(seed).sample(range(total), min(n, total)):
        point = {}
        for name, values in grid.items():
            number, i = divmod(number, len(values))
            point[name] = values[i]
        points.append(point)
    return points


def random_search(train: DataFrame, val: DataFrame, kind: str, feats: list[str], label: str, grid: dict, n: int, seed: int = 0, threads: int = 2, keep=None) -> list[tuple[dict, float]]:
    """Points with their sum of f1 on val, best first.

    Points of ``boost.SMALL`` rows at most are grown and scored by tasks that hold all rows, and no tree reaches the driver.  Of more rows, boosted points grow
    together in shared passes, and forests are Spark ML's, fitted a few at once on cached vectors.
    """
    feats, points, small = allowed(feats), draws(grid, n, seed), held_by_a_task(train, val)
    if kind == "gbt" and small:
        scores = scores_of(boost.grown_and_scored(train, val, feats, label, gbt_points(train, label, points))[0], len(points))
    elif kind == "gbt":
        models = gbt_fits(train, feats, label, points, keep)
        scores = scores_of(boost.confusions(models, val, label), len(models))
    elif small:
        scores = scores_of(fo.forests(train, val, feats, label, [forest_point(p) for p in points]).confusions(), len(points))
    else:
        double = [F.col(c).cast("double").alias(c) for c in feats]
        stages, rows = assembled(weighted(few_tasks(train.select(*double, label)), label), feats, label)
        rows = rows.select("features", label, "weight").persist()
        held = assembled(few_tasks(val.select(*double, label)), feats, label, stages)[1].select("features", label).persist()
        # the largest ones begin first
        order = sorted(range(len(points)), key=lambda i: -points[i].get("n_estimators", 0))
        try:
            with ThreadPoolExecutor(threads) as pool:
                found = dict(zip(order, pool.map(lambda i: sum_f1(forest(label, points[i]).fit(rows), held, label), order)))
            scores = [found[i] for i in range(len(points))]
        finally:
            rows.unpersist()
            held.unpersist()
    return sorted(zip(points, scores), key=lambda x: -x[1])


def refit_and_test(train_val: DataFrame, test: DataFrame, kind: str, feats: list[str], label: str, params: dict, keep=None, path: str | None = None):
    """The model of all training and validation rows, and its row of a table of results: parameters, confusion and report on the test rows.

    Of ``boost.SMALL`` rows at most, model is the table of results of its only point, with packed trees; else Spark ML's pipeline or ``boost.Boosted``.
    A path keeps the model: one row of JSON of boosted trees, lines of JSON of a forest, or Spark ML's pipeline of a forest of more rows.
    """
    small = held_by_a_task(train_val, test)
    if kind == "gbt" and small:
        (p,) = gbt_points(train_val, label, [params])
        found, cuts = boost.grown_and_scored(train_val, test, allowed(feats), label, [p], trees=True)
        model = (keep or io.kept)(found)
        if path:
            boost.save_packed(model, allowed(feats), cuts, p, path)
        return model, result_row(model, kind, params)
    if kind == "rf" and small:
        model = fo.forests(train_val, test, allowed(feats), label, [forest_point(params)], trees=True)
        model.table = (keep or io.kept)(model.table)
        if path:
            model.save(path)
        return model.table, result_row(model.confusions(), kind, params)
    if kind == "gbt":
        model = gbt_fit(train_val, feats, label, params, keep)
        scored = model.predicted(test)
    else:
        model = rf_fit(train_val, feats, label, params)
        scored = predicted(model, test)
    if path and kind == "gbt":
        train_val.sparkSession.createDataFrame([(model.to_json(),)], "model string").write.mode("overwrite").text(path)
    elif path:
        model.write().overwrite().save(path)
    return model, result_row(confusion_matrix(scored, label, "pred"), kind, params)


def result_row(cm: DataFrame, kind: str, params: dict) -> DataFrame:
    """One row: model, params, the confusion's four counts, and the report's figures by class."""
    cm = cm.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tn", "fp", "fn", "tp")])
    report = classification_report(cm.withColumn("one", F.lit(1)), "one")
    cells = [F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{c.replace(' ', '_')}_{m}") for c in ("0", "1", "macro avg", "weighted avg") for m in ("precision", "recall", "f1", "support")]
    single = [F.max(F.when(F.col("class") == c, F.col("f1"))).alias(c.replace(" ", "_")) for c in ("accuracy", "sum f1")]
    names = {f"{c}_{m}": f"class_{c}_{m}" for c in ("0", "1") for m in ("precision", "recall", "f1", "support")}
    flat = report.groupBy("one").agg(*cells, *single).withColumnsRenamed(names)
    row = cm.withColumn("one", F.lit(1)).join(flat, "one").drop("one")
    return row.select(F.lit(kind).alias("model"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), "*")
