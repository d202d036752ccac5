"""Metrics against direct computation, and training on a small feature table."""
import random

import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.operators import metrics, models
from deltascope.plans import experiment


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "truth int, predicted int, score double")


def test_published_confusion(spark):
    rows = [(0, 0, 0.1)] + [(0, 1, 0.6)] * 8 + [(1, 1, 0.9)]
    got = metrics.binary_metrics(_predictions(spark, rows)).first()
    assert (got.tn, got.fp, got.fn, got.tp) == (1, 8, 0, 1)
    assert (got.precision, got.recall, got.f1, got.balanced_accuracy, got.false_positive_rate) == (0.111111, 1.0, 0.2, 0.555556, 0.888889)


def test_one_class_gives_zero_or_null(spark):
    rows = _predictions(spark, [(0, 1, 0.5), (0, 0, 0.1)])
    got = metrics.binary_metrics(rows).first()
    assert got.recall == 0.0 and got.balanced_accuracy == 0.0
    assert metrics.ranking_metrics(rows).first().roc_auc is None


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), 0, rng.randrange(30) / 30) for _ in range(400)]
    pos = [s for t, _, s in rows if t]
    neg = [s for t, _, s in rows if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    precision, before = 0.0, 0
    for s in sorted(set(x for _, _, x in rows), reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        precision += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    got = metrics.ranking_metrics(_predictions(spark, rows)).first()
    assert got.roc_auc == round(auc, 6) and got.pr_auc == round(precision, 6)


def test_kappa_of_the_published_case(spark):
    pairs = [("risky", "risky")] * 3 + [("risky", "uncertain")] * 5 + [("uncertain", "uncertain")] * 6
    got = metrics.cohens_kappa(spark.createDataFrame(pairs, "left string, right string")).first()
    assert got.observed_agreement == pytest.approx(9 / 14, abs=1e-15)
    assert got.expected_agreement == pytest.approx(0.45918367346938777, abs=1e-15)
    assert got.cohens_kappa == pytest.approx(0.339622641509434, abs=1e-14)


def test_degenerate_kappa(spark):
    got = metrics.cohens_kappa(spark.createDataFrame([("a", "a")] * 3 + [("a", vocab.NOT_COMPARABLE)], "left string, right string")).first()
    assert got.status == "NOT_AVAILABLE_DEGENERATE_MARGINALS" and got.cohens_kappa is None and got.comparable_count == 3
    empty = metrics.cohens_kappa(spark.createDataFrame([], "left string, right string")).first()
    assert empty.status == "NOT_AVAILABLE"


def test_bootstrap_surrounds_the_estimate(spark):
    rows = [(1, 1, 1.0)] * 60 + [(1, 0, 0.0)] * 20 + [(0, 0, 0.0)] * 90 + [(0, 1, 1.0)] * 30
    got = {row.metric: row for row in metrics.bootstrap_intervals(_predictions(spark, rows)).collect()}
    assert got["recall"].p05 < 0.75 < got["recall"].p95 and abs(got["recall"].p50 - 0.75) < 0.02
    assert got["recall"].status == "computed"
    again = {row.metric: row.p05 for row in metrics.bootstrap_intervals(_predictions(spark, rows)).collect()}
    assert again == {name: row.p05 for name, row in got.items()}
    small = metrics.bootstrap_intervals(_predictions(spark, rows[:5])).first()
    assert small.status == "computed_but_not_reliable_for_inference"


def test_candidate_order(spark):
    table = spark.createDataFrame(
        [("m", 0, 0.5, 0.5, 0.2, "long text"), ("m", 1, 0.5, 0.5, 0.2, "short"), ("m", 2, 0.5, 0.5, 0.2, "brief"), ("m", 3, 0.4, 0.9, 0.0, "x")],
        "model string, candidate int, f1 double, balanced_accuracy double, false_positive_rate double, params string",
    )
    assert metrics.best_candidates(table, ["model"]).first().candidate == 1


def _feature_rows(spark, n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        risky = i % 4 == 0
        values = {name: float(rng.random() < 0.3) for name in vocab.feature_names()}
        values["added_permission_count"] = rng.random() + 2 * risky
        split = ["train", "train", "validation", "test"][(i // 4) % 4]
        rows.append((f"r{i}", f"e{i // 4}", "risky_transition" if risky else "benign_transition", True, split, *values.values()))
    schema = "record_id string, extension_id string, label string, eligible_for_supervised_training boolean, split string, " + ", ".join(f"{name} double" for name in vocab.feature_names())
    return spark.createDataFrame(rows, schema)


def test_training_and_experiment(spark):
    rows = _feature_rows(spark).persist()
    names = vocab.feature_names(vocab.PERMISSION_ONLY)
    test, table, params, fitted = models.train_and_select(rows, names, "logistic_regression")
    assert table.count() == 6 and metrics.binary_metrics(test).first().f1 > 0.9
    assert models.top_weights(fitted, spark).first().feature == "added_permission_count"
    assert len(models.candidates("random_forest")) == 24
    grids = {"logistic_regression": [params], "random_forest": [{"n_estimators": 5, "max_depth": 2, "min_samples_leaf": 1, "class_weight": None}]}
    result, predictions = experiment.run(rows, [vocab.PERMISSION_ONLY], grids=grids)
    assert {row.model for row in result.collect()} == {"logistic_regression", "random_forest", "rule_engine"}
    assert predictions.count() == 3 * test.count()


def test_training_gate(spark):
    rows = _feature_rows(spark, 40).withColumn("label", F.lit("benign_transition"))
    with pytest.raises(ValueError, match="lacks both binary target classes"):
        models.train_and_select(rows, ["added_permission_count"], "logistic_regression")


def test_candidates_trained_together_are_those_trained_alone(spark):
    """Regressions against pyspark.ml's with the same penalty; a forest read to its end against the model it was stored from."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(2)
    data = [(float(a), float(b), 3.0, float(a + b + rng.normal() > 0.7)) for a, b in rng.normal(size=(300, 2))]
    table = spark.createDataFrame(data, "a double, b double, c double, target double").withColumn("features", F.array("a", "b", "c")).repartition(3).persist()
    train = table.withColumn("vector", array_to_vector("features"))
    support = {"benign": sum(y == 0 for *_, y in data), "review_worthy": sum(y == 1 for *_, y in data)}
    matrix = np.array([row[:3] for row in data])
    grid = models.candidates("logistic_regression")
    fits = models.Regressions([(np.arange(3), params) for params in grid] + [(np.array([1]), grid[0])], support, matrix.mean(0), matrix.std(0, ddof=1))
    fits.fit(train)
    scaled = StandardScaler(inputCol="f", outputCol="s", withMean=True).fit(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(train)).transform(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(train))
    for k, params in enumerate(grid):
        weight = models.class_weights(support, params["class_weight"])
        rows = scaled.withColumn("w", F.when(F.col("target") == 1, float(weight[1])).otherwise(float(weight[0])))
        alone = LogisticRegression(featuresCol="s", labelCol="target", weightCol="w", maxIter=200, tol=1e-10, standardization=False, regParam=1 / (params["C"] * 300)).fit(rows)
        assert np.allclose(fits.weights[k], [*alone.coefficients, 0.0, alone.intercept], atol=1e-4)
    assert fits.weights[-1][0] == 0 and fits.weights[-1][1] != 0

    growth = models.Growth(np.array([1, 0]), 2, np.array([1.0, 2.0]), 30, 12)
    forest = models.grow_by_levels(train, growth, 5)
    folders = [path for path in __import__("glob").glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/forest-*")]
    stored = RandomForestClassificationModel.load(max(folders, key=__import__("os").path.getmtime))
    rows = train.withColumn("chosen", array_to_vector(F.array("b", "a")))
    want = stored.transform(rows).select("a", "b", "c", "target", vector_to_array("probability")[1].alias("p")).collect()
    got = forest.scores(np.array([[r.a, r.b, r.c] for r in want]), [(30, 12), (30, 5), (2, 12)])
    assert np.allclose(got[:, 0], [r.p for r in want])
    assert np.allclose(forest.importances(3, 30, 12)[[1, 0]], stored.featureImportances.toArray(), atol=1e-6)
    assert len(np.unique(got[:, 2])) < len(np.unique(got[:, 0]))

    (local,) = models.grow(train, 300, [growth], 5)
    same_order = np.array([[r.a, r.b, r.c] for r in want])
    shares = local.scores(same_order, [(30, 12), (30, 5), (2, 12)])
    truth = np.array([r.target for r in want])
    assert ((shares[:, 0] > 0.5) == truth).mean() > 0.9 and abs((shares[:, 0] - got[:, 0])).mean() < 0.15
    assert np.allclose(local.importances(3, 30, 12), forest.importances(3, 30, 12), atol=0.15)


def test_trees_against_plain_splits():
    """Every split leaves enough rows on both sides, and no split among all features takes more impurity away."""
    import numpy as np

    rng = np.random.default_rng(6)
    matrix = np.column_stack([rng.integers(0, 5, 200), rng.integers(0, 200, 200)]).astype(float)
    target = (rng.random(200) < 0.2 + 0.1 * matrix[:, 0]).astype(int)
    by_class = np.array([1.0, 3.0])
    growth = models.Growth(np.array([0]), 4, by_class, 6, 3)
    nodes = models.grown_trees(matrix, target, growth, 0, 9)
    times = np.random.default_rng((9, 0)).poisson(1.0, (3, 200))
    gini = lambda w: 0.0 if not w.sum() else w.sum() - (w**2).sum() / w.sum()
    weigh = lambda mask, tree: np.array([(times[tree] * mask * (target == c)).sum() * by_class[c] for c in (0, 1)])
    open_ = [(at, int(nodes["tree"][at]), np.ones(200, bool)) for at in np.flatnonzero(nodes["depth"] == 0)]
    assert len(open_) == 3
    while open_:
        at, tree, mask = open_.pop()
        here = weigh(mask, tree)
        assert abs(nodes["positive"][at] - here[1] / here.sum()) < 1e-9
        gains = []
        for cut in np.arange(0.5, 4):
            sides = mask & (matrix[:, 0] <= cut), mask & (matrix[:, 0] > cut)
            if min((times[tree] * side).sum() for side in sides) >= 4:
                gains.append(gini(here) - sum(gini(weigh(side, tree)) for side in sides))
        best = max([g for g in gains if g > 1e-9], default=0)
        if nodes["left"][at] == at:
            assert not best or nodes["depth"][at] == 6
        else:
            assert abs(nodes["gain"][at] - best) < 1e-4
            below = matrix[:, 0] <= nodes["threshold"][at]
            open_ += [(nodes["left"][at], tree, mask & below), (nodes["right"][at], tree, mask & ~below)]


@pytest.mark.parametrize("node_rows", [1 << 19, 200])
def test_forests_of_many_rows(spark, monkeypatch, node_rows):
    """Rows dealt by tree, with and without nodes split from sums first: forests like those of tasks that hold all rows."""
    import numpy as np

    rng = np.random.default_rng(2)
    data = [(float(a), float(b), 3.0, float(a + b + rng.normal() * 0.3 > 0.7)) for a, b in rng.normal(size=(2000, 2))]
    train = spark.createDataFrame(data, "a double, b double, c double, target double").withColumn("features", F.array("a", "b", "c")).repartition(3).persist()
    growths = [models.Growth(np.array([1, 0]), 2, np.array([1.0, 2.0]), 30, 8), models.Growth(np.array([0, 1, 2]), 1, np.array([1.0, 1.0]), 3, 4)]
    wanted = models.grow(train, len(data), growths, 5)
    monkeypatch.setattr(models, "WHOLE_ROWS", 100)
    monkeypatch.setattr(models, "NODE_ROWS", node_rows)
    monkeypatch.setattr(models, "grow_by_levels", None)
    found = models.grow(train, len(data), growths, 5)
    matrix, truth = np.array([row[:3] for row in data]), np.array([row[3] for row in data])
    for forest, other, growth in zip(found, wanted, growths):
        cuts = [(growth.depth, growth.trees), (2, growth.trees), (3, 2)]
        mine, theirs = forest.scores(matrix, cuts), other.scores(matrix, cuts)
        assert len(forest.roots) == growth.trees and forest.depth.max() <= growth.depth
        assert ((mine[:, 0] > 0.5) == truth).mean() > ((theirs[:, 0] > 0.5) == truth).mean() - 0.02
        # Sums of shares over a bootstrap are those of the rows, whatever the splits.
        assert abs(mine.mean(0) - theirs.mean(0)).max() < 0.03
        assert np.allclose(forest.importances(3, growth.depth, growth.trees), other.importances(3, growth.depth, growth.trees), atol=0.2)
    inner = np.flatnonzero(found[1].left != np.arange(len(found[1].left)))
    assert (found[1].depth[found[1].left[inner]] == found[1].depth[inner] + 1).all()
