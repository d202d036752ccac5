"""Classifier and agreement metrics over prediction and label-pair tables.

Predictions are {keys..., truth, predicted, score}; every function takes the key columns to group by,
so any number of models is measured in one job.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltascope import vocab
from deltascope.functions.numbers import ratio, sum_where

C = F.col


def reduced(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Predictions with equal outcome and score as one row with their number `n`; every metric can be had from it."""
    return predictions.groupBy(*keys, "truth", "predicted", C("score").cast("double").alias("score")).agg(F.count("*").alias("n"))


def _number(predictions: DataFrame) -> Column:
    """How many predictions a row stands for."""
    return C("n") if "n" in predictions.columns else F.lit(1)


def confusion(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    number = _number(predictions)
    cell = lambda truth, predicted: sum_where((C("truth") == truth) & (C("predicted") == predicted), number).cast("long")
    return predictions.groupBy(*keys).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def metric_columns() -> dict[str, Column]:
    """Metrics over the columns tn, fp, fn, tp; an empty denominator gives 0."""
    tn, fp, fn, tp = C("tn"), C("fp"), C("fn"), C("tp")
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    false_positive_rate = ratio(fp, fp + tn)
    both = ((tp + fn) > 0) & ((tn + fp) > 0)
    exact = {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "balanced_accuracy": F.when(both, (recall + specificity) / 2).otherwise(0.0),
        "false_positive_rate": false_positive_rate,
        "false_negative_rate": ratio(fn, fn + tp),
        "false_alerts_per_100_benign": false_positive_rate * 100,
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "specificity": specificity,
    }
    return {name: F.round(value, 6) for name, value in exact.items()}


def binary_metrics(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    return confusion(predictions, keys).withColumns(metric_columns())


def cumulative_by_score(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at it, and how many lie strictly below.

    Rows are first reduced to distinct scores. These are cut at approximate quantiles, so a running sum
    covers one cut at a time and the totals of the cuts before it (as many as shuffle partitions, for each
    key) are added.
    """
    keys, number = list(keys), _number(predictions)
    parts = max(2, int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scores = predictions.groupBy(*keys, C("score").cast("double").alias("score")).agg(
        sum_where(C("truth") == 1, number).cast("long").alias("pos"), sum_where(C("truth") == 0, number).cast("long").alias("neg")
    )
    fractions = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = scores.agg(F.percentile_approx("score", fractions, 10000).alias("b"))
    cut = scores.withColumn("_bounds", bounds.scalar()).withColumn(
        "_cut", F.size(F.filter("_bounds", lambda bound: bound < C("score")))
    ).drop("_bounds")
    totals = cut.groupBy(*keys, "_cut").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_cut", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n")
    )
    inside = Window.partitionBy(*keys, "_cut").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda name: F.coalesce(F.sum(name).over(inside), F.lit(0))
    local = cut.withColumns({"_lp": running("pos"), "_ln": running("neg")})
    joined = local.join(offsets, [*keys, "_cut"])
    return joined.select(
        *keys, "score", "pos", "neg", (C("_lp") + C("_p")).alias("pos_below"), (C("_ln") + C("_n")).alias("neg_below")
    )


def ranking_metrics(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per key; null when only one class is there."""
    keys = list(keys)
    number = _number(predictions)
    totals = predictions.groupBy(*keys).agg(
        sum_where(C("truth") == 1, number).cast("long").alias("positive_count"), sum_where(C("truth") == 0, number).cast("long").alias("negative_count")
    )
    steps = cumulative_by_score(predictions, keys)
    joined = steps.join(totals, keys) if keys else steps.withColumns(
        {"positive_count": totals.select("positive_count").scalar(), "negative_count": totals.select("negative_count").scalar()}
    )
    at_least = (C("positive_count") - C("pos_below")).cast("double")
    flagged = at_least + C("negative_count") - C("neg_below")
    summed = joined.groupBy(*keys, "positive_count", "negative_count").agg(
        F.sum(C("pos") * (C("neg_below") + C("neg") / 2.0)).alias("_wins"),
        F.sum(C("pos") * F.try_divide(at_least, flagged)).alias("_precision"),
    )
    both = (C("positive_count") > 0) & (C("negative_count") > 0)
    product = C("positive_count").cast("double") * C("negative_count")
    return summed.select(
        *keys, "positive_count", "negative_count",
        F.when(both, F.round(F.try_divide(C("_wins"), product), 6)).alias("roc_auc"),
        F.when(both, F.round(F.try_divide(C("_precision"), C("positive_count")), 6)).alias("pr_auc"),
    )


def extended_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    predictions = reduced(predictions, keys)
    return binary_metrics(predictions, keys).join(ranking_metrics(predictions, keys), keys)


def bootstrap_intervals(predictions: DataFrame, keys: list[str] = (), samples: int = 1000, seed: int = 1337) -> DataFrame:
    """5 / 50 / 95 percentiles of four metrics over resamples of the same size.

    A resample is fully described by its four confusion counts, and drawing rows with replacement makes
    these a multinomial draw. So each resample costs one draw, whatever the number of predictions.
    """
    keys = list(keys)
    counts = confusion(predictions, keys)
    kinds = dict(counts.dtypes)
    key_schema = "".join(f"{name} {kinds[name]}, " for name in keys)

    def draw(batches):
        import zlib

        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                cells = np.array([row.tn, row.fp, row.fn, row.tp], dtype="int64")
                n = int(cells.sum())
                if n == 0:
                    continue
                # Each key draws from a stream of its own.
                rng = np.random.default_rng([seed, zlib.crc32(repr([str(getattr(row, name)) for name in keys]).encode())])
                drawn = rng.multinomial(n, cells / n, size=samples)
                out = pd.DataFrame(drawn, columns=["tn", "fp", "fn", "tp"])
                out.insert(0, "n", n)
                for at, name in enumerate(keys):
                    out.insert(at, name, getattr(row, name))
                yield out

    drawn = counts.mapInPandas(draw, key_schema + "n bigint, tn bigint, fp bigint, fn bigint, tp bigint")
    names = ["precision", "recall", "f1", "balanced_accuracy"]
    measured = drawn.withColumns({name: value for name, value in metric_columns().items() if name in names})
    long = measured.unpivot([*keys, "n"], names, "metric", "value")
    at = lambda share: F.round(F.percentile("value", F.lit(share)), 6)
    return long.groupBy(*keys, "metric").agg(
        F.max("n").alias("records"), at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95")
    ).withColumn("status", F.when(C("records") < 20, "computed_but_not_reliable_for_inference").otherwise("computed"))


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Best validation result per key: F1, then balanced accuracy, then lower false-positive rate, then shorter
    parameters; the earlier candidate wins a tie."""
    order = F.struct(
        C("f1"), C("balanced_accuracy"), (-C("false_positive_rate")).alias("a"), (-F.length("params")).alias("b"), (-C("candidate")).alias("c")
    )
    rest = [name for name in candidates.columns if name not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best")).select(*keys, "best.*")


# -- agreement --------------------------------------------------------------
def label_cross_table(pairs: DataFrame) -> DataFrame:
    """Counts per (first label, second label) of comparable pairs: {left, right, n}."""
    comparable = (C("left") != vocab.NOT_COMPARABLE) & (C("right") != vocab.NOT_COMPARABLE)
    return pairs.where(comparable).groupBy("left", "right").agg(F.count("*").alias("n"))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """One row: unweighted kappa of {left, right} labels, with a status when it does not exist."""
    return kappa_of_cross_table(label_cross_table(pairs))


def kappa_of_cross_table(cross: DataFrame) -> DataFrame:
    left = cross.groupBy(C("left").alias("label")).agg(F.sum("n").alias("l"))
    right = cross.groupBy(C("right").alias("label")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(C("l").cast("double") * C("r")), F.lit(0.0)))
    totals = cross.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("comparable_count"),
        F.coalesce(F.sum(F.when(C("left") == C("right"), C("n"))), F.lit(0)).alias("exact_count"),
    ).withColumn("_chance", chance.scalar())
    n = C("comparable_count")
    observed = F.try_divide(C("exact_count").cast("double"), n)
    expected = F.try_divide(C("_chance"), n.cast("double") * n)
    return totals.select(
        "comparable_count", "exact_count", observed.alias("observed_agreement"), expected.alias("expected_agreement")
    ).select(
        "*",
        F.when(
            (C("comparable_count") > 0) & (C("expected_agreement") != 1.0),
            (C("observed_agreement") - C("expected_agreement")) / (1.0 - C("expected_agreement")),
        ).alias("cohens_kappa"),
        F.when(C("comparable_count") == 0, "NOT_AVAILABLE")
        .when(C("expected_agreement") == 1.0, "NOT_AVAILABLE_DEGENERATE_MARGINALS")
        .otherwise("AVAILABLE_UNWEIGHTED")
        .alias("status"),
    )


def check_published_agreement(published: DataFrame, cross: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """Re-derive published numbers {statistic, value} from a cross table; rows that differ come back."""
    derived = kappa_of_cross_table(cross).select(
        C("observed_agreement"), C("expected_agreement"), C("cohens_kappa"),
        C("exact_count").cast("double").alias("exact_agreements"), C("comparable_count").cast("double").alias("comparable_cases"),
    ).unpivot([], ["observed_agreement", "expected_agreement", "cohens_kappa", "exact_agreements", "comparable_cases"], "statistic", "derived")
    joined = published.join(derived, "statistic", "left")
    same = F.abs(C("value") - C("derived")) <= tolerance
    return joined.where(~F.coalesce(same, F.lit(False)))


# -- errors -----------------------------------------------------------------
def error_category(label: Column) -> Column:
    """Why a prediction may have gone wrong, from the features of the pair."""
    return (
        F.when(
            label == "benign_transition",
            F.when(C("new_external_network_count") > 0, "feature-rich benign update / network false positive")
            .when(C("added_obfuscation_score") > 0, "benign minification or obfuscation-like static signal")
            .otherwise("benign update flagged by broad static drift signal"),
        )
        .when((C("added_api_count") == 0) & (C("new_external_network_count") == 0), "insufficient behaviour signal")
        .otherwise("model missed review-worthy transition despite available static drift")
    )


# What an error row shows of its pair
ERROR_FIELDS = [
    "label", "permission_risk_delta", "host_scope_score_delta", "new_external_network_count", "added_obfuscation_score",
    "source_sink_flow_count", "service_worker_introduced", "added_api_count",
]


def attributed_errors(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Wrong predictions joined to the telling features of their pair, with a category."""
    wrong = predictions.where(C("truth") != C("predicted")).select("model", "record_id", "predicted", "score")
    shown = features.select("record_id", *ERROR_FIELDS)
    # By order: files of few values are much smaller than their rows, and would be taken for small enough to go to all tasks.
    return wrong.join(shown.hint("merge"), "record_id").withColumn("failure_category", error_category(C("label")))


def error_breakdown(errors: DataFrame) -> DataFrame:
    """False positives and false negatives per model and category."""
    return errors.groupBy("model", "failure_category").agg(
        F.count_if(C("label") == "benign_transition").alias("false_positives"),
        F.count_if(C("label") == "risky_transition").alias("false_negatives"),
    )


def rule_predictions(features: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Predictions of the baseline rules: a row is flagged when any feature of the rule is above zero."""
    from deltascope.operators.features import binary_label

    rules = vocab.BASELINE_RULES if rules is None else rules
    flagged = [
        F.struct(
            F.lit(rule).alias("model"),
            F.greatest(*[(F.coalesce(C(name).cast("double"), F.lit(0.0)) > 0).cast("int") for name in names], F.lit(0)).alias("predicted"),
        )
        for rule, names in rules.items()
    ]
    return features.select("record_id", "extension_id", "split", binary_label(C("label")).alias("truth"), F.inline(F.array(*flagged)))


def score_predictions(scored: DataFrame, threshold: float = 40.0) -> DataFrame:
    """The score as a classifier: flagged from High upwards."""
    from deltascope.operators.features import binary_label

    return scored.select(
        "record_id", "extension_id", "split", F.lit("rule_engine").alias("model"), binary_label(C("label")).alias("truth"),
        (C("risk_score") >= threshold).cast("int").alias("predicted"), (C("risk_score") / 100.0).alias("score"),
    )
