"""Metrics of a scored table (MET1 to MET12).

Rows are first reduced to one per distinct score (and slice); everything that needs
an order then runs on slices of the score range, never on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loantide.operators.ranking import exact_quantiles, running_totals


def by_score(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg): label counts per distinct score."""
    return (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts with true and false positives above each score."""
    return running_totals(counts, "score", ["pos", "neg"], by, descending=True)


def _rank_aggs() -> list[Column]:
    pos, neg = F.col("pos"), F.col("neg")
    p, n = F.nullif(F.col("pos_total"), F.lit(0)), F.nullif(F.col("neg_total"), F.lit(0))
    tp, fp = F.col("pos_before") + pos, F.col("neg_before") + neg
    below = F.col("neg_total") - fp
    auc = F.sum(pos / p * (below + neg / 2.0) / n)
    return [
        auc.alias("auc_roc"),
        (2 * auc - 1).alias("gini"),
        F.sum(pos / p * tp / (tp + fp)).alias("avg_precision"),
        F.max(F.abs(tp / p - fp / n)).alias("ks"),
    ]


def rank_metrics(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with ties at half, Gini, average precision and KS (MET1, MET2, MET5)."""
    return _ranked(by_score(df, label, score, by), by).groupBy(*by).agg(*_rank_aggs())


def curve_points(df: DataFrame, label: str = "label", score: str = "score", points: int = 100) -> DataFrame:
    """ROC and precision-recall points over all distinct scores, thinned evenly to ``points`` (MET3)."""
    counts = by_score(df, label, score).withColumn("k", F.lit(1))
    r = running_totals(counts, "score", ["pos", "neg", "k"], descending=True)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    # position 0 is the empty prediction, position i the i-th highest distinct score
    position, last = F.col("k_before") + 1, F.col("k_total")
    m = F.least(F.lit(points), last + 1)
    step = F.expr("CAST(((k_before + 1) * (m - 1) + k_total - 1) DIV k_total AS BIGINT)")
    chosen = F.expr("(step * k_total) DIV (m - 1) = position AND step < m")
    curve = (
        r.withColumn("m", m)
        .withColumn("position", position)
        .withColumn("step", step)
        .where(chosen)
        .select(
            "position",
            (fp / F.nullif(F.col("neg_total"), F.lit(0))).alias("fpr"),
            (tp / F.nullif(F.col("pos_total"), F.lit(0))).alias("tpr"),
            (tp / (tp + fp)).alias("precision"),
            "score",
        )
    )
    origin = df.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("score"),
    )
    return origin.unionByName(curve)


def error_metrics(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), cut: float = 0.5, clip: float = 1e-7
) -> DataFrame:
    """Brier score, log-loss, F1 and the confusion matrix at ``cut`` (MET4)."""
    y, s = F.col(label).cast("int"), F.col(score).cast("double")
    p = F.least(F.greatest(s, F.lit(clip)), F.lit(1 - clip))
    hit = s > cut
    tp, fp = F.count_if(hit & (y == 1)), F.count_if(hit & (y == 0))
    fn, tn = F.count_if(~hit & (y == 1)), F.count_if(~hit & (y == 0))
    return df.groupBy(*by).agg(
        F.avg(F.pow(s - y, 2)).alias("brier"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
        F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"),
        tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
        F.count(F.lit(1)).alias("n"),
        F.avg(y.cast("double")).alias("positive_rate"),
    )


def _edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def _bin(score: Column, bins: int, closed: str) -> Column:
    """Bin number; ``left`` is [lo, hi), ``right`` is (lo, hi]; null outside."""
    out = None
    e = _edges(bins)
    for i in range(bins):
        inside = (score >= e[i]) & (score < e[i + 1]) if closed == "left" else (score > e[i]) & (score <= e[i + 1])
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def calibration_error(
    df: DataFrame, label: str = "label", score: str = "score", bins: int = 10, closed: str = "left"
) -> DataFrame:
    """Expected calibration error; a score on no bin (1.0 for ``left``, 0.0 for ``right``) adds nothing (MET6)."""
    per_bin = df.groupBy(_bin(F.col(score), bins, closed).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")
    )
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))).otherwise(0.0)
    return per_bin.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def calibration_curve(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per closed bin; a boundary score counts in both (MET7)."""
    e, s = _edges(bins), F.col(score)
    inside = F.array_compact(F.array(*[F.when((s >= e[i]) & (s <= e[i + 1]), i) for i in range(bins)]))
    return (
        df.select(F.explode(inside).alias("bin"), s.alias("s"), F.col(label).cast("double").alias("y"))
        .groupBy("bin")
        .agg(F.avg("s").alias("mean_prob"), F.avg("y").alias("fraction_pos"))
    )


def capture_rate(df: DataFrame, label: str = "label", score: str = "score", percentile: float = 0.95) -> DataFrame:
    """Share of positives at or above the score percentile (MET8)."""
    q = exact_quantiles(df, score, [percentile])
    threshold = q.select(q.columns[0]).scalar()
    positives = F.count_if(F.col(label) == 1)
    flagged = F.count_if((F.col(label) == 1) & (F.col(score) >= F.col("_threshold")))
    return df.withColumn("_threshold", threshold).agg(
        F.max("_threshold").alias("threshold"),
        (flagged / F.greatest(positives, F.lit(1))).alias("capture_rate"),
    )


def horizon_curve(
    df: DataFrame, label: str = "label", score: str = "score", months: str = "months_to_default", horizons: int = 6
) -> DataFrame:
    """Average precision of each lead time against all negatives, with its rows and positives (MET9).

    Counts per score come before the horizons are multiplied out. Without positives there is no value; ``enough`` says
    whether more than 10 rows and a positive stand behind it.
    """
    h = F.sequence(F.lit(1), F.lit(horizons))
    m = F.col(months)
    counts = (
        df.groupBy(F.col(score).cast("double").alias("score"), m.cast("int").alias("m"), (F.col(label) == 1).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "score", "y", "n",
            F.explode(F.when(F.col("y"), F.filter(h, lambda x: x == F.col("m"))).otherwise(h)).alias("horizon"),
        )
        .groupBy("horizon", "score")
        .agg(
            F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("y"), 0).otherwise(F.col("n"))).alias("neg"),
        )
    )
    per_horizon = _ranked(counts, ["horizon"]).groupBy("horizon").agg(
        *_rank_aggs()[2:3], (F.max("pos_total") + F.max("neg_total")).alias("n"), F.max("pos_total").alias("p")
    )
    every = df.sparkSession.range(1).select(F.explode(h).alias("horizon"))
    return every.join(per_horizon, "horizon", "left").select("horizon", *_with_counts(10))


def _with_counts(least: int) -> list[Column]:
    n, p = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    return [F.when(p > 0, F.col("avg_precision")).alias("pr_auc"), n.alias("n"), p.alias("n_positive"), ((n > least) & (p > 0)).alias("enough")]


def slice_metric(df: DataFrame, by: str, label: str = "label", score: str = "score", min_rows: int = 50) -> DataFrame:
    """Average precision of every slice, with its rows and positives; ``enough``: more than ``min_rows`` rows and a positive (MET10)."""
    out = _ranked(by_score(df, label, score, [by]), [by]).groupBy(by).agg(
        _rank_aggs()[2], (F.max("pos_total") + F.max("neg_total")).alias("n"), F.max("pos_total").alias("p")
    )
    return out.select(by, *_with_counts(min_rows))


def token_accuracy(df: DataFrame, label: str = "label", ranked: str = "top3", loss: str = "loss") -> DataFrame:
    """Top-1 and top-3 accuracy, loss and perplexity over masked positions (MET11)."""
    y, top = F.col(label), F.col(ranked)
    mean_loss = F.sum(loss) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.where(y != -100).agg(
        F.round(F.avg((top[0] == y).cast("int")), 4).alias("masked_accuracy"),
        F.round(F.avg(F.array_contains(top, y).cast("int")), 4).alias("top3_accuracy"),
        F.round(mean_loss, 6).alias("avg_loss"),
        F.round(F.exp(F.least(mean_loss, F.lit(20.0))), 4).alias("perplexity"),
        F.count(F.lit(1)).alias("total_masked"),
    )


def class_accuracy(df: DataFrame, label: str = "label", ranked: str = "top3") -> DataFrame:
    """Top-1 accuracy per class over masked positions (MET11)."""
    y = F.col(label)
    return df.where(y != -100).groupBy(y.alias("class_id")).agg(
        F.round(F.avg((F.col(ranked)[0] == y).cast("int")), 4).alias("accuracy")
    )


def regression_metrics(
    df: DataFrame, target: str = "target", point: str = "point", mu: str = "mu", sigma: str = "sigma"
) -> DataFrame:
    """MSE, Gaussian negative log-likelihood, R² and 90 % interval coverage (MET12).

    The likelihood divides by sigma, not by its square, as documented.
    """
    y, p, m, s = (F.col(c) for c in (target, point, mu, sigma))
    residual = F.sum(F.pow(y - p, 2))
    spread = F.var_pop(y) * F.count(y)
    inside = (y >= m - 1.645 * s) & (y <= m + 1.645 * s)
    return df.agg(
        F.round(F.avg(F.pow(y - p, 2)), 6).alias("mse"),
        F.round(F.avg(0.5 * (F.log(s) + F.pow(y - m, 2) / (s + 1e-8))), 6).alias("nll"),
        F.round(1 - residual / F.greatest(spread, F.lit(1e-8)), 4).alias("r2"),
        F.round(F.avg(inside.cast("int")), 4).alias("coverage_at_90"),
    )


def compare_runs(runs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Runs by falling ROC-AUC, the best marked, baseline figures alongside (TOP4).

    ``runs`` holds one row per training run; ``baseline`` is one row.
    """
    best = runs.agg(F.max("auc_roc")).scalar()
    out = runs.withColumn("is_best", F.col("auc_roc") == best)
    for c in ("auc_roc", "gini", "avg_precision"):
        value = F.lit(None).cast("double") if baseline is None else baseline.select(c).scalar()
        out = out.withColumn(f"baseline_{c}", value)
    return out.orderBy(F.desc("auc_roc"), "run_id")
