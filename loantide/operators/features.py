"""Model inputs and models (FEA2, FEA3, SEQ10, TOP3, MDL1 to MDL5).

The models are those of Spark's own library; their figures differ from other
implementations of the same methods.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from loantide.functions.nulls import fill_missing
from loantide.operators.history import DATE
from loantide.operators.metrics import calibration_error, capture_rate, error_metrics, rank_metrics
from loantide.session import written

NULL_LABEL = "__NULL__"
# Numeric and categorical model features.
FEATURE_COLUMNS = """
origination_year original_balance legal_maturity_months oltomv_original original_market_value_at_origination
loan_to_income payment_due_to_income_pct borrower_annual_income debtor_count construction_year
primary_energy_demand_kwh_m2 interest_only_flag self_employed_flag buy_to_let_flag nhg_flag current_balance
current_interest_rate_pct remaining_term_months seasoning_months cltomv_current cltimv_current arrears_amount
days_past_due default_crr_flag foreclosure_flag forbearance_flag restructuring_flag balance_mom_1m
""".split()
CATEGORICAL_COLUMNS = """
repayment_type rate_type borrower_type employment_status loan_purpose province economic_region_nuts3
construction_year_bucket occupancy property_type property_usage arrears_bucket performing_status epc_label
balance_bucket cltomv_current_bucket
""".split()
TARGET = "default_in_3m"
LAST_TRAIN_YEAR = 2024


def label_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, label, id``: the alphabetical place of each label of each column, from 0; null is a label of its own.

    No column is gathered: the distinct labels are cut into sorted ranges, and the sizes of a column's earlier ranges (a row
    for each range and column) give a range its offset.
    """
    spark = df.sparkSession
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(NULL_LABEL)).alias("label")) for c in cols])).alias("x")
    labels = df.select(pairs).select("x.*").distinct()
    ranges = labels.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "column", "label").sortWithinPartitions("column", "label")
    # the number holds the range above bit 33 and the place in it below; written, so that later reads agree
    placed = written(ranges.withColumn("at", F.monotonically_increasing_id()), "labels").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("column", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("column", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(offsets, ["column", "part"]).select("column", "label", (F.col("at") - F.col("first") + F.col("before")).alias("id"))


def encode_categoricals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Alphabetical label ids in place of text; null is a label of its own (FEA2).

    The dictionary is a table, joined column by column: Spark broadcasts a small one and shuffles a large one.
    """
    present = [c for c in cols if c in df.columns]
    ids = written(label_ids(df, present), "dictionary") if present else None
    out = df
    for c in present:
        mine = ids.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("id").cast("int").alias("_id"))
        out = out.join(mine, F.coalesce(out[c].cast("string"), F.lit(NULL_LABEL)) == F.col("_label"), "left").drop(c, "_label").withColumnRenamed("_id", c)
    return out.select(*df.columns)


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and deviation of each column in one row, written: whatever is scaled by them later, the rows are read once."""
    one = [F.avg(c).alias(f"m_{c}") for c in cols] + [F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    return written(df.agg(F.struct(*one).alias("stats")), "moments")


def standardise(train: DataFrame, df: DataFrame, cols: Sequence[str], measured: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit deviation as measured on ``train``; a constant column keeps deviation 1 (FEA3).

    ``measured``: the ``moments`` of ``train`` where several tables are scaled by them.
    """
    stats = (moments(train, cols) if measured is None else measured).scalar()
    scaled = lambda c: (F.col(c) - F.col(f"_stats.m_{c}")) / F.when(F.col(f"_stats.s_{c}") == 0, 1.0).otherwise(F.col(f"_stats.s_{c}"))
    wanted = set(cols)
    return df.withColumn("_stats", stats).select(*[scaled(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    """One feature vector; missing values become -999 (FEA3)."""
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="keep").transform(fill_missing(df, list(cols)))


def time_split(df: DataFrame, last_train_year: int | None = LAST_TRAIN_YEAR, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train up to a year and test after it; with ``last_train_year`` None the latest dates, beyond ``fraction`` of the rows, are the test set (SEQ10)."""
    if last_train_year is not None:
        late = F.coalesce(F.col("obs_year") > last_train_year, F.lit(False))
        return df.where(~late), df.where(late)
    # the first date whose rows reach beyond the fraction, over one row per date
    day = F.datediff(F.col(DATE), F.lit("1970-01-01").cast("date"))
    threshold = df.agg(F.percentile(day, F.lit(fraction))).scalar()
    split = df.withColumn("_late", F.coalesce(day > threshold, F.lit(False)))
    return split.where("NOT _late").drop("_late"), split.where("_late").drop("_late")


def _scored(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1])


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives weigh as much as all negatives together."""
    weight = df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1)))).scalar()
    return df.withColumn("_pos_weight", weight).withColumn(
        "weight", F.when(F.col(label) == 1, F.col("_pos_weight")).otherwise(1.0)
    ).drop("_pos_weight")


def fit_gbt(train: DataFrame, trees: int = 300, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, seed: int = 42):
    """Boosted-tree default model (MDL1)."""
    gbt = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth,
        stepSize=rate, subsamplingRate=subsample, seed=seed,
    )
    return gbt.fit(with_class_weight(train))


def fit_logistic(train: DataFrame, iterations: int = 1000):
    """Linear probe (MDL2)."""
    return LogisticRegression(labelCol="label", featuresCol="features", maxIter=iterations).fit(train)


def fit_mlp(train: DataFrame, width: int, iterations: int = 100, seed: int = 42):
    """Small network with hidden layers of 128 and 64 (MDL4)."""
    return MultilayerPerceptronClassifier(
        labelCol="label", featuresCol="features", layers=[width, 128, 64, 2], maxIter=iterations, seed=seed
    ).fit(train)


PLATT_STEPS = 12


def fit_platt(df: DataFrame, label: str = "label", score: str = "score", steps: int = PLATT_STEPS) -> tuple[float, float]:
    """Slope and intercept of the sigmoid that maps scores to probabilities (MDL3).

    Newton steps of a fixed number over sums in built-in functions: the driver gets five numbers a step. The rows are
    first counted by score and label. The targets are smoothed, (N+1)/(N+2) for positives and 1/(N+2) for negatives, so that
    separable scores have a finite fit.
    """
    counts = written(df.groupBy(F.col(score).cast("double").alias("s"), (F.col(label) == 1).alias("y")).agg(F.count(F.lit(1)).alias("n")), "score-counts")
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("y"), F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~F.col("y"), F.col("n"))), F.lit(0)).alias("q")).first()
    target = F.when(F.col("y"), (total["p"] + 1.0) / (total["p"] + 2.0)).otherwise(1.0 / (total["q"] + 2.0))
    a, b = 0.0, math.log((total["p"] + 1.0) / (total["q"] + 1.0))
    for _ in range(steps):
        p = 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("s") + F.lit(b))))
        gap, bend = F.col("n") * (target - p), F.col("n") * p * (1.0 - p)
        r = counts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(k) for k, x in (("ga", gap * F.col("s")), ("gb", gap), ("haa", bend * F.col("s") * F.col("s")), ("hab", bend * F.col("s")), ("hbb", bend))]).first()
        det = r["haa"] * r["hbb"] - r["hab"] * r["hab"]
        if det <= 1e-12 * max(r["haa"] * r["hbb"], 1e-300):  # one score only, or saturated: the intercept alone
            a, b = a, b + (r["gb"] / r["hbb"] if r["hbb"] > 1e-12 else 0.0)
        else:
            a, b = a + (r["ga"] * r["hbb"] - r["gb"] * r["hab"]) / det, b + (r["gb"] * r["haa"] - r["ga"] * r["hab"]) / det
    return a, b


def calibrate(held_out: DataFrame, scored: DataFrame) -> DataFrame:
    """Sigmoid calibration of ``score``, fitted on rows that neither trained nor test the model (MDL3)."""
    a, b = fit_platt(held_out)
    return scored.withColumn("score", 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("score") + F.lit(b)))))


def score(model, df: DataFrame) -> DataFrame:
    return _scored(model, df)


def top_features(model, names: Sequence[str], df: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most important features (TOP3); the list is as long as the feature list."""
    values = model.featureImportances.toArray().tolist()
    rows = [F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance")) for n, v in zip(names, values)]
    return (
        df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        .orderBy(F.desc("importance"), "feature").limit(k)
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """Rank, error, calibration and capture figures of one scored table, as one row."""
    scored = written(scored.select("label", "score"), "scored")
    out = rank_metrics(scored)
    for part in (error_metrics(scored).select("brier"), calibration_error(scored), capture_rate(scored).select("capture_rate")):
        out = out.withColumn(part.columns[0], part.scalar())
    return out


def compare_feature_sets(train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], fit=fit_gbt) -> DataFrame:
    """The same model on several feature lists: one result row each (MDL5)."""
    out = None
    for name, cols in sets.items():
        model = fit(assemble(train, cols))
        row = evaluate(_scored(model, assemble(test, cols))).select(F.lit(name).alias("feature_set"), "*")
        out = row if out is None else out.unionByName(row)
    return out
