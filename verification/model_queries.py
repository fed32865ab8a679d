"""Model inputs and models (FEA2, FEA3, SEQ10, MDL1 to MDL5, TOP3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.operators import features as X
from loantide.operators.panels import explode_embedding, gold_features, split_panel, with_embeddings
from verification.bindings import PANEL_SQL, panel, table
from verification.history_queries import SILVER_SQL
from verification.shape import plain

QUERIES, ORACLE = {}, {}
EMB = [f"emb_{i}" for i in range(64)]


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = lambda spark, sf: plain(fn(spark, sf), digits)
    if sql is not None:
        ORACLE[name] = PANEL_SQL + SILVER_SQL + sql


def gold(s, f):
    return gold_features(*split_panel(panel(s, f)))


_CATS = ["province", "arrears_bucket", "cltomv_current_bucket"]
add("fea2_encode_categoricals", lambda s, f: X.encode_categoricals(gold(s, f), _CATS).groupBy(*_CATS).agg(F.count(F.lit(1)).alias("n")),
    ", e AS (SELECT " + ", ".join(f"dense_rank() OVER (ORDER BY coalesce({c}, '__NULL__')) - 1 AS {c}" for c in _CATS)
    + " FROM gold) SELECT *, count(*) AS n FROM e GROUP BY ALL")
_SCALED = ["current_balance", "original_balance", "seasoning_months"]


def _standardised(s, f):
    g = gold(s, f)
    train = g.where("obs_year <= 1998")
    return X.standardise(train, g, _SCALED).groupBy("obs_year").agg(*[F.avg(c).alias(c) for c in _SCALED])


add("fea3_standardise", _standardised, "SELECT CAST(obs_year AS BIGINT) AS obs_year, " + ", ".join(
    f"round(avg(({c} - (SELECT avg({c}) FROM gold WHERE obs_year <= 1998)) / (SELECT stddev_pop({c}) FROM gold WHERE obs_year <= 1998)), 4) AS {c}"
    for c in _SCALED) + " FROM gold GROUP BY 1", 4)


def _parts(s, f, year):
    train, test = X.time_split(gold(s, f), year)
    count = lambda d, p: d.groupBy("obs_year").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(p))
    return count(train, "train").unionByName(count(test, "test"))


add("seq10_time_split", lambda s, f: _parts(s, f, 1998),
    "SELECT CAST(obs_year AS BIGINT) AS obs_year, count(*) AS n, CASE WHEN obs_year > 1998 THEN 'test' ELSE 'train' END AS part FROM gold GROUP BY ALL")
add("seq10_time_split_fallback", lambda s, f: _parts(s, f, None), """
, q AS (SELECT quantile_cont(datediff('day', DATE '1970-01-01', reporting_date), 0.8) AS t FROM gold)
SELECT CAST(obs_year AS BIGINT) AS obs_year, count(*) AS n, CASE WHEN datediff('day', DATE '1970-01-01', reporting_date) > (SELECT t FROM q) THEN 'test' ELSE 'train' END AS part
FROM gold GROUP BY ALL""")


def _platt(s, f):
    """Slope and intercept of the default flag over the loan-to-value ratio."""
    a, b = X.fit_platt(gold(s, f).where("cltomv_current IS NOT NULL").select(F.col("default_in_3m").alias("label"), (F.col("cltomv_current") / 100.0).alias("score")))
    return s.range(1).select(F.lit(a).alias("slope"), F.lit(b).alias("intercept"))


def _newton_sql(steps: int) -> str:
    """One common table expression for each step."""
    out = """, d AS (SELECT cltomv_current / 100.0::DOUBLE AS s, default_in_3m = 1 AS y FROM gold WHERE cltomv_current IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE y)::DOUBLE AS p, count(*) FILTER (WHERE NOT coalesce(y, false))::DOUBLE AS q FROM d),
e AS (SELECT s, CASE WHEN y THEN (p + 1) / (p + 2) ELSE 1 / (q + 2) END AS t FROM d, c),
n0 AS (SELECT 0.0::DOUBLE AS a, ln((p + 1) / (q + 1)) AS b FROM c)"""
    for i in range(steps):
        out += f""",
h{i} AS (SELECT a, b, sum((t - p) * s) AS ga, sum(t - p) AS gb, sum(p * (1 - p) * s * s) AS haa, sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) AS hbb
  FROM (SELECT a, b, s, t, 1 / (1 + exp(-(a * s + b))) AS p FROM e, n{i}) GROUP BY a, b),
n{i + 1} AS (SELECT a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b + (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b FROM h{i})"""
    return out + f" SELECT round(a, 6) AS slope, round(b, 6) AS intercept FROM n{steps}"


add("mdl3_platt_fit", _platt, _newton_sql(X.PLATT_STEPS))


def _prepared(s, f):
    """Labelled gold features with encoded categories and embeddings, split by time."""
    g = X.encode_categoricals(gold(s, f), X.CATEGORICAL_COLUMNS).withColumnRenamed(X.TARGET, "label")
    emb = explode_embedding(table(s, f, "embeddings").select("vec_id", "embedding"), "embedding", 64)
    size = emb.agg(F.count(F.lit(1))).scalar()
    vec = F.substring("loan_id", 2, 18).cast("long")
    joined = with_embeddings(g.withColumn("_n", size).withColumn("vec_id", F.pmod(vec, F.col("_n"))).drop("_n"), emb, "vec_id")
    return X.time_split(X.written(joined, "model-input"), 1998)


BASE = [*X.FEATURE_COLUMNS, *[c for c in X.CATEGORICAL_COLUMNS if c != "construction_year_bucket"]]


def _gbt(s, f):
    train, test = _prepared(s, f)
    model = X.fit_gbt(X.assemble(train, BASE), trees=10, depth=4)
    return train, test, model


def _with_calibration(s, f):
    train, test = _prepared(s, f)
    early, held = train.where("obs_year < 1998"), train.where("obs_year = 1998")
    model = X.fit_logistic(X.assemble(early, BASE), 50)
    return X.evaluate(X.calibrate(X.score(model, X.assemble(held, BASE)), X.score(model, X.assemble(test, BASE))))


def _probe(fit):
    def run(s, f):
        train, test = _prepared(s, f)
        measured = X.moments(train, EMB)
        scaled_train, scaled_test = X.standardise(train, train, EMB, measured), X.standardise(train, test, EMB, measured)
        return X.evaluate(X.score(fit(X.assemble(scaled_train, EMB)), X.assemble(scaled_test, EMB)))
    return run


add("mdl1_gbt", lambda s, f: (lambda tr, te, m: X.evaluate(X.score(m, X.assemble(te, BASE))))(*_gbt(s, f)))
add("mdl2_linear_probe", _probe(lambda d: X.fit_logistic(d, 100)))
add("mdl3_calibrate", _with_calibration)
add("mdl4_mlp", _probe(lambda d: X.fit_mlp(d, 64, 20)))
add("mdl5_compare_feature_sets", lambda s, f: X.compare_feature_sets(*_prepared(s, f), {"base": BASE, "embeddings": EMB, "hybrid": [*BASE, *EMB]},
    fit=lambda d: X.fit_gbt(d, trees=5, depth=4)))
add("top3_top_features", lambda s, f: (lambda tr, te, m: X.top_features(m, BASE, tr))(*_gbt(s, f)))
