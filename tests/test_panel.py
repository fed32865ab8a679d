"""Order statistics, histories, sequences and metrics against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loantide.functions.states import ARREARS_STATES
from loantide.operators import features as X, history as H, metrics as M, ranking as R, sequences as S
from loantide.operators.portfolio import distribution, top_share

RNG = random.Random(7)


def month(i):
    y, m = divmod(i, 12)
    return datetime.date(2020 + y, m + 1, 28)


@pytest.fixture(scope="module")
def rows():
    out = []
    for loan, n in [("a", 1), ("b", 24), ("c", 30), *((f"l{i}", RNG.randint(1, 12)) for i in range(20))]:
        for t in sorted(RNG.sample(range(40), n)):
            out.append((loan, month(t), RNG.choice(ARREARS_STATES), round(RNG.uniform(0, 5), 1), RNG.choice([1.5, 2.5, None]), float(RNG.randint(0, 500)), RNG.random() < 0.2))
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "loan_id string, reporting_date date, arrears_bucket string, cltomv_current double, current_interest_rate_pct double,"
                                       " current_balance double, default_crr_flag boolean").withColumn("days_past_due", F.lit(0)).repartition(5)


def test_quantiles_with_one_value_holding_most_rows(spark):
    values = [5.0] * 700 + [RNG.uniform(0, 10) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    row = R.exact_quantiles(df, "v", [0.05, 0.5, 0.95, 1.0]).first()
    assert np.allclose([row.p5, row.p50, row.p95, row.p100], np.percentile(values, [5, 50, 95, 100]))


def test_top_share_cuts_inside_ties(spark):
    values = [1.0] * 50 + [2.0] * 40 + [3.0] * 10
    df = spark.createDataFrame([(v,) for v in values], "current_balance double")
    r = top_share(df, 0.33, None).first()
    assert (r.n_rows, r.top_sum, r.total) == (33, 10 * 3 + 23 * 2, sum(values))


def test_distribution_shares_add_up(panel):
    assert abs(distribution(panel, "arrears_bucket", None).agg(F.sum("share_pct")).first()[0] - 100) < 1e-9


def test_streaks(panel, rows):
    got = {(r.loan_id, r.reporting_date): (r.arrears_streak, r.default_streak) for r in H.default_streak(H.arrears_streak(panel)).collect()}
    for loan in {r[0] for r in rows}:
        a = d = 0
        for r in sorted(x for x in rows if x[0] == loan):
            a = 0 if r[2] in ("Performing", "Redeemed", "Charged-Off") else a + 1
            d = d + 1 if r[2] == "Defaulted" else 0
            assert got[(loan, r[1])] == (a, d)


def test_one_per_date_with_a_hot_loan(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 50).cast("string"))).alias("loan_id"),
                                  F.date_add(F.lit("2020-01-31").cast("date"), (F.col("id") % 4).cast("int")).alias("reporting_date"), "id")
    out = H.one_per_date(df, [F.desc("id")])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.loan_id, r.reporting_date): r.id for r in out.collect()}[("hot", datetime.date(2020, 1, 31))] == 4992


def test_sequences(panel, rows):
    edges = S.bin_edges(S.fit_bins(panel))
    assert np.allclose(edges["CLTV"], sorted(set(np.percentile([r[3] for r in rows if 0 < r[3] < 200], range(0, 101, 10)))))
    assert len(edges["DPD"]) == 2 and len(S.VOCAB) == 53
    assert [S.VOCAB[f"{f}_Q0"] for f in S.FEATURES] == [13, 23, 33, 43]
    seqs = {(r.loan_id, r.window): r for r in S.next_event(S.mask_events(S.attention_mask(S.build_sequences(panel, edges)))).collect()}
    n_windows = 0
    for loan in {r[0] for r in rows}:
        mine = sorted(x for x in rows if x[0] == loan)
        every = [S.EVENT_TOKENS[ARREARS_STATES.index(r[2])] for r in mine]
        for k in range(0, len(mine), 24):
            s, part, events = seqs[(loan, k // 24)], mine[k : k + 24], every[k : k + 24]
            n, n_windows = len(part), n_windows + 1
            assert len(s.seq_tokens) == 120 and s.seq_len == n and list(s.event_seq) == events
            assert s.final_state == every[-1] and s.had_default == any(r[6] for r in mine)
            assert list(s.seq_tokens[n * 5:]) == [0] * (120 - n * 5) and sum(s.attention_mask) == n
            if part[0][4] is None:
                assert s.seq_tokens[2] == S.UNK
            assert list(s.targets) == [S.VOCAB[e] for e in events[1:]] + [-100] * (24 - n + 1)
            for i, label in enumerate(s.labels):
                masked = label != -100
                assert s.input_ids[i * 5] == (S.MASK if masked else s.seq_tokens[i * 5])
                assert not masked or (i < n and label == s.seq_tokens[i * 5])
    assert n_windows == len(seqs)


def test_label_ids_and_encoding(spark):
    labels = [f"l{i * 7919 % 5000}" for i in range(5000)] + [None]
    df = spark.createDataFrame([(i, x, "ab"[i % 2]) for i, x in enumerate(labels)], "id int, c string, d string").repartition(6)
    got = {r["id"]: (r["c"], r["d"]) for r in X.encode_categoricals(df, ["c", "d", "absent"]).collect()}
    order = {x: i for i, x in enumerate(sorted({x or X.NULL_LABEL for x in labels}))}
    assert got == {i: (order[x or X.NULL_LABEL], i % 2) for i, x in enumerate(labels)}


def test_platt_fit(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.normal(size=3000), 2)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.7 * s - 0.6)))).astype(int)
    frame = lambda s, y: spark.createDataFrame(list(zip(map(int, y), map(float, s))), "label int, score double")
    a, b = X.fit_platt(frame(s, y))
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs(((t - p) * s).sum()) < 1e-6 and abs((t - p).sum()) < 1e-6 and abs(a - 1.7) < 0.3
    assert all(np.isfinite(X.fit_platt(frame([0.0, 1.0] * 20, [0, 1] * 20))))  # separable
    assert X.fit_platt(frame([0.5] * 10, [0, 1] * 5))[0] == 0.0  # one score


def test_transition_rows_sum_to_one_or_zero(panel):
    sums = {r[0]: r[1] for r in S.transition_matrix(panel).groupBy("from_state").agg(F.sum("probability")).collect()}
    assert len(sums) == 8 and all(abs(v - 1) < 1e-9 or v == 0 for v in sums.values())


def test_rank_metrics_with_ties_and_hot_score(spark):
    data = [(int(RNG.random() < 0.3), 0.5 if i % 3 == 0 else round(RNG.random(), 2)) for i in range(900)]
    r = M.rank_metrics(spark.createDataFrame(data, "label int, score double").repartition(5)).first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    ks = max(abs(np.mean([p <= t for p in pos]) - np.mean([n <= t for n in neg])) for t in {s for _, s in data})
    ap = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for _, s in data) for t in {s for _, s in data})
    assert np.allclose([r.auc_roc, r.gini, r.ks, r.avg_precision], [auc, 2 * auc - 1, ks, ap])


def test_single_class_has_no_auc(spark):
    r = M.rank_metrics(spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")).first()
    assert r.auc_roc is None and r.ks is None


def test_scaling_reads_the_training_rows_once(spark):
    from loantide.operators import features as X

    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 6.0), (None, None)], "a double, b double")
    measured = X.moments(train, ["a", "b"])
    for df, want in ((train, [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]), (test, [(3.0, 1.0), (None, None)])):
        alone, shared = X.standardise(train, df, ["a", "b"]), X.standardise(train, df, ["a", "b"], measured)
        assert [tuple(r) for r in alone.collect()] == [tuple(r) for r in shared.collect()] == want
        assert not any("stddev" in x._jdf.queryExecution().optimizedPlan().toString() for x in (alone, shared))
