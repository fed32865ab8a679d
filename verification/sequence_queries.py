"""Tokenised histories and scored-table metrics (SEQ*, AGG24, AGG25, MET*, TOP4, JON12, FN20, FN21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.operators import history as H, metrics as M, panels as G, portfolio as P, sequences as S
from loantide.session import scratch_path
from loantide.sources.sinks import write_sequences
from verification.bindings import PANEL_SQL, panel, table
from verification.history_queries import SILVER_SQL, W, dynamic, gold
from verification.portfolio_queries import on_panel
from verification.shape import plain

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = on_panel(fn, digits)
    if sql is not None:
        ORACLE[name] = PANEL_SQL + SILVER_SQL + sql


def sequences(d):
    dyn = dynamic(d)
    return S.build_sequences(dyn, S.bin_edges(S.fit_bins(dyn)))


_EVENT = ("CASE {0} WHEN '1-29 DPD' THEN 'DPD1' WHEN '30-59 DPD' THEN 'DPD2' WHEN '60-89 DPD' THEN 'DPD3' WHEN '90+ DPD' THEN 'DPD4'"
          " WHEN 'Defaulted' THEN 'DFLT' WHEN 'Charged-Off' THEN 'CHOF' WHEN 'Redeemed' THEN 'RDMD' ELSE 'PERF' END")
_EVENT_ID = "(5 + list_position(['PERF', 'DPD1', 'DPD2', 'DPD3', 'DPD4', 'DFLT', 'CHOF', 'RDMD'], ev) - 1)"
_PROBS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
_FEATURES = {
    "CLTV": ("cltomv_current", "cltomv_current > 0 AND cltomv_current < 200", 13),
    "RATE": ("current_interest_rate_pct", "current_interest_rate_pct > 0", 23),
    "BAL": ("current_balance", "current_balance > 0", 33),
    "DPD": ("days_past_due", "days_past_due >= 0", 43),
}


def _bin(f: str) -> str:
    c, _, base = _FEATURES[f]
    edges = f"(SELECT e FROM bins WHERE feature = '{f}')"
    return f"{base} + least(len([x FOR x IN {edges}[2:-2] IF x <= CAST({c} AS DOUBLE)]), 9)"


BINS_SQL = ", bins AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {_PROBS}))) AS e FROM dyn WHERE {ok}"
    for f, (c, ok, _) in _FEATURES.items()) + ")"
STEPS_SQL = BINS_SQL + f""", ev AS (SELECT *, {_EVENT.format('arrears_bucket')} AS ev,
  row_number() {W} AS t, lag(arrears_bucket) {W} AS pk FROM dyn),
steps AS (SELECT loan_id, reporting_date, ev, t, pk, arrears_bucket, default_crr_flag,
  [{_EVENT_ID}, {", ".join(_bin(f) for f in _FEATURES)}] AS step FROM ev)"""
SEQ_SQL = STEPS_SQL + """, l AS (
SELECT loan_id, arg_max(ev, t) AS final_state,
       bool_or(coalesce(pk IN ('1-29 DPD', '30-59 DPD', '60-89 DPD', '90+ DPD') AND arrears_bucket = 'Performing', false)) AS had_cure,
       bool_or(default_crr_flag) AS had_default, CAST(min(year(reporting_date)) AS BIGINT) AS obs_year_min,
       CAST(max(year(reporting_date)) AS BIGINT) AS obs_year_max FROM steps GROUP BY loan_id), win AS (
SELECT loan_id, CAST((t - 1) // 24 AS BIGINT) AS win, flatten(list(step ORDER BY t)) AS tok, count(*) AS seq_len, list(ev ORDER BY t) AS evs
FROM steps GROUP BY 1, 2), seq AS (SELECT * FROM win JOIN l USING (loan_id)), padded AS (
SELECT * EXCLUDE (tok), list_concat(tok, [0 FOR i IN range((24 - seq_len) * 5)]) AS tok FROM seq)"""

add("seq1_fit_bins", lambda d: S.fit_bins(dynamic(d)).select("feature", F.transform("edges", lambda e: F.round(e, 4)).alias("edges")).select("feature", F.size("edges").alias("n_edges"), F.aggregate("edges", F.lit(0.0), lambda a, e: a + e).alias("edge_sum")),
    BINS_SQL + "SELECT feature, CAST(len(e) AS BIGINT) AS n_edges, round(list_sum([round(x, 4) FOR x IN e]), 3) AS edge_sum FROM bins", 3)
add("seq1_bin_edges_long", lambda d: S.fit_bins(dynamic(d)).select("feature", F.posexplode("edges").alias("i", "edge")),
    BINS_SQL + "SELECT feature, CAST(unnest(range(len(e))) AS BIGINT) AS i, round(unnest(e), 3) AS edge FROM bins", 3)


def _vocab(d):
    """Occurrences of each vocabulary token over all steps: SEQ2, SEQ3 and SEQ4 together."""
    dyn = dynamic(d)
    names = F.create_map(*[F.lit(x) for t, i in S.VOCAB.items() for x in (i, t)])
    steps = S.encode_steps(dyn, S.bin_edges(S.fit_bins(dyn)))
    return steps.select(F.explode("step").alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "token", F.element_at(names, F.col("token_id")))


add("seq2_seq3_token_counts", _vocab, STEPS_SQL + """, t AS (SELECT unnest(step) AS id FROM steps)
SELECT CAST(id AS BIGINT) AS token_id, count(*) AS n,
  CASE WHEN id < 13 THEN ['PERF', 'DPD1', 'DPD2', 'DPD3', 'DPD4', 'DFLT', 'CHOF', 'RDMD'][id - 4]
       ELSE ['CLTV', 'RATE', 'BAL', 'DPD'][(id - 13) // 10 + 1] || '_Q' || CAST((id - 13) % 10 AS VARCHAR) END AS token
FROM t GROUP BY id""")
add("seq4_encode_steps", lambda d: (lambda y: S.encode_steps(y, S.bin_edges(S.fit_bins(y))).select("loan_id", "reporting_date", "event", "step"))(dynamic(d)),
    STEPS_SQL + "SELECT loan_id, CAST(reporting_date AS VARCHAR) AS reporting_date, ev AS event, array_to_string(step, ',') AS step FROM steps")
add("seq5_build_sequences", sequences, SEQ_SQL + """
SELECT loan_id, win AS "window", array_to_string(tok, ',') AS seq_tokens, seq_len, array_to_string(evs, ',') AS event_seq, final_state, had_cure,
       had_default, obs_year_min, obs_year_max FROM padded""")


def _stored(d):
    """Sequences through the table on disk, and the codec of its files."""
    path = scratch_path(d.sparkSession, "sequences")
    write_sequences(S.event_json(sequences(d)), path)
    back = d.sparkSession.read.parquet(path)
    return back.groupBy("final_state", F.endswith(F.col("_metadata.file_name"), F.lit(".snappy.parquet")).alias("snappy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq_len").alias("steps"), F.sum(F.aggregate("seq_tokens", F.lit(0), lambda a, t: a + t)).alias("token_sum"))


add("snk6_write_sequences", _stored, SEQ_SQL + """SELECT final_state, true AS snappy, count(*) AS n, CAST(sum(seq_len) AS BIGINT) AS steps,
  CAST(sum(list_sum(tok)) AS BIGINT) AS token_sum FROM padded GROUP BY final_state""")
add("fn21_event_json", lambda d: S.event_json(sequences(d)).select("loan_id", "window", "event_seq"),
    SEQ_SQL + """SELECT loan_id, win AS "window", '["' || array_to_string(evs, '","') || '"]' AS event_seq FROM padded""")
add("seq6_attention_mask", lambda d: S.attention_mask(sequences(d)).select(
        "loan_id", "window", "attention_mask", F.transform("steps", lambda s: F.array_join(s.cast("array<string>"), "-")).alias("steps")),
    SEQ_SQL + """SELECT loan_id, win AS "window", array_to_string([CASE WHEN i < seq_len THEN 1 ELSE 0 END FOR i IN range(24)], ',') AS attention_mask,
  array_to_string([array_to_string(tok[i * 5 + 1:i * 5 + 5], '-') FOR i IN range(24)], ',') AS steps FROM padded""")
add("win12_next_event", lambda d: S.next_event(sequences(d)).select("loan_id", "window", "targets"),
    SEQ_SQL + """SELECT loan_id, win AS "window", array_to_string([CASE WHEN i < least(seq_len, 24) - 1 THEN tok[(i + 1) * 5 + 1] ELSE -100 END FOR i IN range(24)], ',') AS targets FROM padded""")


def _draw_sql(*unit: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(['loan_id', *unit, '42'])})), 1, 8))::BIGINT % 100"


def _masked_sql(chosen: str) -> str:
    """``chosen`` is a condition on step i."""
    at = chosen.replace("{i}", "(j // 5)")
    return SEQ_SQL + f"""SELECT loan_id, win AS "window", array_to_string([CASE WHEN {chosen.replace("{i}", "i")} THEN tok[i * 5 + 1] ELSE -100 END FOR i IN range(24)], ',') AS labels,
  array_to_string([CASE WHEN j % 5 = 0 AND {at} THEN 4 ELSE tok[j + 1] END FOR j IN range(120)], ',') AS input_ids FROM padded"""


add("seq7_mask_events", lambda d: S.mask_events(sequences(d)).select("loan_id", "window", "labels", "input_ids"),
    _masked_sql(f"({{i}} < seq_len AND {_draw_sql('win', '{i}')} < 15)"))
add("seq8_mask_patches", lambda d: S.mask_patches(sequences(d)).select("loan_id", "window", "labels", "input_ids"),
    _masked_sql(f"({{i}} < seq_len AND {{i}} // 4 < greatest(seq_len // 4, 1) AND {_draw_sql('win', '({i} // 4)')} < 15)"))
add("seq9_oot_split", lambda d: S.oot_parts(sequences(d), 1998).select("loan_id", "window", "part"), SEQ_SQL + """
SELECT loan_id, win AS "window", CASE WHEN obs_year_max <= 1998 THEN 'train' WHEN obs_year_min > 1998 THEN 'test' ELSE 'straddling' END AS part FROM seq""")
add("seq9_oot_split_fallback", lambda d: S.share_parts(sequences(d)).select("loan_id", "window", "part"), SEQ_SQL + f"""
SELECT loan_id, win AS "window", CASE WHEN {_draw_sql()} < 80 THEN 'train' ELSE 'test' END AS part FROM seq""")
add("agg24_transition_matrix", lambda d: S.transition_matrix(d), f"""
, c AS (SELECT {_EVENT.format('p')} AS f, {_EVENT.format('b')} AS t FROM (SELECT arrears_bucket AS b, lag(arrears_bucket) {W} AS p FROM panel) WHERE p IS NOT NULL),
 s AS (SELECT unnest(['PERF', 'DPD1', 'DPD2', 'DPD3', 'DPD4', 'DFLT', 'CHOF', 'RDMD']) AS x),
 n AS (SELECT a.x AS from_state, b.x AS to_state, (SELECT count(*) FROM c WHERE c.f = a.x AND c.t = b.x) AS n FROM s a CROSS JOIN s b)
SELECT from_state, to_state, n, round(CASE WHEN sum(n) OVER (PARTITION BY from_state) > 0 THEN n / sum(n) OVER (PARTITION BY from_state) ELSE 0 END, 6) AS probability FROM n""")
add("agg25_event_frequency", S.event_frequency, f"SELECT {_EVENT.format('arrears_bucket')} AS event, count(*) AS n FROM panel GROUP BY 1")
add("agg25_sequence_stats", lambda d: S.sequence_stats(sequences(d)), SEQ_SQL + """
SELECT count(*) FILTER (WHERE win = 0) AS total_loans, count(*) AS total_windows, count(*) FILTER (WHERE win = 0 AND had_cure) AS total_cures,
       count(*) FILTER (WHERE win = 0 AND had_default) AS total_defaults,
       round(100.0::DOUBLE * count(*) FILTER (WHERE win = 0 AND had_cure) / count(*) FILTER (WHERE win = 0), 3) AS cure_rate_pct,
       round(100.0::DOUBLE * count(*) FILTER (WHERE win = 0 AND had_default) / count(*) FILTER (WHERE win = 0), 3) AS default_rate_pct,
       round(avg(seq_len), 2) AS avg_seq_len, min(seq_len) AS min_seq_len, max(seq_len) AS max_seq_len FROM seq""")
add("agg25_length_histogram", lambda d: S.length_histogram(sequences(d)), SEQ_SQL + "SELECT seq_len, count(*) AS n_windows FROM seq GROUP BY 1")
add("jon12_attach_labels", lambda d: G.attach_labels(sequences(d).select("loan_id", "seq_len"), P.loan_labels(gold(d))).select("loan_id", "label"),
    SEQ_SQL + """SELECT s.loan_id, CAST(coalesce(l.label, 0) AS BIGINT) AS label FROM seq s
LEFT JOIN (SELECT loan_id, max(default_in_3m) AS label FROM gold GROUP BY 1) l ON s.loan_id = l.loan_id""")


def scored(spark, sf):
    """A scored table from the orders: scores with ties, one slice per priority."""
    s = F.floor(F.col("o_totalprice") % 1000) / 1000.0
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), s.alias("score"),
        F.col("o_orderpriority").alias("slice"),
        F.when(F.col("o_orderstatus") == "F", F.pmod("o_orderkey", F.lit(8))).otherwise(-1).cast("int").alias("months_to_default"),
    )


SCORED_SQL = """WITH scored AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  floor(o_totalprice % 1000) / 1000.0::DOUBLE AS score, o_orderpriority AS slice,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 8 ELSE -1 END AS months_to_default FROM orders)"""


def _ranked_sql(src: str, by: str = "'all'") -> str:
    return f""", g AS (SELECT {by} AS grp, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM {src} GROUP BY 1, 2),
 r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS p, sum(neg) OVER (PARTITION BY grp) AS n
       FROM g WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


_AUC = "sum(pos / p::DOUBLE * (n - fp + neg / 2.0::DOUBLE) / n)"
_AP = "sum(pos / p::DOUBLE * tp / (tp + fp))"


def add_scored(name, fn, sql, digits=6):
    QUERIES[name] = lambda spark, sf: plain(fn(scored(spark, sf)), digits)
    if sql is not None:
        ORACLE[name] = SCORED_SQL + sql


add_scored("met1_met2_met5_rank_metrics", M.rank_metrics, _ranked_sql("scored") + f"""
SELECT round({_AUC}, 6) AS auc_roc, round(2 * {_AUC} - 1, 6) AS gini, round({_AP}, 6) AS avg_precision,
       round(max(abs(tp / p::DOUBLE - fp / n::DOUBLE)), 6) AS ks FROM r""")
add_scored("met1_rank_metrics_by_slice", lambda d: M.rank_metrics(d, by=["slice"]), _ranked_sql("scored", "slice") + f"""
SELECT grp AS slice, round({_AUC}, 6) AS auc_roc, round(2 * {_AUC} - 1, 6) AS gini, round({_AP}, 6) AS avg_precision,
       round(max(abs(tp / p::DOUBLE - fp / n::DOUBLE)), 6) AS ks FROM r GROUP BY grp""")
add_scored("met3_curve_points", M.curve_points, _ranked_sql("scored") + """
, c AS (SELECT row_number() OVER (ORDER BY score DESC) AS position, fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr, tp / (tp + fp)::DOUBLE AS precision, score FROM r
        UNION ALL SELECT 0, 0, 0, 1, NULL),
 k AS (SELECT (i * (SELECT max(position) FROM c)) // (least(100, (SELECT max(position) FROM c) + 1) - 1) AS position FROM range(100) t(i))
SELECT CAST(position AS BIGINT) AS position, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision, round(score, 6) AS score
FROM c WHERE position IN (SELECT position FROM k)""")
add_scored("met4_error_metrics", M.error_metrics, """, s AS (SELECT *, greatest(least(score, 1 - 1e-7), 1e-7) AS q FROM scored)
SELECT round(avg(pow(score - label, 2)), 6) AS brier, round(avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss,
       round(2.0::DOUBLE * sum(CASE WHEN score > 0.5 AND label = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) + sum(label)), 6) AS f1,
       count(*) FILTER (WHERE score <= 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score > 0.5 AND label = 0) AS fp,
       count(*) FILTER (WHERE score <= 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score > 0.5 AND label = 1) AS tp,
       count(*) AS n, round(avg(label), 6) AS positive_rate FROM s""")
for _closed, _cond in (("left", "score >= i / 10.0::DOUBLE AND score < (i + 1) / 10.0::DOUBLE"), ("right", "score > i / 10.0::DOUBLE AND score <= (i + 1) / 10.0::DOUBLE")):
    add_scored(f"met6_calibration_error_{_closed}", lambda d, c=_closed: M.calibration_error(d, closed=c), f"""
, b AS (SELECT i, count(*) AS n, avg(score) AS s, avg(label) AS y FROM scored, range(10) t(i) WHERE {_cond} GROUP BY i)
SELECT round(sum(n * abs(s - y)) / (SELECT count(*) FROM scored), 6) AS ece FROM b""")
add_scored("met7_calibration_curve", M.calibration_curve, """
SELECT i AS bin, round(avg(score), 6) AS mean_prob, round(avg(label), 6) AS fraction_pos
FROM scored, range(10) t(i) WHERE score >= i / 10.0::DOUBLE AND score <= (i + 1) / 10.0::DOUBLE GROUP BY i""")
add_scored("met8_capture_rate", M.capture_rate, """, q AS (SELECT quantile_cont(score, 0.95) AS t FROM scored)
SELECT round((SELECT t FROM q), 6) AS threshold, round(sum(CASE WHEN score >= (SELECT t FROM q) THEN label ELSE 0 END) / greatest(sum(label), 1)::DOUBLE, 6) AS capture_rate FROM scored""")
add_scored("met9_horizon_curve", M.horizon_curve,
    ", e AS (SELECT h, score, label FROM scored, range(1, 7) t(h) WHERE label = 0 OR months_to_default = h)" + _ranked_sql("e", "h") + f"""
SELECT CAST(grp AS BIGINT) AS horizon, round({_AP}, 6) AS pr_auc, CAST(max(p + n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_positive, max(p + n) > 10 AND max(p) > 0 AS enough FROM r GROUP BY grp""")
add_scored("met10_slice_metric", lambda d: M.slice_metric(d.withColumn("slice", F.concat_ws("-", "slice", F.when(F.col("id") % 97 == 0, "rare"))), "slice"),
    ", few AS (SELECT *, slice || CASE WHEN id % 97 = 0 THEN '-rare' ELSE '' END AS part FROM scored)" + _ranked_sql("few", "part") + f"""
SELECT grp AS slice, CASE WHEN max(p) > 0 THEN round({_AP}, 6) END AS pr_auc, CAST(max(p + n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_positive, max(p + n) > 50 AND max(p) > 0 AS enough FROM r GROUP BY grp""")


def _runs(spark, sf):
    """One run per priority slice, ranked by its metrics; the whole table is the baseline."""
    d = scored(spark, sf)
    runs = M.rank_metrics(d, by=["slice"]).withColumnRenamed("slice", "run_id")
    return plain(M.compare_runs(runs, M.rank_metrics(d)))


QUERIES["top4_compare_runs"] = _runs
ORACLE["top4_compare_runs"] = SCORED_SQL + _ranked_sql("scored", "slice") + f""", m AS (
SELECT grp AS run_id, {_AUC} AS auc, {_AP} AS ap, max(abs(tp / p::DOUBLE - fp / n::DOUBLE)) AS ks FROM r GROUP BY grp),
 g2 AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1),
 r2 AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g2
        WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT {_AUC} AS auc, {_AP} AS ap FROM r2)
SELECT run_id, round(m.auc, 6) AS auc_roc, round(2 * m.auc - 1, 6) AS gini, round(m.ap, 6) AS avg_precision, round(ks, 6) AS ks,
       m.auc = (SELECT max(auc) FROM m) AS is_best, round(b.auc, 6) AS baseline_auc_roc, round(2 * b.auc - 1, 6) AS baseline_gini,
       round(b.ap, 6) AS baseline_avg_precision FROM m, b"""


def _predictions(d):
    """Each month predicts the next event: its own event first, then performing, then 1-29 days."""
    token = S.event_id(S.event_token(F.col("arrears_bucket")))
    return d.select(
        F.coalesce(F.lead(token).over(H.by_loan()), F.lit(S.IGNORE)).alias("label"),
        F.array(token, F.lit(5), F.lit(6)).alias("top3"),
        (F.col("current_balance") / 1e6).alias("loss"),
    )


_PRED = f""", pr AS (SELECT coalesce(lead(id) {W}, -100) AS label, id, current_balance / 1e6 AS loss
FROM (SELECT *, (5 + list_position(['PERF', 'DPD1', 'DPD2', 'DPD3', 'DPD4', 'DFLT', 'CHOF', 'RDMD'], {_EVENT.format('arrears_bucket')}) - 1) AS id FROM panel))"""
add("met11_token_accuracy", lambda d: M.token_accuracy(_predictions(d)), _PRED + """
SELECT round(avg(CASE WHEN id = label THEN 1 ELSE 0 END), 4) AS masked_accuracy,
       round(avg(CASE WHEN label IN (id, 5, 6) THEN 1 ELSE 0 END), 4) AS top3_accuracy, round(avg(loss), 6) AS avg_loss,
       round(exp(least(avg(loss), 20)), 4) AS perplexity, count(*) AS total_masked FROM pr WHERE label <> -100""")
add("met11_class_accuracy", lambda d: M.class_accuracy(_predictions(d)), _PRED + """
SELECT CAST(label AS BIGINT) AS class_id, round(avg(CASE WHEN id = label THEN 1 ELSE 0 END), 4) AS accuracy FROM pr WHERE label <> -100 GROUP BY 1""")


def _estimates(d):
    x = d.select((F.col("current_balance") / 1e5).alias("target"), (F.col("original_balance") / 1e5).alias("point"),
                 (F.col("original_balance") / 2e5).alias("mu"), (1.0 + F.col("days_past_due") / 100.0).alias("sigma"))
    return x


add("met12_regression_metrics", lambda d: M.regression_metrics(_estimates(d)), """
, e AS (SELECT current_balance / 1e5 AS y, original_balance / 1e5 AS p, original_balance / 2e5 AS m, 1.0::DOUBLE + days_past_due / 100.0::DOUBLE AS s FROM panel)
SELECT round(avg(pow(y - p, 2)), 6) AS mse, round(avg(0.5::DOUBLE * (ln(s) + pow(y - m, 2) / (s + 1e-8))), 6) AS nll,
       round(1 - sum(pow(y - p, 2)) / sum(pow(y - (SELECT avg(y) FROM e), 2)), 4) AS r2,
       round(avg(CASE WHEN y >= m - 1.645::DOUBLE * s AND y <= m + 1.645::DOUBLE * s THEN 1 ELSE 0 END), 4) AS coverage_at_90 FROM e""")
