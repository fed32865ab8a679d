"""Tokenised loan histories (SEQ1 to SEQ10, WIN12, AGG24, AGG25, FN20, FN21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantide.functions.states import ARREARS_STATES, DPD_STATES, PERFORMING
from loantide.operators.history import DATE, KEY, by_loan
from loantide.operators.ranking import exact_quantiles

# Sequence layout and vocabulary, in id order.
MAX_STEPS, STEP_WIDTH, N_BINS = 24, 5, 10
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[BOS]", "[EOS]", "[MASK]")
EVENT_TOKENS = ("PERF", "DPD1", "DPD2", "DPD3", "DPD4", "DFLT", "CHOF", "RDMD")
FEATURES = {
    "CLTV": ("cltomv_current", "cltomv_current > 0 AND cltomv_current < 200"),
    "RATE": ("current_interest_rate_pct", "current_interest_rate_pct > 0"),
    "BAL": ("current_balance", "current_balance > 0"),
    "DPD": ("days_past_due", "days_past_due >= 0"),
}
PAD, UNK, MASK, IGNORE = 0, 1, 4, -100
MASK_PERCENT = 15


def vocab() -> dict[str, int]:
    """Token ids: special tokens, events, then ten bins per feature (SEQ2)."""
    bins = [f"{f}_Q{i}" for f in FEATURES for i in range(N_BINS)]
    return {t: i for i, t in enumerate([*SPECIAL_TOKENS, *EVENT_TOKENS, *bins])}


VOCAB = vocab()


def event_token(state: Column) -> Column:
    """Event name of an arrears state; unknown states count as performing."""
    table = F.create_map(*[F.lit(x) for pair in zip(ARREARS_STATES, EVENT_TOKENS) for x in pair])
    return F.coalesce(F.try_element_at(table, state), F.lit("PERF"))


def event_id(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for t in EVENT_TOKENS for x in (t, VOCAB[t])])
    return F.element_at(table, token)


def fit_bins(df: DataFrame) -> DataFrame:
    """(feature, edges): sorted distinct deciles of each feature's valid values, in one pass (SEQ1)."""
    probs = [i / N_BINS for i in range(N_BINS + 1)]
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.when(F.expr(ok), F.col(c).cast("double")).alias("v"))
            for f, (c, ok) in FEATURES.items()
        ])).alias("x")
    ).select("x.feature", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    q = exact_quantiles(long, "v", probs, ["feature"])
    names = [c for c in q.columns if c.startswith("p")]
    edges = F.array_sort(F.array_distinct(F.array(*names)))
    one_value = F.array(edges[0], edges[0] + 1e-9)
    return q.select("feature", F.when(F.size(edges) < 2, one_value).otherwise(edges).alias("edges"))


def bin_edges(bins: DataFrame) -> dict[str, list[float]]:
    """The fitted edges as a small dictionary: four lists of at most eleven numbers."""
    return {r["feature"]: list(r["edges"]) for r in bins.collect()}


def quantise(feature: str, col: Column, edges: list[float]) -> Column:
    """Bin token of a value: interior edges at or below it; null and NaN are unknown (SEQ3)."""
    v = col.cast("double")
    interior = edges[1:-1] if edges else []
    index = F.lit(0)
    for e in interior:
        index = index + F.when(v >= e, 1).otherwise(0)
    token = F.least(index, F.lit(N_BINS - 1)) + VOCAB[f"{feature}_Q0"]
    if not edges:
        return F.lit(UNK)
    return F.when(v.isNull() | F.isnan(v), UNK).otherwise(token)


def encode_steps(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Add ``event`` and ``step``, the five token ids of one month (SEQ4)."""
    token = event_token(F.col("arrears_bucket"))
    ids = [event_id(F.col("event"))] + [quantise(f, F.col(c), edges.get(f, [])) for f, (c, _) in FEATURES.items()]
    return df.withColumn("event", token).withColumn("step", F.array(*[i.cast("int") for i in ids]))


def build_sequences(dynamic: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """One row per loan and ``window`` of 24 consecutive steps, counted from 0 (SEQ5).

    A longer history has further windows, so no month is lost and every array has a fixed size; the final
    state, flags and years are those of the loan's whole history, in each of its windows. One partitioning by loan serves all.
    """
    w = by_loan()
    prev = F.lag("arrears_bucket").over(w)
    cured = prev.isin(*DPD_STATES) & (F.col("arrears_bucket") == PERFORMING)
    steps = encode_steps(dynamic, edges).select(
        KEY, DATE, "event", "step", "default_crr_flag",
        F.row_number().over(w).alias("_t"),
        F.coalesce(cured, F.lit(False)).alias("_cured"),
    )
    parts = steps.groupBy(KEY, F.floor((F.col("_t") - 1) / MAX_STEPS).cast("int").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("_t", "step", "event"))).alias("_steps"),
        F.max(F.struct("_t", "event")).alias("_last"),
        F.max("_cured").alias("_cured"),
        F.coalesce(F.max("default_crr_flag"), F.lit(False)).alias("_default"),
        F.min(F.year(DATE)).alias("_first_year"),
        F.max(F.year(DATE)).alias("_last_year"),
    )
    loan = Window.partitionBy(KEY)
    n = F.size("_steps")
    tokens = F.concat(
        F.flatten(F.transform("_steps", lambda s: s["step"])),
        F.array_repeat(F.lit(PAD), (F.lit(MAX_STEPS) - n) * STEP_WIDTH),
    )
    return parts.select(
        KEY, "window", tokens.alias("seq_tokens"), n.alias("seq_len"),
        F.transform("_steps", lambda s: s["event"]).alias("event_seq"),
        F.max("_last").over(loan)["event"].alias("final_state"),
        F.max("_cured").over(loan).alias("had_cure"),
        F.max("_default").over(loan).alias("had_default"),
        F.min("_first_year").over(loan).alias("obs_year_min"),
        F.max("_last_year").over(loan).alias("obs_year_max"),
    )


def event_json(seq: DataFrame) -> DataFrame:
    """The event list as JSON text (FN21)."""
    return seq.withColumn("event_seq", F.to_json("event_seq"))


def steps_of(tokens: Column) -> Column:
    """The flat token array as 24 steps of five."""
    return F.transform(F.sequence(F.lit(0), F.lit(MAX_STEPS - 1)), lambda i: F.slice(tokens, i * STEP_WIDTH + 1, STEP_WIDTH))


def _positions() -> Column:
    return F.sequence(F.lit(0), F.lit(MAX_STEPS - 1))


def _event_at(i: Column) -> Column:
    return F.element_at(F.col("seq_tokens"), (i * STEP_WIDTH + 1).cast("int"))


def attention_mask(seq: DataFrame) -> DataFrame:
    """1 for real steps, 0 for padding, and the tokens as steps (SEQ6)."""
    mask = F.transform(_positions(), lambda i: F.when(i < F.col("seq_len"), 1).otherwise(0))
    return seq.withColumn("attention_mask", mask).withColumn("steps", steps_of(F.col("seq_tokens")))


def next_event(seq: DataFrame) -> DataFrame:
    """Target of each step: the event one step later, ignored at the end of a window (WIN12)."""
    target = F.transform(
        _positions(),
        lambda i: F.when(i < F.least(F.col("seq_len"), F.lit(MAX_STEPS)) - 1, _event_at(F.least(i + 1, F.lit(MAX_STEPS - 1)))).otherwise(IGNORE),
    )
    return seq.withColumn("targets", target)


def _draw(seed: int, *unit: Column) -> Column:
    """A fixed pseudo-random number of 32 bits per loan and unit, from an MD5: the same on every run, partitioning and engine."""
    text = F.concat_ws(":", F.col(KEY), *[u.cast("bigint") for u in unit], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _drawn(seed: int, unit: Column) -> Column:
    return F.pmod(_draw(seed, F.col("window"), unit), F.lit(100)) < MASK_PERCENT


def _with_masked(seq: DataFrame, chosen) -> DataFrame:
    labels = F.transform(_positions(), lambda i: F.when(chosen(i), _event_at(i)).otherwise(IGNORE))
    inputs = F.transform(
        "seq_tokens",
        lambda x, j: F.when((j % STEP_WIDTH == 0) & chosen(F.floor(j / STEP_WIDTH)), MASK).otherwise(x),
    )
    return seq.withColumn("labels", labels).withColumn("input_ids", inputs)


def mask_events(seq: DataFrame, seed: int = 42) -> DataFrame:
    """Masked-event training pairs: each real step is masked with 15 % (SEQ7)."""
    return _with_masked(seq, lambda i: (i < F.col("seq_len")) & _drawn(seed, i))


def mask_patches(seq: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """The same for whole patches of ``size`` steps; a short sequence is one patch (SEQ8)."""
    patches = F.greatest(F.floor(F.col("seq_len") / size), F.lit(1))
    patch = lambda i: F.floor(i / size)
    return _with_masked(
        seq, lambda i: (i < F.col("seq_len")) & (patch(i) < patches) & _drawn(seed, patch(i))
    )


def oot_parts(seq: DataFrame, year: int = 2024) -> DataFrame:
    """``part`` by time (SEQ9): ``train`` ends by the year, ``test`` begins after it, ``straddling`` loans have both sides."""
    part = F.when(F.col("obs_year_max") <= year, "train").when(F.col("obs_year_min") > year, "test").otherwise("straddling")
    return seq.withColumn("part", part)


def share_parts(seq: DataFrame, percent: int = 80, seed: int = 42) -> DataFrame:
    """``part`` by loan: about ``percent`` of a hundred loans train, the others test; for data without later loans (SEQ9)."""
    return seq.withColumn("part", F.when(F.pmod(_draw(seed), F.lit(100)) < percent, "train").otherwise("test"))


def oot_split(seq: DataFrame, year: int | None = 2024, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test sequences (SEQ9): by ``year``, without the loans that straddle it, or by loan if ``year`` is None."""
    parts = share_parts(seq, seed=seed) if year is None else oot_parts(seq, year)
    return tuple(parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))


def transition_matrix(df: DataFrame) -> DataFrame:
    """Counts and row-normalised probabilities for all 64 state pairs (AGG24)."""
    prev = F.lag("arrears_bucket").over(by_loan())
    pairs = (
        df.select(prev.alias("prev"), "arrears_bucket")
        .where("prev IS NOT NULL")
        .groupBy(event_token(F.col("prev")).alias("from_state"), event_token(F.col("arrears_bucket")).alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    states = F.array(*[F.lit(t) for t in EVENT_TOKENS])
    grid = df.sparkSession.range(1).select(F.explode(states).alias("from_state")).select(
        "from_state", F.explode(states).alias("to_state")
    )
    total = F.sum("n").over(Window.partitionBy("from_state"))
    return (
        grid.join(pairs, ["from_state", "to_state"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("probability", F.when(total > 0, F.col("n") / total).otherwise(0.0))
    )


def event_frequency(df: DataFrame) -> DataFrame:
    """Occurrences of each event over all steps (AGG25)."""
    return df.groupBy(event_token(F.col("arrears_bucket")).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def sequence_stats(seq: DataFrame) -> DataFrame:
    """Counts and rates over the loans, lengths over their windows (AGG25)."""
    first = F.col("window") == 0
    pct = lambda c: F.round(100.0 * F.count_if(first & c) / F.count_if(first), 3)
    return seq.agg(
        F.count_if(first).alias("total_loans"),
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if(first & F.col("had_cure")).alias("total_cures"),
        F.count_if(first & F.col("had_default")).alias("total_defaults"),
        pct(F.col("had_cure")).alias("cure_rate_pct"),
        pct(F.col("had_default")).alias("default_rate_pct"),
        F.round(F.avg("seq_len"), 2).alias("avg_seq_len"),
        F.min("seq_len").alias("min_seq_len"),
        F.max("seq_len").alias("max_seq_len"),
    )


def length_histogram(seq: DataFrame) -> DataFrame:
    return seq.groupBy("seq_len").agg(F.count(F.lit(1)).alias("n_windows"))
