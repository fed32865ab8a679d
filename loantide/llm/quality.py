"""Quality rules in built-in functions, evaluated as a short-circuit cascade.

Each rule is a condition that rejects a document. On a bounded sample, the share each rule rejects and the time
it takes beyond an empty scan are measured; the rules are then ordered by rejection per cost and evaluated as
nested CASE branches, so that a document pays only for the rules up to the first that rejects it. The order
changes the work, never the verdict.

Defined results: a null text has no words; rules about shares reject no document without words (the word count
does); repeated rows give repeated results; an empty table gives an empty one and leaves the rules in the order
given; further columns are kept.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import SPACES, whole_texts, words
from loantide.session import written

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 400  # bound of the sample that costs and selectivities are estimated on


def with_repeat_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window found at least twice in the row's words.

    Windows are sorted with their places, equal neighbours are repeats, and the covered words are summed over the places.
    """
    n, win, order, at = F.size(words_col), f"{out}_windows", f"{out}_sorted", f"{out}_at"
    window = lambda i: F.concat_ws(" ", F.get(words_col, i), F.get(words_col, i + 1), F.get(words_col, i + 2))
    t = df.withColumn(win, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)))
    pairs = F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    t = t.withColumn(order, F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(pairs)))
    is_x = lambda x, i: F.coalesce(F.get(order, i)["x"] == x["x"], F.lit(False))
    t = t.withColumn(at, F.sort_array(F.transform(F.filter(order, lambda x, i: is_x(x, i - 1) | is_x(x, i + 1)), lambda x: x["i"])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end"))
    covered = F.aggregate(at, zero, step, lambda a: a["n"])
    return t.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(win, order, at)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    t = whole_texts(docs).withColumn("_words", words(F.col("text")))
    t = with_repeat_words(t, "_words", "n_repeat_words")
    text = F.col("text")
    return t.select(
        "doc_id", "text", F.size("_words").cast("long").alias("n_words"), _word_chars(text).alias("word_chars"), _symbols(text).alias("n_symbols"),
        _dup_lines(text).alias("n_dup_lines"), "n_repeat_words",
    )


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def _symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _dup_lines(text: Column) -> Column:
    lines = _worded_lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat_words) > 50 * F.col(n_words))


def rules(text: Column, n_words: Column) -> dict[str, Column]:
    """The method's rules; true rejects. Thresholds are parameters of the published heuristics for web text."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    return {
        "too_few_words": n_words < 50,
        "symbols": _symbols(text) * 10 > n_words,
        "word_length": (n_words > 0) & ((_word_chars(text) < 2 * n_words) | (_word_chars(text) > 12 * n_words)),
        "repeated_lines": (_dup_lines(text) > 0) & (_dup_lines(text) * 10 > F.size(_worded_lines(text)) * 3),
        "few_letters": letters * 10 < _word_chars(text) * 6,
        "shouting": F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")) * 2 > F.greatest(letters, F.lit(1)),
    }


def plan_order(docs: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejection per cost on at most ``sample_rows`` rows; ties in the order given."""
    total = docs.count()
    if not total:
        return list(conditions)
    share = min(1.0, 2.0 * sample_rows / total)
    sample = written(docs.sample(False, share, 7).limit(sample_rows), "rule-sample")

    def seconds(cond: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            t0 = time.perf_counter()
            hits = sample.agg(F.count_if(cond)).first()[0]
            best = min(best, time.perf_counter() - t0)
        return best, hits

    floor, _ = seconds(F.length("text") < 0)
    measured = {k: seconds(c) for k, c in conditions.items()}
    return sorted(conditions, key=lambda k: -measured[k][1] / max(measured[k][0] - floor, 1e-3))


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """True where no rule rejects; later rules are not evaluated after a rejection. A rule without a value does not reject."""
    out = F.lit(True)
    for name in reversed(order):
        out = F.when(F.coalesce(conditions[name], F.lit(False)), F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features, ``base_failed`` and ``kept`` of every row."""
    cheap = whole_texts(docs).withColumn("n_words", F.size(words(F.col("text"))))
    conditions = rules(F.col("text"), F.col("n_words"))
    order = plan_order(cheap, conditions, sample_rows)
    f = features(docs).withColumn("base_failed", base_failed())
    return f.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(conditions, order))).drop("text")


def keep_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass the cascade and the base rules, with their columns."""
    sampled = whole_texts(docs).withColumn("n_words", F.size(words(F.col("text"))))
    order = plan_order(sampled, rules(F.col("text"), F.col("n_words")), sample_rows)
    t = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))).withColumn("__words", words(F.col("__text")))
    # the word windows are the dearest, so only what passes the cascade pays for them
    t = _only(t, cascade(rules(F.col("__text"), F.size("__words")), order))
    t = with_repeat_words(t, "__words", "__repeats")
    return _only(t, 100 * F.col("__repeats") <= 50 * F.size("__words")).select(*docs.columns)


def _only(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition. A filter would be pushed below the columns that it reads and compute them once per
    mention, inside of lambdas even once per element; an exploded flag is not."""
    flag = F.when(condition, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.explode(flag).alias("__pass")).drop("__pass")
