"""Raw tape to silver: read, validate, split, keep history, clean, project."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loantide.operators.bronze import read_current, to_bronze
from loantide.operators.silver import amortisation_long, clean, distinct_dimension, project_topics
from loantide.operators.validate import READER_COLUMNS, sides, split_clean_dirty, validate
from loantide.sources.sinks import merge_bronze, read_clean, replace_deals, write_quarantine
from loantide.sources.snapshots import read_snapshot
from loantide.templates.classes import Template


def silver_tables(current: DataFrame, template: Template) -> dict[str, DataFrame]:
    """The silver tables of a class: its topics, its amortisation rows, or all its fields as one table (PRJ1 to PRJ3, RSH2)."""
    if template.name.endswith("amortisation"):
        # values stay text until they are paired; the long form casts them itself
        return {"amortisation": amortisation_long(clean(current, template))}
    cleaned = clean(current, template)
    if template.topics:
        return project_topics(cleaned, template)
    return {template.name.split("_", 1)[-1]: distinct_dimension(cleaned.drop("pcd", "filename", "part"))}


def load_tape(tape: DataFrame, template: Template, target: str, as_of: str, recorded: str | None = None) -> None:
    """From the tape to the quarantine, bronze and silver tables below ``target``.

    The annotated tape goes to the quarantine and the clean rows come back from there, so parsing and validation happen once and
    nothing is staged beside it. Each table is replaced in one step, for the files or deals of this tape only: whatever is killed
    in between, every table can be read.
    """
    spark = tape.sparkSession
    annotated = validate(tape, template.rules, as_of)
    keys = [template.loan_key] if template.loan_key else list(template.keys)
    good, bad = split_clean_dirty(annotated, ["dl_code", *keys])
    load = write_quarantine(good, bad, f"{target}/quarantine", sides(annotated, ["dl_code", *keys]))
    good = read_clean(spark, f"{target}/quarantine", load, good.drop(*READER_COLUMNS).schema)
    deals = good.select("dl_code").distinct()
    merge_bronze(to_bronze(good, ["dl_code", *keys], recorded=recorded), f"{target}/bronze", ["dl_code", *keys])
    current = read_current(read_snapshot(spark, f"{target}/bronze", deals))
    for name, df in silver_tables(current, template).items():
        replace_deals(df, f"{target}/silver/{name}", deals)
