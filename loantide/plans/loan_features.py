"""Panel to model tables: silver split, gold features, token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loantide.operators.panels import gold_features, split_panel
from loantide.operators.sequences import bin_edges, build_sequences, fit_bins
from loantide.sources.sinks import write_sequences


def write_model_tables(panel: DataFrame, target: str) -> None:
    """Write the silver tables once; gold and sequences are built from what was written."""
    spark = panel.sparkSession
    static, dynamic = split_panel(panel)
    static.write.mode("overwrite").parquet(f"{target}/static_loans")
    dynamic.write.mode("overwrite").parquet(f"{target}/dynamic_performance")
    static = spark.read.parquet(f"{target}/static_loans")
    dynamic = spark.read.parquet(f"{target}/dynamic_performance")
    gold_features(static, dynamic).write.mode("overwrite").parquet(f"{target}/gold_features")
    write_sequences(build_sequences(dynamic, bin_edges(fit_bins(dynamic))), f"{target}/sequences")
