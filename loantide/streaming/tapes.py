"""Arriving tape files as a stream (STR1), and SCD2 per arriving batch (STR2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loantide.operators.bronze import to_bronze
from loantide.operators.validate import CORRUPT
from loantide.plans.tape_load import load_tape
from loantide.sources.sinks import merge_bronze
from loantide.sources.tapes import _schema, finish_tape, literal_path, read_tape, with_file_keys
from loantide.templates.classes import Template


def stream_tapes(
    spark: SparkSession,
    folder: str,
    names: Sequence[str],
    first_label: str | None = None,
    max_files: int | None = None,
    include: str | None = None,
    exclude: str | None = None,
    ragged: str = "pad",
    file_keys: bool = True,
    glob: str = "*.csv",
) -> DataFrame:
    """Each arriving tape file once, all with the fields ``names``; the checkpoint of the query remembers what was read (STR1).

    For files whose headers may differ use ``stream_tape_files``.
    """
    reader = (
        spark.readStream.schema(_schema(names))
        .options(header=True, enforceSchema=True, mode="PERMISSIVE", columnPruning=False, pathGlobFilter=glob, recursiveFileLookup=True)
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.csv(folder).withColumn("filename", F.col("_metadata.file_name"))
    df = finish_tape(raw, names, first_label, include, exclude, ragged)
    return with_file_keys(df) if file_keys else df


def stream_tape_files(
    spark: SparkSession, folder: str, on_tape: Callable[[DataFrame, int], None], checkpoint: str, template: Template | None = None,
    max_files: int | None = None, glob: str = "*.csv*", **read_options,
) -> StreamingQuery:
    """Hands the arriving files of each batch, read by their own headers, to ``on_tape(tape, batch_id)`` (STR1).

    The stream holds the paths of files, not their content; each batch reads its files as ``read_tape`` does, so fields in
    another order, missing or additional fields, and files that cannot be read come out as in a batch load. Files without
    any byte are passed over by Spark's file stream.
    """
    source = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .options(pathGlobFilter=glob, recursiveFileLookup=True)
    )
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)

    def read(files: DataFrame, batch_id: int) -> None:
        paths = sorted(literal_path(r["path"]) for r in files.collect())  # of one trigger
        if paths:
            on_tape(read_tape(files.sparkSession, paths, template, **read_options), batch_id)

    return run_once(source.load(folder).select("path"), read, checkpoint)


def stream_load(spark: SparkSession, folder: str, template: Template, target: str, as_of: str, checkpoint: str, **options) -> StreamingQuery:
    """Every arriving tape to quarantine, bronze and silver. A batch that is repeated after a failure changes nothing."""
    return stream_tape_files(spark, folder, lambda tape, _: load_tape(tape, template, target, as_of), checkpoint, template, **options)


def run_once(df: DataFrame, on_batch, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, and stop; ``checkpoint`` must be the same in every run."""
    query = (
        df.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving rows to a Parquet table, each file exactly once."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_bronze(
    df: DataFrame, path: str, keys: Sequence[str], checkpoint: str, hash_cols: Sequence[str] | None = None
) -> StreamingQuery:
    """Merge each arriving batch into the bronze history (STR2).

    Versions follow from all sightings, so late files come out as if they had arrived in order, and a batch that is
    repeated after a failure changes nothing. Rows without a key are told apart by their content.
    """

    def merge(batch: DataFrame, _id: int) -> None:
        merge_bronze(to_bronze(batch, keys, hash_cols), path, keys)

    return run_once(df, merge, checkpoint)
