"""Loan-tape CSV files and panels (SRC1 to SRC6, SRC9, SRC11, SET3)."""

from __future__ import annotations

import bz2
import csv
import gzip
import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loantide.functions.dates import coerce_date
from loantide.functions.text import clean_text
from loantide.operators.validate import CORRUPT, FIELDS, FILE_ERROR, SURPLUS
from loantide.session import ship_package, written
from loantide.sources.snapshots import read_snapshot, version
from loantide.templates.classes import Template

# Tags of internally generated files that are no input.
EXCLUDED_TAGS = {"assets": "Labeled0M", "consumer": "Labeled"}
BLOCK = 64 << 10


def _schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def header(spark: SparkSession, paths: str | Sequence[str], **options) -> list[str]:
    """Field codes of the first file's first line."""
    return spark.read.options(**options).csv(paths, header=True).columns


def file_headers(spark: SparkSession, paths: str | Sequence[str], include: str | None = None, exclude: str | None = None) -> DataFrame:
    """``path, filename, line, error`` of every wanted file: its first line that is not blank, or why there is none.

    Spark lists the files; tasks open each one and read its first block only. A compressed file is read through, in
    pieces, since only that shows that it is whole; it cannot be split anyhow. Errors: ``empty_file``, ``unreadable_file``.
    Where Python cannot open the store, Spark reads the lines of the files as text.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    # Spark's own listing; a scan would leave out files without any byte
    uris = spark.read.format("binaryFile").load(listed).inputFiles()
    rows = [(u, unquote(u), unquote(u).rsplit("/", 1)[-1]) for u in uris]
    files = _wanted(spark.createDataFrame(rows, "uri string, path string, filename string"), include, exclude)
    if not _opens(listed[0]):
        lines = spark.read.text(listed).select("value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"))
        lines = lines.where((F.col("start") == 0) & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())
        first = lines.groupBy("uri").agg(F.translate(F.min_by("value", "at"), "\ufeff\u0000\r", "").alias("line"))
        found = files.join(first, "uri", "left")
        return found.select("path", "filename", "line", F.when(F.col("line").isNull(), "empty_file").alias("error"))
    ship_package(spark)
    files = files.select("path", "filename").repartition(max(1, min(len(rows), 10 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(_first_lines, "path string, filename string, line string, error string")


def _opens(path: str) -> bool:
    if "://" not in path or path.startswith("file:"):
        return True
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError, ImportError):
        return False
    return True


def _open(path: str):
    if "://" not in path or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")
    store, where = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(where, compression=None)


def _create(path: str):
    if "://" not in path or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "wb")
    store, where = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_output_stream(where, compression=None)


def copy_starts(spark: SparkSession, files: Sequence[tuple[str, str, int]]) -> None:
    """Copy the first bytes of files: (path, new path, bytes) of each. A task for each file, in pieces: no file is held in memory.

    Where Python cannot open the store, the driver copies, in pieces as well.
    """
    if not files:
        return
    if _opens(files[0][0]):
        ship_package(spark)
        given = spark.createDataFrame(list(files), "path string, target string, size long").repartition(len(files))
        given.mapInArrow(_copied_starts, "size long").agg(F.sum("size")).collect()
        return
    at = spark._jvm.org.apache.hadoop.fs.Path
    for path, target, size in files:
        store = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        source, copy = store.open(at(path)), store.create(at(target))
        while size > 0 and (block := source.readNBytes(min(size, BLOCK))):
            copy.write(block)
            size -= len(block)
        source.close()
        copy.close()


def _copied_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, target, size in zip(*(b.column(c).to_pylist() for c in ("path", "target", "size"))):
            with _open(path) as source, _create(target) as copy:
                while size > 0 and (block := source.read(min(size, BLOCK))):
                    copy.write(block)
                    size -= len(block)
        yield b.select(["size"])


def _first_line(file, whole: bool) -> tuple[str | None, str | None]:
    """The first line that is not blank; with ``whole`` the rest is read and dropped."""
    left, line = b"", None
    while block := file.read(BLOCK):
        if line is None:
            *ended, left = (left + block).split(b"\n")
            line = next((x for x in ended if x.strip(b"\xef\xbb\xbf\x00\r \t")), None)
        if line is not None and not whole:
            break
    line = line or left
    text = line.decode("utf-8", "replace").translate({0xFEFF: None, 0: None, 13: None})
    return (text, None) if text.strip() else (None, "empty_file")


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = {"gz": gzip.open, "bz2": bz2.open}
    for b in batches:
        found = []
        for path in b.column("path").to_pylist():
            kind = path.rsplit(".", 1)[-1]
            with _open(path) as raw:
                try:
                    found.append(_first_line(unpack[kind](raw) if kind in unpack else raw, kind in unpack))
                except (EOFError, zlib.error, gzip.BadGzipFile, ValueError):  # of the content; errors of the store end the task
                    found.append((None, "unreadable_file"))
        lines, errors = ([x[i] for x in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("filename"), pa.array(lines, pa.string()), pa.array(errors, pa.string())], ["path", "filename", "line", "error"])


def _wanted(df: DataFrame, include: str | None, exclude: str | None) -> DataFrame:
    """Rows of files whose name has the key and lacks the excluded tag (SRC3)."""
    name = F.col("filename")
    if include:
        df = df.where(F.contains(name, F.lit(include)))
    if exclude:
        df = df.where(~F.contains(name, F.lit(exclude)))
    return df


def finish_tape(
    raw: DataFrame,
    names: Sequence[str],
    first_label: str | None,
    include: str | None = None,
    exclude: str | None = None,
    ragged: str = "pad",
    max_cols: int | None = None,
    clean: bool = True,
) -> DataFrame:
    """The steps after parsing; also applies to a stream of files.

    Values of columns beyond ``max_cols`` are kept as one JSON text, ``_surplus`` (SRC6)."""
    keep = list(names)[:max_cols] if max_cols else list(names)
    beyond = list(names)[len(keep):]
    df = _wanted(raw, include, exclude)
    first = clean_text(F.col(names[0]), unescape=False)
    if first_label:
        df = df.where(first.isNull() | (F.lower(F.trim(first)) != first_label.lower()))
    if ragged == "skip":
        # rows narrower or wider than the header
        df = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    elif ragged == "pad":
        df = df.drop(CORRUPT)
    elif ragged != "mark":
        raise ValueError(f"unknown ragged mode {ragged!r}")
    value = lambda c: clean_text(F.col(c)).alias(c) if clean else F.col(c)
    extra = [c for c in df.columns if c not in set(names)]
    if beyond:
        filled = F.to_json(F.struct(*[value(c) for c in beyond]))  # without its null fields
        extra.append(F.nullif(filled, F.lit("{}")).alias(SURPLUS))  # of one text, made once
    return df.select(*[value(c) for c in keep], *extra)


def surplus_fields(df: DataFrame) -> DataFrame:
    """``field, n``: in how many rows each field beyond the column limit has a value (SRC6)."""
    if SURPLUS not in df.columns:
        return df.sparkSession.createDataFrame([], "field string, n long")
    # outer: a filter, also the one that a plain explode infers, would make the texts again
    return df.select(F.explode_outer(F.json_object_keys(SURPLUS)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n")).where("field IS NOT NULL")


def read_tape(
    spark: SparkSession,
    paths: str | Sequence[str],
    template: Template | None = None,
    first_col: str | None = None,
    first_label: str | None = None,
    include: str | None = None,
    exclude: str | None = None,
    ragged: str = "pad",
    max_cols: int | None = None,
    clean: bool = True,
    file_keys: bool = True,
    **options,
) -> DataFrame:
    """All tape files as text columns, one lineage, split by Spark (SRC1 to SRC6).

    Each file's own header line names its fields: files are read in groups of one header, and a field that a file
    lacks is null there; ``_fields`` lists the fields that a row's file has. The label line is recognised by the first
    field's label. A file that is empty or cannot be unpacked gives one row, with the reason in ``_file_error`` (VAL5).
    ``ragged``: ``pad`` fills short rows with null and cuts long ones, ``skip`` drops both,
    ``mark`` keeps the whole line in ``_corrupt_record`` for validation. Empty lines are skipped.

    If all files have one header, Spark reads the paths as given; otherwise the driver gets the paths of the files of
    each header, as Spark's own listing does.
    """
    if template is not None:
        first_col = first_col or template.first_column
        first_label = first_label or template.first_label
        max_cols = max_cols or template.max_columns
    found = written(file_headers(spark, paths, include, exclude), "headers")
    kinds = found.groupBy("line", "error").agg(F.min("path").alias("first")).orderBy("first").collect()  # a row for each header
    lines = [r["line"] for r in kinds if r["error"] is None]
    read = lambda line: next(csv.reader([line], delimiter=options.get("sep", ",")))
    if len(kinds) == 1 and lines:
        parts = [(read(lines[0]), paths)]
    else:
        files = lambda line: [literal_path(r["path"]) for r in found.where(F.col("line") == line).orderBy("path").collect()]
        parts = [(read(line), files(line)) for line in lines] or [([first_col or "_c0"], None)]
    df = None
    for names, where in parts:
        # the first header cell may carry a byte-order mark or another name
        names = _apart([first_col, *names[1:]] if first_col else names)
        if where is None:
            raw = spark.createDataFrame([], _schema(names)).withColumn("filename", F.lit(None).cast("string"))
        else:
            # columnPruning off: a row's width counts even when few columns are read
            raw = (
                spark.read.schema(_schema(names))
                .options(header=True, enforceSchema=True, mode="PERMISSIVE", columnPruning=False, **options)
                .option("columnNameOfCorruptRecord", CORRUPT)
                .csv(where)
                .withColumn("filename", F.col("_metadata.file_name"))
            )
        one = finish_tape(raw, names, first_label, include, exclude, ragged, max_cols, clean)
        one = one.withColumn(FIELDS, F.array(*[F.lit(n) for n in names]))
        df = one if df is None else df.unionByName(one, allowMissingColumns=True)
    if len(lines) < len(kinds):
        failed = found.where("error IS NOT NULL").select("filename", F.col("error").alias(FILE_ERROR))
        df = df.unionByName(failed, allowMissingColumns=True)
    return with_file_keys(df) if file_keys else df


def literal_path(path: str) -> str:
    """A path whose name Spark does not read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _apart(names: Sequence[str]) -> list[str]:
    """Header cells as column names: repeated and empty ones get their place, so that they show up as unknown fields."""
    seen, out = set(), []
    for i, n in enumerate(names):
        name = n if n.strip() and n.lower() not in seen else f"{n.strip()}#{i + 1}"
        seen.add(name.lower())
        out.append(name)
    return out


def with_file_keys(df: DataFrame, name: str = "filename") -> DataFrame:
    """Deal code and cut-off date from ``{deal}_{yyyy}_{mm}_{dd}_…`` file names (SRC2)."""
    part = lambda i: F.get(F.split(F.col(name), "_"), i)
    date = F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")
    return df.withColumn("dl_code", part(0)).withColumn("pcd", F.date_format(date, "yyyy-MM-dd"))


def clean_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text repair on the given columns (SRC4)."""
    wanted = set(cols)
    return df.select(*[clean_text(F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def read_bronze(spark: SparkSession, path: str, part: str | Sequence[str] | None = None) -> DataFrame | None:
    """Bronze rows, only the named partitions if given; None if the table is absent (SRC9)."""
    if version(spark, path):
        df = read_snapshot(spark, path)
        return df if part is None else df.where(F.col("part").isin(*([part] if isinstance(part, str) else list(part))))
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    if part is None:
        return df
    parts = [part] if isinstance(part, str) else list(part)
    return df.where(F.col("part").isin(*parts))


def as_panel(df: DataFrame, date: str = "reporting_date") -> DataFrame:
    """The date column as a date."""
    return df.withColumn(date, coerce_date(F.col(date).cast("string")))


def read_panel(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema=None, date: str = "reporting_date") -> DataFrame:
    """Cut-off files or a consolidated table as one panel (SRC11, SET3).

    Give a schema for CSV: inferring one reads the data twice.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=schema is None)
    return as_panel(reader.format(fmt).load(paths), date)
