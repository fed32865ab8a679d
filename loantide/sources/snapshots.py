"""Tables whose parts are replaced as a whole, by one rename (SNK1, SNK2, SNK4).

A table is a folder. Every load writes its rows to a folder of its own below ``data``; nothing is overwritten. A manifest, a
small Parquet table below ``_manifests``, says for each unit (a deal, a file) which load holds its rows. A replacement
writes the rows, then the next manifest, and puts a version file in place with one rename, which fails if another writer was
first. Readers take the newest version, so they see all of a replacement or nothing, whatever was killed in between. A unit
that a load covers without rows for it vanishes from the manifest: the loads before it leave nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LOAD = "_load"
MAX_RECORDS_PER_FILE = 5_000_000
FEW_VALUES = 4  # files that a task keeps open at once


class ConcurrentUpdate(RuntimeError):
    """Another writer replaced the same units since they were read."""


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _version_file(path: str, version: int) -> str:
    return f"{path}/_versions/{version:010d}.json"


def version(spark: SparkSession, path: str) -> int:
    """The newest version of the table, 0 if there is none."""
    store, where = _hadoop(spark, f"{path}/_versions")
    if not store.exists(where):
        return 0
    names = [f.getPath().getName() for f in store.listStatus(where)]
    return max((int(n[:10]) for n in names if n[:10].isdigit() and n.endswith(".json")), default=0)


def _state(spark: SparkSession, path: str, at: int) -> dict:
    line = spark.read.text(_version_file(path, at), wholetext=True).first()["value"]
    return json.loads(line)


def _commit(spark: SparkSession, path: str, at: int, state: dict) -> bool:
    """Put the version file in place by a rename that never overwrites; False if the version exists."""
    store, _ = _hadoop(spark, path)
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/.draft-{uuid.uuid4().hex}")
    with_text = store.create(draft, False)
    with_text.write(json.dumps(state).encode())
    with_text.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(rename, 1)
    never_over[0] = rename.NONE
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(jvm.org.apache.hadoop.fs.Path(_version_file(path, at))), never_over)
    except Py4JJavaError as e:
        store.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]):
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in cols])


def _manifest(spark: SparkSession, state: dict) -> DataFrame:
    return spark.read.parquet(state["manifest"])


def _matching(manifest: DataFrame, units: DataFrame, unit: Sequence[str], how: str) -> DataFrame:
    """Rows of the manifest that ``units`` names by some of the unit's columns (``left_semi``), or the others (``left_anti``)."""
    cols = [c for c in unit if c in units.columns]
    wanted = units.select(*cols).distinct()
    return manifest.join(wanted, _same(manifest, wanted, cols), how)


def units_of(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """The units that have rows; None if the table has no version."""
    at = version(spark, path) if at is None else at
    return _manifest(spark, _state(spark, path, at)).drop(LOAD) if at else None


def read_snapshot(spark: SparkSession, path: str, units: DataFrame | None = None, at: int | None = None) -> DataFrame | None:
    """The rows of the table, of all units or of those named (by all or some unit columns); None if it has no version.

    Only the folders of live loads are listed. The manifest is joined to the data by unit and load: where units are
    partition columns, Spark prunes the scan by it.
    """
    at = version(spark, path) if at is None else at
    if not at:
        return None
    state = _state(spark, path, at)
    schema = T.StructType.fromJson(state["schema"])
    live = _manifest(spark, state)
    if units is not None:
        live = _matching(live, units, state["unit"], "left_semi")
    loads = [r[LOAD] for r in live.select(LOAD).distinct().collect()]  # names of folders
    if not loads:
        return spark.createDataFrame([], schema)
    data = _loads(spark, path, loads, schema, state["by"])
    return data.join(live, _same(data, live, [LOAD, *state["unit"]]), "left_semi").select(*schema.names)


def _loads(spark: SparkSession, path: str, loads: Sequence[str], schema: T.StructType, by: Sequence[str]) -> DataFrame:
    # partition columns last, as Spark reads them; given types keep codes with leading zeros
    stored = T.StructType([*[f for f in schema.fields if f.name not in by], T.StructField(LOAD, T.StringType()), *[schema[c] for c in by]])
    return spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{LOAD}={x}" for x in loads])


def new_load() -> str:
    """A name for a load."""
    return uuid.uuid4().hex


def read_load(spark: SparkSession, path: str, load: str, schema: T.StructType, by: Sequence[str]) -> DataFrame:
    """The rows that one load wrote, whatever has replaced them since."""
    store, where = _hadoop(spark, f"{path}/data/{LOAD}={load}")
    if not store.exists(where):  # no rows
        return spark.createDataFrame([], schema)
    return _loads(spark, path, [load], schema, by).select(*schema.names)


@contextmanager
def _open_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Tasks keep up to ``n`` files open, so that Spark does not sort the rows by partition columns before it writes them."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replace_units(
    df: DataFrame, path: str, unit: Sequence[str], by: Sequence[str] = (), covers: DataFrame | None = None, base: int | None = None, gather: bool = True,
    load: str | None = None,
) -> int:
    """Put ``df`` in the place of all rows of the units in ``covers`` and of those in ``df``; returns the version.

    ``covers`` names units by all or some of their columns. ``by``: partition columns of the files, text or integer. Fields
    that other loads lack are null in their rows. ``base``: the version that ``df`` was derived from; if a covered unit has
    changed since, nothing is replaced and ``ConcurrentUpdate`` is raised. ``gather``: rows of one partition column value are
    brought together before they are written; without it each task writes a file for each of its values, for ``by`` of few values,
    and does not sort its rows for that. ``load``: the load's name, of ``new_load``.
    """
    spark = df.sparkSession
    unit, by = list(unit), list(by)
    load = load or new_load()
    rows = df.withColumn(LOAD, F.lit(load))
    with nullcontext() if gather else _open_writers(spark, FEW_VALUES):
        (
            (rows.hint("rebalance", *(by or unit)) if gather else rows).write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy(LOAD, *by).mode("append").parquet(f"{path}/data")
        )
    fresh = f"{path}/_manifests/new-{load}"
    store, where = _hadoop(spark, f"{path}/data/{LOAD}={load}")
    if store.exists(where):
        _loads(spark, path, [load], df.schema, by).select(*unit, LOAD).distinct().write.parquet(fresh)
    else:  # no rows
        spark.createDataFrame([], T.StructType([*[df.schema[c] for c in unit], T.StructField(LOAD, T.StringType())])).write.parquet(fresh)
    new = spark.read.parquet(fresh)
    listed = f"{path}/_manifests/covered-{load}"
    if covers is not None:
        covers.select(*[c for c in unit if c in covers.columns]).distinct().write.parquet(listed)  # read again at each attempt
    while True:
        at = version(spark, path)
        schema, live = df.schema, new
        if at:
            old = _state(spark, path, at)
            if old["unit"] != unit or old["by"] != by:
                raise ValueError(f"the table has units {old['unit']} and partitions {old['by']}")
            before = live = _manifest(spark, old)
            for named in [new, *([spark.read.parquet(listed)] if covers is not None else [])]:
                live = _matching(live, named, unit, "left_anti")
            _refuse_changes(spark, path, base, at, before.exceptAll(live), unit)
            live = live.unionByName(new)
            schema = _merged(T.StructType.fromJson(old["schema"]), df.schema)
        manifest = f"{path}/_manifests/{at + 1:010d}-{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(manifest)  # a row for each unit
        if _commit(spark, path, at + 1, {"manifest": manifest, "unit": unit, "by": by, "schema": json.loads(schema.json())}):
            return at + 1


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    for f in new.fields:
        if f.name in old.names and old[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} was {old[f.name].dataType.simpleString()} and is now {f.dataType.simpleString()}")
    loose = [T.StructField(f.name, f.dataType) for f in [*old.fields, *[f for f in new.fields if f.name not in old.names]]]
    return T.StructType(loose)


def _refuse_changes(spark: SparkSession, path: str, base: int | None, at: int, replaced: DataFrame, unit: Sequence[str]) -> None:
    if base is None or base == at:
        return
    if base:
        then = _manifest(spark, _state(spark, path, base))
        replaced = replaced.join(then, _same(replaced, then, [LOAD, *unit]), "left_anti")
    if not replaced.isEmpty():
        raise ConcurrentUpdate(f"{path} changed since version {base}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the loads and manifests that none of the newest ``keep`` versions names; returns the loads. No writer may run."""
    at = version(spark, path)
    kept = [_state(spark, path, v) for v in range(max(1, at - keep + 1), at + 1)]
    live = {r[LOAD] for s in kept for r in _manifest(spark, s).select(LOAD).distinct().collect()}
    store, where = _hadoop(spark, f"{path}/data")
    gone = [f.getPath() for f in store.listStatus(where) if f.getPath().getName().startswith(f"{LOAD}=") and f.getPath().getName().split("=")[1] not in live]
    for v in range(1, at - keep + 1):
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(_version_file(path, v)), False)
    named = {s["manifest"].rsplit("/", 1)[-1] for s in kept}
    for f in store.listStatus(_hadoop(spark, f"{path}/_manifests")[1]):
        if f.getPath().getName() not in named:
            store.delete(f.getPath(), True)
    for p in gone:
        store.delete(p, True)
    return [p.getName().split("=")[1] for p in gone]
