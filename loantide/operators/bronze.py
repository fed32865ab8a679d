"""Bronze history: validity, checksums and SCD2 (SCD1 to SCD5).

A version row carries its sightings: when its content was valid (the cut-off), when that was recorded, and in which file.
The versions of a key follow from all its sightings alone, so the order in which batches arrive does not matter: at one
cut-off the content recorded last holds, and a run of equal content over the cut-offs is one version. Content that a later
delivery of the same cut-off replaced stays as a row of length zero (``valid_to`` = ``valid_from``): it is valid at no time,
but ``as_known`` can still derive what the history was before the correction.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantide.functions.text import key_hash, row_hash
from loantide.operators.validate import READER_COLUMNS
from loantide.session import written

VALIDITY = ("valid_from", "valid_to", "iscurrent")
HISTORY = (*VALIDITY, "last_seen", "checksum", "part", "seen")
SIGHTINGS = "array<struct<at:timestamp,recorded:timestamp,pcd:string,filename:string>>"


def part_label(dl_code, date):
    """``{deal}_{year}{month}``: one label for writing and for looking up."""
    return F.concat(dl_code, F.lit("_"), F.year(date), F.month(date))


def to_bronze(
    df: DataFrame, keys: Sequence[str], hash_cols: Sequence[str] | None = None, valid_from: str | None = None, recorded: str | None = None,
    gather: bool = False,
) -> DataFrame:
    """Add cut-off year and month, validity, checksum, partition label and the first sighting (SCD1).

    The checksum covers every attribute unless ``hash_cols`` says otherwise; the cut-off date
    is no attribute. Validity starts at the cut-off date unless a time is given; ``last_seen`` is
    the latest time at which the same content was delivered. ``recorded`` defaults to the current time. ``gather`` brings the
    rows of a partition label together before the other columns are added, so that none of them is shuffled.
    """
    if gather:
        df = df.withColumn("_part", part_label(F.col("dl_code"), F.col("pcd").try_cast("date"))).hint("rebalance", "_part").drop("_part")
    skip = {"dl_code", "pcd", "filename", *READER_COLUMNS, *keys}
    known = F.current_timestamp() if recorded is None else F.lit(recorded).cast("timestamp")
    file = F.col("filename") if "filename" in df.columns else F.lit(None).cast("string")
    attributes = [c for c in df.columns if c not in skip] if hash_cols is None else list(hash_cols)
    date = F.col("pcd").try_cast("date")
    start = date.cast("timestamp") if valid_from is None else F.lit(valid_from).cast("timestamp")
    return df.select(
        "*",
        F.year(date).alias("pcd_year"),
        F.month(date).alias("pcd_month"),
        start.alias("valid_from"),
        start.alias("last_seen"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit(1).alias("iscurrent"),
        key_hash(F.col("dl_code"), *[F.col(c) for c in keys], *[F.col(c) for c in attributes]).alias("checksum"),
        part_label(F.col("dl_code"), date).alias("part"),
        F.array(F.struct(start.alias("at"), known.alias("recorded"), F.col("pcd").alias("pcd"), file.alias("filename"))).cast(SIGHTINGS).alias("seen"),
    )


def _without_key(keys: Sequence[str], hash_col: str) -> Column:
    """Rows that lack a key are told apart by their content: they share no window and have no common history."""
    return F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.col(hash_col))


def _with_sightings(df: DataFrame) -> DataFrame:
    """Rows of tables that kept no sightings get the two that their columns tell."""
    if "seen" in df.columns:
        return df
    pcd, file = (F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("pcd", "filename"))
    one = lambda at: F.struct(F.col(at).alias("at"), F.lit(None).cast("timestamp").alias("recorded"), pcd.alias("pcd"), file.alias("filename"))
    return df.withColumn("seen", F.array_distinct(F.array(one("valid_from"), one("last_seen"))).cast(SIGHTINGS))


def versions_of(sightings: DataFrame, keys: Sequence[str], hash_col: str = "checksum") -> DataFrame:
    """``keys, _own, checksum`` and the validity columns of every version, from one narrow row per sighting (column ``s``).

    One shuffle by key; a window holds the sightings of one key, which the number of cut-offs bounds.
    """
    own = [*keys, "_own"]
    # of one cut-off: by recording time; of one delivery that repeats a key, the smallest checksum comes last and holds
    w = Window.partitionBy(*own).orderBy("s.at", F.col("s.recorded").asc_nulls_first(), F.col(hash_col).desc(), "s.filename")
    same_time = F.lag(F.struct("s.at")).over(w).eqNullSafe(F.struct("s.at"))
    repeated = same_time & F.lag(hash_col).over(w).eqNullSafe(F.col(hash_col))
    once = sightings.withColumn("_repeated", repeated).where("NOT _repeated").drop("_repeated")
    replaced = F.lead(F.struct("s.at")).over(w).eqNullSafe(F.struct("s.at"))
    marked = once.withColumn("_replaced", replaced)
    holds = marked.where("NOT _replaced")
    begins = ~F.lag(F.struct(hash_col)).over(w).eqNullSafe(F.struct(hash_col))
    runs = holds.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = [F.min("s").alias("first"), F.max("s.at").alias("last_seen"), F.sort_array(F.collect_list("s")).alias("seen")]
    versions = runs.groupBy(*own, "_run", hash_col).agg(*span).drop("_run").withColumn("valid_from", F.col("first.at"))
    ends = F.lead("valid_from").over(Window.partitionBy(*own).orderBy("valid_from"))
    versions = versions.withColumn("valid_to", ends).withColumn("iscurrent", F.when(F.col("valid_to").isNull(), 1).otherwise(0))
    withdrawn = marked.where("_replaced").groupBy(*own, F.col("s.at").alias("valid_from"), hash_col).agg(*span)
    withdrawn = withdrawn.withColumn("valid_to", F.col("valid_from")).withColumn("iscurrent", F.lit(0))
    return versions.unionByName(withdrawn)


def scd2_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], hash_col: str = "checksum") -> DataFrame:
    """The history after a batch (SCD2, JON9), whatever the order in which batches arrive.

    Keys that the batch does not name pass through untouched. For the others the sightings of the old versions and of the
    batch are put in order as narrow rows, and the versions that follow are joined to their contents. A repeated batch,
    several versions of a key in one batch and late older cut-offs come out as if all had arrived in order.
    """
    keys = list(keys)
    old, new = _with_sightings(old), _with_sightings(new)
    columns = old.columns
    batch_keys = new.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()
    # a missing key equals a missing key, so that a repeated batch changes nothing
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    untouched = old.join(batch_keys, same, "left_anti").select(*columns)
    touched = old.join(batch_keys, same, "left_semi").select(*columns)
    return untouched.unionByName(_rebuilt(touched.unionByName(new.select(*columns)), keys, hash_col).select(*columns))


def _rebuilt(rows: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """All versions of the keys in ``rows``, from their sightings."""
    # written once: the sightings read its narrow columns, the contents the wide ones, and chained merges do not multiply
    rows = written(rows.withColumn("_own", _without_key(keys, hash_col)), "touched")
    own = [*keys, "_own", hash_col]
    versions = versions_of(rows.select(*own, F.explode("seen").alias("s")).distinct(), keys, hash_col)
    # one row per content: of attributes outside the checksum those first valid; cut down before the shuffle
    first = Window.partitionBy(*own).orderBy("valid_from", F.xxhash64(*[c for c in rows.columns if c != "seen"]))
    contents = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*[F.col(c).alias(f"_c_{c}") for c in rows.columns])
    joined = versions.join(contents, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in own]))
    date = F.col("first.pcd").try_cast("date")
    new = {
        "valid_from": F.col("valid_from"), "valid_to": F.col("valid_to"), "iscurrent": F.col("iscurrent"), "last_seen": F.col("last_seen"), "seen": F.col("seen"),
        "pcd": F.col("first.pcd"), "filename": F.col("first.filename"), "pcd_year": F.year(date), "pcd_month": F.month(date),
        "part": part_label(F.col("_c_dl_code"), date) if "dl_code" in rows.columns else F.lit(None),
    }
    return joined.select(*[(new[c] if c in new else F.col(f"_c_{c}")).alias(c) for c in rows.columns if c != "_own"])


def as_known(df: DataFrame, keys: Sequence[str], recorded: str, hash_col: str = "checksum") -> DataFrame:
    """The history as it was known at a time: versions from the sightings recorded until then."""
    until = F.lit(recorded).cast("timestamp")
    known = _with_sightings(df).withColumn("seen", F.filter("seen", lambda x: x["recorded"].isNull() | (x["recorded"] <= until)))
    return _rebuilt(known.where(F.size("seen") > 0), list(keys), hash_col).select(*df.columns)


def initial_history(new: DataFrame, keys: Sequence[str], hash_col: str = "checksum") -> DataFrame:
    """History of a first batch."""
    return _rebuilt(_with_sightings(new), list(keys), hash_col).select(*new.columns)


def load_bronze(old: DataFrame | None, new: DataFrame, keys: Sequence[str], mode: str = "merge") -> DataFrame:
    """First load, merge, or skip partitions that already exist (SCD3)."""
    if old is None:
        return initial_history(new, keys)
    if mode == "merge":
        return scd2_merge(old, new, keys)
    if mode == "skip":
        there = old.select(F.col("dl_code").alias("_deal"), F.col("part").alias("_part")).distinct()
        # a missing label equals a missing label, so undated rows are not appended again and again
        fresh = new.join(there, F.col("dl_code").eqNullSafe(F.col("_deal")) & F.col("part").eqNullSafe(F.col("_part")), "left_anti")
        return old.unionByName(fresh.select(*old.columns))
    raise ValueError(f"unknown load mode {mode!r}")


def as_of(df: DataFrame, ts: str) -> DataFrame:
    """Versions valid at a time (SCD4)."""
    t = F.lit(ts).cast("timestamp")
    return df.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def read_current(df: DataFrame) -> DataFrame:
    """Current rows without the history columns (SRC10)."""
    return df.where("iscurrent = 1").drop(*VALIDITY, "last_seen", "checksum", "seen")


def facility_bronze_columns(df: DataFrame, ingested_at: str) -> DataFrame:
    """Ingest time and row hash of facility rows (SCD5)."""
    return df.select("*", F.lit(ingested_at).alias("_ingested_at"), row_hash(df.columns).alias("_row_hash"))
