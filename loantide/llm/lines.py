"""Line dedup by content-defined chunks: repeated multi-line chunks are removed, the first stays.

A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk where its low bits are zero, so that
inserted or deleted lines move only the boundaries near them. A chunk has at least two lines (a last one may have
one and is never removed) and at most ``MAX_LINES``. Chunks are counted globally by their hash; those found more
than once are compared byte by byte with the first occurrence (smallest doc_id, then text key, then place), and
only equal ones are removed.

Counting moves hashes only and is combined before the shuffle. The joins on the hash have one row per hash on one
side, so adaptive execution can split a hot chunk.

Defined results: a null text stays null and has no chunk; rows with equal doc_id and text are one document and keep
the same lines; blank lines are lines; an empty table gives an empty one; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loantide.llm.common import map_arrow, text_key
from loantide.session import written

WINDOW = 2
MIN_LINES = 2
MAX_LINES = 64
MEAN_LINES = 4  # power of two: a boundary on average every so many lines
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunk_bounds(lines: list[str]) -> list[int]:
    """Ends (exclusive) of the content-defined chunks of a text's lines."""
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    lead = pow(_BASE, WINDOW, 1 << 64)
    ends, rolling, start = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h - (hashes[i - WINDOW] * lead if i >= WINDOW else 0)) & _MASK
        size = i + 1 - start
        if size >= MAX_LINES or (size >= MIN_LINES and (rolling >> 32) % MEAN_LINES == 0):
            ends.append(i + 1)
            start = i + 1
    if start < len(lines):
        ends.append(len(lines))
    return ends


def _chunker(with_body: bool):
    """Rows per chunk of two lines or more; the hash and the size stand for the body where it is not asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, key, text in zip(b.column("doc_id"), b.column("key"), b.column("text")):
                d, k, lines, start = doc_id.as_py(), key.as_py(), text.as_py().split("\n"), 0
                for n, end in enumerate(chunk_bounds(lines)):
                    if end - start >= MIN_LINES:
                        body = "\n".join(lines[start:end]).encode("utf-8", "surrogatepass")
                        h = xxhash.xxh3_64_intdigest(body)
                        rows.append((d, k, n, start, end, h - ((h >> 63) << 64), len(body), body if with_body else None))
                    start = end
            columns = list(zip(*rows)) if rows else [()] * 8
            keep = 7 + with_body
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], _TYPES)], _NAMES[:keep])

    return run


_NAMES = ["doc_id", "key", "n", "start", "end", "h", "size", "body"]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
_SCHEMA = "doc_id long, key string, n int, start int, end int, h long, size int"


def chunks(docs: DataFrame, with_body: bool = False) -> DataFrame:
    """``doc_id, key, n, start, end, h, size`` (and ``body``) of every chunk of two lines or more; start and end count lines."""
    t = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    return map_arrow(t, _chunker(with_body), _SCHEMA + ", body binary" * with_body)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, start, end`` of the chunks to remove: equal, byte by byte, to an earlier one."""
    place = F.struct("doc_id", "key", "n")
    found = chunks(docs).groupBy("h", "size").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not (first <=> last)")
    found = written(found.select("h", "size", "first"), "repeats")
    shared = chunks(docs, True).join(found, ["h", "size"]).withColumn("is_first", place.eqNullSafe(F.col("first"))).drop("first")
    shared = written(shared, "chunks")
    kept = written(shared.where("is_first").groupBy("h", "size").agg(F.first("body").alias("kept")), "kept")
    return shared.where("not is_first").join(kept, ["h", "size"]).where("body = kept").select("doc_id", "key", "n", "start", "end")


def dedup_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks cut from ``text``; ``n_chars`` follows the text, where given.

    ``report`` adds ``n_lines``, ``n_removed_chunks``, ``n_removed_lines`` and ``removed`` (start:end in lines).
    """
    cuts = repeated_chunks(docs).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.struct("start", "end").alias("__cut")).distinct()
    # at most one entry per chunk of one document
    cuts = cuts.groupBy("__id", "__key").agg(F.sort_array(F.collect_list("__cut")).alias("__cuts"))
    t = docs.withColumn("__own", text_key("text"))
    t = t.join(cuts, t["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    lines = F.split("text", "\n", -1)
    outside = lambda x, i: ~F.exists("__cuts", lambda c: (c["start"] <= i) & (i < c["end"]))
    new = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, outside), "\n"))
    t = t.withColumn("__new", new)
    columns = [F.col("__new").alias("text") if c == "text" else F.when(F.col("__cuts").isNull(), F.col(c)).otherwise(F.length("__new").cast("long")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    if report:
        gone = F.aggregate("__cuts", F.lit(0), lambda a, c: a + c["end"] - c["start"])
        columns += [
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.when(F.col("__cuts").isNull(), 0).otherwise(F.size("__cuts")), F.lit(0)).cast("long").alias("n_removed_chunks"),
            F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed_lines"),
            F.coalesce(F.array_join(F.transform("__cuts", lambda c: F.concat_ws(":", c["start"], c["end"])), ","), F.lit("")).alias("removed"),
        ]
    return t.select(*columns)
