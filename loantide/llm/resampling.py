"""Importance resampling towards a target corpus: array-scored weights, then a distributed quickselect.

Words and their runs are hashed to a fixed number of buckets. Two counts per bucket, one of the raw documents and one
of the target, give an array of gains; a document's weight is the floored mean of its features' gains. A Gumbel term
derived from the document's id is added, and the documents with the highest scores are drawn.

The draw never sorts the corpus. Rows have the composite key (score descending, doc_id ascending, row number), which no
two rows share. Each round takes a few random keys of the open range as pivots and counts, in one pass, the rows that
lie before, on and after each; the range shrinks to the gap that holds the k-th key, until a pivot is that key. Only the
rows up to it are range-partitioned and numbered, by the offsets of their partitions. The driver sees pivots and counts.

Defined results: a null or empty text has no features and weight 0; a row without a doc_id counts towards the bucket
counts and keeps its weight, has no score and is never drawn; repeated rows are rows of their own, and where the last
place falls among equal rows the first row numbers are drawn; an empty target has zero counts; an empty table gives an
empty one; further columns, of any name, are ignored. Words of any length and texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import map_arrow, partitions
from loantide.session import written

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
PIVOTS = 15
#: On UTF-8 bytes, after A-Z became a-z: digits, letters and every byte of a character beyond 0x7F.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_bytes(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def feature_buckets(tokens: list[bytes], max_run: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``max_run`` consecutive words, repeats kept."""
    hashes = [crc32(w) for w in tokens]
    for n in range(2, max_run + 1):
        hashes += [crc32(b" ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1)]
    return np.array(hashes, dtype=np.int64) % buckets


def bucket_counts(texts: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all rows: one row per bucket and task is shuffled, ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for t in b.column("text"):
                total += np.bincount(feature_buckets(word_bytes(t.as_py()), max_run, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    sums = map_arrow(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """Per bucket the floored 1000-fold log ratio of the smoothed target and raw frequencies."""
    b, s, t = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((float(y + 1) * float(s + b)) / (float(x + 1) * float(t + b)))) for x, y in zip(raw, target)]


def gumbel(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: list[int], max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    per_bucket = np.array(gains, dtype=np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for i, t in zip(ids, b.column("text")):
                tokens = word_bytes(t.as_py())
                features = feature_buckets(tokens, max_run, len(per_bucket))
                weight = int(per_bucket[features].sum()) // len(features) if len(features) else 0
                rows.append((len(tokens), len(features), weight, None if i is None else weight + gumbel(i, seed)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "n_words", "n_features", "weight", "score"])

    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(t, score, "doc_id long, n_words long, n_features long, weight long, score long")


def _key(score: Column, doc_id: Column, row: Column) -> Column:
    """The composite key, ascending: the highest score first."""
    return F.struct((-score).alias("s"), doc_id.alias("d"), row.alias("r"))


def _literal(key: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(key, "sdr")])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, int, int]:
    """The k-th smallest (from 1) of distinct keys in column ``key``, exactly; ``keys`` must read written rows."""
    low = high = None
    round_ = 0
    while True:
        inside = keys
        if low is not None:
            inside = inside.where(F.col("key") > _literal(low))
        if high is not None:
            inside = inside.where(F.col("key") < _literal(high))
        # random keys of the open range: each task sends its few with the smallest draws
        draw = F.xxhash64("key", F.lit(round_))
        found = sorted(tuple(r["key"]) for r in inside.select("key", draw.alias("u")).orderBy("u", "key").limit(pivots).collect())
        # position 2i is the gap before pivot i, 2i + 1 the pivot itself
        position = sum(((F.col("key") > _literal(p)).cast("int") + (F.col("key") >= _literal(p)).cast("int") for p in found), F.lit(0))
        counts = {r["p"]: r["n"] for r in inside.groupBy(position.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = 0
        while k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at += 1
            if at > 2 * len(found):
                raise ValueError("fewer keys than k")
        if at % 2:
            return found[at // 2]
        low, high = (found[at // 2 - 1] if at else low), (found[at // 2] if at // 2 < len(found) else high)
        round_ += 1


def ranked(winners: DataFrame) -> DataFrame:
    """The rows with ``rank`` from 1 by ``key``: ranges are sorted apart, and their sizes give each its offset."""
    spark = winners.sparkSession
    ranges = winners.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    # the id holds the range above bit 33 and the place in it below; written, so that later reads agree
    placed = written(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets, done = {}, 0
    for r in sizes.orderBy("part").collect():  # one row per range
        offsets[r["part"]], done = done, done + r["n"]
    before = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map().cast("map<bigint,bigint>")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("rank", (F.element_at(before.cast("map<bigint,bigint>"), F.shiftright("at", 33)) + place + 1).cast("long")).drop("at")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; rows not drawn have no rank.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (floored) are drawn.
    """
    gains = bucket_gains(bucket_counts(docs, max_run, buckets), bucket_counts(target, max_run, buckets))
    rows = written(weigh(docs, gains, max_run, seed).withColumn("row", F.monotonically_increasing_id()), "weights")
    takes_part = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    k = percent * rows.where(takes_part).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    keyed = rows.withColumn("key", F.when(takes_part, _key(F.col("score"), F.col("doc_id"), F.col("row"))))
    last = kth_key(keyed.where("key IS NOT NULL").select("key"), k)
    drawn = F.coalesce(F.col("key") <= _literal(last), F.lit(False))
    winners = ranked(keyed.where(drawn).select(*out, "key")).select(*out, "rank")
    return winners.unionByName(keyed.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
