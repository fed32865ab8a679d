"""SimHash near-duplicates: segment popcounts as an embedding, a grid join under Manhattan distance, exact checks.

Fingerprints of 64 bits are mapped to 32 counts of set bits, one per two-bit segment. The Manhattan distance of two
count vectors never exceeds the Hamming distance of the fingerprints. The grid divides the 32 counts into
``g`` runs; within a Manhattan distance of ``d`` at least ``g - d`` runs are equal, so two fingerprints
within reach share a cell of at least one choice of ``g - d`` runs. Cells are joined, the Manhattan distance
of the whole vectors filters, and the Hamming distance decides. More runs make more and finer cells: ``runs_for`` takes as
many as the number of distinct fingerprints needs for unrelated ones to meet rarely, so the joins grow with the rows.

A cell never emits all its pairs. First every member is checked against the cell's smallest fingerprint, and the
links found are contracted to components. Then only cells that still hold several components are looked at, and in
those a pair is formed only if one of its ends is outside the cell's most frequent component: pairs inside one
component need no link. The result has the components of the full similarity graph.

Defined results: a null or empty text has fingerprint zero and is linked like any other; texts with fewer words
than a shingle hash the whole sequence; repeated rows have one fingerprint and one component; an empty table gives an empty one; a null
doc_id keeps its fingerprint and takes the component of its fingerprint (null if no row of it has an id); further
columns are ignored by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loantide.llm.common import map_arrow, partitions, text_key, whole_texts
from loantide.llm.components import components
from loantide.session import written

SHINGLE = 4
MAX_BITS = 4
LEAST_RUNS, MOST_RUNS = 9, 16
#: Entropy of the number of set bits among two random ones.
COUNT_BITS = 1.5
SEED = 42
#: Row b: the eight bits of byte value b, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of the shingles' XXH64."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(x) + 1 for x in tokens])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp)], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp`` (signed 64 bits) of every row; ``key`` tells texts of one doc_id apart."""
    t = whole_texts(docs).withColumn("key", text_key())
    return map_arrow(t.select("doc_id", "key", "text"), _fingerprints, "doc_id long, key string, fp long")


def _counts(fp: Column) -> Column:
    """The 32 popcounts 0-2, packed in two bits each: the sum of a segment's bits."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Of two packed count vectors. Counts 0, 1, 2 in unary (00, 01, 11) differ in as many bits as in value."""
    low = F.lit(0x5555555555555555)
    unary = lambda c: c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(low))
    # 10 (two) becomes 11, 01 and 00 stay
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def runs_for(prints: int, max_bits: int = MAX_BITS) -> int:
    """The fewest runs with which few cells (at most about a quarter) hold unrelated fingerprints: cells grow in number with
    the runs, and unrelated pairs with the square of the fingerprints."""
    for g in range(max(LEAST_RUNS, max_bits + 1), MOST_RUNS):
        if 4 * prints <= 2 ** (COUNT_BITS * 32 * (g - max_bits) / g):
            return g
    return MOST_RUNS


def _grid(max_bits: int, groups: int) -> list[int]:
    """Masks over the packed counts: each keeps one choice of ``groups - max_bits`` runs of segments."""
    cuts = [32 * i // groups for i in range(groups + 1)]
    runs = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(runs[i] for i in c) for c in combinations(range(groups), groups - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(prints: DataFrame, max_bits: int, groups: int) -> DataFrame:
    """``cell, counts_in_cell, fp, node`` for every choice of runs."""
    masks = F.array(*[F.lit(_signed(m)) for m in _grid(max_bits, groups)])
    # narrow rows, dealt out before each becomes many
    t = prints.repartition(partitions(prints.sparkSession)).withColumn("counts", _counts(F.col("fp")))
    t = t.select("fp", "node", "counts", F.posexplode(masks).alias("grid", "mask"))
    return t.select("grid", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "fp", "node", "counts")


def _near(a: str, b: str, max_bits: int) -> Column:
    """Manhattan distance of the counts first, then the Hamming distance of the fingerprints."""
    bound = _manhattan(F.col(f"{a}.counts"), F.col(f"{b}.counts")) <= max_bits
    return bound & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= max_bits)


def link(prints: DataFrame, max_bits: int = MAX_BITS, groups: int | None = None) -> DataFrame:
    """``node, component`` over ``prints`` (``fp`` distinct, ``node`` its long label); nodes alone are not returned."""
    grid = cells(prints, max_bits, runs_for(prints.count(), max_bits) if groups is None else groups)
    # every member gets its cell's smallest one in the same shuffle; cells with one member take no part
    by = W.partitionBy("grid", "cell")
    headed = grid.drop("counts").withColumn("head", F.min(F.struct("node", "fp")).over(by)).withColumn("n", F.count(F.lit(1)).over(by)).where("n > 1")
    shared = headed.select("grid", "cell", "node", "fp", F.col("head.node").alias("head_node"), F.col("head.fp").alias("head_fp"))
    shared = written(shared.withColumn("counts", _counts(F.col("fp"))).withColumn("head_counts", _counts(F.col("head_fp"))), "cells")
    h = shared.select("node", F.struct("fp", "counts").alias("x"), "head_node", F.struct(F.col("head_fp").alias("fp"), F.col("head_counts").alias("counts")).alias("y"))
    first = h.where("node <> head_node").where(_near("x", "y", max_bits)).select(F.col("node").alias("a"), F.col("head_node").alias("b"))
    merged = components(first)
    # second look: cells that still hold several components
    named = shared.drop("head_node", "head_fp", "head_counts").join(merged, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = written(named, "cells")
    sizes = named.groupBy("grid", "cell", "c").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("grid", "cell").agg(F.max(F.struct("n", F.col("c").alias("c"))).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = written(most.select("grid", "cell", F.col("top.c").alias("top")), "mixed")
    open_cells = written(named.join(mixed, ["grid", "cell"]), "open")
    x = open_cells.where("c <> top").select("grid", "cell", F.struct("node", "fp", "counts", "c").alias("x"))
    y = open_cells.select("grid", "cell", F.struct("node", "fp", "counts", "c").alias("y"), (F.col("c") == F.col("top")).alias("in_top"))
    pairs = x.join(y, ["grid", "cell"]).where((F.col("x.c") != F.col("y.c")) & (F.col("in_top") | (F.col("x.node") > F.col("y.node"))))
    second = pairs.where(_near("x", "y", max_bits)).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    # the second links tie components of the first, whose labels are their smallest nodes
    tied = components(second)
    moved = merged.join(tied.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = tied.join(merged, "node", "left_anti")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(alone.select("node", "component"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, groups: int | None = None) -> DataFrame:
    """``doc_id, key, fp, c, component_id`` of every row: ``c`` labels its component over links of at most ``max_bits`` by a
    fingerprint, ``component_id`` by the smallest doc_id in it (null without one; components that repeat an id share it)."""
    rows = written(fingerprints(docs), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    nodes = prints.withColumn("node", F.col("fp"))
    joined = link(nodes, max_bits, groups)
    # components are labelled by fingerprints; the smallest doc_id of all their members names them
    named = written(prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp")), "named")
    best = written(named.groupBy("c").agg(F.min("least").alias("component_id")), "best")
    by_print = named.select("fp", "c").join(best, "c").select("fp", "c", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "key", "fp", "c", "component_id")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The row with the smallest doc_id of every component, with its columns; of repeated rows one stays."""
    found = near_duplicates(docs, max_bits)
    # one winner per component by a minimum, rows without doc_id last: no group is gathered
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    winners = found.groupBy("c").agg(F.min(place).alias("w")).select(F.col("w.doc_id").alias("__id"), F.col("w.key").alias("__key"))
    t = docs.withColumn("__own", text_key("text"))
    kept = t.join(winners, t["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_semi")
    one = W.partitionBy("doc_id", "__own").orderBy(*[c for c in docs.columns if c != "text"])
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
