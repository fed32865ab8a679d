"""Ranked lexical search without a document index: an Aho-Corasick automaton over the items' terms reads the texts.

A text is lower-cased (A-Z only), every character outside terms becomes a space, and a space is put at both ends. The
automaton's keys are the items' terms between two spaces, so a match is a whole term and neighbouring terms may share
a space. One pass over the documents counts their terms, the terms of all documents and in how many documents each item
term occurs. With the weights that follow, a second pass counts tf again from the text, maps each term to its items,
and keeps the best ``k`` documents per item and task; only these are shuffled and ranked.

Items are dealt to blocks by hash until the terms and item lists of every block lie below ``BLOCK_BYTES`` (or the block is
one item); one block's automaton is broadcast at a time.

Defined results: a null or empty text has no terms, counts in no statistic and is never returned; an item without terms
has no rows; repeated items are answered each, repeated documents are documents of their own; equal scores are ordered
by doc_id, null last (rows equal in both in any order); empty tables give an empty result; further columns are ignored.
Texts and terms of any length are taken whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loantide.llm.common import map_arrow
from loantide.session import written

TOP = 20
B_PERCENT = 25
K1_TENTHS = 12
#: Bound on the UTF-8 bytes of the terms of one broadcast automaton, plus 16 bytes for each (term, item) pair.
BLOCK_BYTES = 8 << 20
_LAST = 1 << 63
#: Bytes: A-Z to a-z, digits, a-z and all bytes of characters beyond 0x7F as they are, the rest to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return b" %b " % (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def term_list(text: str | None) -> list[str]:
    return [x.decode("utf-8", "surrogatepass") for x in folded(text).split()]


class Matcher:
    """The automaton of one block; built once in each worker that receives it."""

    def __init__(self, terms: list[str], items: list[tuple[int, Counter]]):
        self.terms = terms
        number = {t: i for i, t in enumerate(terms)}
        hits: list[list[tuple[int, int]]] = [[] for _ in terms]
        for place, (_, counts) in enumerate(items):
            for t, c in counts.items():
                hits[number[t]].append((place, c))
        self.rows = [r for r, _ in items]
        # per term: the items that hold it and how often
        self.places = [np.array([p for p, _ in h], dtype=np.int64) for h in hits]
        self.repeats = [np.array([c for _, c in h], dtype=np.int64) for h in hits]
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def count(self, text: str | None) -> tuple[int, Counter]:
        """The number of terms in the text, and how often each item term occurs."""
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for i, t in enumerate(self.terms):
                made.add_word(f" {t} ", i)
            if self.terms:
                made.make_automaton()
            self._automaton = made
        line = folded(text)
        n = len(line.split())
        if not n or not self.terms:
            return n, Counter()
        return n, Counter([i for _, i in self._automaton.iter(line.decode("utf-8", "surrogatepass"))])


def length_norm(n: int, docs: int, terms: int) -> int:
    return 100 - B_PERCENT + (B_PERCENT * n * docs) // terms


def item_terms(items: DataFrame) -> DataFrame:
    """``row, item_id, terms, bytes`` of every item with a term."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [term_list(t.as_py()) for t in b.column("text")]
            sizes = [sum(len(t.encode("utf-8", "surrogatepass")) + 16 for t in set(ts)) for ts in found]
            arrays = [b.column("row"), b.column("item_id"), pa.array(found, pa.list_(pa.string())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "item_id", "terms", "bytes"])

    t = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    return written(map_arrow(t, split, "row long, item_id long, terms array<string>, bytes long").where("size(terms) > 0"), "items")


def blocks(items: DataFrame, bound: int = BLOCK_BYTES) -> DataFrame:
    """The items with ``block``: every block's terms lie below the bound, or it holds one item."""
    n = 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items"))
        if sizes.where((F.col("bytes") > bound) & (F.col("items") > 1)).isEmpty():
            return dealt
        n *= 2


def _statistics(texts: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and documents per item term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total, df = 0, 0, Counter()
        for b in batches:
            for t in b.column("text"):
                n, tf = shared.value.count(t.as_py())
                docs, total = docs + bool(n), total + n
                df.update(tf.keys())
        ids = [-2, -1, *df.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([docs, total, *df.values()], pa.int64())], ["term", "n"])

    sums = map_arrow(texts.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in sums.collect()}  # at most a row for each term of the block
    return df.pop(-2, 0), df.pop(-1, 0), df


def _best(texts: DataFrame, shared, weights: list[int], docs: int, total: int, k: int) -> DataFrame:
    """``row, doc_id, score``: the best ``k`` of every item and task, scores above 0."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in m.rows]
        least = np.zeros(len(m.rows), dtype=np.int64)  # scores below this cannot enter
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                n, tf = m.count(t.as_py())
                if not tf:
                    continue
                norm = K1_TENTHS * length_norm(n, docs, total)
                terms = list(tf)
                gain = np.array([weights[x] * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + norm)) for x in terms], dtype=np.int64)
                scores = np.zeros(len(m.rows), dtype=np.int64)
                places = [m.places[x] for x in terms]
                np.add.at(scores, np.concatenate(places), np.concatenate([m.repeats[x] for x in terms]) * np.repeat(gain, [len(p) for p in places]))
                key = -(_LAST if i is None else i)
                for p in np.flatnonzero((scores > 0) & (scores >= least)).tolist():
                    heap, entry = best[p], (int(scores[p]), key)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[p] = heap[0][0]
        for start in range(0, len(best), 1000):
            rows = [(m.rows[p], None if d == -_LAST else -d, s) for p in range(start, min(start + 1000, len(best))) for s, d in best[p]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["row", "doc_id", "score"])

    t = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(t, search, "row long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, bound: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents, ties to the smaller doc_id."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    dealt = written(blocks(item_terms(items), bound), "blocks")
    parts = None
    for r in dealt.select("block").distinct().orderBy("block").collect():
        rows = dealt.where(F.col("block") == r["block"]).select("row", "terms").collect()  # below the bound
        counted = [(x["row"], Counter(x["terms"])) for x in sorted(rows, key=lambda x: x["row"])]
        shared = spark.sparkContext.broadcast(Matcher(sorted({t for _, c in counted for t in c}), counted))
        n_docs, total, df = _statistics(texts, shared)
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(shared.value.terms))]
        one = written(_best(texts, shared, weights, n_docs, total, k), "best")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(dealt.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
