"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``CAPACITY`` tokens. The histogram of piece lengths has at most ``CAPACITY``
rows whatever the input; best-fit decreasing runs over its counts on the driver: pieces of one length fill the
tightest open sequences many at a time. The plan is a list of slots as ranges: for a length, the pieces of ranks
[from, to) go to consecutive sequences, ``per`` of them side by side. Pieces take their slots by joining on length
and rank. Ranks come from counts per (length, bucket) and row numbers within a bucket, so a length that a third of
the pieces share is no single group.

Defined results: a null or empty text is the end id alone; pieces of repeated rows are packed as often as they
occur; an empty table gives an empty one; further columns are ignored. Sequence ids have no order.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F

from loantide.llm.common import map_arrow, partitions, whole_texts
from loantide.session import written

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 50_000
BROADCAST_RANGES = 50_000  # a plan up to this size (about 3 MB) is broadcast; beyond, it is joined by shuffle
#: Fixed value: the words of a byte-level pre-tokenizer, as its library defines them.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizers library gives them for a tokenizers file.

    Where the file is plain byte-level BPE, whose ids rank its merges, the ids come from tiktoken, which needs a fraction
    of the time. Both agree: merges go by rank in both, and as every token is reached from its own bytes, two neighbours
    that spell a token are always the pair that its merge names. Other files, and texts whose runs of white space are
    too long for tiktoken's pattern, go through the tokenizers library.

    ``ordinary`` takes the strings of special tokens in a text as ordinary text. Otherwise they are their tokens, as the
    library does by default; texts with one go through it.
    """

    def __init__(self, path: str, ordinary: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = self._ranks()
        self.ranked = ranks and tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self) -> dict[bytes, int] | None:
        """Tokens as bytes with their ids, if the ids alone tell how texts are merged."""
        whole = json.loads(self.tokenizer.to_str())
        model, splitter = whole["model"], whole["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        splits = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter["add_prefix_space"]
        ordinary = all(t["special"] for t in whole["added_tokens"])
        if not (plain and splits and ordinary and whole["normalizer"] is None and whole["truncation"] is None and whole["padding"] is None):
            return None
        byte = {c: b for b, c in enumerate(_byte_chars())}
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in pairwise(merged)) or not byte.keys() <= vocab.keys():
            return None
        if any(not byte.keys() >= set(t) or len(self.tokenizer.model.tokenize(t)) != 1 for t in vocab):
            return None
        return {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}

    def encode(self, text: str) -> bytes:
        if self.ranked and not any(s in text for s in self.special):
            try:
                return self.ranked.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # a run of white space beyond the stack of its pattern
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@functools.cache
def tokenizer(path: str, ordinary: bool = True) -> TextTokenizer:
    return TextTokenizer(path, ordinary)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row's pieces; only the first may be shorter than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokenizer(path, ordinary=False), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = t.encode(text.as_py()) + end
                n = len(ids) // 4
                cut, start = n % capacity or capacity, 0
                for k in range(-(-n // capacity)):
                    rows.append((d, k, start, cut - start, zlib.crc32(ids[4 * start : 4 * cut])))
                    start, cut = cut, cut + capacity
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(whole_texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank from, rank to, per sequence, first sequence, offset)."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of sequences (first, number)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = sorted(c for c in room if c >= length and room[c])
        while left:
            if fits:
                free = fits[0]
                first, many = room[free].pop()
                if not room[free]:
                    fits.pop(0)
            else:
                free, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            per = free // length
            full = min(many, left // per)
            for number, each in ((full, per), (1 if full < many and left > full * per else 0, left - full * per)):
                if number:
                    out.append((length, rank, rank + number * each, each, first, capacity - free))
                    rank, left, first, many = rank + number * each, left - number * each, first + number, many - number
                    room[free - each * length].append((first - number, number))
            if many:
                room[free].append((first, many))
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    p = written(pieces(docs, path, capacity), "pieces")
    counts = Counter({r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()})
    ranges = plan(counts, capacity)
    buckets = max(partitions(spark), sum(counts.values()) // BUCKET_ROWS + 1)
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = p.withColumn("within", within - 1).join(written(sizes, "sizes"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    slots = spark.createDataFrame(ranges, "length long, rank_from long, rank_to long, per long, first long, at long")
    slots = F.broadcast(slots) if len(ranges) <= BROADCAST_RANGES else slots
    inside = (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    step = F.col("rank") - F.col("rank_from")
    return ranked.join(slots, inside).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + (step % F.col("per")) * ranked["length"]).alias("offset"),
    )
