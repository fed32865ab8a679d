"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte spans. Every adjacent pair that the vocabulary knows waits in the bucket of
its rank; a two-level bitmap marks the buckets in use, and find-first-set gives the lowest rank. Within a rank the
leftmost position comes first. An entry whose pair has changed since is stale and skipped. A pre-token of n bytes
takes O(n log n), so very long ones are fine. A pre-token that is itself a token needs no merges.

Defined results: a null text is the empty text with no ids; repeated rows give repeated results; an empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loantide.llm.common import map_arrow, whole_texts

CACHE_ENTRIES = 800_000  # pre-tokens a worker remembers; then it starts anew


class Encoder:
    """Encodes and decodes by a rank file's vocabulary and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        self.bits = [0] * (max(ranks.values()) // 64 + 1)  # empty between pre-tokens
        self.names = {i: str(i) for i in self.tokens}
        self.one = [ranks.get(bytes((a,)), -1) for a in range(256)]
        #: The rank of each pair of bytes, -1 if it is no token, in a row per first byte.
        self.two = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.known = _Known(self)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token.

        Token ``token[i]`` begins at i and ends at ``end[i]``, where the next begins. ``waits[i]`` is the rank of the pair that
        begins at i, -1 if it has none. The queue: ``buckets`` of positions by rank, ``bits`` with a bit per bucket
        in use, 64 to a word, and ``summary`` with a bit per word in use.
        """
        get, longest = self.ranks.get, self.longest
        whole = get(piece)
        if whole is not None:
            return (whole,)
        n, bits, buckets, summary = len(piece), self.bits, {}, 0
        end, before = list(range(1, n + 2)), list(range(-1, n))
        two = self.two
        token = list(map(self.one.__getitem__, piece))
        waits = [two[a][b] for a, b in zip(piece, piece[1:])]
        waits.append(-1)
        for i, r in enumerate(waits):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # positions grow: still a heap
                else:
                    buckets[r] = [i]
                    bits[r >> 6] |= 1 << (r & 63)
                    summary |= 1 << (r >> 6)
        while summary:
            w = (summary & -summary).bit_length() - 1
            word = bits[w]
            rank = (w << 6) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                del buckets[rank]
                bits[w] = word = word & (word - 1)
                if not word:
                    summary &= summary - 1
            if waits[i] != rank:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            before[k], waits[j] = i, -1
            token[i] = rank
            p = before[i]
            if p >= 0:
                r = get(piece[p:k], -1) if k - p <= longest else -1
                if waits[p] != r:
                    waits[p] = r
                    if r in buckets:
                        heappush(buckets[r], p)
                    elif r >= 0:
                        buckets[r] = [p]
                        bits[r >> 6] |= 1 << (r & 63)
                        summary |= 1 << (r >> 6)
            waits[i] = -1
            if k < n:
                to = end[k]
                r = get(piece[i:to], -1) if to - i <= longest else -1
                if r >= 0:
                    waits[i] = r
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        bits[r >> 6] |= 1 << (r & 63)
                        summary |= 1 << (r >> 6)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Known(dict):
    """Ids of the pre-tokens met so far."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        self[piece] = ids = self.encoder.piece(piece.encode("utf-8", "surrogatepass"))
        return ids


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` of every row, or ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``path`` is a rank file that every executor can open, ``pattern`` splits texts into pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            one, two, three = [], [], []
            for t in b.column("text"):
                ids = e.encode(t.as_py())
                back = e.decode(ids)
                if digests:
                    one.append(len(ids))
                    two.append(hashlib.sha256(",".join(map(e.names.__getitem__, ids)).encode()).hexdigest())
                    three.append(hashlib.sha256(back).hexdigest())
                else:
                    one.append(ids)
                    two.append(back)
            if digests:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(one, pa.int64()), pa.array(two, pa.string()), pa.array(three, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(one, pa.list_(pa.int32())), pa.array(two, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return map_arrow(whole_texts(docs), run, schema)
