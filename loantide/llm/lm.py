"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with Dirichlet smoothing towards an add-half unigram model:

    p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU),    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

so every history is a state, every seen bigram an arc, and the failure arc of a state leads to the root with weight
MU / (c(h) + MU). A text is read once from left to right: the state is carried, an arc is taken if there is one,
else the failure arc and then the root's.

Neither the model nor the corpus is ever in one place. Documents form blocks of bounded size. Each block sends its
distinct words and bigram keys with their training counts to buckets by key, packed as arrays; a bucket sums them
over all blocks and returns to each block the totals of its own entries in their order, without the entries, which
the block finds again in its texts (a bigram key that no other block sends has one bit for an answer). Each block then
builds the part of the automaton that its documents can reach, and scores them. The result is that of the whole automaton. Words are compared as such; bigrams by 64-bit hashes of their words.

Defined results: a null text is the empty text, one end token; a null doc_id is hashed as the empty text; repeated
rows count and are scored as often as they occur; without training tokens every token has the probability of an
unknown one; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import map_arrow, whole_texts
from loantide.session import written

MU = 500.0
BLOCK_CHARS = 4_000_000
BUCKET_CHARS = 6_000_000  # of the corpus, per bucket of keys
FLUSH_TOKENS = 3_000_000
END = b""  # no word is empty
_START = np.uint64(0x243F6A8885A308D3)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def bigram_keys(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each token and the one before it, from their hashes."""
    x = (before ^ (before >> np.uint64(32))) * _M1 + hashes
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance, highest first: the high bytes of sorted keys then compress to little."""
    return np.ascontiguousarray(a.byteswap().view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel().byteswap()


class _Block:
    """Words and bigram keys of a block's texts, with their training counts (zero for what only held-out texts have)."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.texts: list[np.ndarray] = []
        self.train: list[bool] = []

    def add(self, text: str, train: bool) -> int:
        t, ids = tokens(text), self.ids
        for w in set(t).difference(ids):
            ids[w] = len(ids)
        self.texts.append(np.fromiter(map(ids.__getitem__, t), np.int64, len(t)))
        self.train.append(train)
        return len(t)

    def numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens in order: word, word before it (``len(ids)`` at a start), whether it is for training; and each word's hash."""
        lengths = [len(x) for x in self.texts]
        word = np.concatenate(self.texts)
        before = np.r_[0, word[:-1]]
        before[np.r_[0, np.cumsum(lengths)[:-1]]] = len(self.ids)
        return word, before, np.repeat(np.array(self.train, bool), lengths), np.fromiter(map(xxhash.xxh3_64_intdigest, self.ids), np.uint64, len(self.ids))

    def order(self, hashes: np.ndarray) -> np.ndarray:
        """The words by hash, so that those of a bucket stand together; different words with one hash by their bytes."""
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        if (h[1:] == h[:-1]).any():
            words = list(self.ids)
            order = np.array(sorted(range(len(words)), key=lambda i: (hashes[i], words[i])))
        return order

    def rows(self, block: int, bits: int) -> Iterator[tuple]:
        word, before, train, hashes = self.numbers()
        keys, inverse = np.unique(bigram_keys(np.r_[hashes, _START][before], hashes[word]), return_inverse=True)
        counts = np.bincount(inverse[train], minlength=len(keys)).astype(np.uint32)
        order, words = self.order(hashes), list(self.ids)
        n = np.bincount(word[train], minlength=len(words)).astype(np.uint32)[order]
        of_keys, of_words, order = _edges(keys, bits), _edges(hashes[order], bits), order.tolist()
        for r in range(1 << bits):
            a, b, c, d = of_keys[r], of_keys[r + 1], of_words[r], of_words[r + 1]
            if b > a or d > c:
                yield block, r, b" ".join([words[i] for i in order[c:d]]), _planes(n[c:d]), d - c, _planes(keys[a:b]), _planes(counts[a:b])


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys start among sorted ones, and the end."""
    of_key = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return np.searchsorted(of_key, np.arange((1 << bits) + 1))


_PACKED = "block long, r int, words binary, n binary, n_words int, keys binary, c binary"


def _counts(bits: int):
    names = ["block", "r", "words", "n", "n_words", "keys", "c"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def batch(blocks: dict[int, _Block]) -> Iterator[pa.RecordBatch]:
        for k, block in blocks.items():
            columns = list(zip(*block.rows(k, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size = defaultdict(_Block), 0
        for b in batches:
            for k, text, held in zip(b.column("block").to_pylist(), b.column("text"), b.column("held_out").to_pylist()):
                size += blocks[k].add(text.as_py(), not held)
                if size > FLUSH_TOKENS:
                    yield from batch(blocks)
                    blocks, size = defaultdict(_Block), 0
        yield from batch(blocks)

    return run


_ANSWER = "block long, r int, n binary, n_keys int, shared binary, c binary, n_tokens long, n_known long"


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: sums over all blocks, returned to each block in the order of its words and keys; the bucket's words and tokens once."""
    # the end token is the empty word: one word that joins to the empty text
    words = [x.split(b" ") if n else [] for x, n in zip(rows["words"], rows["n_words"])]
    total: Counter = Counter()
    for some, n in zip(words, rows["n"]):
        for w, c in zip(some, _from_planes(n, np.uint32).tolist()):
            total[w] += c
    keys = [_from_planes(k, np.uint64) for k in rows["keys"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    # exact below 2^53
    sums = np.bincount(inverse, np.concatenate([_from_planes(c, np.uint32) for c in rows["c"]]), len(every)).astype(np.uint64)
    shared, at = np.bincount(inverse, minlength=len(every)) > 1, 0
    of_block: dict[int, list[tuple[list[bytes], np.ndarray]]] = defaultdict(list)
    for block, some, k in zip(rows["block"], words, keys):
        of_block[block].append((some, inverse[at : at + len(k)]))
        at += len(k)
    known, out = sum(c > 0 for c in total.values()), []
    for i, (block, parts) in enumerate(of_block.items()):
        # a block may come in parts: its order is that of all its words and keys
        some, mine = parts[0] if len(parts) == 1 else (sorted(set().union(*[w for w, _ in parts]), key=lambda w: (xxhash.xxh3_64_intdigest(w), w)), np.unique(np.concatenate([m for _, m in parts])))
        answered = shared[mine]
        out.append((
            block, int(rows["r"].iloc[0]), _planes(np.array([total[w] for w in some], np.uint64)), len(mine), np.packbits(answered).tobytes(), _planes(sums[mine[answered]]),
            0 if i else sum(total.values()), 0 if i else known,
        ))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _ANSWER.split(", ")])


class Automaton:
    """States are histories, ``arcs`` the seen bigrams, ``failure`` the weight from a state to the root; log10 throughout."""

    def __init__(self, root: list[float], failure: list[float], arcs: dict[int, float]):
        self.root, self.failure, self.arcs, self.width = root, failure, arcs, len(root)

    def score(self, ids: list[int], start: int) -> float:
        """Of one text: one pass from left to right. The state after a token is the token itself."""
        arc, root, failure, width = self.arcs.get, self.root, self.failure, self.width
        total, state = 0.0, start
        for w in ids:
            p = arc(state * width + w)
            total += p if p is not None else failure[state] + root[w]
            state = w
        return total


def _scorer(n: int, v: int, texts: int, mu: float):
    norm = n + 0.5 * (v + 1)

    def run(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        back = back.sort_values("r")
        block = _Block()
        for t, held in zip(docs["text"], docs["held_out"]):
            block.add(t, not held)
        word, before, train, hashes = block.numbers()
        c = np.empty(len(block.ids) + 1)
        c[np.r_[block.order(hashes), -1]] = np.r_[np.concatenate([_from_planes(x, np.uint64) for x in back["n"]]), 0]
        # bigrams of the block: own training counts, replaced by totals where other blocks know them
        every, inverse = np.unique(bigram_keys(np.r_[hashes, _START][before], hashes[word]), return_inverse=True)
        sums = np.bincount(inverse[train], minlength=len(every)).astype(np.int64)
        shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(back["shared"], back["n_keys"])]).astype(bool)
        sums[shared] = np.concatenate([_from_planes(x, np.uint64) for x in back["c"]]).astype(np.int64)
        p = (c + 0.5) / norm
        context = np.r_[c[:-1], texts]
        seen = np.flatnonzero(sums)
        one = np.empty(len(every), np.int64)
        one[inverse] = np.arange(len(inverse))  # any token with the key
        state, arc = before[one[seen]], word[one[seen]]
        weight = np.log10((sums[seen] + mu * p[arc]) / (context[state] + mu))
        root, known, start = np.log10(p), c > 0, len(block.ids)
        model = Automaton(root.tolist(), np.log10(mu / (context + mu)).tolist(), dict(zip((state * (start + 1) + arc).tolist(), weight.tolist())))
        lengths = np.array([len(x) for x in block.texts])
        starts = np.cumsum(lengths) - lengths  # no text is without a token
        return pd.DataFrame({
            "doc_id": docs["doc_id"].astype("Int64"), "held_out": docs["held_out"], "n_tokens": lengths, "n_known": np.add.reduceat(known[word].astype(np.int64), starts),
            "train_tokens": n, "base_score": np.add.reduceat(root[word], starts), "score": [model.score(x.tolist(), start) for x in block.texts],
        })

    return run


def held_out_fifth(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 1


def score_texts(docs: DataFrame, held_out: Column | None = None, mu: float = MU) -> DataFrame:
    """Trains on the rows where ``held_out`` is false and scores every row:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    # a block is a part of one split of the input, so counting needs no shuffle of texts; the file and the place in it
    # are the same in both passes (for input that is no file, the hash alone deals the documents)
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    t = whole_texts(docs).withColumn("split", split).withColumn("held_out", held_out_fifth() if held_out is None else held_out)
    sizes = t.groupBy("split").agg(F.sum(F.length("text")).alias("chars"), F.count_if(~F.col("held_out")).alias("texts"))
    total, largest, texts = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.max("chars"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    parts = largest // BLOCK_CHARS + 1
    bits = max(0, (int(total) // BUCKET_CHARS).bit_length())
    t = t.select("doc_id", "text", "held_out", F.xxhash64("split", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(parts))).alias("block"))
    packed = map_arrow(t, _counts(bits), _PACKED)
    back = packed.groupBy("r").applyInPandas(_totals, _ANSWER)
    back = written(back, "totals")
    n, v = back.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return t.groupBy("block").cogroup(back.drop("n_tokens", "n_known").groupBy("block")).applyInPandas(_scorer(int(n), int(v), int(texts), mu), schema)
