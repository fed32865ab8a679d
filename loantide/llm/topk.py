"""Exact top-k by inner product with a three-phase uniform threshold.

The components of the vectors are divided into ``PARTS`` parts; each (query block, candidate block, part) is a
source that knows its part's scores only. Phase 1: each source sends its k best part scores per query and its
smallest; the k-th best whole score of these candidates, t, is a safe cutoff. Phase 2: each source sends every part score of at least t / PARTS: a candidate that no source sends is
below t. Bounds of the sums prune again. Phase 3: the scores of what is left are computed exactly.

Equal vectors form one class. A class keeps its k + 1 smallest ids, which is exact: ties go to the smaller id, so no
further member can be among the k best of any query, its own row left out. Queries with one vector share a search.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
vectors are scored against those of the same length; rows that repeat a vec_id count once; an empty table gives an
empty result; fewer than k candidates give all; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from loantide.session import written

PARTS = 2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
CHUNK = 256  # queries scored at a time within a source


def _matrix(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), -1)
    top = int(np.abs(m).max()) if m.size else 0
    # sums below 2^53 are exact in doubles, whose products are faster
    return m.astype(np.float64) if top * top * max(1, m.shape[1]) < 1 << 50 else m


def _pair(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    a, b = _matrix(q), _matrix(c)
    return (a, b) if a.dtype == b.dtype == np.float64 and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 1 << 52 else (a.astype(np.int64), b.astype(np.int64))


def classes(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> tuple[DataFrame, DataFrame]:
    """(``vec_id, class_id`` of every usable row; ``class_id, vec, members`` with the k + 1 smallest ids of each class)."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    usable = vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & finite)
    usable = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vec"))
    usable = written(usable, "vectors")
    by = W.partitionBy("vec").orderBy("vec_id")
    few = usable.withColumn("n", F.dense_rank().over(by)).where(F.col("n") <= k + 1)
    kept = few.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    kept = written(kept.select(F.get("members", 0).alias("class_id"), "vec", "members"), "classes")
    named = usable.join(kept.select("vec", "class_id"), "vec").select("vec_id", "class_id").distinct()
    return named, kept


def search(queries: DataFrame, candidates: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """``q, c, score``: the k best candidates of each query, ties to the smaller id; both sides have ``id, vec``."""
    n = candidates.count()
    n_q, n_c = -(-max(1, queries.count()) // QUERY_BLOCK), -(-max(1, n) // CANDIDATE_BLOCK)
    dim = F.size("vec")

    def dealt(df: DataFrame, kind: str, own: int, other: int, own_name: str, other_name: str, extra: tuple = ()) -> DataFrame:
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        d = df.select("id", "vec", dim.alias("dim"), F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(own_name), *extra)
        d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name))
        return d.select("id", "vec", "dim", "qb", "cb", *extra, part)

    def piece(df: DataFrame) -> DataFrame:
        a, b = F.floor(F.col("dim") * F.col("part") / parts).cast("int"), F.floor(F.col("dim") * (F.col("part") + 1) / parts).cast("int")
        return df.withColumn("vec", F.slice("vec", a + 1, b - a))

    keys = ["qb", "cb", "dim", "part"]
    c_rows = piece(dealt(candidates, "c", n_c, n_q, "cb", "qb"))

    def scores(q: pd.DataFrame, c: pd.DataFrame):
        a, b = _pair(q["vec"], c["vec"])
        for i in range(0, len(a), CHUNK):
            yield q.iloc[i : i + CHUNK], (a[i : i + CHUNK] @ b.T).astype(np.int64)

    def phase1(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "c": [], "part": [], "s": [], "low": []}).astype("int64")]
        ids = c["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c.iloc[order]
        if len(q) and len(c):
            for some, s in scores(q, c):
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                m = best.shape[1]
                out.append(pd.DataFrame({"q": np.repeat(some["id"].to_numpy(), m), "c": ids[best].ravel(), "part": int(q["part"].iloc[0]), "s": np.take_along_axis(s, best, 1).ravel(), "low": np.repeat(s.min(axis=1), m)}))
        return pd.concat(out)

    def exact_scores(pairs: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "c": [], "score": []}).astype("int64")]
        q, c = vecs[vecs["is_q"]], vecs[~vecs["is_q"]]
        if len(pairs) and len(q) and len(c):
            a, b = _pair(q["vec"], c["vec"])
            i = pd.Index(q["id"]).get_indexer(pairs["q"])
            j = pd.Index(c["id"]).get_indexer(pairs["c"])
            s = np.concatenate([np.einsum("ij,ij->i", a[i[n : n + 65536]], b[j[n : n + 65536]]) for n in range(0, len(i), 65536)]).astype(np.int64)
            all_pairs = pd.DataFrame({"q": pairs["q"].to_numpy(), "c": pairs["c"].to_numpy(), "score": s}).sort_values(["q", "score", "c"], ascending=[True, False, True])
            out.append(all_pairs.groupby("q").head(k))
        return pd.concat(out)

    block = lambda name, many: F.pmod(F.xxhash64(name), F.lit(many)).cast("int")
    q_whole = queries.select("id", "vec", F.lit(True).alias("is_q"), block("id", n_q).alias("qb")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    c_whole = candidates.select("id", "vec", F.lit(False).alias("is_q"), block("id", n_c).alias("cb")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    vecs = q_whole.unionByName(c_whole)

    def resolve(pairs: DataFrame) -> DataFrame:
        """Exact scores of pairs, the k best of each query and candidate block."""
        p = pairs.withColumn("qb", block("q", n_q)).withColumn("cb", block("c", n_c))
        return p.groupBy("qb", "cb").cogroup(vecs.groupBy("qb", "cb")).applyInPandas(exact_scores, "q long, c long, score long")

    q_rows = piece(dealt(queries, "q", n_q, n_c, "qb", "cb"))
    local = q_rows.groupBy(*keys).cogroup(c_rows.groupBy(*keys)).applyInPandas(phase1, "q long, c long, part int, s long, low long")
    local = written(local, "local")
    lows = written(local.groupBy("q", "part").agg(F.min("low").alias("low")), "lows")
    # the k-th best exact score among what the sources sent is a safe cutoff
    kth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    first = resolve(local.select("q", "c").distinct()).withColumn("n", kth).where(F.col("n") <= k)
    cut = first.groupBy("q").agg(F.when(F.count("c") >= k, F.min("score")).otherwise(F.lit(-(1 << 62))).alias("t"))
    cut = written(cut.select(F.col("q").alias("id"), "t"), "cutoffs")

    def phase2(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "c": [], "part": [], "s": []}).astype("int64")]
        if len(q) and len(c):
            ids = c["id"].to_numpy()
            for some, s in scores(q, c):
                i, j = np.nonzero(s >= -(-some["t"].to_numpy() // parts)[:, None])
                out.append(pd.DataFrame({"q": some["id"].to_numpy()[i], "c": ids[j], "part": int(q["part"].iloc[0]), "s": s[i, j]}))
        return pd.concat(out)

    q_cut = piece(dealt(queries.join(cut, "id"), "q", n_q, n_c, "qb", "cb", ("t",)))
    sent = q_cut.groupBy(*keys).cogroup(c_rows.groupBy(*keys)).applyInPandas(phase2, "q long, c long, part int, s long")
    seen = sent.groupBy("q", "c").agg(F.sum("s").alias("s"), F.count("part").alias("seen"))
    bounds = seen.join(cut.withColumnRenamed("id", "q"), "q").join(lows.groupBy("q").agg(F.min("low").alias("least")), "q")
    missing = F.lit(parts) - F.col("seen")
    bounds = bounds.select("q", "c", (F.col("s") + missing * F.col("least")).alias("lower"), (F.col("s") + missing * F.floor((F.col("t") - 1) / parts)).alias("upper"), "seen", "s")
    bounds = written(bounds, "bounds")
    kth2 = F.row_number().over(W.partitionBy("q").orderBy(F.desc("lower")))
    cut2 = bounds.withColumn("n", kth2).where(F.col("n") == k).select("q", F.col("lower").alias("t2"))
    left = bounds.join(cut2, "q", "left").where(F.col("t2").isNull() | (F.col("upper") >= F.col("t2"))).select("q", "c")

    exact = resolve(left)
    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))
    return exact.withColumn("n", best).where(F.col("n") <= k).drop("n")


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other rows. ``is_query`` is a condition on ``vec_id``."""
    named, kept = classes(vectors, k, id_col, vec_col, scale)
    queries = written(named.where(is_query).select(F.col("vec_id").alias("query_id"), "class_id"), "queries")
    wanted = queries.select("class_id").distinct()
    q = written(kept.join(wanted, "class_id").select(F.col("class_id").alias("id"), "vec"), "query-vectors")
    c = kept.select(F.col("class_id").alias("id"), "vec")
    found = search(q, c, k + 1)
    # k + 1 classes hold the k + 1 best rows; members in order of score, then id
    rows = found.join(kept.select(F.col("class_id").alias("c"), "members"), "c").select("q", "score", F.explode("members").alias("vec_id"))
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    lists = rows.withColumn("n", order).where(F.col("n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    lists = written(lists, "lists")
    each = queries.join(lists, queries["class_id"] == lists["q"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("i", "b"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
