"""Importance resampling, WARC archives and ranked search against brute force and SQL: nulls, ties, repeats, clashing columns."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loantide.llm import lexical, resampling, warc

SF = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score long, rank string, row int, key string, weight double, terms int"


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def some_text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["Alpha", "beta-Gamma", "ÉTÉ", "straße", "x1", "of", "the", "Of,", "\x7f.", "λόγος"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rows = [(i, some_text(i % 17, 5 + i % 60)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " .,; "), (None, some_text(3, 40)), (None, None), (7, some_text(7, 12)), (7, some_text(7, 12)), (503, "beta " * 40_000), (504, "z" * 100_000)]
    return rows + [(600, some_text(1, 30))] * 30


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "r", 2, "k", 0.5, 3) for i, t in texts], DOCS).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Alpha ALPHA beta"), (2, "λόγος straße"), (3, None), (4, "nothing here matches"), (5, "été of the"), (5, "été of the"), (None, "x1"), (6, "..")]
    return spark.createDataFrame([(i, t, 9, "b") for i, t in rows], "item_id long, text string, row int, block string")


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.select(*want.columns).collect()
    assert rows and Counter(map(tuple, rows)) == Counter(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_warc", "op13_ranked_search"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)


# --- resampling


def brute_resample(texts, target, percent, min_words, max_run, buckets):
    def features(t):
        w = terms(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in texts:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, able = [], []
    for i, x in texts:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(terms(x)) >= min_words:
                able.append((-score, i))
        out.append((i, len(f), weight, score))
    return out, sorted(able)[: percent * len(able) // 100]


@pytest.mark.parametrize("percent,max_run,buckets", [(10, 1, 10_000), (37, 3, 50), (100, 1, 7), (0, 1, 100)])
def test_resample(docs, texts, items, percent, max_run, buckets):
    target = [r.text for r in items.collect()]
    want, drawn = brute_resample(texts, target, percent, 20, max_run, buckets)
    got = resampling.resample(docs, items, percent=percent, max_run=max_run, buckets=buckets).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert ranked == [(n + 1, *k) for n, k in enumerate(drawn)]


def test_resample_empty(spark, docs, items):
    assert resampling.resample(docs.limit(0), items).count() == 0
    assert resampling.resample(docs, items.limit(0)).where("rank IS NOT NULL").count() > 0


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_key_among_ties(spark, tmp_path, k):
    # a third of all rows shares score and doc_id; only the row number tells them apart
    keys = [(-5, 1, i) if i % 3 == 0 else (-(i % 11), i % 4, i) for i in range(1000)]
    spark.createDataFrame([(x,) for x in keys], "key struct<s:long,d:long,r:long>").write.parquet(str(tmp_path / "keys"))
    assert resampling.kth_key(spark.read.parquet(str(tmp_path / "keys")), k, pivots=3) == sorted(keys)[k - 1]


# --- ranked search


def brute_search(texts, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in texts]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return Counter(out)


@pytest.mark.parametrize("bound", [lexical.BLOCK_BYTES, 60])
def test_ranked_search(docs, texts, items, bound):
    got = lexical.rank_documents(docs, items, bound=bound)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(texts, [(r.item_id, r.text) for r in items.collect()])


def test_blocks_lie_below_the_bound(items):
    dealt = lexical.blocks(lexical.item_terms(items), 60)
    sizes = dealt.groupBy("block").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert len(sizes) > 1 and all(r.b <= 60 or r.n == 1 for r in sizes)


def test_search_empty(docs, items):
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0


# --- archives


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 40}</p>") for i in range(200)]
    rows += [(300, None, None), (301, "http://x\r\ny", ""), (None, "u", "same"), (None, "v", "same"), (302, "w", "same"), (303, "é", "é\U0001f600\r\n\r\nWARC/1.1\r\n" + "ü" * 300_000), (304, "r", "twice"), (304, "r", "twice")]
    return spark.createDataFrame([(*r, "x", 1, b"p") for r in rows], "page_id long, url string, html string, record_id string, row int, payload binary").repartition(4)


def brute_pages(rows, min_bytes):
    groups = {}
    for r in rows:
        groups.setdefault((r.html or "").encode(), []).append(r.page_id)
    out = []
    for body, ids in groups.items():
        digest, ids = base64.b32encode(hashlib.sha1(body).digest()).decode(), sorted(ids, key=lambda i: (i is not None, i or 0))
        plain = len(body) < min_bytes
        out += [(i, len(body), digest, "response" if plain or n + 1 == len(ids) else "revisit", None if plain or n + 1 == len(ids) else ids[-1]) for n, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_archive_and_read(pages, min_bytes):
    got = warc.archive_and_read(pages, min_bytes)
    assert Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute_pages(pages.collect(), min_bytes)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_over_many_files(spark, pages, tmp_path, compression):
    path = str(tmp_path / "w")
    rows = pages.select(F.concat(F.lit("<urn:"), F.monotonically_increasing_id().cast("string"), F.lit(">")).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    warc.write_warc(rows, path, compression=compression, file_bytes=5_000)
    got = warc.read_warc(spark, path, partition_bytes=8_000)
    assert got.rdd.getNumPartitions() > 2 and len(list(tmp_path.glob("w/*.warc*"))) > 4
    seen = Counter((r.target_uri, bytes(r.payload), r.payload_length) for r in got.where("warc_type = 'response'").collect())
    clean = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    assert seen == Counter((clean(r.url), (r.html or "").encode(), len((r.html or "").encode())) for r in pages.collect())
    # predicates on headers are evaluated by the reader, with the same rows as Spark's own filter
    some = warc.read_warc(spark, path, ["target_uri", "read_length"]).where(F.col("target_uri").startswith("http://a/1") & F.col("target_uri").isin("http://a/1", "http://a/12"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # nothing is left for Spark to filter
    assert sorted(tuple(r) for r in some.collect()) == [("http://a/1", 8), ("http://a/12", 9)]


class Counting(io.BytesIO):
    asked = 0

    def read(self, n=-1):
        got = super().read(n)
        self.asked += len(got)
        return got


@pytest.mark.parametrize("pack", [warc.gzip_member, lambda x: x])
def test_unwanted_payloads_are_not_read(pack):
    noise = random.Random(1).randbytes(2_000_000)
    data = b"".join(pack(warc.encode_record({"warc_type": t, "record_id": f"<{t}>", "payload": p})) for t, p in [("response", noise), ("metadata", b"m"), ("response", noise)])
    f = Counting(data)
    found = list(warc.records(f, len(data), lambda h: h["warc-type"] == "metadata", {"payload"}))
    assert [r["payload"] for r in found] == [b"m"] and f.asked < 400_000
    f = Counting(data)
    assert [r["payload_length"] for r in warc.records(f, len(data), lambda h: True, {"payload_length"})] == [2_000_000, 1, 2_000_000] and f.asked < 600_000


def test_foreign_archives(spark, tmp_path):
    """Without skip lengths, all records in one member, chunked bodies, folded headers and blank lines between records."""
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nX-Long: a\r\n b\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <b>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    both = one % (len(http), http) + two
    (tmp_path / "plain.warc").write_bytes(both)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(both))
    (tmp_path / "each.warc.gz").write_bytes(gzip.compress(one % (len(http), http)) + gzip.compress(two))
    (tmp_path / "note.txt").write_bytes(b"no archive")
    got = warc.read_warc(spark, str(tmp_path))
    assert Counter((r.record_id, r.warc_type, bytes(r.payload)) for r in got.collect()) == {("<a>", "response", b"3\r\nabc\r\n0\r\n\r\n"): 3, ("<b>", "resource", b"hello"): 3}
    assert [r.payload_length for r in warc.read_warc(spark, str(tmp_path), ["warc_type", "payload_length"]).where("warc_type = 'resource'").collect()] == [5, 5, 5]
    assert {r.headers["x-long"] for r in got.where("record_id = '<a>'").collect()} == {"a b"}


def test_damaged_and_uncommitted_files(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.archive_pages(pages, path)
    n = warc.read_warc(spark, path, ["record_id"]).count()
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"left by a lost task")  # no manifest names it
    assert warc.read_warc(spark, path, ["record_id"]).count() == n
    (tmp_path / "bad.warc.gz").write_bytes(warc.gzip_member(warc.encode_record({"warc_type": "resource", "payload": b"x"})) + b"\x1f\x8b\x08\x00cut")
    with pytest.raises(Exception, match="no sound archive"):
        warc.read_warc(spark, str(tmp_path / "bad.warc.gz"), ["record_id"]).collect()
    assert warc.read_warc(spark, str(tmp_path / "bad.warc.gz"), ["record_id"], damaged="skip").count() == 1


def test_archive_empty(spark, pages):
    assert warc.archive_and_read(pages.limit(0)).count() == 0
