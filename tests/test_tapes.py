"""Readers, validation, silver and history on small fixtures."""

import datetime
import gzip
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loantide.operators import bronze as B, silver as S, validate as V
from loantide.plans.tape_load import load_tape
from loantide.session import scratch_path
from loantide.sources import deals, sinks, snapshots, tapes
from loantide.sources.snapshots import ConcurrentUpdate, read_snapshot, replace_units, vacuum, version
from loantide.streaming import tapes as stream
from loantide.templates import TEMPLATES
from loantide.templates.rules import Rule
from verification import tape_queries

RULES = {
    "AS1": Rule("AS1", "datetime", False, min="2012-01-01", max="2030-12-31"),
    "AS2": Rule("AS2", "string", False),
    "AS3": Rule("AS3", "number", True, min=0.0),
    "AS4": Rule("AS4", "string", True, allowed=("Y", "N")),
    "AS5": Rule("AS5", "string", True, regex="^[A-Z]{3}$", maxlength=3),
    "AS6": Rule("AS6", "integer", True, min=0, max=9999),
}


def reasons(df):
    return [sorted((e["field"], e["reason"]) for e in r["qc_errors"]) for r in df.orderBy("id").collect()]


def test_every_broken_rule_is_reported(spark):
    rows = [
        (1, "2020-11-30", "x", "1.005", "Y", "EUR", "12"),
        (2, "2020-13", "", "abc", "y", "eu", "1.5"),
        (3, "2011", "ND", "-1", "ND1", None, "10000"),
        (4, "2020-11", "ND Bank", None, "N", "EURO", "x"),
        (5, "20201", "x", "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "id int, AS1 string, AS2 string, AS3 string, AS4 string, AS5 string, AS6 string")
    got = reasons(V.validate(df, RULES, "2025-01-01", system=["id"]))
    assert got[0] == []
    assert got[1] == sorted([("AS1", "not_a_date"), ("AS2", "null_not_allowed"), ("AS3", "not_a_number"),
                             ("AS4", "unallowed_value"), ("AS5", "regex_mismatch"), ("AS6", "not_an_integer")])
    assert got[2] == sorted([("AS1", "below_min"), ("AS2", "null_not_allowed"), ("AS3", "below_min"), ("AS6", "above_max")])
    assert got[3] == sorted([("AS5", "regex_mismatch"), ("AS5", "too_long"), ("AS6", "not_an_integer")])
    assert got[4] == [("AS1", "not_a_date")]


def test_prefix_mode_unknown_field_and_null_on_failure(spark):
    df = spark.createDataFrame([(1, "NDB Bank", "abc", "z")], "id int, AS2 string, AS3 string, ZZ string")
    assert reasons(V.validate(df, RULES, "2025-01-01", system=["id"])) == [[("AS3", "not_a_number"), ("ZZ", "unknown_field")]]
    lenient = V.validate(df.drop("ZZ"), RULES, "2025-01-01", nd_mode="prefix", on_fail="null", system=["id"])
    assert reasons(lenient) == [[("AS2", "null_not_allowed")]]


def test_clean_and_dirty_make_up_the_input(spark):
    df = spark.createDataFrame([(str(i), str(i - 5)) for i in range(20)], "AS2 string, AS3 string")
    clean, dirty = V.split_clean_dirty(V.validate(df, RULES, "2025-01-01"))
    assert clean.count() + dirty.count() == 20 and dirty.count() == 5
    assert clean.columns == df.columns


def test_every_template_validates_its_own_columns(spark):
    for t in TEMPLATES.values():
        if t.rules:
            df = spark.createDataFrame([[None] * len(t.rules)], ", ".join(f"{f} string" for f in t.rules))
            row = V.validate(df, t.rules, "2025-01-01").select("qc_errors").first()[0]
            assert {e["field"] for e in row} == {f for f, r in t.rules.items() if not r.nullable}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "D1_2020_11_30_Loan_Data.csv").write_bytes(
        "﻿AS1,AS2,AS3\nPool Cut-off Date,Pool,Loan\n2020-11-30,p\\u00e9\x00,1\n\n2020-11-30,p,\n2020-11-30,p\n2020-11-30,p,3,4\n".encode())
    (tmp_path / "D2_2021_02_28_Loan_Data.csv").write_text("AS1,AS2,AS3\nPool Cut-off Date,Pool,Loan\n2021-02-28,q,9\n")
    (tmp_path / "D2_2021_02_28_Loan_Labeled0M.csv").write_text("AS1,AS2,AS3\nPool Cut-off Date,Pool,Loan\n2021-02-28,q,7\n")
    return str(tmp_path)


def read(spark, folder, **kw):
    df = tapes.read_tape(spark, folder, TEMPLATES["sme_assets"], exclude="Labeled0M", **kw)
    return sorted((r["dl_code"], r["pcd"], r["AS1"], r["AS2"], r["AS3"] or "") for r in df.collect())


def test_tape_files(spark, folder):
    d1, d2 = ("D1", "2020-11-30", "2020-11-30"), ("D2", "2021-02-28", "2021-02-28", "q", "9")
    assert read(spark, folder) == sorted([d1 + ("pé", "1"), d1 + ("p", ""), d1 + ("p", ""), d1 + ("p", "3"), d2])
    assert read(spark, folder, ragged="skip") == sorted([d1 + ("pé", "1"), d1 + ("p", ""), d2])
    marked = tapes.read_tape(spark, folder, TEMPLATES["sme_assets"], ragged="mark", exclude="Labeled0M")
    assert marked.where(F.col(V.CORRUPT).isNotNull()).count() == 2


def test_stream_reads_each_file_once_and_equals_batch(spark, folder):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    for _ in range(2):
        src = stream.stream_tapes(spark, folder, ["AS1", "AS2", "AS3"], "Pool Cut-off Date", exclude="Labeled0M")
        stream.stream_to_parquet(src, out, checkpoint)
    got = sorted((r["dl_code"], r["pcd"], r["AS1"], r["AS2"], r["AS3"] or "") for r in spark.read.parquet(out).collect())
    assert got == read(spark, folder)


DOC = ("<root{ns}><head/><body><list><meta/><deals><deal><DealCode>D1</DealCode><DealName></DealName>"
       "<ISIN><string>A</string><string>B</string></ISIN><Country>NL</Country><Submissions><Submission>"
       "<PoolCutOffDate>2020-11-30T00:00:00</PoolCutOffDate><MetricData>x</MetricData></Submission></Submissions></deal></deals></list></body></root>")


@pytest.mark.parametrize("ns", ["", " xmlns='urn:d'"])
def test_deal_documents(spark, tmp_path, ns):
    (tmp_path / "d.xml").write_text(DOC.format(ns=ns))
    by_position = deals.read_deals(spark, str(tmp_path), ["DealCode", "DealName", "ISIN", "Country"])
    by_tag = deals.read_deals_by_tag(spark, str(tmp_path), "deal")
    for df in (by_position, by_tag):
        r = df.first().asDict()
        assert (r["dl_code"], r["DealName"], r["ISIN"], r["pcd"], r["year"]) == ("D1", None, "A;B", "2020-11-30", 2020)
        assert "Country" not in r and "MetricData" not in r


def test_amortisation_pairings(spark):
    df = spark.createDataFrame([("L_1", 10.0, "2020-01-31", 5.0, "2020-02-29", None, "2020-03-31")],
                               "AS3 string, AS150 double, AS151 string, AS152 double, AS153 string, AS154 double, AS155 string")
    rows = lambda p: sorted((r["AS3"], str(r["DATE_VALUE"]), r["DOUBLE_VALUE"]) for r in S.amortisation_long(df, p).collect())
    assert rows("period") == [("L_1", "2020-01-31", 10.0), ("L_1", "2020-02-29", 5.0)]
    assert len(rows("all")) == 6


def batch(spark, rows):
    df = spark.createDataFrame(rows, "dl_code string, pcd string, k string, v string")
    return B.to_bronze(df, ["dl_code", "k"], ["v"])


def brute_force(observations):
    """Versions per key from all observations in time order; the last row of a day wins."""
    out = {}
    for key in {o[0] for o in observations}:
        days = dict(sorted((d, v) for k, d, v in observations if k == key))
        versions = []
        for d, v in sorted(days.items()):
            if not versions or versions[-1][1] != v:
                versions.append((d, v))
        out[key] = versions
    return out


def history(df):
    out = {}
    for r in df.orderBy("k", "valid_from").collect():
        out.setdefault(r["k"], []).append((str(r["valid_from"])[:10], r["v"]))
    return out


FIRST = [("D", "2020-01-31", "a", "1"), ("D", "2020-01-31", "b", "1"), ("D", "2020-01-31", "c", "1")]
SECOND = [("D", "2020-02-29", "a", "2"), ("D", "2020-02-29", "b", "1"), ("D", "2020-02-29", "d", "1"), ("D", "2020-03-31", "a", "3")]
LATE = [("D", "2020-02-15", "b", "9"), ("D", "2020-01-15", "a", "0")]


def test_history_cases(spark):
    keys = ["dl_code", "k"]
    h = B.load_bronze(None, batch(spark, FIRST), keys)
    for rows in (SECOND, SECOND):
        h = B.scd2_merge(h, batch(spark, rows), keys)
    want = brute_force([(k, d, v) for _, d, k, v in FIRST + SECOND])
    assert history(h) == want
    assert h.where("iscurrent = 1").groupBy("k").count().where("count > 1").count() == 0
    for _ in range(2):  # a late batch, and the same again
        h = B.scd2_merge(h, batch(spark, LATE), keys)
        assert history(h) == brute_force([(k, d, v) for _, d, k, v in FIRST + SECOND + LATE])
    assert {r["k"]: r["v"] for r in B.read_current(h).collect()} == {"a": "3", "b": "1", "c": "1", "d": "1"}
    assert {r["k"]: r["v"] for r in B.as_of(h, "2020-02-20").collect()} == {"a": "1", "b": "9", "c": "1"}


def test_history_on_disk_and_skip_mode(spark):
    path = scratch_path(spark, "bronze")
    for rows in (FIRST, SECOND, LATE, SECOND):
        sinks.merge_bronze(batch(spark, rows), path, ["k"])
    assert history(tapes.read_bronze(spark, path)) == brute_force([(k, d, v) for _, d, k, v in FIRST + SECOND + LATE])
    other = scratch_path(spark, "bronze")
    for rows in (FIRST, FIRST + SECOND):
        sinks.merge_bronze(batch(spark, rows), other, ["k"], mode="skip")
    assert tapes.read_bronze(spark, other).count() == 7


def test_csv_sink_refuses_empty_data(spark):
    with pytest.raises(ValueError):
        sinks.write_csv(spark.range(0), scratch_path(spark, "csv"))


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "A_2020_01_31_x.csv").write_text("AS1,AS2,AS3\nPool Cut-off Date,Pool,Loan\n2020-01-31,p,1\n")
    (tmp_path / "B_2020_01_31_x.csv").write_text("AS1,AS3,AS2\nPool Cut-off Date,Loan,Pool\n2020-01-31,9,q\n")
    (tmp_path / "C_2020_01_31_x.csv").write_text("﻿AS1,AS2\r\nPool Cut-off Date,Pool\r\n2020-01-31,r\r\n")
    (tmp_path / "0_2020_01_31_Labeled0M.csv").write_text("AS1,ZZ\nPool Cut-off Date,Z\n2020-01-31,z\n")
    df = tapes.read_tape(spark, str(tmp_path), TEMPLATES["sme_assets"], exclude="Labeled0M")
    assert "ZZ" not in df.columns
    assert sorted((r["dl_code"], r["AS2"], r["AS3"]) for r in df.collect()) == [("A", "p", "1"), ("B", "q", "9"), ("C", "r", None)]


def test_quarantine_keeps_earlier_loads(spark):
    path = scratch_path(spark, "quarantine")
    one = lambda deal, v: spark.createDataFrame([(deal, "2020-01-31", v)], "dl_code string, pcd string, AS2 string")
    for deal, v in (("D1", "a"), ("D2", "b"), ("D1", "c")):
        sinks.write_quarantine(one(deal, v), one(deal, v + "!"), path)
    for side, mark in (("clean", ""), ("dirty", "!")):
        got = sinks.read_quarantine(spark, path, side)
        assert sorted((r["dl_code"], r["AS2"]) for r in got.collect()) == [("D1", "c" + mark), ("D2", "b" + mark)]


def test_rows_without_a_key(spark):
    row = ("D", "2020-01-31", None, "1")
    h = B.load_bronze(None, batch(spark, [row, ("D", "2020-01-31", "a", "1")]), ["dl_code", "k"])
    assert B.scd2_merge(h, batch(spark, [row, ("D", "2020-01-31", "a", "1")]), ["dl_code", "k"]).count() == 2
    checked = V.validate(spark.createDataFrame([("x", None), ("y", "1")], "AS2 string, AS3 string"), RULES, "2025-01-01")
    clean, dirty = V.split_clean_dirty(checked, ["AS3"])
    assert [r["AS2"] for r in clean.collect()] == ["y"] and "null_key" in dirty.first()["qc_errors"]


def test_bronze_of_other_deals_and_undated_rows_stays(spark):
    path = scratch_path(spark, "bronze")
    for rows in ([("D", "2020-01-31", "a", "1"), ("E", None, "a", "1")], [("D_1", "2020-01-31", "a", "1")], [("D", None, "b", "1")], [("D", "2020-02-29", "a", "2")]):
        sinks.merge_bronze(batch(spark, rows), path, ["k"])
    got = sorted((r["dl_code"], r["k"], r["v"]) for r in tapes.read_bronze(spark, path).where("iscurrent = 1").collect())
    assert got == [("D", "a", "2"), ("D", "b", "1"), ("D_1", "a", "1"), ("E", "a", "1")]


def test_numbers_and_classes_without_rules(spark):
    texts = ["5d", "1f", "0x1p3", "NaN", "Infinity", "1e999", "1.5", " -2 ", ".5", "1e3", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(V.coerce_number(F.col("t")).alias("v"))
    assert [r["v"] for r in df.collect()] == [None] * 6 + [1.5, -2.0, 0.5, 1000.0, 7.0]
    row = V.validate(spark.createDataFrame([("x",)], "AA1 string"), TEMPLATES["auto_assets"].rules, "2025-01-01").first()
    assert row["qc_ok"] and row["qc_errors"] == []


@pytest.mark.parametrize("rows,order", [
    # A, A, A and a late B between the sightings
    ([("D", "2020-01-31", "a", "A"), ("D", "2020-03-31", "a", "A"), ("D", "2020-05-31", "a", "A"), ("D", "2020-02-29", "a", "B")], [0, 1, 2, 3]),
    ([("D", f"2020-0{m}-28", "a", v) for m, v in zip((1, 2, 3, 4, 5), "AABAA")], [4, 0, 2, 3, 1]),
    ([("D", f"2020-0{m}-28", "a", v) for m, v in zip((1, 2, 3, 4, 5), "ABABA")], [2, 4, 1, 0, 3]),
    ([("D", f"2020-0{m}-28", "a", v) for m, v in zip((1, 2, 3, 4, 5), "AAAAA")], [3, 1, 4, 2, 0]),
])
def test_history_does_not_depend_on_the_order_of_arrival(spark, rows, order):
    keys, h = ["dl_code", "k"], None
    for i in order:
        h = B.load_bronze(h, batch(spark, [rows[i]]), keys)
    want = brute_force([(k, d, v) for _, d, k, v in rows])
    assert history(h) == want
    ends = [str(r["valid_to"])[:10] for r in h.orderBy("valid_from").collect()]
    assert ends == [d for d, _ in want["a"]][1:] + ["None"]
    for d in ("2020-01-31", "2020-03-15", "2020-04-15", "2020-05-31"):
        assert [r["v"] for r in B.as_of(h, d).collect()] == [v for a, v in want["a"] if a <= d][-1:]


def test_history_as_known_before_a_correction(spark):
    keys, h = ["dl_code", "k"], None
    row = lambda v, day: spark.createDataFrame([("D", "2020-01-31", "a", v, f"{v}.csv")], "dl_code string, pcd string, k string, v string, filename string")
    for v, day in (("x", "2021-01-01"), ("y", "2021-02-01"), ("y", "2021-03-01"), ("x", "2021-04-01")):
        h = B.load_bronze(h, B.to_bronze(row(v, day), keys, ["v"], recorded=day), keys)
    now = h.where("iscurrent = 1").collect()
    assert [(r["v"], r["filename"], len(r["seen"])) for r in now] == [("x", "x.csv", 1)]
    for day, v in (("2021-01-15", "x"), ("2021-03-15", "y"), ("2021-05-01", "x")):
        assert [r["v"] for r in B.as_of(B.as_known(h, keys, day), "2020-06-30").collect()] == [v]
    assert B.as_known(h, keys, "2020-12-31").count() == 0


def test_rows_without_a_key_share_no_window(spark):
    rows = [("D", "2020-01-31", None, str(i % 3)) for i in range(9)]
    h = B.load_bronze(None, batch(spark, rows), ["dl_code", "k"])
    assert sorted((r["v"], r["iscurrent"]) for r in h.collect()) == [("0", 1), ("1", 1), ("2", 1)]


def one_tape(spark, folder, name, lines, compress=False):
    text = "".join(x + "\n" for x in lines).encode()
    (folder / (name + (".gz" if compress else ""))).write_bytes(gzip.compress(text) if compress else text)


def test_unknown_and_missing_fields_count_per_file(spark, tmp_path):
    one_tape(spark, tmp_path, "D1_2020_01_31_x.csv", ["AS1,AS2", "2020-01-31,p", "2020-01-31,q"])
    one_tape(spark, tmp_path, "D2_2020_01_31_x.csv", ["AS1,AS2,AS9,AS2", "2020-01-31,p,9,9"])
    one_tape(spark, tmp_path, "D3_2020_01_31_x.csv", ["AS1", "2020-01-31"])
    df = tapes.read_tape(spark, str(tmp_path))
    got = {(r["dl_code"], e["field"], e["reason"]) for r in V.validate(df, RULES, "2025-01-01").collect() for e in r["qc_errors"]}
    assert got == {("D2", "AS9", "unknown_field"), ("D2", "AS2#4", "unknown_field")}


def test_a_file_that_cannot_be_read_is_one_dirty_row(spark, tmp_path):
    good = ["AS1,AS2"] + [f"2020-01-31,{i}" for i in range(20_000)]
    one_tape(spark, tmp_path, "D1_2020_01_31_x.csv", good[:3])
    one_tape(spark, tmp_path, "D2_2020_01_31_x.csv", good, True)
    whole = (tmp_path / "D2_2020_01_31_x.csv.gz").read_bytes()
    (tmp_path / "D3_2020_02_29_x.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "D4_2020_01_31_x.csv").write_bytes(b"")
    (tmp_path / "D5_2020_01_31_x.csv").write_bytes(b" \n\n")
    df = V.validate(tapes.read_tape(spark, str(tmp_path)), RULES, "2025-01-01")
    clean, dirty = V.split_clean_dirty(df, ["dl_code", "AS2"])
    assert {r["dl_code"]: r["n"] for r in clean.groupBy("dl_code").agg(F.count("*").alias("n")).collect()} == {"D1": 2, "D2": 20_000}
    bad = sorted((r["filename"], r["pcd"], r["qc_errors"]) for r in dirty.collect())
    reason = lambda x: '[{"field":"file","reason":"%s"}]' % x
    assert bad == [("D3_2020_02_29_x.csv.gz", "2020-02-29", reason("unreadable_file")), ("D4_2020_01_31_x.csv", "2020-01-31", reason("empty_file")),
                   ("D5_2020_01_31_x.csv", "2020-01-31", reason("empty_file"))]
    only = tapes.read_tape(spark, str(tmp_path / "D4_2020_01_31_x.csv"), first_col="AS1")
    assert [r["_file_error"] for r in only.collect()] == ["empty_file"]


class Counted:
    def __init__(self, data):
        self.data, self.at, self.asked = data, 0, 0

    def read(self, n):
        got = self.data[self.at : self.at + n]
        self.at += len(got)
        self.asked += len(got)
        return got


def test_headers_read_the_first_block_only():
    for size in (10, 10_000_000):
        f = Counted(b"\xef\xbb\xbf\r\n\r\nAS1,AS2\r\n" + b"x" * size)
        assert tapes._first_line(f, False) == ("AS1,AS2", None) and f.asked <= tapes.BLOCK
    long = b"A" * (3 * tapes.BLOCK)
    assert tapes._first_line(Counted(long + b"\nx"), False) == (long.decode(), None)


def test_names_with_pattern_characters(spark, tmp_path):
    for name, head in (("D{1}_2020_01_31_[a].csv", "AS1,AS2"), ("D{2}_2020_01_31_b c%20.csv", "AS2,AS1")):
        one_tape(spark, tmp_path, name, [head, "1,2"])
    got = sorted((r["filename"], r["AS1"], r["AS2"]) for r in tapes.read_tape(spark, str(tmp_path)).collect())
    assert [x[1:] for x in got] == [("1", "2"), ("2", "1")]


def test_columns_beyond_the_limit_are_kept_and_reported(spark, tmp_path):
    one_tape(spark, tmp_path, "D1_2020_01_31_x.csv", ["AS1,AS2,AS3,AS4", "a,b,c,", "a,b,,", "a,b,c,d"])
    df = tapes.read_tape(spark, str(tmp_path), max_cols=2)
    assert {r["field"]: r["n"] for r in tapes.surplus_fields(df).collect()} == {"AS3": 2, "AS4": 1}
    assert "AS3" not in df.columns and df.where("_surplus IS NULL").count() == 1


def test_surplus_is_made_once_and_plain_text_is_not_repaired(spark):
    rows = [("a", "x\\u0041\\u00e9"), ("b", "\ufeffy\u0000"), ("c", None), ("d", "p\\q"), ("e", "")]
    raw = spark.createDataFrame(rows, "AS1 string, AS2 string")
    df = tapes.finish_tape(raw, ["AS1", "AS2"], None, ragged="mark", max_cols=1)
    assert {r["AS1"]: r["_surplus"] for r in df.collect()} == {
        "a": '{"AS2":"xA\u00e9"}', "b": '{"AS2":"y"}', "c": None, "d": '{"AS2":"p\\\\q"}', "e": '{"AS2":""}'}
    counts = tapes.surplus_fields(df)
    assert [tuple(r) for r in counts.collect()] == [("AS2", 4)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().lower().count("structstojson") == 1


def test_reloads_leave_nothing_behind(spark, tmp_path):
    target, small = str(tmp_path / "out"), replace(TEMPLATES["sme_assets"], rules=RULES, keys=("AS1",), loan_key="AS2", types={}, topics={"loan_info": (2, 6)}, general=(1, 1))

    def load(**files):
        folder = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for name, rows in files.items():
            one_tape(spark, folder, f"{name}_x.csv", ["AS1,AS2,AS3", *rows])
        load_tape(tapes.read_tape(spark, str(folder), first_col="AS1", file_keys=True), small, target, "2025-01-01")

    def sides():
        return {x: sorted((r["filename"][:2], r["AS2"]) for r in sinks.read_quarantine(spark, f"{target}/quarantine", x).collect()) for x in ("clean", "dirty")}

    silver = lambda: sorted((r["dl_code"], r["AS2"], r["AS3"]) for r in read_snapshot(spark, f"{target}/silver/loan_info").collect())
    load(D1_2020_01_31=["2020-01-31,a,1", "2020-01-31,b,x"])
    assert sides() == {"clean": [("D1", "a")], "dirty": [("D1", "b")]}
    load(D1_2020_01_31=["2020-01-31,a,1", "2020-01-31,b,2"])  # corrected
    assert sides() == {"clean": [("D1", "a"), ("D1", "b")], "dirty": []}
    load(f1=["2020-01-31,n,1"])  # no deal, no date: two loads keep both
    load(f2=["2020-01-31,m,1"])
    load(D2_2020_01_31=["2020-01-31,c,1"])
    assert sides() == {"clean": [("D1", "a"), ("D1", "b"), ("D2", "c"), ("f1", "n"), ("f2", "m")], "dirty": []}
    before = silver()
    assert [x for x in before if x[0] == "D1"] == [("D1", "a", "1"), ("D1", "b", "2")]
    load(D1_2020_02_29=["2020-02-29,a,5"])
    assert [x for x in silver() if x[0] == "D1"] == [("D1", "a", "5"), ("D1", "b", "2")] and [x for x in silver() if x[0] != "D1"] == [x for x in before if x[0] != "D1"]


def test_replacement_is_all_or_nothing(spark, tmp_path):
    path, table = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(rows, "u string, p string, v int")
    read = lambda: {(r["u"], r["p"], r["v"]) for r in read_snapshot(spark, path).collect()}
    assert read_snapshot(spark, path) is None
    replace_units(table(("a", "01", 1), ("a", "02", 2), ("b", "01", 3), (None, "1", 4)), path, ["u"], ["p"])
    replace_units(table(("a", "03", 5)), path, ["u"], ["p"])
    assert read() == {("a", "03", 5), ("b", "01", 3), (None, "1", 4)}
    base = version(spark, path)
    with pytest.raises(Exception, match="broken"):
        replace_units(table(("b", "01", 9)).withColumn("v", F.raise_error(F.lit("broken")).cast("int")), path, ["u"], ["p"])
    assert version(spark, path) == base and read_snapshot(spark, path).where("u = 'b'").first()["v"] == 3
    replace_units(table(("b", "04", 7)), path, ["u"], ["p"], base=base)
    with pytest.raises(ConcurrentUpdate):  # derived from what another writer has replaced
        replace_units(table(("b", "05", 8)), path, ["u"], ["p"], base=base)
    replace_units(table(("c", "05", 8)), path, ["u"], ["p"], base=base)  # another unit does not matter
    replace_units(table(("b", "", 0)).limit(0), path, ["u"], ["p"], covers=table(("b", "", 0)))  # emptied
    assert {r["u"] for r in read_snapshot(spark, path).collect()} == {"a", "c", None}
    assert [r["v"] for r in read_snapshot(spark, path, table(("a", "", 0)).select("u")).collect()] == [5]
    assert {r["u"] for r in read_snapshot(spark, path, at=1).collect()} == {"a", "b", None}
    wider = table(("d", "06", 6)).withColumn("w", F.lit("new"))
    replace_units(wider, path, ["u"], ["p"])
    assert sorted((r["v"], r["w"]) for r in read_snapshot(spark, path).where("u IN ('a', 'd')").collect()) == [(5, None), (6, "new")]
    rows = {tuple(r) for r in read_snapshot(spark, path).collect()}
    assert vacuum(spark, path) and {tuple(r) for r in read_snapshot(spark, path).collect()} == rows


def test_commit_refuses_a_taken_version(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_units(spark.range(3), path, ["id"])
    assert not snapshots._commit(spark, path, 1, {}) and read_snapshot(spark, path).count() == 3


def test_stream_with_differing_headers_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    heads = {"A": ["AS1,AS2,AS3", "2020-01-31,p,1"], "B": ["AS1,AS3,AS2", "2020-01-31,9,q"], "C": ["AS1,AS2", "2020-01-31,r"], "E": [""]}
    got, seen = str(tmp_path / "out"), []

    def keep(tape, batch_id):
        seen.append(batch_id)
        tape.select("dl_code", *[F.col(c) if c in tape.columns else F.lit(None).cast("string").alias(c) for c in ("AS2", "AS3", "_file_error")]).write.mode("append").parquet(got)

    for deal, lines in heads.items():
        one_tape(spark, folder, f"{deal}_2020_01_31_x.csv", lines)
        stream.stream_tape_files(spark, str(folder), keep, str(tmp_path / "cp"), TEMPLATES["sme_assets"], max_files=1)
    rows = lambda df: sorted((r["dl_code"], r["AS2"] or "", r["AS3"] or "", r["_file_error"] or "") for r in df.collect())
    assert rows(spark.read.parquet(got)) == rows(tapes.read_tape(spark, str(folder), TEMPLATES["sme_assets"])) and len(seen) == 4
    assert rows(spark.read.parquet(got)) == [("A", "p", "1", ""), ("B", "q", "9", ""), ("C", "r", "", ""), ("E", "", "", "empty_file")]


def test_loads_of_collateral_and_amortisation(spark, tmp_path):
    coll = spark.createDataFrame([("D1", "2020-01-31", "c1", "l1", "1"), ("D1", "2020-01-31", "c1", "l1", "1")], "dl_code string, pcd string, CS1 string, CS2 string, CS3 string")
    none = lambda t: replace(t, rules={})
    load_tape(coll.withColumn("filename", F.lit("f")), none(TEMPLATES["sme_collateral"]), str(tmp_path / "c"), "2025-01-01")
    assert [(r["CS1"], r["CS2"]) for r in read_snapshot(spark, str(tmp_path / "c/silver/collateral")).collect()] == [("c1", "l1")]
    amort = spark.createDataFrame([("D1", "2020-01-31", "l1", "10.5", "2021-01-31", "5", "2022-01-31")], "dl_code string, pcd string, AS3 string, AS150 string, AS151 string, AS152 string, AS153 string")
    load_tape(amort, none(TEMPLATES["sme_amortisation"]), str(tmp_path / "a"), "2025-01-01")
    got = read_snapshot(spark, str(tmp_path / "a/silver/amortisation"))
    assert sorted((str(r["DATE_VALUE"]), r["DOUBLE_VALUE"]) for r in got.collect()) == [("2021-01-31", 10.5), ("2022-01-31", 5.0)]


def test_mixed_headers_are_written_by_as_many_tasks_as_the_table_has(spark, tmp_path):
    from verification.tape_queries import _mixed_headers

    spark.range(0, 400, 1, 12).selectExpr(
        "id l_orderkey", "id % 60 l_partkey", "id % 10 l_suppkey", "CAST(id % 7 + 1 AS INT) l_linenumber", "2.0D l_quantity", "3.5D l_extendedprice", "0.1D l_discount",
        "0.02D l_tax", "substr('RAN', CAST(id % 3 + 1 AS INT), 1) l_returnflag", "'O' l_linestatus", "DATE '1996-03-05' l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 2
    got = _mixed_headers(spark, str(tmp_path))
    assert got.count() == 400 and len(got.inputFiles()) > 4


def test_rows_told_by_a_digest_are_those_that_grouping_tells(spark):
    rows = [("a", None, 0.0, 1), (None, "a", -0.0, 1), ("a", None, -0.0, 1), ("1:a", "", 2.5, None), ("1:a", None, 2.5, None), ("1:a", "", 2.5, None),
            ("a~", "b", float("nan"), 2), ("a", "~b", float("nan"), 2), ("a", "~b", float("nan"), 2), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, v double, n int")
    told = lambda d: sorted(map(str, d.collect()))
    plain = told(df.dropDuplicates())
    assert len(plain) == 7
    for lead, together in (((), False), (("x",), False), (("x", "n"), True)):
        assert told(S.distinct_dimension(df, lead, together)) == plain
    nested = df.select(F.array("x").alias("a"), "n")  # without an exact text: compared as it is
    assert told(S.distinct_dimension(nested, ("n",))) == told(nested.dropDuplicates())


def test_counting_distinct_rows_shuffles_no_whole_rows(spark):
    df = spark.range(10).select(*[F.concat(F.lit(f"c{i}-"), F.col("id").cast("string")).alias(f"c{i}") for i in range(20)])
    plan = S.distinct_dimension(df, ["c0"]).groupBy("c0").count()._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("c7#" in line for line in exchanged) and "keys=[c0#" in plan and "c7#" not in plan.split("HashAggregate")[1]


def _shuffled(monkeypatch, write):
    """Hints that ``write`` puts on DataFrames."""
    from pyspark.sql.classic.dataframe import DataFrame as Rows
    hints, hint = [], Rows.hint
    monkeypatch.setattr(Rows, "hint", lambda df, name, *cols: hints.append((len(df.columns), name)) or hint(df, name, *cols))
    write()
    return hints


def test_quarantine_is_written_where_its_rows_are(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(str(i), str(i - 5), f"f{i % 3}.csv") for i in range(20)], "AS2 string, AS3 string, filename string")
    clean, dirty = V.split_clean_dirty(V.validate(df, RULES, "2025-01-01"))
    assert _shuffled(monkeypatch, lambda: sinks.write_quarantine(clean, dirty, f"{tmp_path}/q")) == []
    sides = {x: sinks.read_quarantine(spark, f"{tmp_path}/q", x).count() for x in ("clean", "dirty")}
    assert sides == {"clean": 15, "dirty": 5}


def test_bronze_gathers_rows_before_it_adds_columns(spark, tmp_path, monkeypatch):
    rows = [(f"D{i % 2}", "2020-01-31" if i % 3 else None, str(i), "x") for i in range(12)]
    df = spark.createDataFrame(rows, "dl_code string, pcd string, AS3 string, AS4 string")
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    make = lambda **more: B.to_bronze(df, ["AS3"], recorded="2020-02-01", **more)
    sinks.write_bronze(make(), one)
    assert _shuffled(monkeypatch, lambda: sinks.write_bronze(make(gather=True), two, gather=False)) == [(5, "rebalance")]
    a, b = (sorted(map(str, spark.read.parquet(p).collect())) for p in (one, two))
    assert a == b and len(a) == 12


def test_distinct_rows_in_ranges_are_shuffled_once(spark, tmp_path):
    rows = [(y, m, x, z) for y in (2019, 2020, None) for m in (1, 2, None) for x in ("a", None) for z in (0.0, -0.0, None)]
    df = spark.createDataFrame(rows * 3, "pcd_year int, pcd_month int, AS1 string, AS2 double")
    one = S.distinct_dimension(df, ranges=("pcd_year", "pcd_month"))
    key = lambda d: sorted(map(str, (r.asDict() for r in d.withColumn("AS2", F.col("AS2") + 0.0).collect())))
    assert key(one) == key(df.dropDuplicates()) and one.columns == df.columns and one.count() == 36
    assert one._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    for replace_ in (False, True):
        sinks.write_silver(one, str(tmp_path / "t"), replace=replace_, gather=False)
    assert key(spark.read.parquet(str(tmp_path / "t")).select(*df.columns)) == key(df.dropDuplicates())


def test_all_pairs_compare_only_rows_that_share_their_ids(spark):
    rows = [("L1", 1.0, "2020-01-01", 1.0, "2020-02-01"), ("L2", 1.0, "2020-01-01", 2.0, None), ("L2", 2.0, "2020-01-01", 3.0, "2020-02-01"),
            (None, 0.0, "2020-01-01", -0.0, "2020-01-01"), (None, -0.0, "2020-01-01", None, None), ("L3", None, "2020-01-01", None, None)]
    df = spark.createDataFrame(rows, "AS3 string, AS150 double, AS151 string, AS152 double, AS153 string")
    want = {(i, str(d), b + 0.0) for i, b1, d1, b2, d2 in rows for b in (b1, b2) for d in (d1, d2) if b is not None and d is not None}
    long = S.amortisation_long(df, "all")
    assert sorted(map(str, ((r[0], str(r[1]), r[2] + 0.0) for r in long.collect()))) == sorted(map(str, want))
    alone = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in alone and alone.count("Aggregate") == 1


@pytest.mark.parametrize("opens", [True, False])
def test_starts_of_files_are_copied_in_pieces(spark, tmp_path, monkeypatch, opens):
    """Halves, a whole file and nothing, of files longer than a piece; by tasks, or by the driver where Python cannot open the store."""
    monkeypatch.setattr(tapes, "_opens", lambda path: opens)
    data = bytes(range(256)) * (3 * tapes.BLOCK // 256) + b"end"
    files = []
    for name, size in (("half.gz", len(data) // 2), ("whole.gz", len(data)), ("none.gz", 0)):
        (tmp_path / name).write_bytes(data)
        files.append((f"file:{tmp_path}/{name}", f"{tmp_path}/cut-{name}", size))
    tapes.copy_starts(spark, files)
    for _, target, size in files:
        with open(target, "rb") as f:
            assert f.read() == data[:size]


def test_failing_files_hold_no_content_in_rows(spark, monkeypatch, tmp_path):
    """The cut copies of ``val5_file_failures`` are made without reading a file into a row."""
    made = []
    copy = tapes.copy_starts
    monkeypatch.setattr(tapes, "copy_starts", lambda s, files: made.extend(files) or copy(s, files))
    li = [(i, 1, i % 10, i % 7 + 1, 1.0, 2.0, 0.0, 0.0, "N", "O", datetime.date(1998, 1, 1)) for i in range(1000)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(li, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["kind"], r["reason"]): r["n"] for r in tape_queries.QUERIES["val5_file_failures"](spark, str(tmp_path)).collect()}
    assert got == {("whole", None): 1000, ("cut", "unreadable_file"): 3, ("empty", "empty_file"): 1}
    assert len(made) == 3 and all(size > 0 for _, _, size in made)


def test_quarantine_in_one_pass(spark, tmp_path):
    """``sides`` has the rows of ``split_clean_dirty``, file errors and lacking keys included; with it rows are evaluated once."""
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    rows = [("2020-01-31", "a", "D1", "f1", None), ("2020-01-31", None, "D1", "f1", None), ("2020-13", "b", "D2", "f2", None), ("2020-01-31", "c", None, "f2", None),
            (None, None, None, "f3", "empty_file")]
    raw = spark.createDataFrame(rows, f"AS1 string, AS2 string, dl_code string, filename string, {V.FILE_ERROR} string").withColumn(V.FIELDS, F.array(F.lit("AS1"), F.lit("AS2")))
    annotated = V.validate(raw, {c: RULES[c] for c in ("AS1", "AS2")}, "2025-01-01")
    clean, dirty = V.split_clean_dirty(annotated, ["dl_code"])
    both = V.sides(annotated, ["dl_code"])
    key = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert key(both.where("side = 'clean'").select(*clean.columns)) == key(clean) and clean.count() == 1
    assert key(both.where("side = 'dirty'").drop("side")) == key(dirty) and dirty.count() == 4
    assert both.where("side = 'clean'").where(F.col(V.ERRORS).isNotNull()).count() == 0
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    sinks.write_quarantine(clean, dirty, one)
    looked = annotated.withColumn("AS2", look("AS2"))
    load = sinks.write_quarantine(*V.split_clean_dirty(looked, ["dl_code"]), two, V.sides(looked, ["dl_code"]))
    assert seen.value == len(rows)
    for side in ("clean", "dirty"):
        a, b = (sinks.read_quarantine(spark, p, side) for p in (one, two))
        assert key(a) == key(b) and a.columns == b.columns
    # a later load of the file takes its place; what the first one wrote can still be read by its name
    sinks.write_quarantine(clean.limit(0), dirty.withColumn("filename", F.lit("f1")), two)
    assert sinks.read_quarantine(spark, two, "clean").count() == 0
    assert key(sinks.read_clean(spark, two, load, clean.schema)) == key(clean)
    assert sinks.read_clean(spark, two, snapshots.new_load(), clean.schema).count() == 0


def test_few_sides_are_written_without_a_sort(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    df = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("filename"), F.when(F.col("id") % 2 == 0, "clean").otherwise("dirty").alias("side"), "id")
    with snapshots._open_writers(spark, 4):
        assert int(spark.conf.get(name)) >= 4
    replace_units(df.coalesce(1), f"{tmp_path}/t", ["filename"], ["side"], gather=False)
    assert spark.conf.get(name) == before
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    written_ = [store.apply(i).physicalPlanDescription() for i in range(store.size())]
    mine = [p for p in written_ if f"{tmp_path}/t/data" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert mine and all("Sort" not in p for p in mine)
    assert read_snapshot(spark, f"{tmp_path}/t").count() == 1000


def test_load_stages_no_copy_of_the_annotated_tape(spark, tmp_path, monkeypatch):
    """The quarantine is the only copy of all rows: bronze starts from its clean side."""
    from loantide import session

    names, path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: names.append(name) or path(s, name))
    rows = [("D1", "2020-01-31", "2020-01-31", f"L{i}") for i in range(4)] + [("D1", "2020-01-31", "2020-13", "L9")]
    load_tape(spark.createDataFrame(rows, "dl_code string, pcd string, AS1 string, AS3 string"), TEMPLATES["sme_assets"], str(tmp_path), "2025-01-01")
    assert names == ["touched"]
    assert sinks.read_quarantine(spark, f"{tmp_path}/quarantine", "clean").count() == 4
    assert sinks.read_quarantine(spark, f"{tmp_path}/quarantine", "dirty").count() == 1
    assert read_snapshot(spark, f"{tmp_path}/bronze").count() == 4
