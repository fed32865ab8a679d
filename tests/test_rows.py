"""Facilities, real estate, filters and scalar helpers: golden values."""

import datetime

import pytest
from pyspark.sql import functions as F

from loantide.functions import buckets, dates, loanmath
from loantide.operators import catalog as C, cre, facilities as D

FIELDS = "facility_id sponsor country report_date gross_revenue_eur energy_cost_eur opex_eur debt_service_eur market_value_eur outstanding_debt_eur it_load_mw leased_capacity_mw".split()


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_quality_report(spark):
    rows = [("f1", "s", "NL", "2020-06-30", "10", "1", "1", "1", "10", "5", "1", "1"),
            ("", "s", "NL", "2020-13-01", "abc", "1", "1", "-1", "10", "5", "1", "1")]
    r = D.quality_report(frame(spark, rows, FIELDS)).first()
    assert (r.row_count, r.missing_key_identifiers, r.missing_critical_fields, r.invalid_dates, r.invalid_numeric_values, r.suspicious_values) == (2, 1, 1, 1, 1, 1)
    assert r.overall_quality_score == 75.0


def test_facility_rollup_and_empty_dashboard(spark):
    rows = [("f1", "s", "NL", "d", "100", "20", "20", "40", "100", "75", "10", "9"), ("f2", "s", "NL", "d", "x", "1", "1", "1", "1", "1", "1", "1")]
    silver = D.dc_silver(D.dc_bronze(frame(spark, rows, FIELDS), "t"))
    r = D.sponsor_rollup(silver).first()
    assert (r.facility_count, r.avg_dscr, r.avg_ltv_pct, r.avg_occupancy_pct, r.watch_count, r.breach_count) == (1, 1.5, 75.0, 90.0, 1, 0)
    assert D.portfolio_dashboard(silver.limit(0), "d").first().avg_dscr is None


def test_real_estate_golden(spark):
    names = ["CREL1", "CREL4", "CREL5", "CREL32", "CREL41", "CREL44", "CREL59"]
    rows = [("deal-a", "loan-a", "loan-a", "1500000", "1000000", "1.4", "95"), ("deal-b", "loan-b", "", "1000000", "-500", "abc", "120"),
            ("deal-c", "", "", "", "500", "1.1", "50")]
    out = cre.cre_validate(cre.cre_normalise(frame(spark, rows, names)))
    r = cre.cre_summary(out).first()
    assert (r.valid_record_count, r.invalid_record_count, r.rows_missing_primary_identifiers) == (1, 2, 1)
    assert [r[n] for n in cre.RULES] == [1, 1, 1, 1]


TABLE = {"AS3": C.ColumnInfo("STRING"), "AS15": C.ColumnInfo("STRING"), "AS26": C.ColumnInfo("STRING"), "AS17": C.ColumnInfo("STRING", False),
         "DOUBLE_VALUE": C.ColumnInfo("FLOAT"), "DATE_VALUE": C.ColumnInfo("DATE"), "flag": C.ColumnInfo("BOOLEAN"), "n": C.ColumnInfo("INTEGER")}


@pytest.mark.parametrize("text,ids", [
    ("AS15:pl", [1, 3]),
    ("-as15:pl and AS26:3", [2]),
    ("AS3~%test%", [2]),
    ("DOUBLE_VALUE>=1.5", [2, 3]),
    ("DATE_VALUE:2023-01-15 or n<2", [1]),
    ("AS15:pl or AS26:3 and n>5", [1, 3]),
    ("flag:true", [1]),
])
def test_filters(spark, text, ids):
    d = datetime.date
    df = spark.createDataFrame([(1, "a", "PL", "1", 0.5, d(2023, 1, 15), True, 1), (2, "myTest", "NL", "3", 1.5, d(2023, 2, 1), False, 2),
                                (3, "c", "PL", "3", 2.5, d(2023, 3, 1), False, 3)],
                               "id int, AS3 string, AS15 string, AS26 string, DOUBLE_VALUE double, DATE_VALUE date, flag boolean, n int")
    assert [r.id for r in C.filter_table(df, TABLE, text).orderBy("id").collect()] == ids


@pytest.mark.parametrize("text", ["AS15:pl and", "and AS15:pl", "AS15pl", "NONEXISTENT:val", "AS17:val", "AS15>val", "DATE_VALUE:x", "n:1.5", "flag>true"])
def test_wrong_filters(spark, text):
    df = spark.createDataFrame([], "AS15 string")
    with pytest.raises(C.FilterError):
        C.filter_table(df, TABLE, text)


def test_projection_and_catalog():
    with pytest.raises(C.FilterError):
        C.table_of({"sme": {}}, "sme", "loans")
    with pytest.raises(C.FilterError):
        C.select_cols(None, TABLE, "as3")


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("x,want", [(0, "<100k"), (100000, "<100k"), (100000.01, "100k-150k"), (600000, "550k-600k"), (600001, "600k+"), (-1, None), (None, None)])
def test_balance_bucket_edges(spark, x, want):
    assert value(spark, buckets.balance_bucket(F.lit(x).cast("double"))) == want


@pytest.mark.parametrize("text,want", [("2020", "2020-01-01"), ("2020-11", "2020-11-01"), ("2020-11-30", "2020-11-30"), ("2020-13", None), ("20201", None),
                                       ("2020-11-30T00:00:00", None), ("abc", None), ("", None)])
def test_flexible_dates(spark, text, want):
    v = value(spark, dates.coerce_date(F.lit(text)))
    assert (str(v) if v else None) == want


def test_amortisation_step_agrees_with_closed_form(spark):
    p, r, n, io = F.lit(200000.0), F.lit(3.0), F.lit(360), F.lit("N")
    pay = loanmath.scheduled_payment(p, r, n, io)
    step = loanmath.next_balance(p, r, pay, io, F.lit("Performing"))
    assert value(spark, F.abs(step - loanmath.annuity_balance(p, r, n, F.lit(1), io))) < 1e-6
    assert value(spark, loanmath.next_balance(p, r, pay, io, F.lit("90+ DPD"))) == 200000.0
    assert value(spark, loanmath.next_balance(p, r, pay, io, F.lit("Redeemed"))) == 0.0


def test_validate_splits_methods_that_the_jvm_does_not_compile(spark):
    from loantide.operators.validate import validate
    from loantide.session import METHOD_LIMIT
    from loantide.templates.rules import Rule

    tape = spark.createDataFrame([("x",), (None,)], "A1 string")
    rules = {"A1": Rule("A1", "string", False)}
    before = spark.conf.get(METHOD_LIMIT)
    try:
        for named, used in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(METHOD_LIMIT, named)
            assert [r.qc_ok for r in validate(tape, rules, "2000-01-01").orderBy("A1").collect()] == [False, True]
            assert spark.conf.get(METHOD_LIMIT) == used
    finally:
        spark.conf.set(METHOD_LIMIT, before)
