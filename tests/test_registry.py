"""The registered queries: names, SQL and a sample run on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["agg13_pool_dynamics", "val10_panel_checks", "fea1_gold_features", "seq5_build_sequences", "scd2_merge", "met1_rank_metrics_by_slice",
          "prj2_bond_topics", "agg21_sponsor_rollup"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")
def test_report_sections_equal_the_single_operators(spark):
    from loantide.operators import portfolio as P
    from loantide.plans.portfolio_report import portfolio_report
    from loantide.session import written
    from verification.bindings import FIRST, LAST, panel
    from verification.shape import plain

    p = written(panel(spark, SF), "panel")
    report = portfolio_report(p, FIRST, LAST)
    single = {
        "01_pool_overview": P.pool_overview(p, FIRST, LAST), "02_monthly_composition": P.monthly_composition(p),
        "08_arrears_trajectory": P.arrears_trajectory(p), "11_exit_accounting": P.exit_accounting(p, FIRST, LAST),
        "12_headline_rates": P.headline_rates(p, FIRST, LAST), "13_delinquency_rates": P.delinquency_rates(p),
        "14_compliance": P.compliance(p), "15_pool_dynamics": P.pool_dynamics(p),
        "17_vintage_outcomes": P.vintage_outcomes(p), "19_loss_given_default": P.lgd(p),
    }
    for name, df in single.items():
        a, b = plain(report[name]), plain(df)
        assert sorted(a.columns) == sorted(b.columns), name
        assert rows_of(a.columns, [tuple(r) for r in a.collect()]) == rows_of(b.columns, [tuple(r) for r in b.collect()]), name


@pytest.mark.parametrize("absent", ["loantide.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_entry_without_the_optional_part(absent):
    """The other queries are there whichever part or library of the optional operators is absent."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, optional = out.stdout.split()
    assert int(n) > 190 and optional == "False"
