"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. The panel is written once to the
shared folder, as a consolidated panel is in practice, and the sections read that table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loantide.operators import checks as K, panels as G, sequences as S  # noqa: E402
from loantide.plans.portfolio_report import portfolio_report  # noqa: E402
from loantide.session import local_session, scratch_path  # noqa: E402
from verification.bindings import FIRST, LAST, panel  # noqa: E402
from verification.history_queries import AS_OF, EXPECT  # noqa: E402
from verification.registry import queries  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
# registered queries timed from the raw tables
DIRECT = ["val1_validate_error_counts", "prj1_project_topics", "jon6_loan_star", "rsh2_amortisation_period", "agg21_sponsor_rollup",
          "met1_met2_met5_rank_metrics", "flt1_filter_table_3", "snk2_merge_bronze_table"]


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(os.environ.get("BENCH_PARTITIONS", cores)))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        t0 = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - t0, 3)

    given = os.environ.get("BENCH_PANEL")
    path = given or scratch_path(spark, "panel")
    if not given:
        timed("panel_write", lambda: panel(spark, SF).write.parquet(path))
    p = spark.read.parquet(path)
    sections: dict = {}
    timed("report_00_shared_tables", lambda: sections.update(portfolio_report(p, FIRST, LAST)))
    for name, df in sections.items():
        timed(f"report_{name}", lambda: force(df))
    report = sum(v for k, v in times.items() if k.startswith("report_"))
    timed("panel_checks_53", lambda: force(K.run_panel_checks(p, EXPECT)))
    static, dynamic = G.split_panel(p)
    gold = G.gold_features(static, dynamic)
    timed("gold_features", lambda: force(gold))
    timed("gold_checks_18", lambda: force(K.run_gold_checks(static, dynamic, gold, AS_OF)))
    timed("sequences", lambda: force(S.build_sequences(dynamic, S.bin_edges(S.fit_bins(dynamic)))))
    if not given:
        for name in DIRECT:
            timed(name, lambda: force(queries()[name](spark, SF)))
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "report_total": round(report, 3), "panel_rows": p.count(), "cores": cores, "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
