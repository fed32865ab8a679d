"""Tape side: sources, validation, silver, bronze history, facilities, real estate, filters, BI."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.functions import codes, dates, loanmath, states, text
from loantide.functions.nulls import fill_missing, first_non_empty, safe_ratio
from loantide.operators import bi, bronze as B, catalog as C, cre, facilities as D, silver as S, validate as V
from loantide.operators.panels import explode_embedding, pack_embedding, with_embeddings
from loantide.plans.tape_load import load_tape
from loantide.session import scratch_path, written
from loantide.sources import deals, sinks, tapes
from loantide.sources.snapshots import read_snapshot
from loantide.streaming import tapes as stream
from loantide.templates import TEMPLATES
from verification.bindings import PANEL_SQL, panel, table
from verification.shape import plain

SME = TEMPLATES["sme_assets"]
AS_OF = "2000-01-01"
QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = lambda spark, sf: plain(fn(spark, sf), digits)
    if sql is not None:
        ORACLE[name] = sql


n = F.count


def _count(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# ---- the tape: line items as text fields ------------------------------------------------------

_TAPE = {
    "dl_code": "'DEAL' || CAST(l_suppkey % 5 AS STRING)",
    "pcd": "CAST(last_day(CAST(l_shipdate AS DATE)) AS STRING)",
    "AS1": "CASE WHEN l_linenumber = 7 AND l_partkey % 50 = 1 THEN '1998-13' WHEN l_linenumber = 1 THEN substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 4)"
           " WHEN l_linenumber = 2 THEN substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) ELSE CAST(last_day(CAST(l_shipdate AS DATE)) AS STRING) END",
    "AS2": "'POOL' || CAST(l_suppkey % 5 AS STRING)",
    "AS3": "'L' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "AS4": "'Originator A'",
    "AS5": "'S1'",
    "AS6": "'Servicer A'",
    "AS7": "'B' || CAST(l_partkey AS STRING)",
    "AS8": "CASE l_returnflag WHEN 'R' THEN 'NDB Bank' WHEN 'A' THEN 'ND2' ELSE 'Group' END",
    "AS15": "'NL'",
    "AS16": "CASE WHEN l_partkey % 100 = 0 THEN '' ELSE '1000AA' END",
    "AS18": "CAST(l_suppkey % 7 AS STRING)",
    "AS20": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "AS23": "CASE WHEN l_returnflag = 'N' THEN 'Y' WHEN l_returnflag = 'A' THEN 'N' WHEN l_linenumber % 2 = 0 THEN 'y' ELSE 'ND' END",
    "AS25": "CAST(l_linenumber AS STRING)",
    "AS26": "CAST(l_linenumber AS STRING)",
    "AS27": "CASE WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN 'abc' WHEN l_linenumber = 6 THEN '-1' ELSE CAST(l_quantity AS STRING) END",
    "AS37": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_extendedprice AS STRING) END",
    "AS42": "'N' || CAST(l_suppkey % 10 AS STRING)",
    "AS50": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "AS51": "CASE WHEN l_partkey % 40 = 0 THEN 'ND3' ELSE '1994-06-30' END",
    "AS52": "'EUR'",
    "AS53": "CASE l_linestatus WHEN 'O' THEN 'Y' ELSE 'N' END",
    "AS54": "CAST(l_extendedprice AS STRING)",
    "AS55": "CAST(l_quantity AS STRING)",
    "AS56": "CAST(l_tax AS STRING)",
    "AS57": "CAST(l_linenumber + l_suppkey % 10 AS STRING)",
    "AS58": "CAST(l_linenumber AS STRING)",
    "AS62": "CAST(l_linenumber AS STRING)",
    "AS65": "CAST(l_linenumber % 4 AS STRING)",
    "AS80": "CAST(l_discount AS STRING)",
    "AS83": "CAST(l_linenumber AS STRING)",
    "AS84": "CAST(l_linenumber AS STRING)",
    "AS85": "CAST(l_tax AS STRING)",
    "AS94": "CAST(l_linenumber AS STRING)",
    "AS100": "CAST(l_extendedprice AS STRING)",
    "AS111": "'text'",
    "AS115": "CAST(l_quantity AS STRING)",
    "AS116": "CAST(l_discount AS STRING)",
    "AS121": "CASE l_linestatus WHEN 'O' THEN 'Y' ELSE 'ND' END",
    "AS123": "CAST(l_linenumber AS STRING)",
    "AS129": "CAST(l_linenumber AS STRING)",
}
TAPE_FIELDS = [c for c in _TAPE if c.startswith("AS")]
TAPE_SQL = "WITH tape AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _TAPE.items()) + " FROM lineitem)"


def tape(spark, sf):
    return table(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for c, e in _TAPE.items()])


def _nb(c):
    return f"CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '^ND[0-9]?$') THEN {c} END"


def _num(c):
    return f"TRY_CAST({_nb(c)} AS DOUBLE)"


def _allowed(c, hi):
    return f"{_nb(c)} NOT IN ({', '.join(repr(str(i)) for i in range(1, hi + 1))})"


_DATE1 = "TRY_CAST(CASE length(AS1) WHEN 4 THEN AS1 || '-01-01' WHEN 7 THEN AS1 || '-01' ELSE AS1 END AS DATE)"
# (field, reason, condition) of every rule that this tape can break.
TAPE_ERRORS = [
    ("AS1", "not_a_date", f"{_DATE1} IS NULL"),
    ("AS1", "below_min", f"{_DATE1} < DATE '2012-01-01'"),
    ("AS16", "null_not_allowed", f"{_nb('AS16')} IS NULL"),
    ("AS18", "unallowed_value", _allowed("AS18", 5)),
    ("AS20", "above_max", f"CAST(AS20 AS DATE) > DATE '{AS_OF}'"),
    ("AS23", "unallowed_value", f"{_nb('AS23')} NOT IN ('Y', 'N')"),
    ("AS26", "unallowed_value", _allowed("AS26", 5)),
    ("AS27", "not_a_number", f"{_nb('AS27')} IS NOT NULL AND {_num('AS27')} IS NULL"),
    ("AS27", "below_min", f"{_num('AS27')} < 0"),
    ("AS37", "null_not_allowed", "AS37 IS NULL"),
    ("AS50", "above_max", f"CAST(AS50 AS DATE) > DATE '{AS_OF}'"),
    ("AS51", "null_not_allowed", f"{_nb('AS51')} IS NULL"),
    ("AS57", "unallowed_value", _allowed("AS57", 13)),
    ("AS58", "unallowed_value", _allowed("AS58", 6)),
    ("AS65", "unallowed_value", _allowed("AS65", 3)),
    ("AS94", "unallowed_value", _allowed("AS94", 6)),
    ("AS123", "unallowed_value", _allowed("AS123", 4)),
    ("AS129", "unallowed_value", _allowed("AS129", 6)),
    ("XX1", "unknown_field", "true"),
]


def validated(spark, sf, extra=False, tape_=None):
    t = tape(spark, sf) if tape_ is None else tape_
    return V.validate(t.withColumn("XX1", F.lit("x")) if extra else t, SME.rules, AS_OF)


add("val1_validate_error_counts", lambda s, f: V.error_counts(validated(s, f, True)),
    TAPE_SQL + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS field, '{r}' AS reason, count(*) AS n FROM tape WHERE {c}" for a, r, c in TAPE_ERRORS) + ") WHERE n > 0")


def _fixed_dates(df):
    """The tape with its cut-off years moved into the allowed range."""
    return df.withColumn("AS1", F.regexp_replace("AS1", "^(199|200)", "201")).withColumn("AS1", F.regexp_replace("AS1", "^201([01])", "202$1"))


_FIXED = "regexp_replace(regexp_replace(AS1, '^(199|200)', '201'), '^201([01])', '202\\1')"
_DATE1F = f"TRY_CAST(CASE length({_FIXED}) WHEN 4 THEN {_FIXED} || '-01-01' WHEN 7 THEN {_FIXED} || '-01' ELSE {_FIXED} END AS DATE)"
_ROW_ERRORS = [(a, r, c) for a, r, c in TAPE_ERRORS if a not in ("XX1", "AS1")] + [
    ("AS1", "not_a_date", f"{_DATE1F} IS NULL"), ("AS1", "below_min", f"{_DATE1F} < DATE '2012-01-01'"),
    ("AS1", "above_max", f"{_DATE1F} > DATE '2030-12-31'")]
_ERR_N = " + ".join(f"coalesce(CAST({c} AS INTEGER), 0)" for _, _, c in _ROW_ERRORS)


def _clean_dirty(s, f):
    clean, dirty = V.split_clean_dirty(validated(s, f, tape_=_fixed_dates(tape(s, f))))
    a = _count(clean.withColumn("side", F.lit("clean")), "side", "dl_code")
    b = _count(dirty.withColumn("side", F.lit("dirty")), "side", "dl_code")
    return a.unionByName(b)


add("snk4_split_clean_dirty", _clean_dirty, TAPE_SQL + f"""
SELECT CASE WHEN {_ERR_N} = 0 THEN 'clean' ELSE 'dirty' END AS side, dl_code, count(*) AS n FROM tape GROUP BY ALL""")
add("val1_errors_per_row", lambda s, f: _count(validated(s, f, tape_=_fixed_dates(tape(s, f))).select(F.size("qc_errors").alias("n_errors")), "n_errors"),
    TAPE_SQL + f"SELECT CAST({_ERR_N} AS BIGINT) AS n_errors, count(*) AS n FROM tape GROUP BY ALL")


# Tapes of other classes, with the kinds of rules that the first one lacks: field, its text, and (reason, condition) of the rules it can break.
_CLASS_TAPES = {
    "esma_auto": [
        ("AUTL1", "CASE WHEN l_linenumber = 7 THEN repeat('x', 30) ELSE 'L' || CAST(l_orderkey AS STRING) END", [("too_long", "l_linenumber = 7")]),
        ("AUTL6", "CASE WHEN l_linenumber = 6 THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END", [("not_a_date", "l_linenumber = 6")]),
        ("AUTL11", "CASE WHEN l_linenumber = 1 THEN '12' WHEN l_linenumber = 2 THEN 'ND1' ELSE '1999' END", [("regex_mismatch", "l_linenumber = 1")]),
        ("AUTL13", "l_returnflag", [("unallowed_value", "l_returnflag <> 'N'")]),
        ("AUTL26", "CASE WHEN l_linenumber = 2 THEN '1.5' ELSE CAST(l_orderkey AS STRING) END",
         [("not_an_integer", "l_linenumber = 2"), ("above_max", "l_linenumber <> 2 AND l_orderkey > 9999")]),
        ("AUTL48", "CAST(l_linenumber * 20 AS STRING)", [("above_max", "l_linenumber > 5")]),
        ("AUTL69", "CASE WHEN l_linenumber <> 3 THEN '5' END", [("null_not_allowed", "l_linenumber = 3")]),
        ("AUTL70", "CASE WHEN l_linestatus = 'O' THEN 'GONE' ELSE 'PERF' END", [("unallowed_value", "l_linestatus = 'O'")]),
    ],
    "consumer_assets": [
        ("AN1", "CASE WHEN l_linenumber = 7 THEN '2031-01-31' WHEN l_linenumber = 6 THEN '2011' ELSE '2020-06' END",
         [("above_max", "l_linenumber = 7"), ("below_min", "l_linenumber = 6")]),
        ("AN7", "CASE WHEN l_linenumber = 1 THEN 'X' WHEN l_linenumber = 2 THEN 'ND' ELSE 'Y' END", [("unallowed_value", "l_linenumber = 1")]),
        ("AN16", "CAST(l_suppkey % 12 AS STRING)", [("unallowed_value", "l_suppkey % 12 > 9")]),
        ("AN19", "CAST(l_linenumber AS STRING)", [("unallowed_value", "l_linenumber > 6")]),
        ("AN26", "CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS STRING) END", [("null_not_allowed", "l_linenumber = 4")]),
        ("AN28", "CAST(l_linenumber + 2 AS STRING)", [("unallowed_value", "l_linenumber > 6")]),
        ("AN51", "CAST(CAST(l_shipdate AS DATE) AS STRING)", [("below_min", "true")]),
    ],
}


def _class_errors(cls):
    def run(s, f):
        t = table(s, f, "lineitem").select(*[F.expr(e).alias(c) for c, e, _ in _CLASS_TAPES[cls]])
        return V.error_counts(V.validate(t, TEMPLATES[cls].rules, AS_OF))
    return run


for _cls, _fields in _CLASS_TAPES.items():
    add(f"val1_{_cls}_error_counts", _class_errors(_cls), "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, '{r}' AS reason, count(*) AS n FROM lineitem WHERE {cond}" for c, _, broken in _fields for r, cond in broken) + ") WHERE n > 0")


def _class_silver(s, f):
    """Two of the three classes through their silver types: consumer flags and numbers, lease flags that stay text."""
    parts = []
    for cls, cols in (("consumer_assets", ("AN7", "AN26")), ("esma_auto", ("AUTL13", "AUTL48"))):
        t = table(s, f, "lineitem").select(*[F.expr(e).alias(c) for c, e, _ in _CLASS_TAPES[cls] if c in cols])
        d = S.clean(t, TEMPLATES[cls])
        parts.append(d.groupBy(F.lit(cls).alias("class"), F.col(cols[0]).cast("string").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum(cols[1]).alias("amount")))
    return parts[0].unionByName(parts[1])


add("cln3_other_classes", _class_silver, """
SELECT 'consumer_assets' AS class, CASE l_linenumber WHEN 1 THEN 'false' WHEN 2 THEN NULL ELSE 'true' END AS flag, count(*) AS n,
  round(sum(CASE WHEN l_linenumber <> 4 THEN l_quantity END), 6) AS amount FROM lineitem GROUP BY ALL
UNION ALL SELECT 'esma_auto', l_returnflag, count(*), round(sum(l_linenumber * 20.0::DOUBLE), 6) FROM lineitem GROUP BY ALL""")
add("val2_null_blank", lambda s, f: tape(s, f).agg(*[
    F.count(V.null_blank(F.col(c), m)).alias(f"{c}_{m}".lower()) for c in ("AS8", "AS16", "AS51") for m in ("pattern", "prefix")]),
    TAPE_SQL + "SELECT " + ", ".join(
        f"count(CASE WHEN {c} <> '' AND NOT {cond.format(c)} THEN 1 END) AS {c.lower()}_{m}"
        for c in ("AS8", "AS16", "AS51")
        for m, cond in (("pattern", "regexp_matches({0}, '^ND[0-9]?$')"), ("prefix", "starts_with({0}, 'ND')"))) + " FROM tape")
add("val3_coercion", lambda s, f: tape(s, f).select(
        dates.coerce_date(F.col("AS1")).alias("d"), dates.coerce_number(F.col("AS27")).alias("v"), dates.coerce_integer(F.col("AS57")).alias("i")
    ).agg(F.count("d").alias("dates"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count("v").alias("numbers"),
          F.sum("v").alias("number_sum"), F.sum("i").alias("integer_sum")),
    TAPE_SQL + f"""SELECT count({_DATE1}) AS dates, CAST(min({_DATE1}) AS VARCHAR) AS first_date, CAST(max({_DATE1}) AS VARCHAR) AS last_date,
       count(TRY_CAST(AS27 AS DOUBLE)) AS numbers, round(sum(TRY_CAST(AS27 AS DOUBLE)), 6) AS number_sum, CAST(sum(CAST(AS57 AS INTEGER)) AS BIGINT) AS integer_sum FROM tape""")


def amortisation(spark, sf):
    """Amortisation fields per order: one period per line number."""
    li = table(spark, sf, "lineitem")
    aggs = []
    for p in range(1, 8):
        mine = F.col("l_linenumber") == p
        aggs.append(F.round(F.sum(F.when(mine, F.col("l_extendedprice"))), 2).alias(f"AS{148 + 2 * p}"))
        aggs.append(F.min(F.when(mine, F.col("l_shipdate").cast("date"))).alias(f"AS{149 + 2 * p}"))
    return li.groupBy(F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("AS3")).agg(*aggs)


_AMORT_SQL = """WITH a AS (SELECT 'L' || CAST(l_orderkey AS VARCHAR) AS AS3, l_linenumber AS p, round(sum(l_extendedprice), 2) AS b,
  min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY ALL)"""


def _val4(s, f):
    wide = amortisation(s, f)
    text_ = wide.select(*[F.col(c).cast("string").alias(c) for c in wide.columns])
    return V.error_counts(V.validate(text_, TEMPLATES["sme_amortisation"].rules, AS_OF))


add("val4_generated_rules", _val4, _AMORT_SQL + """, o AS (SELECT DISTINCT AS3 FROM a), p AS (SELECT * FROM o, range(1, 8) t(p))
SELECT 'AS' || CAST(148 + 2 * p.p AS VARCHAR) AS field, 'null_not_allowed' AS reason, count(*) AS n FROM p LEFT JOIN a USING (AS3, p) WHERE b IS NULL GROUP BY 1
UNION ALL SELECT 'AS' || CAST(149 + 2 * p.p AS VARCHAR), 'null_not_allowed', count(*) FROM p LEFT JOIN a USING (AS3, p) WHERE d IS NULL GROUP BY 1
UNION ALL SELECT 'AS' || CAST(149 + 2 * p AS VARCHAR), 'below_min', count(*) FROM a WHERE d < DATE '2012-01-01' GROUP BY 1""")
add("rsh2_amortisation_period", lambda s, f: S.amortisation_long(amortisation(s, f)),
    _AMORT_SQL + " SELECT DISTINCT AS3, CAST(d AS VARCHAR) AS DATE_VALUE, b AS DOUBLE_VALUE FROM a")
add("rsh2_amortisation_all_pairs", lambda s, f: S.amortisation_long(amortisation(s, f), "all"),
    _AMORT_SQL + " SELECT DISTINCT x.AS3, CAST(x.d AS VARCHAR) AS DATE_VALUE, y.b AS DOUBLE_VALUE FROM a x JOIN a y ON x.AS3 = y.AS3")
add("rsh1_melt", lambda s, f: (lambda m: m.groupBy("FEATURE_NAME").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("FEATURE_VALUE").alias("n_values")))(
        S.melt(S.null_nd(tape(s, f)), ["AS3"], ["AS8", "AS27", "AS37", "AS51"])),
    TAPE_SQL + " UNION ALL ".join(f"SELECT '{c}' AS FEATURE_NAME, count(v) AS n, count(DISTINCT v) AS n_values FROM (SELECT CASE WHEN NOT regexp_matches({c}, '^ND[0-9]?$') THEN {c} END AS v FROM tape) x "
                                   for c in ("AS8", "AS27", "AS37", "AS51")))
add("rsh6_field_length", lambda s, f: _count(S.field_length(tape(s, f).select("AS3", "AS8")).select("field_length"), "field_length"),
    TAPE_SQL + "SELECT CAST(length(AS3) AS BIGINT) AS field_length, count(*) AS n FROM tape GROUP BY 1")

# ---- silver -------------------------------------------------------------------------------------
add("cln1_null_nd", lambda s, f: _count(S.null_nd(tape(s, f)), "AS8", "AS23", "AS121"),
    TAPE_SQL + "SELECT " + ", ".join(f"CASE WHEN NOT regexp_matches({c}, '^ND[0-9]?$') THEN {c} END AS {c}" for c in ("AS8", "AS23", "AS121")) + ", count(*) AS n FROM tape GROUP BY ALL")
add("cln1_null_nd_prefix", lambda s, f: _count(S.null_nd(tape(s, f), "prefix"), "AS8"),
    TAPE_SQL + "SELECT CASE WHEN NOT starts_with(AS8, 'ND') THEN AS8 END AS AS8, count(*) AS n FROM tape GROUP BY 1")
for _ic in (False, True):
    add("cln2_flags_to_bool" + ("_ignore_case" if _ic else ""),
        lambda s, f, i=_ic: _count(S.flags_to_bool(S.null_nd(tape(s, f)), ["AS23", "AS53", "AS121"], i), "AS23", "AS53", "AS121"),
        TAPE_SQL + "SELECT " + ", ".join(
            f"CASE WHEN {c} IS NULL OR regexp_matches({c}, '^ND[0-9]?$') THEN NULL ELSE {'upper(' + c + ')' if _ic else c} = 'Y' END AS {c}"
            for c in ("AS23", "AS53", "AS121")) + ", count(*) AS n FROM tape GROUP BY ALL")
add("cln3_cast_types", lambda s, f: S.clean(tape(s, f), SME).agg(
        F.count("AS1").alias("dates"), F.min("AS1").alias("first_date"), F.sum("AS27").alias("as27"), F.sum("AS37").alias("as37"),
        F.sum("AS80").alias("as80"), F.count_if("AS53").alias("flags"), F.count("AS51").alias("as51")),
    TAPE_SQL + f"""SELECT count({_DATE1}) AS dates, CAST(min({_DATE1}) AS VARCHAR) AS first_date, round(sum(TRY_CAST(AS27 AS DOUBLE)), 2) AS as27,
       round(sum(CAST(AS37 AS DOUBLE)), 2) AS as37, round(sum(CAST(AS80 AS DOUBLE)), 2) AS as80, count(*) FILTER (WHERE AS53 = 'Y') AS flags,
       count({_nb('AS51')}) AS as51 FROM tape""", 2)


def _deal_rows(s, f):
    """Details per customer as text, each row twice; some amounts and terms are no numbers."""
    k = F.col("c_custkey")
    d = table(s, f, "customer").select(
        F.concat(F.lit("D"), k.cast("string")).alias("dl_code"), F.col("c_mktsegment").alias("Employment Status"),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("Primary Income"),
        F.when(k % 5 == 0, "12.5").otherwise((k % 360).cast("string")).alias("Original Term"))
    return d.unionByName(d)


add("cln3_deal_details", lambda s, f: S.deal_details(_deal_rows(s, f)), """
SELECT 'D' || CAST(c_custkey AS VARCHAR) AS dl_code, c_mktsegment AS "Employment Status", CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal, 2) END AS "Primary Income",
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 360 AS BIGINT) END AS "Original Term" FROM customer""")


def _bronze(s, f):
    return B.to_bronze(tape(s, f), ["dl_code", "AS3"])


def _topics(s, f, cleaned=True, lead=None, together=False, ranges=()):
    b = _bronze(s, f)
    return S.project_topics(S.clean(b, SME) if cleaned else b, SME, lead, together, ranges)


_YM = "year(CAST(pcd AS DATE)) AS y, month(CAST(pcd AS DATE)) AS m"
_TOPIC_COLS = {t: [f"AS{i}" for i in range(1, 15) if f"AS{i}" in _TAPE] + [f"AS{i}" for i in range(lo, hi + 1) if f"AS{i}" in _TAPE]
               for t, (lo, hi) in SME.topics.items()}


def _topic_counts(s, f):
    out = None
    for t, df in _topics(s, f, False, lead=()).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("topic"), F.lit(len(df.columns)).cast("long").alias("n_columns"), "n")
        out = part if out is None else out.unionByName(part)
    return out


add("prj1_project_topics", _topic_counts, TAPE_SQL + " UNION ALL ".join(
    f"SELECT '{t}' AS topic, CAST({len(cols) + 3} AS BIGINT) AS n_columns, (SELECT count(*) FROM (SELECT DISTINCT dl_code, {_YM}, {', '.join(cols)} FROM tape)) AS n"
    for t, cols in _TOPIC_COLS.items()))
add("prj1_interest_rate_topic", lambda s, f: _count(_topics(s, f)["interest_rate"], "dl_code", "pcd_year", "AS83", "AS80"),
    TAPE_SQL + f""", c AS (SELECT DISTINCT dl_code, {_YM}, {_DATE1}, AS2, AS3, AS4, AS5, AS6, AS7, CASE WHEN NOT regexp_matches(AS8, '^ND[0-9]?$') THEN AS8 END,
      round(CAST(AS80 AS DOUBLE), 2) AS AS80, AS83, AS84, CAST(AS85 AS DOUBLE), AS94 FROM tape)
SELECT dl_code, CAST(y AS BIGINT) AS pcd_year, AS83, AS80, count(*) AS n FROM c GROUP BY ALL""")


def bonds(spark, sf):
    """Bond rows per deal and month, from the line items."""
    li = table(spark, sf, "lineitem")
    m = F.last_day(F.col("l_shipdate").cast("date"))
    return li.groupBy(F.concat(F.lit("DEAL"), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("dl_code"), F.date_format(m, "yyyy-MM-dd").alias("BS1")).agg(
        F.lit("Issuer A").alias("BS2"), F.round(F.sum("l_quantity"), 2).cast("string").alias("BS3"),
        F.when(F.count(F.lit(1)) % 2 == 0, "Y").otherwise("N").alias("BS5"), F.min("l_discount").cast("string").alias("BS11"),
        F.when(F.count(F.lit(1)) % 3 == 0, "Y").otherwise("N").alias("BS12"), F.lit("Contact").alias("BS19"),
        F.max("l_tax").cast("string").alias("BS30"), F.lit("ND1").alias("BS25"),
    )


_BONDS_SQL = """WITH bonds AS (SELECT 'DEAL' || CAST(l_suppkey % 5 AS VARCHAR) AS dl_code, CAST(last_day(CAST(l_shipdate AS DATE)) AS VARCHAR) AS BS1,
  'Issuer A' AS BS2, round(sum(l_quantity), 2) AS BS3, count(*) % 2 = 0 AS BS5, min(l_discount) AS BS11, count(*) % 3 = 0 AS BS12, max(l_tax) AS BS30
  FROM lineitem GROUP BY 1, 2)"""


def _bond_topics(s, f):
    return S.project_topics(S.clean(bonds(s, f), TEMPLATES["sme_bonds"]), TEMPLATES["sme_bonds"])


add("prj2_bond_topics", lambda s, f: _bond_topics(s, f)["bond_info"], _BONDS_SQL + " SELECT DISTINCT dl_code, BS1, BS2, BS3, BS5 FROM bonds", 4)
add("jon7_bond_star", lambda s, f: (lambda t: bi.bond_star(t["bond_info"], t["collateral_info"], t["tranche_info"]))(_bond_topics(s, f)),
    _BONDS_SQL + " SELECT dl_code, BS1, BS2, BS3, BS5, BS11, BS12, CAST(NULL AS VARCHAR) AS BS25, BS30 FROM bonds", 4)
add("fn17_bond_key", lambda s, f: bi.bond_key(bonds(s, f)).select("dl_code", "bond_key"), _BONDS_SQL + " SELECT dl_code, BS1 || '|' || BS2 AS bond_key FROM bonds")
add("prj3_distinct_dimension", lambda s, f: _count(S.distinct_dimension(tape(s, f).select("dl_code", "AS7", "AS18")), "dl_code"),
    TAPE_SQL + "SELECT dl_code, count(*) AS n FROM (SELECT DISTINCT dl_code, AS7, AS18 FROM tape) GROUP BY 1")
add("set4_drop_duplicates", lambda s, f: _count(S.distinct_dimension(tape(s, f), ["dl_code"]), "dl_code"), TAPE_SQL + "SELECT dl_code, count(*) AS n FROM (SELECT DISTINCT * FROM tape) GROUP BY 1")
add("prj4_restrict", lambda s, f: _count(S.restrict(tape(s, f), ["AS25", "AS26", "ZZ9"]), "AS25", "AS26"), TAPE_SQL + "SELECT AS25, AS26, count(*) AS n FROM tape GROUP BY ALL")

# ---- bronze history -----------------------------------------------------------------------------
add("scd1_to_bronze", lambda s, f: B.to_bronze(tape(s, f), ["dl_code", "AS3"], hash_cols=["AS25"]).select(
        "AS3", "pcd_year", "pcd_month", "valid_from", "iscurrent", "checksum", "part"),
    TAPE_SQL + """SELECT AS3, CAST(year(CAST(pcd AS DATE)) AS BIGINT) AS pcd_year, CAST(month(CAST(pcd AS DATE)) AS BIGINT) AS pcd_month,
       pcd || ' 00:00:00' AS valid_from, CAST(1 AS BIGINT) AS iscurrent, md5(dl_code || '|' || dl_code || '|' || AS3 || '|' || AS25) AS checksum,
       dl_code || '_' || CAST(year(CAST(pcd AS DATE)) AS VARCHAR) || CAST(month(CAST(pcd AS DATE)) AS VARCHAR) AS part FROM tape""")


def snapshots(spark, sf):
    """Last event type per user and day: the raw state of a slowly changing table."""
    e = table(spark, sf, "events")
    return e.groupBy(F.pmod("user_id", F.lit(3)).cast("string").alias("g"), "user_id", F.col("ts").cast("date").alias("day")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")
    ).select(F.concat(F.lit("D"), "g").alias("dl_code"), "user_id", F.date_format("day", "yyyy-MM-dd").alias("pcd"), "event_type")


def _history_parts(s, f):
    b = B.to_bronze(snapshots(s, f), ["dl_code", "user_id"], ["event_type"])
    cut = F.lit("2024-01-15").cast("timestamp")
    return b.where(F.col("valid_from") <= cut), b.where(F.col("valid_from") > cut)


def _history(s, f):
    a, b = _history_parts(s, f)
    return B.scd2_merge(B.load_bronze(None, a, ["dl_code", "user_id"]), b, ["dl_code", "user_id"])


_HIST_SQL = """WITH s AS (SELECT 'D' || CAST(user_id % 3 AS VARCHAR) AS dl_code, user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS event_type
  FROM events GROUP BY 1, 2, 3),
 c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM s),
 k AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM c WHERE prev IS NULL OR prev <> event_type),
 h AS (SELECT dl_code, user_id, event_type, strftime(day, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(nxt, '%Y-%m-%d %H:%M:%S') AS valid_to,
       CAST(CASE WHEN nxt IS NULL THEN 1 ELSE 0 END AS BIGINT) AS iscurrent FROM k)"""
_HCOLS = ["dl_code", "user_id", "event_type", "valid_from", "valid_to", "iscurrent"]
add("scd2_merge", lambda s, f: _history(s, f).select(*_HCOLS), _HIST_SQL + " SELECT * FROM h")
add("scd2_merge_same_batch_again", lambda s, f: B.scd2_merge(_history(s, f), _history_parts(s, f)[1], ["dl_code", "user_id"]).select(*_HCOLS), _HIST_SQL + " SELECT * FROM h")
add("scd2_merge_late_batch", lambda s, f: (lambda a, b: B.scd2_merge(B.load_bronze(None, b, ["dl_code", "user_id"]), a, ["dl_code", "user_id"]))(*_history_parts(s, f))
    .where("iscurrent = 1").select("user_id", "event_type"), _HIST_SQL + " SELECT user_id, event_type FROM h WHERE iscurrent = 1")
add("scd2_merge_late_batch_all_versions", lambda s, f: (lambda a, b: B.scd2_merge(B.load_bronze(None, b, ["dl_code", "user_id"]), a, ["dl_code", "user_id"]))(*_history_parts(s, f))
    .select(*_HCOLS), _HIST_SQL + " SELECT * FROM h")


def _interleaved(s, f):
    """Three batches in which days alternate, the middle one last: every version is split and joined again."""
    b = B.to_bronze(snapshots(s, f), ["dl_code", "user_id"], ["event_type"])
    h = None
    for i in (2, 0, 1):
        h = B.load_bronze(h, b.where(F.pmod(F.dayofmonth("valid_from"), F.lit(3)) == i), ["dl_code", "user_id"])
    return h.select(*_HCOLS)


add("scd2_merge_any_order", _interleaved, _HIST_SQL + " SELECT * FROM h")


def _corrected(s, f):
    """Every day delivered twice: first all as one type, later as it was."""
    keys, b = ["dl_code", "user_id"], snapshots(s, f)
    first = B.to_bronze(b.withColumn("event_type", F.lit("draft")), keys, ["event_type"], recorded="2024-02-01")
    h = B.load_bronze(B.load_bronze(None, first, keys), B.to_bronze(b, keys, ["event_type"], recorded="2024-03-01"), keys)
    then = B.as_known(h, keys, "2024-02-15").select("user_id", F.lit("before").alias("known"), *_HCOLS[2:])
    return then.unionByName(h.where("valid_to IS NULL OR valid_to > valid_from").select("user_id", F.lit("after").alias("known"), *_HCOLS[2:]))


add("scd4_as_known", _corrected, _HIST_SQL + """ SELECT user_id, 'after' AS known, event_type, valid_from, valid_to, iscurrent FROM h UNION ALL
SELECT user_id, 'before', 'draft', strftime(min(day), '%Y-%m-%d %H:%M:%S'), NULL, CAST(1 AS BIGINT) FROM s GROUP BY user_id""")


def _skip_mode(s, f):
    """All users; the second batch repeats the first deals and months and adds a month."""
    b = B.to_bronze(snapshots(s, f), ["dl_code", "user_id"], ["event_type"])
    later = B.to_bronze(snapshots(s, f).withColumn("pcd", F.date_format(F.date_add(F.col("pcd").cast("date"), 31), "yyyy-MM-dd")), ["dl_code", "user_id"], ["event_type"])
    keys = ["dl_code", "user_id"]
    return _count(B.load_bronze(B.load_bronze(B.load_bronze(None, b, keys), b, keys, "skip"), later.unionByName(b), keys, "skip"), "part")


add("scd3_load_bronze_skip", _skip_mode, _HIST_SQL + """, l AS (SELECT dl_code, CAST(day + INTERVAL 31 DAY AS DATE) AS day FROM s),
have AS (SELECT DISTINCT dl_code || '_' || CAST(year(day) AS VARCHAR) || CAST(month(day) AS VARCHAR) AS part FROM k),
fresh AS (SELECT dl_code || '_' || CAST(year(day) AS VARCHAR) || CAST(month(day) AS VARCHAR) AS part FROM l)
SELECT dl_code || '_' || CAST(year(day) AS VARCHAR) || CAST(month(day) AS VARCHAR) AS part, count(*) AS n FROM k GROUP BY 1
UNION ALL SELECT part, count(*) AS n FROM fresh WHERE part NOT IN (SELECT part FROM have) GROUP BY 1""")
add("scd4_as_of", lambda s, f: B.as_of(_history(s, f), "2024-01-10 12:00:00").select("user_id", "event_type"),
    _HIST_SQL + " SELECT user_id, event_type FROM k WHERE day <= DATE '2024-01-10' AND (nxt IS NULL OR nxt > DATE '2024-01-10')")
add("src10_read_current", lambda s, f: _count(B.read_current(_history(s, f)), "event_type"), _HIST_SQL + " SELECT event_type, count(*) AS n FROM h WHERE iscurrent = 1 GROUP BY 1")

# ---- sources and sinks, through the shared folder -------------------------------------------------


def _written_tape(s, f, folder):
    """The tape as CSV files with a header and a label row in front."""
    t = tape(s, f).select(*TAPE_FIELDS)
    labels = s.range(1).select(*[F.lit(SME.first_label if c == "AS1" else f"Label {c}").alias(c) for c in TAPE_FIELDS])
    t.unionByName(labels).write.option("header", True).option("emptyValue", "").csv(folder)


def _read_back(s, f):
    folder = scratch_path(s, "tape")
    _written_tape(s, f, folder)
    return tapes.read_tape(s, folder, SME, file_keys=False)


add("src1_read_tape", lambda s, f: _count(_read_back(s, f), "AS1", "AS8", "AS25"), TAPE_SQL + "SELECT AS1, AS8, AS25, count(*) AS n FROM tape GROUP BY ALL")
def _limited(s, f):
    """Ten columns of the tape as fields, the others as values of the surplus."""
    d = tapes.finish_tape(tape(s, f).select(*TAPE_FIELDS), TAPE_FIELDS, None, ragged="mark", max_cols=10)
    kept = d.select(F.lit("kept").alias("side"), F.explode(F.array(*[F.lit(c) for c in d.columns if c != V.SURPLUS])).alias("field"))
    return _count(kept, "side", "field").unionByName(tapes.surplus_fields(d).select(F.lit("surplus").alias("side"), "field", "n"))


add("src6_column_cap", _limited, TAPE_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT 'kept' AS side, '{c}' AS field, count(*) AS n FROM tape" for c in TAPE_FIELDS[:10]]
    + [f"SELECT 'surplus' AS side, '{c}' AS field, count({c}) AS n FROM tape" for c in TAPE_FIELDS[10:]]) + ") WHERE n > 0")


def _mixed_headers(s, f):
    """Two tapes: one with the fields in reverse order and an unknown one."""
    folder, t = scratch_path(s, "mixed"), _fixed_dates(tape(s, f)).select(*TAPE_FIELDS)
    k = F.substring("AS2", 5, 1).cast("int") % 2
    t.where(k == 0).write.option("header", True).option("emptyValue", "").csv(folder)
    t.where(k == 1).withColumn("XX1", F.lit("x")).select("XX1", *reversed(TAPE_FIELDS)).write.mode("append").option("header", True).option("emptyValue", "").csv(folder)
    return tapes.read_tape(s, folder, file_keys=False)


def _per_file(s, f):
    v = V.validate(_mixed_headers(s, f), SME.rules, AS_OF)
    unknown = F.exists("qc_errors", lambda e: e["reason"] == "unknown_field")
    return _count(v.select("AS2", "AS25", unknown.alias("unknown"), F.size("qc_errors").alias("n_errors")), "AS2", "AS25", "unknown", "n_errors")


add("src1_mixed_headers", _per_file, TAPE_SQL + f""" SELECT AS2, AS25, CAST(substr(AS2, 5, 1) AS INTEGER) % 2 = 1 AS unknown,
  CAST({_ERR_N} + CAST(substr(AS2, 5, 1) AS INTEGER) % 2 AS BIGINT) AS n_errors, count(*) AS n FROM tape GROUP BY ALL""")


def _failing_files(s, f):
    """A tape in compressed files beside an empty file and copies of which the end is cut off."""
    folder = scratch_path(s, "failing")
    tape(s, f).select(*TAPE_FIELDS[:5]).repartition(3).write.option("header", True).option("compression", "gzip").csv(folder)
    where = s._jvm.org.apache.hadoop.fs.Path
    store = where(folder).getFileSystem(s._jsparkSession.sessionState().newHadoopConf())
    whole = [(f.getPath().toString(), f.getLen() // 2) for f in store.listStatus(where(folder)) if f.getPath().getName().endswith(".gz")]
    tapes.copy_starts(s, [(path, f"{folder}/cut-{path.rsplit('/', 1)[-1]}", size) for path, size in whole])
    store.create(where(f"{folder}/empty.csv")).close()
    v = V.validate(tapes.read_tape(s, folder, file_keys=False), {c: SME.rules[c] for c in TAPE_FIELDS[:5]}, AS_OF)
    kind = F.when(F.startswith("filename", F.lit("cut-")), "cut").when(F.col("filename") == "empty.csv", "empty").otherwise("whole")
    return _count(v.select(kind.alias("kind"), F.try_element_at(F.filter("qc_errors", lambda e: e["field"] == "file"), F.lit(1))["reason"].alias("reason")), "kind", "reason")


add("val5_file_failures", _failing_files, """SELECT 'whole' AS kind, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM lineitem
UNION ALL SELECT 'cut', 'unreadable_file', CAST(3 AS BIGINT) UNION ALL SELECT 'empty', 'empty_file', CAST(1 AS BIGINT)""")
_FILES_SQL = """WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE 'DEAL' || CAST(o_custkey % 5 AS VARCHAR) || '_' || strftime(o_orderdate, '%Y_%m_%d') END
  || '_loans' || CASE WHEN o_orderkey % 7 = 0 THEN '_Labeled0M' ELSE '' END || '.csv' AS filename FROM orders)"""


def _file_names(s, f):
    k = F.col("o_orderkey")
    return table(s, f, "orders").select(F.concat(
        F.when(k % 10 == 0, "bad").otherwise(F.concat(F.lit("DEAL"), (F.col("o_custkey") % 5).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyy_MM_dd"))),
        F.lit("_loans"), F.when(k % 7 == 0, "_Labeled0M").otherwise(""), F.lit(".csv")).alias("filename"))


add("src2_file_keys", lambda s, f: _count(tapes.with_file_keys(_file_names(s, f)), "dl_code", "pcd"), _FILES_SQL + """
SELECT split_part(filename, '_', 1) AS dl_code, CASE WHEN starts_with(filename, 'bad') THEN NULL
  ELSE split_part(filename, '_', 2) || '-' || split_part(filename, '_', 3) || '-' || split_part(filename, '_', 4) END AS pcd, count(*) AS n FROM t GROUP BY ALL""")
add("src3_file_selection", lambda s, f: _count(tapes._wanted(_file_names(s, f), "DEAL1", tapes.EXCLUDED_TAGS["assets"]), "filename"),
    _FILES_SQL + " SELECT filename, count(*) AS n FROM t WHERE contains(filename, 'DEAL1') AND NOT contains(filename, 'Labeled0M') GROUP BY 1")


def _dirty_text(s, f):
    t = F.col("text")
    return table(s, f, "documents").select("doc_id", F.concat(F.lit("﻿"), F.regexp_replace(t, "é", r"\\u00e9"), F.lit("\u0000"), F.lit(r"😀")).alias("text"))


add("src4_clean_text", lambda s, f: tapes.clean_columns(_dirty_text(s, f), ["text"]).select("doc_id", F.md5("text").alias("digest")),
    "SELECT doc_id, md5(replace(text, '\\u00e9', 'é') || '😀') AS digest FROM documents")


def _ragged(mode):
    """Lines of three to five fields under a header of four."""
    def run(s, f):
        k = F.col("l_partkey")
        lines = table(s, f, "lineitem").select(F.concat_ws(",", F.col("l_orderkey").cast("string"), F.lit("a"), F.lit("b"),
                F.when(k % 3 > 0, "c"), F.when(k % 3 == 2, "d")).alias("value"))
        folder = scratch_path(s, "ragged")
        lines.write.text(folder)
        names = ["AS1", "AS2", "AS3", "AS4"]
        raw = s.read.schema(tapes._schema(names)).options(mode="PERMISSIVE", columnPruning=False, columnNameOfCorruptRecord=tapes.CORRUPT).csv(folder)
        return _count(tapes.finish_tape(raw, names, None, ragged=mode), "AS3", "AS4")
    return run


add("src5_ragged_pad", _ragged("pad"), "SELECT 'b' AS AS3, CASE WHEN l_partkey % 3 > 0 THEN 'c' END AS AS4, count(*) AS n FROM lineitem GROUP BY ALL")
add("src5_ragged_skip", _ragged("skip"), "SELECT 'b' AS AS3, 'c' AS AS4, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 1")

_XML_FIELDS = ["DealCode", "DealName", "ISIN", "Country", "AssetClass", "DealVisibleToOrg"]


def deal_documents(s, f):
    """One deal document per supplier, the second half with a default namespace."""
    k = F.col("s_suppkey").cast("string")
    head = F.when(F.col("s_suppkey") % 2 == 0, F.lit("<root>")).otherwise(F.lit("<root xmlns='urn:deal'>"))
    body = F.concat(
        F.lit("<head/><body><list><meta/><deals><deal><DealCode>D"), k, F.lit("</DealCode><DealName>"), F.col("s_name"),
        F.lit("</DealName><ISIN><string>NL"), k, F.lit("</string><string>XS"), k, F.lit("</string></ISIN><Country>NL</Country><AssetClass>"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("SME"), F.lit("</AssetClass><Submissions><Submission><PoolCutOffDate>2020-0"),
        (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit("-28T00:00:00</PoolCutOffDate><MetricData>x</MetricData></Submission></Submissions></deal></deals></list></body></root>"))
    return table(s, f, "supplier").select("s_suppkey", F.concat(head, body.substr(F.lit(1), F.length(body))).alias("xml"))


add("src7_parse_deals", lambda s, f: deals.with_deal_dates(deals.parse_deals(deal_documents(s, f), "xml", _XML_FIELDS)), """
SELECT s_suppkey, 'D' || CAST(s_suppkey AS VARCHAR) AS dl_code, s_name AS DealName, 'NL' || CAST(s_suppkey AS VARCHAR) || ';XS' || CAST(s_suppkey AS VARCHAR) AS ISIN,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'SME' END AS AssetClass, '2020-0' || CAST(s_suppkey % 9 + 1 AS VARCHAR) || '-28T00:00:00' AS PoolCutOffDate,
       '2020-0' || CAST(s_suppkey % 9 + 1 AS VARCHAR) || '-28' AS pcd, CAST(2020 AS BIGINT) AS year, CAST(s_suppkey % 9 + 1 AS BIGINT) AS month FROM supplier""")
add("src8_normalise_deal", lambda s, f: deals.normalise_deal(tape(s, f).select(F.col("AS2").alias("DealCode"), "AS16")).groupBy("dl_code").agg(F.count("AS16").alias("n")),
    TAPE_SQL + "SELECT AS2 AS dl_code, count(CASE WHEN AS16 <> '' THEN 1 END) AS n FROM tape GROUP BY 1")


def _bronze_table(s, f):
    path = scratch_path(s, "bronze")
    sinks.write_bronze(B.to_bronze(tape(s, f), ["dl_code", "AS3"], gather=True), path, gather=False)
    return path


_PARTS = "dl_code || '_' || CAST(year(CAST(pcd AS DATE)) AS VARCHAR) || CAST(month(CAST(pcd AS DATE)) AS VARCHAR)"
add("src9_read_bronze_partition", lambda s, f: _count(tapes.read_bronze(s, _bronze_table(s, f), ["DEAL1_19985", "DEAL2_199612"]), "part", "AS25"),
    TAPE_SQL + f", t AS (SELECT *, {_PARTS} AS part FROM tape) SELECT part, AS25, count(*) AS n FROM t WHERE part IN ('DEAL1_19985', 'DEAL2_199612') GROUP BY ALL")
add("snk2_write_bronze", lambda s, f: _count(tapes.read_bronze(s, _bronze_table(s, f)), "part"), TAPE_SQL + f"SELECT {_PARTS} AS part, count(*) AS n FROM tape GROUP BY 1")


def _merged_bronze(s, f):
    """Two batches through the table on disk."""
    path = scratch_path(s, "history")
    for part in _history_parts(s, f):
        sinks.merge_bronze(part, path, ["user_id"])
    return tapes.read_bronze(s, path).select(*_HCOLS)


add("snk2_merge_bronze_table", _merged_bronze, _HIST_SQL + " SELECT * FROM h")


def _silver_table(s, f):
    path = scratch_path(s, "silver")
    topic = written(_topics(s, f, ranges=("pcd_year", "pcd_month"))["obligor_info"], "topic")
    sinks.write_silver(topic, path, gather=False)
    sinks.write_silver(topic, path, replace=True, gather=False)
    return _count(s.read.parquet(path), "pcd_year", "AS18")


add("snk1_write_silver_twice", _silver_table, TAPE_SQL + f""", c AS (SELECT DISTINCT dl_code, {_YM}, {_DATE1}, AS2, AS3, AS4, AS5, AS6, AS7,
  CASE WHEN NOT regexp_matches(AS8, '^ND[0-9]?$') THEN AS8 END, AS15, AS16, AS18, AS20, CASE WHEN AS23 = 'ND' THEN NULL ELSE AS23 = 'Y' END, AS25, AS26,
  round(TRY_CAST(AS27 AS DOUBLE), 2), round(CAST(AS37 AS DOUBLE), 2), AS42 FROM tape)
SELECT CAST(y AS BIGINT) AS pcd_year, AS18, count(*) AS n FROM c GROUP BY ALL""")


def _deal_table(s, f):
    path = scratch_path(s, "deals")
    d = deals.with_deal_dates(deals.parse_deals(deal_documents(s, f), "xml", _XML_FIELDS))
    sinks.write_deals(d, path)
    sinks.write_deals(d, path)
    return _count(s.read.parquet(path), "month", "AssetClass")


add("snk3_write_deals", _deal_table, "SELECT CAST(s_suppkey % 9 + 1 AS BIGINT) AS month, CASE WHEN s_suppkey % 3 <> 0 THEN 'SME' END AS AssetClass, count(*) AS n FROM supplier GROUP BY ALL")


def _round_trip(writer, reader, build):
    def run(s, f):
        path = scratch_path(s, "out")
        writer(build(s, f), path)
        return reader(s, path)
    return run


def _panel_csv(s, f):
    path = scratch_path(s, "panel")
    p = panel(s, f).select("loan_id", "reporting_date", "arrears_bucket", "current_balance")
    sinks.write_csv(p, path)
    return _count(tapes.read_panel(s, path, "csv", "loan_id string, reporting_date string, arrears_bucket string, current_balance double"), "reporting_date", "arrears_bucket")


add("src11_snk7_read_panel_csv", _panel_csv, PANEL_SQL + "SELECT CAST(reporting_date AS VARCHAR) AS reporting_date, arrears_bucket, count(*) AS n FROM panel GROUP BY ALL")


def _two_panels(s, f):
    a, b = scratch_path(s, "panel"), scratch_path(s, "panel")
    p = panel(s, f).select("loan_id", "reporting_date", "arrears_bucket")
    p.where("reporting_date < DATE '1998-01-01'").write.parquet(a)
    p.where("reporting_date >= DATE '1998-01-01'").write.parquet(b)
    return _count(tapes.read_panel(s, [a, b]), "reporting_date")


add("set3_concatenate_cutoffs", _two_panels, PANEL_SQL + "SELECT CAST(reporting_date AS VARCHAR) AS reporting_date, count(*) AS n FROM panel GROUP BY 1")

# ---- whole tape load -----------------------------------------------------------------------------


def _loaded(s, f):
    target = scratch_path(s, "load")
    load_tape(_fixed_dates(tape(s, f)), SME, target, AS_OF)
    silver = read_snapshot(s, f"{target}/silver/loan_info")
    return silver.groupBy("dl_code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("AS3").alias("n_loans"))


_LOAD_SQL = TAPE_SQL + f""", good AS (SELECT * FROM tape WHERE {_ERR_N} = 0)
SELECT dl_code, count(DISTINCT AS3) AS n_loans FROM good GROUP BY 1"""
add("flow_load_tape", lambda s, f: _loaded(s, f).drop("n"), _LOAD_SQL)


def _reloaded(s, f):
    """A tape with errors, then the corrected tape of two of its deals, then one without deal and date."""
    target = scratch_path(s, "reload")
    first = _fixed_dates(tape(s, f)).withColumn("filename", F.concat("dl_code", F.lit(".csv")))
    mended = first.where("dl_code IN ('DEAL1', 'DEAL2')").withColumn("AS16", F.lit("1000AA")).withColumn("AS27", F.lit("1"))
    nameless = first.where("dl_code = 'DEAL3'").select(F.lit(None).cast("string").alias("dl_code"), F.lit(None).cast("string").alias("pcd"), *TAPE_FIELDS, F.lit("other.csv").alias("filename"))
    for t in (first, mended, nameless):
        annotated = V.validate(t, SME.rules, AS_OF)
        good, bad = V.split_clean_dirty(annotated)
        sinks.write_quarantine(good, bad, target, V.sides(annotated))
    side = lambda x: sinks.read_quarantine(s, target, x).select(F.lit(x).alias("side"), "filename")
    return _count(side("clean").unionByName(side("dirty")), "side", "filename")


_ERR_MENDED = " + ".join(f"coalesce(CAST({c} AS INTEGER), 0)" for a, _, c in _ROW_ERRORS if a not in ("AS16", "AS27"))
add("snk4_reload", _reloaded, TAPE_SQL + f""", r AS (SELECT dl_code || '.csv' AS filename, CASE WHEN dl_code IN ('DEAL1', 'DEAL2') THEN {_ERR_MENDED} ELSE {_ERR_N} END AS e FROM tape
  UNION ALL SELECT 'other.csv', {_ERR_N} FROM tape WHERE dl_code = 'DEAL3')
SELECT CASE WHEN e = 0 THEN 'clean' ELSE 'dirty' END AS side, filename, count(*) AS n FROM r GROUP BY ALL""")

# ---- facilities ----------------------------------------------------------------------------------
_FAC = {
    "gross_revenue_eur": "sum(l_extendedprice)", "energy_cost_eur": "sum(l_extendedprice * l_discount)",
    "opex_eur": "sum(l_extendedprice * l_tax)", "debt_service_eur": "sum(l_extendedprice) * 0.6",
    "market_value_eur": "sum(l_extendedprice) * 10", "outstanding_debt_eur": "sum(l_extendedprice) * (6 + l_suppkey % 3)",
    "it_load_mw": "sum(l_quantity) * 2", "leased_capacity_mw": "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_quantity * 2 END)",
}


def facilities(s, f):
    """Facility rows as text: amounts per supplier, some of them broken."""
    sums = table(s, f, "lineitem").groupBy("l_suppkey").agg(*[F.expr(e).alias(c) for c, e in _FAC.items()])
    k = F.col("s_suppkey")
    whole = lambda c: F.round(c, 0).cast("bigint").cast("string")
    broken = {"it_load_mw": F.when(k % 23 == 1, "n/a"), "debt_service_eur": F.when(k % 29 == 1, "-5")}
    rows = table(s, f, "supplier").join(table(s, f, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(sums, k == F.col("l_suppkey"))
    return rows.select(
        F.when(k % 17 == 1, "").otherwise(F.concat(F.lit("F"), k.cast("string"))).alias("facility_id"), F.col("n_name").alias("sponsor"),
        F.lit("NL").alias("country"), F.when(k % 19 == 1, "2020-13-01").otherwise("2020-06-30").alias("report_date"),
        *[(F.coalesce(broken[c], whole(F.col(c))) if c in broken else whole(F.col(c))).alias(c) for c in _FAC],
    )


_FB = {"it_load_mw": "CASE WHEN s_suppkey % 23 = 1 THEN 'n/a' ELSE {} END", "debt_service_eur": "CASE WHEN s_suppkey % 29 = 1 THEN '-5' ELSE {} END"}
FAC_SQL = "WITH sums AS (SELECT l_suppkey, " + ", ".join(f"{e} AS {c}" for c, e in _FAC.items()) + """ FROM lineitem GROUP BY l_suppkey),
fac AS (SELECT CASE WHEN s_suppkey % 17 = 1 THEN '' ELSE 'F' || CAST(s_suppkey AS VARCHAR) END AS facility_id, n_name AS sponsor, 'NL' AS country,
 CASE WHEN s_suppkey % 19 = 1 THEN '2020-13-01' ELSE '2020-06-30' END AS report_date, """ + ", ".join(
    (_FB.get(c, "{}")).format(f"CAST(CAST(round(sums.{c}) AS BIGINT) AS VARCHAR)") + f" AS {c}" for c in _FAC) + """
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN sums ON s_suppkey = l_suppkey)"""
_FSORT = sorted(["facility_id", "sponsor", "country", "report_date", *_FAC])
_FVALID = " AND ".join(f"TRY_CAST({c} AS DOUBLE) IS NOT NULL" for c in _FAC)
_FSILVER = f""", n AS (SELECT facility_id, sponsor, country, report_date, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FAC)} FROM fac WHERE {_FVALID}),
r AS (SELECT *, gross_revenue_eur - energy_cost_eur - opex_eur AS noi,
  CASE WHEN debt_service_eur = 0 THEN 0 ELSE (gross_revenue_eur - energy_cost_eur - opex_eur) / debt_service_eur END AS d,
  CASE WHEN market_value_eur = 0 THEN 0 ELSE outstanding_debt_eur / market_value_eur END * 100.0::DOUBLE AS l FROM n),
silver AS (SELECT facility_id, sponsor, country, report_date, round(noi, 2) AS noi_eur, round(d, 3) AS dscr, round(l, 2) AS ltv_pct,
  round(CASE WHEN it_load_mw = 0 THEN 0 ELSE leased_capacity_mw / it_load_mw END * 100.0::DOUBLE, 2) AS occupancy_pct,
  round(CASE WHEN gross_revenue_eur = 0 THEN 0 ELSE energy_cost_eur / gross_revenue_eur END * 100.0::DOUBLE, 2) AS energy_cost_ratio_pct,
  CASE WHEN d < 1.20 OR l > 78 THEN 'breach' WHEN d < 1.35 OR l > 74 THEN 'watch' ELSE 'ok' END AS junior_note_watch_status FROM r)"""


def _fsilver(s, f):
    return D.dc_silver(D.dc_bronze(facilities(s, f), "2020-07-01T00:00:00"))


add("val8_scd5_facility_bronze", lambda s, f: D.dc_bronze(facilities(s, f), "2020-07-01T00:00:00").select("facility_id", "_ingested_at", "_row_hash", "_is_valid_numeric"),
    FAC_SQL + f"""SELECT facility_id, '2020-07-01T00:00:00' AS _ingested_at, sha256({" || '|' || ".join(_FSORT)}) AS _row_hash, {_FVALID} AS _is_valid_numeric FROM fac""")
add("fn9_fn10_facility_silver", _fsilver, FAC_SQL + _FSILVER + " SELECT * FROM silver")
_AVG = """count(*) AS facility_count, CAST(round(CAST(avg(dscr) AS DECIMAL(30, 9)), 3) AS DOUBLE) AS avg_dscr,
 CAST(round(CAST(avg(ltv_pct) AS DECIMAL(30, 9)), 2) AS DOUBLE) AS avg_ltv_pct, CAST(round(CAST(avg(occupancy_pct) AS DECIMAL(30, 9)), 2) AS DOUBLE) AS avg_occupancy_pct,
 count(*) FILTER (WHERE junior_note_watch_status = 'breach') AS breach_count, count(*) FILTER (WHERE junior_note_watch_status = 'watch') AS watch_count"""
add("agg21_sponsor_rollup", lambda s, f: D.sponsor_rollup(_fsilver(s, f)), FAC_SQL + _FSILVER + f" SELECT sponsor, {_AVG} FROM silver GROUP BY 1")
add("agg22_portfolio_dashboard", lambda s, f: D.portfolio_dashboard(_fsilver(s, f), "2020-07-01"), FAC_SQL + _FSILVER + f" SELECT {_AVG}, '2020-07-01' AS as_of FROM silver")
_QSQL = FAC_SQL + f""", q AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE facility_id = '') AS missing_key_identifiers,
  count(*) FILTER (WHERE facility_id = '') AS missing_critical_fields, count(*) FILTER (WHERE TRY_CAST(report_date AS DATE) IS NULL) AS invalid_dates,
  CAST({" + ".join(f"count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NULL)" for c in _FAC)} AS BIGINT) AS invalid_numeric_values,
  CAST({" + ".join(f"count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) < 0)" for c in D.NON_NEGATIVE_FIELDS)} AS BIGINT) AS suspicious_values FROM fac),
 report AS (SELECT *, round(greatest(0.0::DOUBLE, 100.0::DOUBLE - (missing_key_identifiers + missing_critical_fields + invalid_dates + invalid_numeric_values + suspicious_values)
  / greatest(row_count, 1)::DOUBLE * 10.0::DOUBLE), 2) AS overall_quality_score FROM q)"""
add("val9_quality_report", lambda s, f: D.quality_report(facilities(s, f)), _QSQL + " SELECT * FROM report")


def _summaries(s, f):
    path = scratch_path(s, "quality")
    sinks.write_json(D.quality_report(facilities(s, f)), path)
    return C.quality_summaries(s.read.schema("row_count long, invalid_dates long, overall_quality_score double").json(path), ["row_count"], 10)


add("flt7_snk5_quality_summaries", _summaries, _QSQL + " SELECT row_count, invalid_dates, overall_quality_score FROM report")

# ---- commercial real estate ----------------------------------------------------------------------
_CRE = {
    "CREL1": "CASE WHEN o_orderkey % 31 = 0 THEN 'ND' ELSE 'deal' || CAST(o_custkey % 10 AS STRING) END",
    "CREL2": "'ob' || CAST(o_custkey AS STRING)",
    "CREL3": "CASE WHEN o_orderkey % 2 = 0 THEN ' NA ' ELSE 'new' || CAST(o_custkey AS STRING) END",
    "CREL4": "CASE WHEN o_orderkey % 13 = 0 THEN 'ND2' ELSE 'loan' || CAST(o_orderkey AS STRING) END",
    "CREL5": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'loan' || CAST(o_orderkey AS STRING) || 'x' END",
    "CREL19": "'NL'",
    "CREL26": "o_orderpriority",
    "CREL32": "'1,500,000.5'",
    "CREL40": "'77'",
    "CREL41": "CASE WHEN o_orderkey % 11 = 0 THEN '-500' WHEN o_orderkey % 11 = 1 THEN '' ELSE CAST(o_totalprice AS STRING) END",
    "CREL44": "CASE WHEN o_orderkey % 7 = 0 THEN 'abc' ELSE '1.4' END",
    "CREL59": "CAST(o_orderkey % 130 AS STRING)",
    "CREL68": "o_orderstatus",
    "CREL71": "'N'",
    "OTHER": "'not in the taxonomy'",
}
_CRE_SQL = "WITH raw AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _CRE.items()) + " FROM orders), v AS (SELECT " + ", ".join(
    f"CASE WHEN trim({c}) NOT IN ('', 'ND', 'ND1', 'ND2', 'ND3', 'ND4', 'ND5', 'NA') THEN trim({c}) END AS {c}" for c in _CRE) + """ FROM raw),
 c AS (SELECT CREL1 AS deal_id, coalesce(CREL3, CREL2) AS obligor_id, coalesce(CREL5, CREL4) AS loan_id, CREL26 AS property_type, CREL19 AS country,
  CREL68 AS default_status, CREL71 AS special_servicing, TRY_CAST(replace(coalesce(CREL41, CREL40), ',', '') AS DOUBLE) AS current_balance,
  TRY_CAST(replace(CREL32, ',', '') AS DOUBLE) AS appraised_value, TRY_CAST(CREL44 AS DOUBLE) AS dscr, TRY_CAST(CREL59 AS DOUBLE) AS occupancy_rate, CREL44, CREL4 FROM v),
 x AS (SELECT *, coalesce(current_balance < 0, false) AS r1, coalesce(NOT occupancy_rate BETWEEN 0 AND 100, false) AS r2, loan_id IS NULL AS r3, CREL44 IS NOT NULL AND dscr IS NULL AS r4 FROM c)"""


def _cre(s, f):
    raw = table(s, f, "orders").select(*[F.expr(e).alias(c) for c, e in _CRE.items()])
    return cre.cre_normalise(raw, [c for c in _CRE if c != "OTHER"])


add("rsh4_cre_normalise", lambda s, f: _cre(s, f).withColumn("raw_fields", F.size("raw")).drop("raw"), _CRE_SQL + """
SELECT deal_id, obligor_id, loan_id, property_type, country, default_status, special_servicing, current_balance, appraised_value, dscr, occupancy_rate, CAST(14 AS BIGINT) AS raw_fields FROM c""")
add("val6_cre_validate", lambda s, f: _count(cre.cre_validate(_cre(s, f)).select("validation.is_valid", F.array_join("validation.failed_rules", ";").alias("failed_rules")), "is_valid", "failed_rules"),
    _CRE_SQL + """SELECT NOT (r1 OR r2 OR r3 OR r4) AS is_valid, concat_ws(';', CASE WHEN r1 THEN 'negative_current_balance' END, CASE WHEN r2 THEN 'occupancy_out_of_range' END,
  CASE WHEN r3 THEN 'missing_loan_id' END, CASE WHEN r4 THEN 'non_numeric_dscr' END) AS failed_rules, count(*) AS n FROM x GROUP BY ALL""")
_CRE_SUM = """SELECT count(*) AS record_count, count(*) FILTER (WHERE deal_id IS NULL OR CREL4 IS NULL) AS rows_missing_primary_identifiers,
  count(*) FILTER (WHERE NOT (r1 OR r2 OR r3 OR r4)) AS valid_record_count, count(*) FILTER (WHERE r1 OR r2 OR r3 OR r4) AS invalid_record_count,
  count(*) FILTER (WHERE r1) AS negative_current_balance, count(*) FILTER (WHERE r2) AS occupancy_out_of_range, count(*) FILTER (WHERE r3) AS missing_loan_id,
  count(*) FILTER (WHERE r4) AS non_numeric_dscr FROM x"""
add("val7_cre_summary", lambda s, f: cre.cre_summary(cre.cre_validate(_cre(s, f))), _CRE_SQL + _CRE_SUM)
add("snk5_cre_json", _round_trip(sinks.write_json, lambda s, p: s.read.schema("deal_id string, validation struct<is_valid:boolean>").json(p)
    .groupBy("deal_id").agg(F.count_if("validation.is_valid").alias("n")), lambda s, f: cre.cre_validate(_cre(s, f))),
    _CRE_SQL + "SELECT deal_id, count(*) FILTER (WHERE NOT (r1 OR r2 OR r3 OR r4)) AS n FROM x GROUP BY 1")

# ---- catalogued filters --------------------------------------------------------------------------
_COLS = {"loan_no": C.ColumnInfo("INTEGER"), "Status": C.ColumnInfo("STRING"), "priority": C.ColumnInfo("STRING"), "total": C.ColumnInfo("FLOAT"),
         "booked": C.ColumnInfo("DATE"), "open": C.ColumnInfo("BOOLEAN"), "customer": C.ColumnInfo("INTEGER", False)}
CATALOG = {"sme": {"loans": _COLS}}
_LOANS_SQL = """WITH loans AS (SELECT o_orderkey AS loan_no, o_orderstatus AS Status, o_orderpriority AS priority, o_totalprice AS total, CAST(o_orderdate AS DATE) AS booked,
  o_orderstatus = 'O' AS open, o_custkey AS customer FROM orders)"""


def _loans(s, f):
    return table(s, f, "orders").select(
        F.col("o_orderkey").alias("loan_no"), F.col("o_orderstatus").alias("Status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("booked"), (F.col("o_orderstatus") == "O").alias("open"), F.col("o_custkey").alias("customer"))


for _i, (_text, _where) in enumerate([
    ("status:f", "Status = 'F'"),
    ("-status:f and total>=400000.5", "NOT Status = 'F' AND total >= 400000.5"),
    ("priority~%high% or booked<1995-03-01 and open:true", "upper(priority) LIKE '%HIGH%' OR booked < DATE '1995-03-01' AND open = true"),
    ("loan_no<=100 or -priority~1-urg% and total<2000", "loan_no <= 100 OR NOT upper(priority) LIKE '1-URG%' AND total < 2000"),
], 1):
    add(f"flt1_filter_table_{_i}", lambda s, f, t=_text: C.filter_table(_loans(s, f), C.table_of(CATALOG, "sme", "loans"), t).select("loan_no", "Status", "total"),
        _LOANS_SQL + f" SELECT loan_no, Status, total FROM loans WHERE {_where}")
add("flt2_page", lambda s, f: C.page(_loans(s, f), ["total", "loan_no"], 25, 50).select("loan_no", "total"), _LOANS_SQL + " SELECT loan_no, total FROM loans ORDER BY total, loan_no LIMIT 25 OFFSET 50")
add("flt3_rows_as_lists", lambda s, f: C.rows(C.page(_loans(s, f), ["loan_no"], 200).select("loan_no", "Status", "priority"), False),
    _LOANS_SQL + " SELECT CAST(loan_no AS VARCHAR) || ',' || Status || ',' || priority AS values FROM (SELECT * FROM loans ORDER BY loan_no LIMIT 200)")
add("prj5_select_cols", lambda s, f: C.select_cols(_loans(s, f), _COLS, " priority, total ,loan_no,"), _LOANS_SQL + " SELECT priority, total, loan_no FROM loans")

# ---- BI ------------------------------------------------------------------------------------------
_MEASURED = ["current_balance", "original_balance", "loan_to_income", "seasoning_months"]
add("agg23_measures", lambda s, f: bi.measures(panel(s, f), ["province", "performing_status"], _MEASURED).select(
        "province", "performing_status", "count", *[F.col(f"{c}_{a}").cast("double").alias(f"{c}_{a}") for c in _MEASURED for a in ("min", "max", "avg")]),
    PANEL_SQL + "SELECT province, performing_status, count(*) AS count, " + ", ".join(
        f"round(CAST({a}({c}) AS DOUBLE), 4) AS {c}_{a}" for c in _MEASURED for a in ("min", "max", "avg")) + " FROM panel GROUP BY 1, 2", 4)
_BOOK = {k: codes.CODEBOOK[k] for k in ("purpose", "amortisation_type", "interest_rate_index" if "interest_rate_index" in codes.CODEBOOK else "current_interest_rate_index", "business_type", "asset_type")}
_LABEL = lambda labels, c: "CASE " + c + " " + " ".join(f"WHEN '{i}' THEN '{t}'" for i, t in enumerate(labels, 1)) + " ELSE 'unknown' END"
add("fn16_decode", lambda s, f: _count(codes.decode(tape(s, f), _BOOK), *_BOOK),
    TAPE_SQL + "SELECT " + ", ".join(f"{_LABEL(labels, c)} AS {k}" for k, (c, labels) in _BOOK.items()) + ", count(*) AS n FROM tape GROUP BY ALL")


def _industry(s, f):
    return table(s, f, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("industry"))


def _star(s, f, on_cutoff):
    t = _topics(s, f, lead=bi.star_keys(on_cutoff), together=True)
    star = bi.loan_star(t["loan_info"], [t["performance_info"], t["financial_info"], t["interest_rate"], t["obligor_info"]], _industry(s, f), on_cutoff=on_cutoff)
    return star.groupBy("dl_code", "industry", "AS25").agg(F.count(F.lit(1)).alias("n"), F.sum("AS54").alias("amount"), F.sum("AS80").alias("rate"), F.sum("AS115").alias("arrears"))


_GEN = "dl_code, " + _YM + ", AS1, AS2, AS3, AS4, AS5, AS6, AS7, AS8"


def _star_sql(on_cutoff):
    keys = "USING (AS3, dl_code, y, m)" if on_cutoff else "USING (AS3, dl_code)"
    t = lambda name, cols: f"{name} AS (SELECT DISTINCT {_GEN}, {cols} FROM tape)"
    return TAPE_SQL + ", " + ", ".join([
        t("li", "AS50, AS51, AS52, AS53, AS54, AS55, AS56, AS57, AS58, AS62, AS65"), t("pe", "AS115, AS116, AS121, AS123, AS129"), t("fi", "AS100, AS111"),
        t("ir", "AS80, AS83, AS84, AS85, AS94"), t("ob", "AS15, AS16, AS18, AS20, AS23, AS25, AS26, AS27, AS37, AS42")]) + f"""
SELECT dl_code, n_name AS industry, AS25, count(*) AS n, round(sum(CAST(AS54 AS DOUBLE)), 2) AS amount, round(sum(CAST(AS80 AS DOUBLE)), 2) AS rate, round(sum(CAST(AS115 AS DOUBLE)), 2) AS arrears
FROM li LEFT JOIN pe {keys} LEFT JOIN fi {keys} LEFT JOIN ir {keys} LEFT JOIN ob {keys} LEFT JOIN nation ON AS42 = 'N' || CAST(n_nationkey AS VARCHAR) GROUP BY ALL"""


add("jon6_loan_star", lambda s, f: _star(s, f, True), _star_sql(True), 2)
add("jon6_loan_star_all_snapshots", lambda s, f: _star(s, f, False), _star_sql(False), 2)
add("fn15_time_grains", lambda s, f: dates.time_grains(_loans(s, f).select("booked").distinct(), "booked").drop("booked"), """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT CAST(d AS VARCHAR) AS booked_raw, CAST(d AS VARCHAR) AS booked_date, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS booked_week, strftime(d, '%Y-%m') AS booked_month,
       CAST(CAST(date_trunc('quarter', d) AS DATE) AS VARCHAR) AS booked_quarter, CAST(year(d) AS BIGINT) AS booked_year, CAST(day(d) AS BIGINT) AS booked_day_of_month,
       'Q' || CAST(quarter(d) AS VARCHAR) AS booked_quarter_of_year FROM d""")

# ---- scalar functions ----------------------------------------------------------------------------
_R = "(current_interest_rate_pct / 100.0::DOUBLE / 12.0::DOUBLE)"
_POW = f"pow(1.0::DOUBLE + {_R}, {{}})"


def _loan_math(s, f):
    c = F.col
    p = panel(s, f)
    io, rate, term, age = c("interest_only_flag"), c("current_interest_rate_pct"), c("legal_maturity_months"), c("seasoning_months")
    return p.select(
        "loan_id", "reporting_date",
        loanmath.scheduled_payment(c("original_balance"), rate, term, io).alias("payment"),
        loanmath.annuity_balance(c("original_balance"), rate, term, age, io).alias("annuity_balance"),
        loanmath.next_balance(c("current_balance"), rate, c("scheduled_monthly_payment"), io, c("arrears_bucket")).alias("next_balance"),
        loanmath.ltv(c("current_balance"), c("indexed_market_value")).alias("ltv"),
        loanmath.loan_to_income(c("original_balance"), c("borrower_annual_income")).alias("lti"),
        loanmath.payment_to_income(c("scheduled_monthly_payment"), c("borrower_annual_income")).alias("dsti"),
        loanmath.market_value(c("original_balance"), c("oltomv_original")).alias("market_value"),
        loanmath.monthly_drift(c("current_original_market_value"), age).alias("drifted"),
        loanmath.arrears_amount(c("scheduled_monthly_payment"), c("days_past_due")).alias("arrears"),
        safe_ratio(c("original_balance"), c("current_balance")).alias("ratio"),
    )


_MATH = ["payment", "annuity_balance", "next_balance", "ltv", "lti", "dsti", "market_value", "drifted", "arrears", "ratio"]
add("fn02_to_fn08_loan_math", lambda s, f: _loan_math(s, f).groupBy("reporting_date").agg(*[F.sum(c).alias(c) for c in _MATH]), PANEL_SQL + f""", x AS (SELECT loan_id, CAST(reporting_date AS VARCHAR) AS reporting_date,
  CASE WHEN interest_only_flag = 'Y' THEN original_balance * {_R} ELSE original_balance * {_R} * {_POW.format('legal_maturity_months')} / ({_POW.format('legal_maturity_months')} - 1) END AS payment,
  CASE WHEN interest_only_flag = 'Y' THEN original_balance ELSE original_balance * ({_POW.format('legal_maturity_months')} - {_POW.format('seasoning_months')}) / ({_POW.format('legal_maturity_months')} - 1) END AS annuity_balance,
  CASE WHEN arrears_bucket IN ('Redeemed', 'Charged-Off') THEN 0 WHEN arrears_bucket = 'Performing' AND interest_only_flag = 'N'
        THEN greatest(current_balance * (1 + {_R}) - scheduled_monthly_payment, 0) ELSE current_balance END AS next_balance,
  CASE WHEN indexed_market_value = 0 THEN 0 ELSE current_balance / indexed_market_value * 100 END AS ltv,
  original_balance / borrower_annual_income AS lti, scheduled_monthly_payment * 12 / borrower_annual_income * 100 AS dsti,
  original_balance / (oltomv_original / 100.0::DOUBLE) AS market_value,
  current_original_market_value * pow(1.03::DOUBLE, seasoning_months / 12.0::DOUBLE) AS drifted, arrears_amount AS arrears,
  original_balance / nullif(current_balance, 0) AS ratio FROM panel)
SELECT reporting_date, {", ".join(f"round(sum({c}), 2) AS {c}" for c in _MATH)} FROM x GROUP BY 1""", 2)
add("fn11_states", lambda s, f: _count(panel(s, f).select("arrears_bucket", states.days_past_due(F.col("arrears_bucket")).alias("dpd"), states.performing_status(F.col("arrears_bucket")).alias("status"),
        states.default_flag(F.col("arrears_bucket")).alias("default_flag"), states.foreclosure_flag(F.col("arrears_bucket")).alias("foreclosure_flag")), "arrears_bucket", "dpd", "status", "default_flag", "foreclosure_flag"),
    PANEL_SQL + "SELECT arrears_bucket, CAST(days_past_due AS BIGINT) AS dpd, performing_status AS status, default_crr_flag AS default_flag, foreclosure_flag, count(*) AS n FROM panel GROUP BY ALL")
add("fn12_guarantee_deposit", lambda s, f: _count(panel(s, f), "nhg_flag", "guarantee_type", "construction_deposit_flag", "construction_deposit_pct"),
    PANEL_SQL + "SELECT nhg_flag, guarantee_type, construction_deposit_flag, CAST(construction_deposit_pct AS BIGINT) AS construction_deposit_pct, count(*) AS n FROM panel GROUP BY ALL")
add("fn13_loan_dates", lambda s, f: panel(s, f).select("loan_id", "reporting_date", "seasoning_months", "remaining_term_months", "maturity_date_proxy",
        dates.first_business_day(F.year("reporting_date"), F.month("reporting_date")).alias("first_business_day"), F.array_max(dates.month_ends(F.col("reporting_date"), 24)).alias("last_month_end")),
    PANEL_SQL + """SELECT loan_id, CAST(reporting_date AS VARCHAR) AS reporting_date, CAST(seasoning_months AS BIGINT) AS seasoning_months, CAST(remaining_term_months AS BIGINT) AS remaining_term_months,
  CAST(maturity_date_proxy AS VARCHAR) AS maturity_date_proxy,
  CAST(CAST(date_trunc('month', reporting_date) AS DATE) + CASE dayofweek(date_trunc('month', reporting_date)) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS VARCHAR) AS first_business_day,
  CAST(last_day(CAST(date_trunc('month', reporting_date) + INTERVAL 23 MONTH AS DATE)) AS VARCHAR) AS last_month_end FROM panel""")
add("fn14_date_parts", lambda s, f: _count(panel(s, f).select(F.year("reporting_date").alias("y"), F.month("reporting_date").alias("m"), dates.is_iso_date(F.col("reporting_date")).alias("iso"),
        dates.day_difference(F.col("reporting_date"), F.col("closing_date")).alias("days")), "y", "m", "iso", "days"),
    PANEL_SQL + "SELECT year(reporting_date) AS y, month(reporting_date) AS m, true AS iso, datediff('day', closing_date, reporting_date) AS days, count(*) AS n FROM panel GROUP BY ALL")
add("fn18_fn19_text_and_hashes", lambda s, f: table(s, f, "customer").select(
        text.sequence_id("GL", F.col("c_custkey")).alias("seq_id"), text.strip_namespace(F.concat(F.lit("{urn:x}"), "c_name")).alias("tag"),
        text.number_with_commas(F.concat(F.lit("1,"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))).alias("number"),
        text.key_hash(F.col("c_name"), F.col("c_custkey")).alias("key_md5"), F.sha2("c_name", 256).alias("sha")),
    """SELECT 'GL_' || CASE WHEN c_custkey < 1000000 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS seq_id, c_name AS tag,
  CAST(1000 + c_custkey % 1000 AS DOUBLE) AS number, md5(c_name || '|' || CAST(c_custkey AS VARCHAR)) AS key_md5, sha256(c_name) AS sha FROM customer""")
add("fn22_null_handling", lambda s, f: fill_missing(tape(s, f).select(
        first_non_empty(F.col("AS16"), F.col("AS2")).alias("first"), dates.coerce_number(F.col("AS27")).alias("v"), dates.coerce_number(F.col("AS37")).alias("w")), ["v", "w"])
        .groupBy("first").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")),
    TAPE_SQL + """SELECT coalesce(nullif(AS16, ''), nullif(AS2, '')) AS first, round(sum(coalesce(TRY_CAST(AS27 AS DOUBLE), -999)), 2) AS v,
  round(sum(coalesce(TRY_CAST(AS37 AS DOUBLE), -999)), 2) AS w, count(*) AS n FROM tape GROUP BY 1""", 2)

# ---- embeddings ----------------------------------------------------------------------------------
_E = 64


def _embedded(s, f):
    emb = explode_embedding(table(s, f, "embeddings").select("vec_id", "embedding"), "embedding", _E)
    loans_ = table(s, f, "customer").select(F.col("c_custkey").alias("vec_id"), "c_mktsegment")
    return with_embeddings(loans_, emb, "vec_id")


add("rsh5_explode_embedding", lambda s, f: pack_embedding(explode_embedding(table(s, f, "embeddings"), "embedding", _E)).select(
        "vec_id", "label", F.size("embedding").alias("width"), F.col("embedding")[0].alias("emb_first"), F.col("embedding")[63].alias("emb_last")),
    "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE), 5) AS emb_first, round(CAST(embedding[64] AS DOUBLE), 5) AS emb_last FROM embeddings", 5)
add("jon3_with_embeddings", lambda s, f: _embedded(s, f).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("emb_0").alias("s0"), F.sum("emb_63").alias("s63")),
    """SELECT c_mktsegment, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS s0, round(sum(CAST(embedding[64] AS DOUBLE)), 4) AS s63
FROM customer JOIN embeddings ON c_custkey = vec_id GROUP BY 1""", 4)

# ---- streams -------------------------------------------------------------------------------------
_EV = ["user_id", "event_type", "day"]


def _stream_source(s, f, per_day):
    """Events as CSV files that arrive day by day."""
    folder = scratch_path(s, "arriving")
    e = snapshots(s, f).select("user_id", "event_type", F.col("pcd").alias("day"), "dl_code") if per_day else table(s, f, "events").select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("D").alias("dl_code"))
    e.repartition(4, "day").write.option("header", True).csv(folder)
    return folder


def _streamed(s, f):
    folder, out = _stream_source(s, f, False), scratch_path(s, "streamed")
    checkpoint = scratch_path(s, "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        src = stream.stream_tapes(s, folder, [*_EV, "dl_code"], max_files=1, file_keys=False)
        stream.stream_to_parquet(src, out, checkpoint)
    return _count(s.read.parquet(out), "day", "event_type")


add("str1_stream_tapes", _streamed, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")


def _streamed_bronze(s, f):
    folder, path = _stream_source(s, f, True), scratch_path(s, "stream-bronze")
    src = stream.stream_tapes(s, folder, [*_EV, "dl_code"], max_files=1, file_keys=False).withColumnRenamed("day", "pcd").drop("filename")
    stream.stream_bronze(src.withColumn("user_id", F.col("user_id").cast("long")), path, ["dl_code", "user_id"], scratch_path(s, "stream-checkpoint"), ["event_type"])
    return tapes.read_bronze(s, path).where("valid_to IS NULL OR valid_to > valid_from").select(*_HCOLS)


add("str2_stream_bronze", _streamed_bronze, _HIST_SQL + " SELECT * FROM h")


def _streamed_mixed(s, f):
    """Events as files that arrive with their fields in two orders."""
    folder, out = scratch_path(s, "arriving"), scratch_path(s, "streamed")
    e = table(s, f, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    for i, cols in enumerate((["user_id", "event_type", "day"], ["day", "user_id", "event_type"])):
        e.where(F.pmod("user_id", F.lit(2)) == i).select(*cols).coalesce(2).write.mode("append").option("header", True).csv(folder)
    keep = lambda df, _: df.select("user_id", "event_type", "day").write.mode("append").parquet(out)
    stream.stream_tape_files(s, folder, keep, scratch_path(s, "checkpoint"), max_files=2, file_keys=False)
    return _count(s.read.parquet(out), "day", "event_type")


add("str1_stream_mixed_headers", _streamed_mixed, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
