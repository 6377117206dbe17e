"""Profiles and business figures over the transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import OUTLIERS, SKEW, label_sql
from ..functions.scalar import with_week_index
from ..operators import profile as P
from ..operators.windows import velocity_grid
from ..sources.tables import transactions as tx
from ..sources.tables import tx_sql
from .rows import r6, text

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


NUM = ["monto", "b", "c", "d", "e", "f", "h", "l", "m"]
CAT = ["a", "g", "o", "p"]
ALL = ["k", "fecha", "j", "monto", "fraude", "score", *CAT, "n", *[c for c in NUM if c != "monto"]]
WEEK = "floor(datediff('day', (SELECT min(fecha)::DATE FROM tx), fecha::DATE) / 7)::INT"
weekly = lambda s, d: with_week_index(tx(s, d), "fecha")
union = " UNION ALL ".join


def _structure_sql(c):
    numeric = c in (*NUM, "k", "fraude", "score", "a", "n")
    kind = "numerica" if numeric else "fecha" if c == "fecha" else "categorica"
    zero = f"count(*) FILTER ({c} = 0)" if numeric else "NULL::BIGINT"
    pct = f"round(count(*) FILTER ({c} = 0) / count(*), 4)" if numeric else "NULL::DOUBLE"
    return f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(DISTINCT {c}) = 2 AS is_binary, count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count(*), 4) AS pct_unique, count(*) FILTER ({c} IS NULL) AS n_null, round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS pct_null, {zero} AS n_zero, {pct} AS pct_zero FROM tx"


add("a1_general_structure", lambda s, d: P.general_structure(tx(s, d).select(ALL)), tx_sql(union(_structure_sql(c) for c in ALL)))
add("a2_date_range", lambda s, d: P.date_range_summary(tx(s, d), ["fecha"]).select("column_name", text("first", "first_ts"), text("last", "last_ts"), "days_covered", "n"), tx_sql("SELECT 'fecha' AS column_name, strftime(min(fecha), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(fecha), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, floor((epoch_us(max(fecha)) - epoch_us(min(fecha))) / 86400000000)::BIGINT AS days_covered, count(fecha) AS n FROM tx"))
add("a3_id_like_columns", lambda s, d: P.id_like_columns(tx(s, d)), tx_sql("SELECT column_name, n_unique, pct_unique, CASE WHEN pct_unique >= 0.9 THEN 'unique' WHEN column_name = 'j' THEN 'prefix' ELSE 'name' END AS reason FROM (" + union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count(*), 4) AS pct_unique FROM tx" for c in ALL if c != "fecha") + ") WHERE pct_unique >= 0.9 OR column_name = 'j'"))
_PERIOD = {"D": "strftime(fecha, '%Y-%m-%d')", "W": "strftime(date_trunc('week', fecha), '%Y-%m-%d') || '/' || strftime(date_trunc('week', fecha) + INTERVAL 6 DAY, '%Y-%m-%d')", "M": "strftime(fecha, '%Y-%m')"}
for _f, _n in (("D", "daily"), ("W", "weekly"), ("M", "monthly")):
    add(f"a4_target_{_n}", lambda s, d, f=_f: P.target_by_period(tx(s, d), "fecha", "fraude", f), tx_sql(f"SELECT {_PERIOD[_f]} AS period, count(fraude) AS n_total, sum(fraude)::BIGINT AS n_pos, (count(fraude) - sum(fraude))::BIGINT AS n_neg, round(sum(fraude) / count(fraude), 4) AS rate FROM tx GROUP BY 1"))
_SIDES = "coalesce(sum(monto) FILTER (fraude = 0), 0) AS a0, coalesce(sum(monto) FILTER (fraude = 1), 0) AS a1"
add("a5_daily_amount", lambda s, d: P.daily_amount(tx(s, d), "fecha", "fraude", "monto"), tx_sql(f"SELECT period, round(a0, 2) AS amount_neg, round(a1, 2) AS amount_pos, round(a0 + a1, 2) AS amount_total, round(a1 / (a0 + a1), 4) AS pct_pos FROM (SELECT {_PERIOD['D']} AS period, {_SIDES} FROM tx GROUP BY 1)"))
IMPACT_SQL = tx_sql(f"SELECT period, round(a0, 2) AS amount_neg, round(a1, 2) AS amount_pos, round(0.25 * a0, 4) AS gain, round(a1, 4) AS loss, round(0.25 * a0 - a1, 4) AS net FROM (SELECT CASE WHEN grouping(day) = 1 THEN 'TOTAL' ELSE day END AS period, {_SIDES} FROM (SELECT *, {_PERIOD['D']} AS day FROM tx) GROUP BY ROLLUP (day))")
add("a6_economic_impact", lambda s, d: P.economic_impact(tx(s, d), "fecha", "fraude", "monto"), IMPACT_SQL)
_COUNTS = "c AS (" + union(f"SELECT '{c}' AS column_name, coalesce({c}::VARCHAR, '(nulo)') AS value, count(*) AS n FROM tx GROUP BY 2" for c in CAT) + ")"
_RANKED = "r AS (SELECT *, sum(pct) OVER (PARTITION BY column_name ORDER BY pos) AS cum FROM (SELECT *, round(n / (SELECT count(*) FROM tx), 4) AS pct, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS pos FROM c))"
add("a7_concentration", lambda s, d: P.categorical_concentration(tx(s, d), CAT), tx_sql("SELECT column_name, value AS category, n, pct, round(cum, 4) AS pct_cum FROM r WHERE pos <= 10 UNION ALL SELECT column_name, 'otros (' || count(*) || ' categorías)', sum(n)::BIGINT, round(sum(pct), 4), 1.0 FROM r WHERE pos > 10 GROUP BY column_name", _COUNTS, _RANKED))
add("a8_concentration_summary", lambda s, d: P.concentration_summary(tx(s, d), CAT), tx_sql("SELECT column_name, count(*) AS n_categories, max(value) FILTER (pos = 1) AS top1, max(pct) FILTER (pos = 1) AS top1_pct, round(sum(pct) FILTER (pos <= 3), 4) AS top3_pct, round(sum(pct * pct), 4) AS hhi FROM r GROUP BY column_name", _COUNTS, _RANKED))
add("w7_cumulative_share", lambda s, d: P._ranked(tx(s, d), ["g"]).select("value", "n", F.round("cum", 4).alias("cum")), tx_sql("SELECT value, n, round(cum, 4) AS cum FROM r WHERE column_name = 'g'", _COUNTS, _RANKED))


def _dist_sql(c):
    return f"""SELECT '{c}' AS column_name, round(mean, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(sk, 4) AS skew, {label_sql('abs(sk)', SKEW, True)} AS skew_label, n_out AS n_outliers,
        round(n_out / n, 4) AS pct_outliers, {label_sql('round(n_out / n, 4)', OUTLIERS, True)} AS outlier_label FROM (SELECT any_value(mean) AS mean, any_value(med) AS med, any_value(sd) AS sd, any_value(lo) AS lo, any_value(hi) AS hi, any_value(sk) AS sk, any_value(s.n) AS n,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_out FROM tx, (SELECT avg({c}) AS mean, median({c}) AS med, stddev_samp({c}) AS sd, min({c}) AS lo, max({c}) AS hi, skewness({c}) AS sk, count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM tx) s)"""


add("a9_numeric_distribution", lambda s, d: P.numeric_distribution(tx(s, d), NUM), tx_sql(union(_dist_sql(c) for c in NUM)))
add("a10_category_rate", lambda s, d: P.category_rate(tx(s, d), "g", "fraude"), tx_sql("SELECT category, n_total, n_pos, rate, round(rate / (SELECT avg(fraude) FROM tx), 2) AS lift FROM (SELECT coalesce(g, '(nulo)') AS category, count(fraude) AS n_total, sum(fraude)::BIGINT AS n_pos, round(sum(fraude) / count(fraude), 4) AS rate FROM tx GROUP BY 1 HAVING count(fraude) >= 30)"))
CORR = ["monto", "b", "d", "m", "l"]
_corr = lambda a, b: f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS r FROM tx"
add("a11_correlation_matrix", lambda s, d: P.correlation_matrix(tx(s, d), CORR).select("variable_1", "variable_2", r6("corr")), tx_sql("SELECT variable_1, variable_2, round(r, 6) AS corr FROM (" + union(_corr(a, b) for a in CORR for b in CORR) + ")"))
_MID = lambda c: f"SELECT k, '{c}' AS column_name, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rank FROM tx WHERE {c} IS NOT NULL"
_TAU = ["n", "monto", "score", "d"]
_CON = "count(*) FILTER ((x.{0} - y.{0}) * (x.{1} - y.{1}) > 0)"
_DIS = "count(*) FILTER ((x.{0} - y.{0}) * (x.{1} - y.{1}) < 0)"
_FREE = "count(*) FILTER (x.{0} <> y.{0} AND x.{1} IS NOT NULL AND y.{1} IS NOT NULL)"
add("a11_kendall", lambda s, d: P.correlation_matrix(tx(s, d), _TAU, "kendall").select("variable_1", "variable_2", r6("corr")), tx_sql(" UNION ALL ".join(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, " + ("1.0::DOUBLE" if a == b else f"(SELECT round(({_CON} - {_DIS}) / sqrt({_FREE}::DOUBLE * {_FREE.replace('{0}', '{2}').replace('{1}', '{0}').replace('{2}', '{1}')}::DOUBLE), 6) FROM tx x JOIN tx y ON x.k < y.k)".format(a, b)) + " AS corr" for a in _TAU for b in _TAU)))
add("w11_mid_ranks", lambda s, d: P.mid_ranks(tx(s, d), ["score", "d"], "k"), tx_sql(union(_MID(c) for c in ("score", "d"))))
add("a11_spearman", lambda s, d: P.correlation_matrix(tx(s, d), ["monto", "score", "d"], "spearman", "k").select("variable_1", "variable_2", r6("corr")), tx_sql("SELECT x.column_name AS variable_1, y.column_name AS variable_2, round(corr(x.rank, y.rank), 6) AS corr FROM r x JOIN r y USING (k) GROUP BY 1, 2", "r AS (" + union(_MID(c) for c in ("monto", "score", "d")) + ")"))
add("a12_correlation_with_target", lambda s, d: P.correlation_with_target(tx(s, d), NUM, "fraude"), tx_sql(union(f"SELECT '{c}' AS column_name, round(corr({c}, fraude), 4) AS corr, round(abs(corr({c}, fraude)), 4) AS abs_corr FROM tx" for c in NUM)))
add("a13_high_correlation", lambda s, d: P.high_correlation_pairs(tx(s, d), NUM, 0.5), tx_sql("SELECT variable_1, variable_2, round(r, 4) AS corr FROM (" + union(_corr(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]) + ") WHERE abs(r) >= 0.5"))
# two columns: both inflations are 1 / (1 - r^2)
add("a14_vif", lambda s, d: P.vif(tx(s, d), ["d", "m"]), tx_sql("SELECT v AS column_name, round(1 / (1 - r * r), 4) AS vif, CASE WHEN 1 / (1 - r * r) > 10 THEN 'severa' WHEN 1 / (1 - r * r) > 5 THEN 'moderada' ELSE 'baja' END AS multicollinearity, n AS n_rows FROM (SELECT corr(d, m) AS r, count(*) AS n FROM tx WHERE d IS NOT NULL AND m IS NOT NULL), (VALUES ('d'), ('m')) t(v)"))
add("a15_week_summary", lambda s, d: P.week_summary(weekly(s, d), "week", "fecha", "fraude").select("week", "n", "rate_pct", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day")), tx_sql(f"SELECT {WEEK} AS week, count(*) AS n, round(avg(fraude) * 100, 4) AS rate_pct, min(fecha)::DATE::VARCHAR AS first_day, max(fecha)::DATE::VARCHAR AS last_day FROM tx GROUP BY 1"))
add("a16_null_rate_by_week", lambda s, d: P.null_rate_by_week(weekly(s, d), "week", ["b", "d", "o"]), tx_sql(union(f"SELECT {WEEK} AS week, '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 4) AS pct_null FROM tx GROUP BY 1" for c in ("b", "d", "o"))))
_HIST = lambda c: f"""SELECT '{c}' AS column_name, grp AS "group", bin, round(lo + bin * width, 6) AS low, count(*) AS n, round(count(*) / (any_value(total) * width), 8) AS density FROM (SELECT s.*, CASE WHEN hi > lo THEN (hi - lo) / 40 ELSE 1.0 END AS width, least(floor((v - lo) / (CASE WHEN hi > lo THEN (hi - lo) / 40 ELSE 1.0 END)), 39)::INT AS bin
    FROM (SELECT fraude AS grp, {c} AS v, min({c}) OVER (PARTITION BY fraude) AS lo, max({c}) OVER (PARTITION BY fraude) AS hi, count({c}) OVER (PARTITION BY fraude) AS total FROM tx WHERE {c} IS NOT NULL) s) GROUP BY grp, bin, lo, width"""  # noqa: E731
add("a18_histogram", lambda s, d: P.histogram_by_group(tx(s, d), ["monto", "d"], "fraude"), tx_sql(union(_HIST(c) for c in ("monto", "d"))))
_BOX = lambda c, g: f"""SELECT '{c}' AS column_name, grp AS "group", round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS high
    FROM (SELECT {g} AS grp, {c} AS v FROM tx WHERE {c} IS NOT NULL) JOIN (SELECT {g} AS grp, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM tx WHERE {c} IS NOT NULL GROUP BY 1) USING (grp) GROUP BY grp"""  # noqa: E731
add("a19_box_by_class", lambda s, d: P.box_stats_by_group(tx(s, d), ["monto", "l"], "fraude"), tx_sql(union(_BOX(c, "fraude") for c in ("monto", "l"))))
add("a19_box_by_week", lambda s, d: P.box_stats_by_group(weekly(s, d), ["monto"], "week"), tx_sql(_BOX("monto", WEEK)))
add("a20_category_share", lambda s, d: P.category_share_by_week(weekly(s, d), "g", "week"), tx_sql("""SELECT week, category, round(coalesce(n, 0) / total, 6) AS share FROM (SELECT DISTINCT week FROM c) CROSS JOIN (SELECT category FROM top UNION ALL SELECT '__OTHER__') JOIN (SELECT week, sum(n) AS total FROM c GROUP BY week) USING (week)
    LEFT JOIN (SELECT week, CASE WHEN category IN (SELECT category FROM top) THEN category ELSE '__OTHER__' END AS category, sum(n) AS n FROM c GROUP BY 1, 2) USING (week, category)""", f"c AS (SELECT {WEEK} AS week, coalesce(g, '__MISSING__') AS category, count(*) AS n FROM tx GROUP BY 1, 2)", "top AS (SELECT category FROM c WHERE week = 0 ORDER BY n DESC, category LIMIT 6)"))
add("a21_velocity_null_share", lambda s, d: P.null_share(velocity_grid(tx(s, d), windows=("1h", "1d"), aggregates=("sum",)), ["monto_sum_1h", "monto_sum_1d"]), tx_sql(union(f"SELECT 'monto_sum_{n}' AS column_name, round(avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END), 6) AS share FROM (SELECT sum(monto) OVER (PARTITION BY j ORDER BY fecha RANGE BETWEEN INTERVAL '{h} hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING) AS x FROM tx)" for n, h in (("1h", 1), ("1d", 24)))))
add("a22_label_distribution", lambda s, d: P.label_distribution(tx(s, d), "o"), tx_sql("SELECT o AS label, count(*) AS n FROM tx GROUP BY o"))
