"""Feature tests against the target, rankings, and drift by week."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalar as S
from ..operators import assoc as A
from ..operators import drift as D
from ..operators import joins
from ..operators.ecdf import value_ecdf
from ..sources.tables import transactions as tx
from ..sources.tables import tx_sql
from .profiles import WEEK, union, weekly
from .rows import r6

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


CONT = ["monto", "b", "d", "m", "score", "l"]
CATS = ["a", "g", "o", "p", "n"]

_LONG = "v AS (" + union(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, fraude AS y FROM tx WHERE {c} IS NOT NULL" for c in CONT) + ")"
_VC = "vc AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1 FROM (SELECT feature, value, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM v GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value))"
_TOT = "tot AS (SELECT feature, count(*) FILTER (y = 0) AS t0, count(*) FILTER (y = 1) AS t1, avg(value) FILTER (y = 0) AS m0, avg(value) FILTER (y = 1) AS m1, var_samp(value) FILTER (y = 0) AS v0, var_samp(value) FILTER (y = 1) AS v1, corr(value, y) AS r FROM v GROUP BY 1)"
_STAT = "st AS (SELECT feature, any_value(t0) AS n0, any_value(t1) AS n1, sum(n0 * (c1 - n1 / 2)) AS u0, sum((n0 + n1)::DOUBLE ** 3 - (n0 + n1)) AS ties, max(abs(c0 / t0 - c1 / t1)) AS ks, any_value(r) AS r, any_value((m1 - m0) / sqrt(((t0 - 1) * v0 + (t1 - 1) * v1) / (t0 + t1 - 2))) AS d FROM vc JOIN tot USING (feature) GROUP BY feature)"
ctes = (_LONG, _VC, _TOT, _STAT)
stats = lambda s, d: A.continuous_statistics(value_ecdf(tx(s, d), CONT, "fraude"))

add("t1_value_ecdf", lambda s, d: value_ecdf(tx(s, d), CONT, "fraude").select("feature", r6("value"), "n0", "n1", "cum_n0", "cum_n1"), tx_sql("SELECT feature, round(value, 6) AS value, n0, n1, c0::BIGINT AS cum_n0, c1::BIGINT AS cum_n1 FROM vc", _LONG, _VC))
add("t2_mann_whitney", lambda s, d: stats(s, d).select("feature", "n0", "n1", F.round("mannwhitney_stat", 1).alias("u0"), r6("mannwhitney_z", "z")), tx_sql("SELECT feature, n0, n1, round(u0, 1) AS u0, round((greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))), 6) AS z FROM st", *ctes))
add("t3_ks_test", lambda s, d: stats(s, d).select("feature", r6("ks_stat")), tx_sql("SELECT feature, round(ks, 6) AS ks_stat FROM st", *ctes))
add("t4_point_biserial", lambda s, d: stats(s, d).select("feature", r6("point_biserial_corr", "r"), r6("point_biserial_t", "t")), tx_sql("SELECT feature, round(r, 6) AS r, round(r * sqrt((n0 + n1 - 2) / (1 - r * r)), 6) AS t FROM st", *ctes))
add("t5_auc", lambda s, d: stats(s, d).select("feature", r6("auc"), r6("auc_abs"), "auc_interpretation"), tx_sql(f"SELECT feature, round(1 - u0 / (n0 * n1), 6) AS auc, round(greatest(u0 / (n0 * n1), 1 - u0 / (n0 * n1)), 6) AS auc_abs, {L.label_sql('greatest(u0 / (n0 * n1), 1 - u0 / (n0 * n1))', L.AUC)} AS auc_interpretation FROM st", *ctes))
add("t6_cohens_d", lambda s, d: stats(s, d).select("feature", r6("cohens_d"), "cohens_d_interpretation"), tx_sql(f"SELECT feature, round(d, 6) AS cohens_d, {L.label_sql('abs(d)', L.COHEN_D)} AS cohens_d_interpretation FROM st", *ctes))
# a binary predictor has its slope and error in closed form: the log odds ratio and the root of the sum of inverse counts
add("t7_logit_wald_binary", lambda s, d: A.logit_wald(value_ecdf(tx(s, d), ["n"], "fraude")).select("feature", F.round("logit_beta", 5).alias("beta"), F.round("logit_odds_ratio", 5).alias("odds_ratio"), F.col("logit_separation_detected").alias("separation")), tx_sql("SELECT 'n' AS feature, round(ln(a * d / (b * c)), 5) AS beta, round(a * d / (b * c), 5) AS odds_ratio, false AS separation FROM (SELECT (count(*) FILTER (n = 1 AND fraude = 1))::DOUBLE AS a, (count(*) FILTER (n = 1 AND fraude = 0))::DOUBLE AS b, (count(*) FILTER (n = 0 AND fraude = 1))::DOUBLE AS c, (count(*) FILTER (n = 0 AND fraude = 0))::DOUBLE AS d FROM tx)"))
add("t7_logit_wald", lambda s, d: A.logit_wald(value_ecdf(tx(s, d), CONT, "fraude")))

_CC = "cc AS (" + union(f"SELECT '{c}' AS feature, coalesce({c}::VARCHAR, '__MISSING__') AS category, count(*) FILTER (fraude = 0) AS n0, count(*) FILTER (fraude = 1) AS n1 FROM tx GROUP BY 2" for c in CATS) + ")"
_CHI = "x AS (SELECT feature, dof, n, sum(CASE WHEN dof = 1 THEN (abs(o - e) - least(0.5, abs(o - e))) ** 2 / e ELSE (o - e) ** 2 / e END) AS chi2 FROM (SELECT feature, lv - 1 AS dof, g + b AS n, unnest([n0, n1]) AS o, unnest([(n0 + n1) * g / (g + b), (n0 + n1) * b / (g + b)]) AS e FROM cc JOIN (SELECT feature, sum(n0) AS g, sum(n1) AS b, count(*) AS lv FROM cc GROUP BY 1) USING (feature)) GROUP BY 1, 2, 3)"
counts = lambda s, d: A.category_counts(tx(s, d), CATS, "fraude")
add("t8_chi_square", lambda s, d: A.chi_square(counts(s, d)).select("feature", r6("chi2_stat"), "chi2_dof"), tx_sql("SELECT feature, round(chi2, 6) AS chi2_stat, dof::INT AS chi2_dof FROM x", _CC, _CHI))
add("t9_cramers_v", lambda s, d: A.chi_square(counts(s, d)).select("feature", r6("cramers_v"), "cramers_v_interpretation"), tx_sql(f"SELECT feature, round(sqrt(chi2 / n), 6) AS cramers_v, {L.label_sql('sqrt(chi2 / n)', L.CRAMERS_V)} AS cramers_v_interpretation FROM x", _CC, _CHI))
_COL = "k20 AS (SELECT feature, CASE WHEN lv > 20 AND pos >= 20 THEN '__OTHER__' ELSE category END AS category, sum(n0) AS n0, sum(n1) AS n1 FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n0 + n1 DESC, category) AS pos, count(*) OVER (PARTITION BY feature) AS lv FROM cc) GROUP BY 1, 2)"
_WOE = "woe AS (SELECT feature, category, n0, n1, pg, pb, ln(pg / pb) AS woe, (pg - pb) * ln(pg / pb) AS iv FROM (SELECT *, (n0 + 0.5) / (sum(n0) OVER w + 0.5 * count(*) OVER w) AS pg, (n1 + 0.5) / (sum(n1) OVER w + 0.5 * count(*) OVER w) AS pb FROM k20 WINDOW w AS (PARTITION BY feature)))"
woe = lambda s, d: A.woe_table(counts(s, d))
add("t10_woe_table", lambda s, d: woe(s, d).select("variable", "categoria", "n_total", "n_good", "n_bad", r6("pct_good"), r6("pct_bad"), r6("woe"), r6("iv_contribution")), tx_sql("SELECT feature AS variable, category AS categoria, (n0 + n1)::BIGINT AS n_total, n0::BIGINT AS n_good, n1::BIGINT AS n_bad, round(pg, 6) AS pct_good, round(pb, 6) AS pct_bad, round(woe, 6) AS woe, round(iv, 6) AS iv_contribution FROM woe", _CC, _COL, _WOE))
add("t11_information_value", lambda s, d: A.information_value(woe(s, d)).select("variable", r6("iv"), "iv_interpretation"), tx_sql(f"SELECT feature AS variable, round(sum(iv), 6) AS iv, {L.label_sql('sum(iv)', L.IV)} AS iv_interpretation FROM woe GROUP BY feature", _CC, _COL, _WOE))
_AUCW = "aw AS (SELECT feature, sum(n1 * (c0 - n0 / 2)) / (sum(n0) * sum(n1)) AS auc FROM (SELECT *, sum(n0) OVER (PARTITION BY feature ORDER BY w) AS c0 FROM (SELECT feature, round(woe, 12) AS w, sum(n0) AS n0, sum(n1) AS n1 FROM woe GROUP BY 1, 2)) GROUP BY feature)"
add("t12_auc_woe", lambda s, d: A.auc_woe(woe(s, d)).select("variable", r6("auc_woe"), r6("auc_woe_abs"), "auc_woe_interpretation"), tx_sql(f"SELECT feature AS variable, round(auc, 6) AS auc_woe, round(greatest(auc, 1 - auc), 6) AS auc_woe_abs, {L.label_sql('greatest(auc, 1 - auc)', L.AUC)} AS auc_woe_interpretation FROM aw", _CC, _COL, _WOE, _AUCW))
_XLN = lambda a, t: f"CASE WHEN {a} > 0 THEN {a} * ln({a} / ({t})) ELSE 0 END"
add("t13_lr_test", lambda s, d: A.lr_test(counts(s, d)).select("feature", r6("lr_stat"), "lr_dof", "lr_separation_detected"), tx_sql(f"SELECT feature, round(greatest(0, 2 * (sum({_XLN('n0', 'n0 + n1')} + {_XLN('n1', 'n0 + n1')}) - any_value({_XLN('g', 'g + b')} + {_XLN('b', 'g + b')}))), 6) AS lr_stat, (count(*) - 1)::INT AS lr_dof, bool_or(n0 = 0 OR n1 = 0) OR count(*) = 1 AS lr_separation_detected FROM k20 JOIN (SELECT feature, sum(n0) AS g, sum(n1) AS b FROM cc GROUP BY 1) USING (feature) GROUP BY feature", _CC, _COL))

batteries = lambda s, d: (A.continuous_battery(tx(s, d), CONT, "fraude"), A.categorical_battery(tx(s, d), CATS, "fraude"))
add("t14_continuous_battery", lambda s, d: batteries(s, d)[0])
add("t14_categorical_battery", lambda s, d: batteries(s, d)[1])
ranking = lambda s, d: A.feature_ranking(*batteries(s, d))
add("t15_feature_ranking", ranking)
add("t16_feature_summary", lambda s, d: A.feature_summary(ranking(s, d), tuple(CONT + CATS)))


def _made(s, d):
    """Features of every kind that the summary has words for, beside some original ones."""
    t = tx(s, d)
    made = {"ratio_monto_l": S.ratio("monto", "l"), "fecha_hour": S.hour("fecha"), "fecha_weekday": S.weekday("fecha"), "fecha_is_weekend": S.is_weekend("fecha"), "f_log": S.log_feature("f"), "b_missing": S.missing_flag("b"), "e_is_zero": S.zero_flag("e"), "other": F.col("score") * 2}
    return A.feature_summary(A.feature_ranking(A.continuous_battery(t.withColumns(made), ["monto", *made], "fraude"), A.categorical_battery(t, ["o"], "fraude")), ("monto", "o")).select("variable", "transformacion_aplicada", "tipo_test_aplicado", F.round("auc_abs", 6).alias("auc_abs"))


_MADE = {"monto": ("monto", A.ORIGINAL), "ratio_monto_l": ("CASE WHEN l = 0 THEN NULL ELSE monto / l END", "Ratio monto / l"), "fecha_hour": ("hour(fecha)", "Extracción de hora del día"), "fecha_weekday": ("(isodow(fecha) - 1)", "Extracción de día de la semana"), "fecha_is_weekend": ("(isodow(fecha) > 5)::INT", "Extracción de indicador de fin de semana"), "f_log": ("CASE WHEN f > -1 THEN ln(1 + f) END", "Transformación logarítmica (log1p)"), "b_missing": ("(b IS NULL)::INT", "Missing indicator (flag de nulo)"), "e_is_zero": ("coalesce(e = 0, false)::INT", "Zero flag (flag de valor cero)"), "other": ("score * 2", A.UNKNOWN)}
_RANKED = "SELECT '{0}' AS variable, '{2}' AS transformacion_aplicada, '{3}' AS tipo_test_aplicado, (SELECT round(greatest(a, 1 - a), 6) FROM (SELECT sum(n1 * (c0 - n0 / 2)) / (sum(n0) * sum(n1)) AS a FROM (SELECT *, sum(n0) OVER (ORDER BY v) AS c0 FROM (SELECT {1} AS v, count(*) FILTER (fraude = 0) AS n0, count(*) FILTER (fraude = 1) AS n1 FROM tx WHERE {1} IS NOT NULL GROUP BY 1)))) AS auc_abs"
_WOE_O = "(SELECT ln(((count(*) FILTER (x.fraude = 0) + 0.5) / ((SELECT count(*) FROM tx WHERE fraude = 0) + 1.5)) / ((count(*) FILTER (x.fraude = 1) + 0.5) / ((SELECT count(*) FROM tx WHERE fraude = 1) + 1.5))) FROM tx x WHERE x.o IS NOT DISTINCT FROM tx.o)"
add("t16_transformations", _made, tx_sql(" UNION ALL ".join([_RANKED.format(n, e, w, A.TESTS[A.CONTINUOUS].replace("'", "''")) for n, (e, w) in _MADE.items()] + [_RANKED.format("o", _WOE_O, A.ORIGINAL, A.TESTS[A.CATEGORICAL])])))
add("t17_logit_comparison", lambda s, d: A.logit_comparison(tx(s, d), ["monto", "d", "h"], "fraude", without=("d", "h")))
add("p12_labels", lambda s, d: stats(s, d).select("feature", "auc_interpretation", "cohens_d_interpretation"), tx_sql(f"SELECT feature, {L.label_sql('greatest(u0 / (n0 * n1), 1 - u0 / (n0 * n1))', L.AUC)} AS auc_interpretation, {L.label_sql('abs(d)', L.COHEN_D)} AS cohens_d_interpretation FROM st", *ctes))


def _origins(s, d):
    t = tx(s, d).withColumn("log_monto", S.log_feature("monto")).withColumn("monto_per_l", S.ratio("monto", "l"))
    metrics = A.continuous_statistics(value_ecdf(t, ["monto", "log_monto", "monto_per_l"], "fraude")).select(F.col("feature").alias("variable"), r6("auc_abs"))
    return joins.feature_vs_origin(metrics, s.createDataFrame([("log_monto", "monto"), ("monto_per_l", "monto")], "variable string, origin string")).select("variable", "origin", "auc_abs", "origin_auc", r6("delta"), "improved")


_U = lambda x: f"(SELECT round(greatest(a, 1 - a), 6) FROM (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 0) * count(*) FILTER (y = 1)) AS a FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM (SELECT fraude AS y, {x} AS v FROM tx) WHERE v IS NOT NULL)))"
add("j5_feature_vs_origin", _origins, tx_sql(f"SELECT variable, 'monto' AS origin, auc_abs, o AS origin_auc, round(auc_abs - o, 6) AS delta, auc_abs - o > 0 AS improved FROM (SELECT 'log_monto' AS variable, {_U('CASE WHEN monto > -1 THEN ln(1 + monto) END')} AS auc_abs UNION ALL SELECT 'monto_per_l', {_U('CASE WHEN l <> 0 THEN monto / l END')}), (SELECT {_U('monto')} AS o)"))

# --- drift ------------------------------------------------------------------------------------------------------------------------
WEEKS = [1, 2, 3, 4]
_WTX = f"wt AS (SELECT *, {WEEK} AS week FROM tx)"
_WV = "wv AS (" + union(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, week FROM wt WHERE {c} IS NOT NULL" for c in ("monto", "score", "b")) + ")"
_KS = "ks AS (SELECT feature, week, max(abs(cw / tw - cr / tr)) AS ks, any_value(tr) AS n_ref, any_value(tw) AS n_cur FROM (SELECT *, sum(nw) OVER w AS cw, sum(nr) OVER w AS cr, sum(nw) OVER p AS tw, sum(nr) OVER p AS tr FROM (SELECT feature, t.week, value, count(*) FILTER (wv.week = t.week) AS nw, count(*) FILTER (wv.week = 0) AS nr FROM wv, (VALUES (1), (2), (3), (4)) t(week) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY feature, week ORDER BY value), p AS (PARTITION BY feature, week)) GROUP BY 1, 2)"
_X = "(ks * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)))"
_KS_P = f"""round(CASE WHEN {_X} < 1e-6 THEN 1.0 WHEN {_X} < 0.5 THEN greatest(0.0, 1 - sqrt(2 * pi()) / {_X} * list_sum([exp(-((2 * i - 1) * (2 * i - 1)) * pi() * pi() / (8 * {_X} * {_X})) FOR i IN range(1, 101)]))
    WHEN {_X} IS NOT NULL THEN greatest(0.0, least(1.0, 2 * list_sum([(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * {_X} * {_X}) FOR i IN range(1, 101)]))) END, 6)"""
ks = lambda s, d: D.ks_drift(weekly(s, d), ["monto", "score", "b"], "week", WEEKS)
add("d1_ks_drift", lambda s, d: ks(s, d).select("feature", "week", r6("ks_stat"), "n_ref", "n_cur", r6("ks_p_value"), "ks_label"), tx_sql(f"SELECT feature, week, round(ks, 6) AS ks_stat, n_ref::BIGINT AS n_ref, n_cur::BIGINT AS n_cur, {_KS_P} AS ks_p_value, {L.label_sql('ks', L.KS_DRIFT, missing=L.NO_DATA)} AS ks_label FROM ks", _WTX, _WV, _KS))
_PC = "pc AS (SELECT feature, week, category, count(*) AS n FROM (" + union(f"SELECT '{c}' AS feature, week, coalesce({c}::VARCHAR, '__MISSING__') AS category FROM wt" for c in ("g", "o", "j")) + ") GROUP BY 1, 2, 3)"
_TOP = "tp AS (SELECT feature, category FROM pc WHERE week = 0 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, category) < 20)"
_SH = "sh AS (SELECT feature, week, category, n / sum(n) OVER (PARTITION BY feature, week) AS pct FROM (SELECT pc.feature, week, CASE WHEN tp.category IS NULL THEN '__OTHER__' ELSE pc.category END AS category, sum(n) AS n FROM pc LEFT JOIN tp ON pc.feature = tp.feature AND pc.category = tp.category GROUP BY 1, 2, 3))"
_PSI = "ps AS (SELECT feature, week, sum((c - r) * ln(c / r)) AS psi FROM (SELECT f.feature, f.week, coalesce(s.pct, 0) + 1e-4 AS c, coalesce(r.pct, 0) + 1e-4 AS r FROM (SELECT DISTINCT feature, category, w AS week FROM sh, (VALUES (1), (2), (3), (4)) t(w) WHERE sh.week = 0 OR sh.week = w) f LEFT JOIN sh s ON s.feature = f.feature AND s.category = f.category AND s.week = f.week LEFT JOIN sh r ON r.feature = f.feature AND r.category = f.category AND r.week = 0) GROUP BY 1, 2)"
psi = lambda s, d: D.psi(weekly(s, d), ["g", "o", "j"], "week", WEEKS)
add("d2_psi", lambda s, d: psi(s, d).select("feature", "week", r6("psi"), "psi_label"), tx_sql(f"SELECT feature, week, round(psi, 6) AS psi, {L.label_sql('psi', L.PSI, missing=L.NO_DATA)} AS psi_label FROM ps", _WTX, _PC, _TOP, _SH, _PSI))
add("d3_drift_pivot", lambda s, d: D.drift_pivot(ks(s, d).withColumn("ks_stat", r6("ks_stat")), "ks_stat", WEEKS), tx_sql("SELECT feature, " + ", ".join(f"round(max(ks) FILTER (week = {w}), 6) AS week_{w}" for w in WEEKS) + " FROM ks GROUP BY feature", _WTX, _WV, _KS))
add("d4_drift_summary", lambda s, d: D.drift_summary(psi(s, d), "psi", L.PSI), tx_sql(f"SELECT feature, round(max(psi), 4) AS worst, arg_max(week, (psi, -week)) AS worst_week, round(avg(psi), 4) AS mean, {L.label_sql('max(psi)', L.PSI, missing=L.NO_DATA)} AS alert FROM ps GROUP BY feature", _WTX, _PC, _TOP, _SH, _PSI))
