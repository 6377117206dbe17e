"""Fitted transforms: learnt on the first days, applied to all rows or to the later ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitted as T
from ..plans import pipeline
from ..sources.tables import transactions as tx
from ..sources.tables import tx_sql
from .rows import r6

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


CUT = "timestamp'2024-01-21'"
train = lambda s, d: tx(s, d).where(f"fecha < {CUT}")
TRAIN = "train AS (SELECT * FROM tx WHERE fecha < TIMESTAMP '2024-01-21')"


def fit_apply(name, make, columns, sql, *ctes):
    add(name, lambda s, d: make().fit(train(s, d)).transform(tx(s, d)).select("k", *columns()), tx_sql(sql, TRAIN, *ctes))


fit_apply("f1_top_percentile", lambda: T.TopPercentileFlag("monto", 0.99, name="top"), lambda: ["top"], "SELECT k, CASE WHEN monto >= (SELECT quantile_cont(monto, 0.99) FROM train) THEN 1 ELSE 0 END AS top FROM tx")
fit_apply("f1_bottom_percentile", lambda: T.TopPercentileFlag("c", 0.05, "bottom", "low"), lambda: ["low"], "SELECT k, CASE WHEN c <= (SELECT quantile_cont(c, 0.05) FROM train) THEN 1 ELSE 0 END AS low FROM tx")
fit_apply("f2_quantile_bins", lambda: T.QuantileBins("monto", 5, name="bin"), lambda: ["bin"], "SELECT k, CASE WHEN monto IS NULL THEN '__MISSING__' ELSE (CASE WHEN monto <= q[1] THEN '0' WHEN monto <= q[2] THEN '1' WHEN monto <= q[3] THEN '2' WHEN monto <= q[4] THEN '3' ELSE '4' END) END AS bin FROM tx, (SELECT quantile_cont(monto, [0.2, 0.4, 0.6, 0.8]) AS q FROM train)")
fit_apply("f2_quantile_bins_nulls", lambda: T.QuantileBins("b", 4, name="bin"), lambda: ["bin"], "SELECT k, CASE WHEN b IS NULL THEN '__MISSING__' WHEN b <= q[1] THEN '0' WHEN b <= q[2] THEN '1' WHEN b <= q[3] THEN '2' ELSE '3' END AS bin FROM tx, (SELECT quantile_cont(b, [0.25, 0.5, 0.75]) AS q FROM train)")
fit_apply("f3_frequency_encoding", lambda: T.FrequencyEncoding("g", name="freq"), lambda: [r6("freq")], "SELECT k, round(CASE WHEN has THEN freq ELSE (SELECT avg(freq) FROM m) END, 6) AS freq FROM tx LEFT JOIN (SELECT *, true AS has FROM m) m ON tx.g IS NOT DISTINCT FROM m.g", "m AS (SELECT g, count(*) / (SELECT count(*) FROM train) AS freq FROM train GROUP BY g)")
fit_apply("f4_rare_grouping", lambda: T.RareGrouping("g", 0.01, name="grouped"), lambda: ["grouped"], "SELECT k, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.g IS NOT DISTINCT FROM tx.g) THEN g ELSE '__OTHER__' END AS grouped FROM tx", "m AS (SELECT g FROM train GROUP BY g HAVING count(*) >= 0.01 * (SELECT count(*) FROM train))")
_FOLD = "(('0x' || substr(md5(k::VARCHAR), 1, 8))::BIGINT % 5)::INT"
_GM = "gm AS (SELECT sum(fraude) / count(fraude) AS gm FROM train)"
add("f5_target_encoding_oof", lambda s, d: T.TargetEncoding("g", name="enc").fit_transform(train(s, d)).select("k", r6("enc")), tx_sql("SELECT t.k, round(CASE WHEN c.n - f.n > 0 THEN (c.s - f.s + 10 * gm) / (c.n - f.n + 10) ELSE gm END, 6) AS enc FROM (SELECT *, " + _FOLD + " AS fold FROM train) t JOIN c ON t.g IS NOT DISTINCT FROM c.g JOIN f ON t.g IS NOT DISTINCT FROM f.g AND t.fold = f.fold, gm", TRAIN, _GM, "f AS (SELECT g, " + _FOLD + " AS fold, sum(fraude) AS s, count(fraude) AS n FROM train GROUP BY 1, 2)", "c AS (SELECT g, sum(fraude) AS s, count(fraude) AS n FROM train GROUP BY g)"))
fit_apply("f6_target_encoding", lambda: T.TargetEncoding("j", name="enc"), lambda: [r6("enc")], "SELECT k, round(coalesce((c.s + 10 * gm) / (c.n + 10), gm), 6) AS enc FROM tx LEFT JOIN (SELECT j, sum(fraude) AS s, count(fraude) AS n FROM train GROUP BY j) c ON tx.j IS NOT DISTINCT FROM c.j, gm", _GM)
# two standardised columns: the first component is their sum over the square root of two, where they go together
fit_apply("f7_pca", lambda: T.PCA(["d", "m"], 1, scale=True, prefix="pca_dm"), lambda: [F.abs(F.round("pca_dm_1", 5)).alias("pca_dm_1")], "SELECT k, abs(round(((coalesce(d, dm) - da) / ds + (coalesce(m, mm) - ma) / ms) / sqrt(2), 5)) AS pca_dm_1 FROM tx, st", "md AS (SELECT median(d) AS dm, median(m) AS mm FROM train)", "st AS (SELECT any_value(dm) AS dm, any_value(mm) AS mm, avg(coalesce(d, dm)) AS da, stddev_pop(coalesce(d, dm)) AS ds, avg(coalesce(m, mm)) AS ma, stddev_pop(coalesce(m, mm)) AS ms FROM train, md)")
fit_apply("f8_one_hot", lambda: T.OneHot(["o", "p"]), lambda: ["o_N", "o_Y", F.col("o___MISSING__").alias("o_missing"), "p_N", "p_Y"], "SELECT k, (o IS NOT DISTINCT FROM 'N')::INT AS o_N, (o IS NOT DISTINCT FROM 'Y')::INT AS o_Y, (o IS NULL)::INT AS o_missing, (p = 'N')::INT AS p_N, (p = 'Y')::INT AS p_Y FROM tx")
fit_apply("f9_impute_median", lambda: T.MedianImputer(["b", "d"]), lambda: [r6("b_imputed"), r6("d_imputed")], "SELECT k, round(coalesce(b, (SELECT median(b) FROM train)), 6) AS b_imputed, round(coalesce(d, (SELECT median(d) FROM train)), 6) AS d_imputed FROM tx")
fit_apply("f10_standardize", lambda: T.Standardizer(["monto", "d"]), lambda: [r6("monto_std"), r6("d_std")], "SELECT k, round((monto - ma) / ms, 6) AS monto_std, round((d - da) / ds, 6) AS d_std FROM tx, (SELECT avg(monto) AS ma, stddev_samp(monto) AS ms, avg(d) AS da, stddev_samp(d) AS ds FROM train)")

CONFIG = [{"process": "log_feature", "column": "f", "new_column": "f_log"}, {"process": "missing_flag", "column": "b", "new_column": "b_missing"}, {"process": "no_such_process", "column": "b", "new_column": "lost"}, {"process": "frequency_encoding", "column": "p", "new_column": "p_freq"}, {"process": "ratio", "column": ["monto", "l"], "new_column": "ratio_monto_l"}]
add("f11_apply_transformations", lambda s, d: pipeline.apply_transformations(tx(s, d), CONFIG, skip_errors=True)[0].select("k", r6("f_log"), "b_missing", r6("p_freq"), r6("ratio_monto_l")), tx_sql("SELECT k, CASE WHEN f > -1 THEN round(ln(1 + f), 6) END AS f_log, (b IS NULL)::INT AS b_missing, round(count(*) OVER (PARTITION BY p) / count(*) OVER (), 6) AS p_freq, CASE WHEN l <> 0 THEN round(monto / l, 6) END AS ratio_monto_l FROM tx"))
STEPS = {"steps": [
    {"name": "h", "type": "HourTransformer", "cols": ["fecha"]}, {"name": "z", "type": "ZeroFlagTransformer", "cols": ["d"]}, {"name": "t", "type": "TopPercentileFlagTransformer", "cols": ["monto"], "params": {"quantile": 0.9}},
    {"name": "r", "type": "RareGroupingTransformer", "cols": ["g"]}, {"name": "s", "type": "SumWindowTransformer", "cols": ["monto", "j", "fecha"], "params": {"value_column": "monto", "window": "1d"}}, {"name": "m", "type": "MaxWindowTransformer", "cols": ["monto", "j", "fecha"], "params": {"value_column": "monto", "window": "7d"}},
]}
WANTED = ["hour_fecha", "d_is_zero", "monto_sum_1d", "monto_max_7d"]


def _plan():
    return pipeline.build_preprocessor(pipeline.filter_config_by_features(STEPS, WANTED, ["d"]))


_over = lambda h: f"OVER (PARTITION BY j ORDER BY fecha RANGE BETWEEN INTERVAL '{h} hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)"
PLAN_SQL = f"SELECT k, hour(fecha)::INT AS hour_fecha, CASE WHEN d = 0 THEN 1 ELSE 0 END AS d_is_zero, round(sum(monto) {_over(24)}, 6) AS monto_sum_1d, max(monto) {_over(168)} AS monto_max_7d, d"
add("f12_preprocessor_fit_transform", lambda s, d: _plan().fit_transform(train(s, d)).select("k", "hour_fecha", "d_is_zero", r6("monto_sum_1d"), "monto_max_7d", "d"), tx_sql(PLAN_SQL + " FROM train", TRAIN))
add("f13_preprocessor_transform", lambda s, d: _plan().fit(train(s, d)).transform(tx(s, d).where(f"fecha >= {CUT}")).select("k", "hour_fecha", "d_is_zero", r6("monto_sum_1d"), "monto_max_7d", "d"), tx_sql(f"SELECT * EXCLUDE (fecha) FROM ({PLAN_SQL}, fecha FROM tx) WHERE fecha >= TIMESTAMP '2024-01-21'"))
