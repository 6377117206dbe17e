"""Evaluation of scores, classifiers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import decide
from ..operators import evaluate as E
from ..operators import modeling as M
from ..operators.joins import top_k
from ..plans import artifact
from ..plans.pipeline import build_preprocessor
from ..sources.scratch import scratch_dir
from ..sources.tables import transactions as tx
from ..sources.tables import transactions_of, tx_sql
from ..streaming import jobs
from .rows import r6, text

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


scored = lambda s, d: tx(s, d).select("k", "fraude", "monto", (F.col("score") / F.lit(99.0)).alias("p"))
both = lambda s, d: scored(s, d).withColumn("model", F.lit("A")).unionByName(scored(s, d).withColumn("p", 1 - F.col("p")).withColumn("model", F.lit("B")))
SC = "sc AS (SELECT k, fraude, monto, score / 99.0::DOUBLE AS p FROM tx)"
TH = "th AS (SELECT i, i / 299.0::DOUBLE AS t FROM range(300) r(i))"
SW = "sw AS (SELECT i, t, count(*) FILTER (p >= t AND fraude = 0) AS fp, count(*) FILTER (p >= t AND fraude = 1) AS tp, count(*) FILTER (fraude = 1) AS pos, coalesce(sum(monto) FILTER (p >= t AND fraude = 0), 0) AS afp, coalesce(sum(monto) FILTER (p < t AND fraude = 1), 0) AS afn FROM sc, th GROUP BY 1, 2)"
CM = "cm AS (SELECT count(*) FILTER (p < 0.5 AND fraude = 0) AS tn, count(*) FILTER (p >= 0.5 AND fraude = 0) AS fp, count(*) FILTER (p < 0.5 AND fraude = 1) AS fn, count(*) FILTER (p >= 0.5 AND fraude = 1) AS tp FROM sc)"
PR = "pr AS (SELECT *, c1 / (c0 + c1) AS prec, c1 / t1 AS rec FROM (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM (SELECT p, count(*) FILTER (fraude = 0) AS n0, count(*) FILTER (fraude = 1) AS n1 FROM sc GROUP BY p) WINDOW w AS (ORDER BY p DESC)))"

add("e1_business_j", lambda s, d: E.business_j(scored(s, d).withColumn("y", decide("p", 0.5)), "fraude", "y", "monto").select(F.round("j", 4).alias("j")), tx_sql("SELECT round(-(coalesce(sum(monto) FILTER (p < 0.5 AND fraude = 1), 0)) - 0.25 * coalesce(sum(monto) FILTER (p >= 0.5 AND fraude = 0), 0), 4) AS j FROM sc", SC))
add("e2_profit_sweep", lambda s, d: E.profit_sweep(scored(s, d), "fraude", "p", "monto").select(F.col("bucket").alias("i"), r6("threshold"), F.round("j", 4).alias("j")), tx_sql("SELECT i::INT AS i, round(t, 6) AS threshold, round(-0.25 * afp - afn, 4) AS j FROM sw", SC, TH, SW))
add("e2_best_threshold", lambda s, d: E.best_of_sweep(E.profit_sweep(scored(s, d), "fraude", "p", "monto"), "j").select(r6("threshold"), F.round("j", 4).alias("j")), tx_sql("SELECT round(t, 6) AS threshold, round(-0.25 * afp - afn, 4) AS j FROM sw ORDER BY round(-0.25 * afp - afn, 6) DESC, i LIMIT 1", SC, TH, SW))
_P, _R = "(tp / (tp + fp + 1e-9))", "(tp / (pos + 1e-9))"
add("e3_fbeta_sweep", lambda s, d: E.fbeta_sweep(scored(s, d), "fraude", "p").select(F.col("bucket").alias("i"), r6("fbeta")), tx_sql(f"SELECT i::INT AS i, round(5 * {_P} * {_R} / (4 * {_P} + {_R} + 1e-9), 6) AS fbeta FROM sw", SC, TH, SW))
add("e4_pr_curve", lambda s, d: E.pr_points(scored(s, d), "fraude", "p").select(r6("threshold"), r6("precision"), r6("recall")), tx_sql("SELECT round(p, 6) AS threshold, round(prec, 6) AS precision, round(rec, 6) AS recall FROM pr", SC, PR))
add("e4_pr_summary", lambda s, d: E.pr_summary(E.pr_points(scored(s, d), "fraude", "p")).select(r6("auc_pr"), r6("roc_auc"), r6("best_f1_threshold"), r6("best_f1"), r6("baseline")), tx_sql("SELECT round(sum(n1 / t1 * prec), 6) AS auc_pr, round(sum(n0 * (c1 - n1 / 2)) / any_value(t0 * t1), 6) AS roc_auc, round(arg_max(p, (round(2 * prec * rec / (prec + rec + 1e-9), 12), -p)), 6) AS best_f1_threshold, round(max(2 * prec * rec / (prec + rec + 1e-9)), 6) AS best_f1, round(any_value(t1 / (t0 + t1)), 6) AS baseline FROM pr", SC, PR))
add("e5_confusion", lambda s, d: E.confusion(scored(s, d), "fraude", "p", 0.5).select("tn", "fp", "fn", "tp", *[r6(c) for c in ("tn_pct", "fp_pct", "fn_pct", "tp_pct", "precision", "recall")]), tx_sql("SELECT tn, fp, fn, tp, round(tn / (tn + fp), 6) AS tn_pct, round(fp / (tn + fp), 6) AS fp_pct, round(fn / (fn + tp), 6) AS fn_pct, round(tp / (fn + tp), 6) AS tp_pct, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall FROM cm", SC, CM))
_REP = "rp AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS n FROM (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tn + fp AS s0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, fn + tp AS s1, (tn + tp) / (tn + fp + fn + tp) AS acc FROM cm))"
add("e6_classification_report", lambda s, d: E.classification_report(scored(s, d), "fraude", "p", 0.5).select("label", r6("precision"), r6("recall"), r6("f1"), "support"), tx_sql("SELECT label, round(a, 6) AS precision, round(b, 6) AS recall, round(c, 6) AS f1, s AS support FROM (SELECT '0' AS label, p0 AS a, r0 AS b, f0 AS c, s0 AS s FROM rp UNION ALL SELECT '1', p1, r1, f1, s1 FROM rp UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM rp UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM rp UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM rp)", SC, CM, _REP))


def _eval_sql(model, score):
    n, sc = f"of_{model}_", f"SELECT k, fraude, monto, {score} AS p FROM tx"
    return f"""SELECT '{model}' AS model, (SELECT round(sum(n0 * (c1 - n1 / 2)) / any_value(t0 * t1), 4) FROM {n}pr) AS auc, (SELECT round(sum(n1 / t1 * prec), 4) FROM {n}pr) AS pr_auc, (SELECT round(tp / (tp + fp), 4) FROM {n}cm) AS precision_fixed, (SELECT round(tp / (tp + fn), 4) FROM {n}cm) AS recall_fixed,
        (SELECT round(-(coalesce(sum(monto) FILTER (p < 0.5 AND fraude = 1), 0)) - 0.25 * coalesce(sum(monto) FILTER (p >= 0.5 AND fraude = 0), 0), 4) FROM {n}sc) AS j_fixed, (SELECT round(-0.25 * afp - afn, 4) FROM {n}sw WHERE i = 0) AS j_block_all,
        round(t, 4) AS best_threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision_best, round(tp / pos, 4) AS recall_best, round(-0.25 * afp - afn, 4) AS j_best FROM (SELECT * FROM {n}sw ORDER BY round(-0.25 * afp - afn, 6) DESC, i LIMIT 1)""", [c.replace("sc AS (SELECT k, fraude, monto, score / 99.0::DOUBLE AS p FROM tx)", f"{n}sc AS ({sc})").replace("FROM sc", f"FROM {n}sc").replace("sw AS", f"{n}sw AS", 1).replace("cm AS", f"{n}cm AS", 1).replace("pr AS", f"{n}pr AS", 1) for c in (SC, SW, CM, PR)]


_A, _B = _eval_sql("A", "score / 99.0::DOUBLE"), _eval_sql("B", "1 - score / 99.0::DOUBLE")
add("e7_evaluate_models", lambda s, d: E.evaluate_models(both(s, d), "fraude", "p", "monto"), tx_sql(f"SELECT * FROM ({_A[0]}) UNION ALL SELECT * FROM ({_B[0]})", TH, *_A[1], *_B[1]))
add("e13_calibration_gain", lambda s, d: E.calibration_gain(E.evaluate_models(both(s, d), "fraude", "p", "monto")).select("model", "gain", "gain_pct"), tx_sql(f"SELECT model, round(j_best - j_fixed, 4) AS gain, round((j_best - j_fixed) / abs(j_fixed) * 100, 4) AS gain_pct FROM (SELECT * FROM ({_A[0]}) UNION ALL SELECT * FROM ({_B[0]}))", TH, *_A[1], *_B[1]))
add("e8_profit_decomposition", lambda s, d: E.profit_decomposition(scored(s, d).withColumn("y", decide("p", 0.5)), "fraude", "y", "monto").select(*[F.round(c, 4).alias(c) for c in ("result", "constant", "j")]), tx_sql("SELECT round(0.25 * sum(monto) FILTER (fraude = 0 AND p < 0.5) - sum(monto) FILTER (fraude = 1 AND p < 0.5), 4) AS result, round(0.25 * sum(monto) FILTER (fraude = 0), 4) AS constant, round(-(sum(monto) FILTER (fraude = 1 AND p < 0.5)) - 0.25 * sum(monto) FILTER (fraude = 0 AND p >= 0.5), 4) AS j FROM sc", SC))
add("e9_class_weights", lambda s, d: E.class_weights(tx(s, d), "fraude").select("label", "n", r6("balanced"), r6("neg_per_pos")), tx_sql("SELECT fraude AS label, count(*) AS n, round((SELECT count(*) FROM tx) / (2 * count(*)), 6) AS balanced, round((SELECT count(*) FILTER (fraude = 0) / count(*) FILTER (fraude = 1) FROM tx), 6) AS neg_per_pos FROM tx GROUP BY fraude"))

NUMERIC, CATEGORICAL = ["monto", "score", "b", "d", "l"], ["o", "p"]
CUT = "timestamp'2024-01-21'"


def _fit(s, d, kind):
    return M.train_classifier(tx(s, d).where(f"fecha < {CUT}"), kind, NUMERIC, CATEGORICAL, "fraude")


def _scores(s, d):
    """The later rows scored by one model of each kind, long."""
    new = tx(s, d).where(f"fecha >= {CUT}")
    out = None
    for kind in M.KINDS:
        one = M.batch_score(new, *_fit(s, d, kind)).select("k", "fraude", "monto", F.col("probability_1").alias("p"), F.lit(kind).alias("model"))
        out = one if out is None else out.unionByName(one)
    return out


#: What makes the inputs of the saved model: a step of every kind of fitted state.
PLAN = {"steps": [
    {"name": "log", "type": "log_feature", "cols": ["l"]}, {"name": "top", "type": "top_percentile_flag", "cols": ["monto"], "params": {"quantile": 0.9}}, {"name": "bins", "type": "quantile_bins_dropna", "cols": ["b"], "params": {"num_bins": 4}},
    {"name": "freq", "type": "frequency_encoding", "cols": ["g"]}, {"name": "rare", "type": "rare_grouping", "cols": ["g"]}, {"name": "target", "type": "target_encoding_cv", "cols": ["g", "fraude"]}, {"name": "pca", "type": "pca", "cols": ["d", "m"], "params": {"scale": True}},
    {"name": "sum", "type": "sum_window", "cols": ["monto"], "params": {"window": "1d"}}, {"name": "max", "type": "max_window", "cols": ["monto"], "params": {"window": "7d"}},
]}
MADE = ["log_l", "monto_top10_flag", "g_freq_encoded", "g_target_enc", "pca_1", "monto_sum_1d", "monto_max_7d", "score"]


def fit_plan(train):
    """A fitted preprocessor, and a classifier on its training features with metadata."""
    plan = build_preprocessor(PLAN)
    features = plan.fit_transform(train)
    return plan, *M.train_classifier(features, "logistic", MADE, ["b_qbin_dropna", "g_grouped", "p"], "fraude")


def _saved(s, d):
    """What was fitted, and the same loaded from where it was saved."""
    plan, model, meta = fit_plan(tx(s, d).where(f"fecha < {CUT}"))
    folder = f"{scratch_dir(s)}/models-{uuid.uuid4().hex}"
    artifact.save_model(model, meta, folder, "logistic", plan)
    return artifact.Artifact("logistic", 0, plan, model, meta), artifact.load_models(s.newSession(), folder)["logistic"], folder


def _save_load(s, d):
    """Whether each later row has the same features and score before the model was saved and after another session loaded it."""
    fitted, loaded, folder = _saved(s, d)
    again = artifact.load_model(s, folder, "logistic")
    new = tx(s, d).where(f"fecha >= {CUT}")
    columns = [*MADE, "b_qbin_dropna", "g_grouped", "probability_1"]
    row = lambda a, n: a.score(new).select("k", F.struct(*columns).alias(n))
    same = F.forall(F.array(*[F.when(F.col(f"before.{c}").isNull(), F.col(f"after.{c}").isNull()).when(F.col(f"before.{c}") == F.col(f"after.{c}"), True).otherwise(F.abs(F.col(f"before.{c}").try_cast("double") - F.col(f"after.{c}").try_cast("double")) < 1e-9) for c in columns]), lambda x: x)
    return row(fitted, "before").join(row(again, "after"), "k").select("k", same.alias("same"), F.lit(loaded.version).alias("version"))


def _reload(s, d):
    """AUC of the later rows before the model is saved and after it is loaded again."""
    fitted, _, folder = _saved(s, d)
    new = tx(s, d).where(f"fecha >= {CUT}")
    auc = lambda a, n: E.pr_summary(E.pr_points(a.score(new), "fraude", "probability_1")).select(F.col("roc_auc").alias(n))
    return auc(fitted, "before").crossJoin(auc(artifact.load_model(s, folder, "logistic"), "after")).select("before", "after", (F.abs(F.col("before") - F.col("after")) < 1e-9).alias("same"))  # one row each


add("e10_train_classifiers", lambda s, d: E.evaluate_models(_scores(s, d), "fraude", "p", "monto"))
add("e11_batch_score", lambda s, d: M.batch_score(tx(s, d).where(f"fecha >= {CUT}"), *_fit(s, d, "logistic")).select("k", "probability_1"))
add("e11_minmax_score", lambda s, d: M.minmax_score(tx(s, d), "score").select("k", r6("probability_1")), tx_sql("SELECT k, round((score - (SELECT min(score) FROM tx)) / ((SELECT max(score) - min(score) FROM tx) + 1e-9), 6) AS probability_1 FROM tx"))


def _importance(s, d):
    model, meta = _fit(s, d, "forest")
    return s.createDataFrame(M.feature_importance(tx(s, d), model, meta), "feature string, importance double")


add("e12_feature_importance", _importance)
add("o3_top_importance", lambda s, d: top_k(_importance(s, d), "importance", 5, "feature"))
add("e14_reproducibility", _reload)
add("s5_save_load_model", _save_load, tx_sql("SELECT k, true AS same, 1::BIGINT AS version FROM tx WHERE fecha >= TIMESTAMP '2024-01-21'"))

# --- streams: the event file replayed -----------------------------------------------------------------------------------------------


def _stream(s, d):
    """The event table as a stream of files; the schema is read from the table itself."""
    path = f"{d}/events.parquet"
    e = s.read.parquet(path)
    return transactions_of(s.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(e, path) else f"{d}/events*.parquet"))


def _is_folder(e, path):
    files = e.inputFiles()
    return bool(files) and not files[0].rstrip("/").endswith("/events.parquet")


def _run(s, stream, mode="append"):
    """Run a stream over what is there, into a Parquet table in the shared folder."""
    base = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/out")


def _with_state(s):
    """A session whose streams keep their state where timers and lists need it; the caller's stays as it is."""
    own = s.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def _st1(s, d):
    out = _run(s, jobs.stream_velocity(_stream(_with_state(s), d), windows=("1d", "7d")))
    return out.select("k", *[F.round(f"monto_{a}_{w}", 6).alias(f"monto_{a}_{w}") for w in ("1d", "7d") for a in ("sum", "max")])


def _late(s, d):
    """The same with rows that wait for late ones, by entity and day; the last hour's rows wait for a later one."""
    rows = _stream(_with_state(s), d).select("k", "j", "fecha", "monto")  # what the result needs of a row that waits
    out = _run(s, jobs.stream_velocity(rows, windows=("1d", "7d"), aggregates=("sum", "median"), watermark="1 hour", late=True, stretch="1d"))
    return out.select("k", *[F.round(f"monto_{a}_{w}", 6).alias(f"monto_{a}_{w}") for w in ("1d", "7d") for a in ("sum", "median")])


def _stream_score(s, d):
    """Whether each later row has the score in a stream that the batch gives it."""
    fitted, _, folder = _saved(s, d)
    own = _with_state(s)
    streamed = _run(s, jobs.stream_scores(_stream(own, d).where(f"fecha >= {CUT}"), artifact.load_model(own, folder, "logistic")).select("k", F.col("probability_1").alias("streamed")))
    batch = fitted.score(tx(s, d).where(f"fecha >= {CUT}")).select("k", "probability_1")
    return streamed.join(batch, "k").select("k", (F.abs(F.col("streamed") - F.col("probability_1")) < 1e-9).alias("same"))


add("st1_stream_velocity", _st1, tx_sql("SELECT k, " + ", ".join(f"round({a}(monto) OVER (PARTITION BY j ORDER BY fecha RANGE BETWEEN INTERVAL '{h} hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING), 6) AS monto_{a}_{w}" for w, h in (("1d", 24), ("7d", 168)) for a in ("sum", "max")) + " FROM tx"))
_frame = lambda h: f"OVER (PARTITION BY j ORDER BY fecha RANGE BETWEEN INTERVAL '{h} hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)"
add("st1_stream_late_rows", _late, tx_sql("SELECT * FROM (SELECT k, " + ", ".join(f"round({a}(monto) {_frame(h)}, 6) AS monto_{a}_{w}" for w, h in (("1d", 24), ("7d", 168)) for a in ("sum", "median")) + " FROM tx) WHERE k IN (SELECT k FROM tx WHERE fecha <= (SELECT date_trunc('millisecond', max(fecha)) - INTERVAL 1 HOUR FROM tx))"))
add("st1_stream_score", _stream_score, tx_sql("SELECT k, true AS same FROM tx WHERE fecha >= TIMESTAMP '2024-01-21'"))
# the last day stays open: no later row moves the watermark past its end
add("st2_stream_kpis", lambda s, d: _run(s, jobs.period_kpis(_stream(s, d), "fecha", "fraude", "monto")).select(text("start", "start_ts"), "n_total", "n_pos", F.round("amount_neg", 2).alias("amount_neg"), F.round("amount_pos", 2).alias("amount_pos")), tx_sql("SELECT strftime(date_trunc('day', fecha), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, count(*) AS n_total, sum(fraude)::BIGINT AS n_pos, round(sum(monto) FILTER (fraude = 0), 2) AS amount_neg, round(sum(monto) FILTER (fraude = 1), 2) AS amount_pos FROM tx GROUP BY date_trunc('day', fecha) HAVING date_trunc('day', fecha) + INTERVAL 1 DAY <= (SELECT max(fecha) - INTERVAL 1 HOUR FROM tx)"))
