"""The batteries, the ranking, its words and the models against values worked out from the rows themselves, without Spark."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.functions import special
from txrisk.operators import assoc, modeling
from txrisk.queries import scoring
from txrisk.queries import tests_and_drift as queries
from txrisk.sources.tables import transactions

MISSING = "__MISSING__"


@pytest.fixture(scope="module")
def table(spark, small):
    return transactions(spark, small).toPandas()


def rows_of(table, c):
    x = table[c].astype(float).to_numpy()
    known = ~np.isnan(x)
    return x[known], table["fraude"].to_numpy()[known]


def logit(x, y, steps=60):
    """Coefficients and standard errors by Newton steps; the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_continuous_battery(spark, small, table):
    """Every figure of every feature: U and AUC by comparing all pairs, the distance over all values, r, d, and the logit by its own steps."""
    got = {r["variable"]: r for r in queries.QUERIES["t14_continuous_battery"](spark, small).collect()}
    assert set(got) == set(queries.CONT)
    for c, r in got.items():
        x, y = rows_of(table, c)
        a, b = x[y == 0], x[y == 1]
        above = np.sign(a[:, None] - b[None, :])
        u = ((above + 1) / 2).sum()
        n0, n1, n = len(a), len(b), len(x)
        ties = sum(float(t) ** 3 - t for t in np.unique(x, return_counts=True)[1])
        sigma = math.sqrt(n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (max(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sigma
        ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in x)
        rho = np.corrcoef(x, y)[0, 1]
        d = (b.mean() - a.mean()) / math.sqrt(((n0 - 1) * a.var(ddof=1) + (n1 - 1) * b.var(ddof=1)) / (n - 2))
        scale = x.std()
        coef, se = logit((x - x.mean()) / scale, y)
        want = {
            "mannwhitney_stat": u, "mannwhitney_p_value": math.erfc(z / math.sqrt(2)), "ks_stat": ks, "ks_p_value": special.distance_sf(ks, n0, n1), "point_biserial_corr": rho, "point_biserial_p_value": special.t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2),
            "auc": 1 - u / (n0 * n1), "auc_abs": max(u / (n0 * n1), 1 - u / (n0 * n1)), "cohens_d": d, "logit_beta": coef[0] / scale, "logit_odds_ratio": math.exp(coef[0] / scale), "logit_p_value": math.erfc(abs(coef[0] / se[0]) / math.sqrt(2)),
        }
        for name, v in want.items():
            assert r[name] == pytest.approx(v, rel=1e-5, abs=1e-9), (c, name)
        assert r["logit_separation_detected"] == (abs(coef[0] / scale) > 20)


def test_categorical_battery(spark, small, table):
    """Chi-square with Yates' correction, V, WoE and its IV and AUC, and the likelihood ratio, from the counts of each category."""
    got = {r["variable"]: r for r in queries.QUERIES["t14_categorical_battery"](spark, small).collect()}
    assert set(got) == set(queries.CATS)
    for c, r in got.items():
        values = table[c].astype(object).where(table[c].notna(), MISSING).astype(str)
        cats = sorted(set(values))
        n = np.array([[((values == v) & (table["fraude"] == k)).sum() for k in (0, 1)] for v in cats], dtype=float)
        expected = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
        dof = len(cats) - 1
        apart = np.abs(n - expected)
        apart = np.maximum(apart - np.minimum(0.5, apart), 0) if dof == 1 else apart
        chi2 = (apart**2 / expected).sum()
        assert r["chi2_stat"] == pytest.approx(chi2, rel=1e-9) and r["chi2_dof"] == dof
        assert r["chi2_p_value"] == pytest.approx(special.chi2_sf(chi2, dof), rel=1e-9) and r["cramers_v"] == pytest.approx(math.sqrt(chi2 / n.sum()), rel=1e-9)
        if len(cats) <= 20:
            share = (n + 0.5) / (n.sum(0) + 0.5 * len(cats))
            woe = np.log(share[:, 0] / share[:, 1])
            assert r["iv"] == pytest.approx(((share[:, 0] - share[:, 1]) * woe).sum(), rel=1e-9)
            better = (np.sign(woe[:, None] - woe[None, :]) + 1) / 2
            auc = (n[:, 0][:, None] * n[:, 1][None, :] * better).sum() / n[:, 0].sum() / n[:, 1].sum()
            assert r["auc_woe_abs"] == pytest.approx(max(auc, 1 - auc), rel=1e-9)
            log = lambda k, t: np.where(k > 0, k * np.log(np.where(k > 0, k / t, 1)), 0).sum()
            lr = 2 * (log(n, n.sum(1, keepdims=True)) - log(n.sum(0), n.sum()))
            assert r["lr_stat"] == pytest.approx(max(0.0, lr), rel=1e-7, abs=1e-9) and r["lr_dof"] == dof


def test_ranking_and_its_words(spark, small):
    """The verdict on each feature from the batteries' figures, in their order, and the words that go with it."""
    a, b = (queries.QUERIES[f"t14_{k}_battery"](spark, small).collect() for k in ("continuous", "categorical"))
    want = {}
    for r in a:
        want[r["variable"]] = ("continua", r["auc_abs"], abs(r["cohens_d"]), r["mannwhitney_p_value"], r["logit_separation_detected"], "Cohen's d", r["cohens_d_interpretation"], None, None)
    for r in b:
        want[r["variable"]] = ("categórica", r["auc_woe_abs"], r["cramers_v"], r["chi2_p_value"], r["lr_separation_detected"], "V de Cramér", r["cramers_v_interpretation"], r["iv"], r["iv_interpretation"])
    ranked = queries.QUERIES["t15_feature_ranking"](spark, small).collect()
    assert {r["variable"] for r in ranked} == set(want)
    assert [r["auc_abs"] for r in ranked] == sorted((r["auc_abs"] for r in ranked), reverse=True)
    verdicts = {}
    for r in ranked:
        kind, auc, effect, p, apart, *_ = w = want[r["variable"]]
        told = "Revisar antes de decidir (inestabilidad numérica)" if apart else "Útil" if auc >= 0.7 else "Marginal (evaluar en conjunto)" if auc >= 0.6 else "Descartable"
        assert (r["tipo"], r["clasificacion"]) == (kind, told) and [r["auc_abs"], r["effect_size"], r["p_value"]] == pytest.approx([auc, effect, p], rel=1e-9)
        assert r["advertencia_iv"] == (w[8] == "sospechoso (posible leakage)" if w[8] else False) or w[8] is not None
        verdicts[r["variable"]] = (told, r["advertencia_iv"], w)
    for r in queries.QUERIES["t16_feature_summary"](spark, small).collect():
        told, suspect, w = verdicts[r["variable"]]
        notes = [told, f"efecto ({w[5]}) {w[6]}"] + (["IV sospechoso, revisar posible leakage"] if suspect else []) + (["inestabilidad numérica en el ajuste logístico"] if w[4] else [])
        assert r["observaciones_generales"] == "; ".join(notes) and r["transformacion_aplicada"] == "Variable original (sin transformar)"
        assert r["tipo_test_aplicado"].startswith("Continua (Mann-Whitney" if w[0] == "continua" else "Categórica (Chi²")


def test_logit_comparison(spark, small, table):
    """Coefficients, errors and condition numbers of the three standardised fits."""
    got = {(r["model"], r["term"]): r for r in queries.QUERIES["t17_logit_comparison"](spark, small).collect()}
    cols = ["monto", "d", "h"]
    full = table[[*cols, "fraude"]].astype(float).dropna()
    z = (full[cols] - full[cols].mean()) / full[cols].std()
    for model, use in (("full", cols), ("sin_d", ["monto", "h"]), ("sin_h", ["monto", "d"])):
        coef, se = logit(z[use].to_numpy(), full["fraude"].to_numpy())
        condition = math.sqrt(np.linalg.cond(np.corrcoef(z[use].T)))
        for term, b, e in zip([*use, "const"], coef, se):
            r = got[model, term]
            assert [r["coef"], r["se"], r["condition"]] == pytest.approx([b, e, condition], rel=1e-4, abs=1e-6), (model, term)


def test_models_by_their_scores(spark, small):
    """AUC and money of each kind of model, from its scores by comparing all pairs; and what the inputs count for."""
    scores = scoring._scores(spark, small).toPandas()
    got = {r["model"]: r for r in scoring.QUERIES["e10_train_classifiers"](spark, small).collect()}
    assert set(got) == set(modeling.KINDS)
    for kind, part in scores.groupby("model"):
        y, p, amount = (part[c].to_numpy() for c in ("fraude", "p", "monto"))
        good, bad = p[y == 0], p[y == 1]
        auc = ((np.sign(bad[:, None] - good[None, :]) + 1) / 2).mean()
        money = lambda t: -amount[(y == 1) & (p < t)].sum() - 0.25 * amount[(y == 0) & (p >= t)].sum()  # noqa: B023, E731
        assert got[kind]["auc"] == pytest.approx(auc, abs=1e-4) and got[kind]["j_fixed"] == pytest.approx(money(0.5), abs=1e-3)
        assert got[kind]["j_best"] == pytest.approx(max(money(i / 299) for i in range(300)), abs=1e-3)
    model, meta = scoring._fit(spark, small, "logistic")
    sizes = np.abs(model.stages[-1].coefficients.toArray())
    told = modeling.feature_importance(transactions(spark, small), model, meta, top_n=100)
    assert sorted((v for _, v in told), reverse=True) == pytest.approx(sorted(sizes / sizes.sum() * 100, reverse=True)) and {"monto", "score", "b", "d", "l"} <= {n for n, _ in told}
    trees = scoring.QUERIES["e12_feature_importance"](spark, small).collect()
    assert sum(r["importance"] for r in trees) <= 100 + 1e-9 and [r["importance"] for r in trees] == sorted((r["importance"] for r in trees), reverse=True)
    top = scoring.QUERIES["o3_top_importance"](spark, small).collect()
    assert [(r["feature"], r["importance"]) for r in top] == [(r["feature"], r["importance"]) for r in trees[:5]]


def test_words_for_transformations(spark):
    """Originals, special names, endings, and what is none of them."""
    names = {"monto": "Variable original (sin transformar)", "pca_dm_1": "PCA (1 componente) sobre d y m", "ratio_monto_l": "Ratio monto / l", "fecha_hour_sin": "Codificación cíclica de hora (seno)", "f_log": "Transformación logarítmica (log1p)", "g_target_enc": "Target encoding con validación cruzada", "q": "Transformación no clasificada"}
    rank = spark.createDataFrame([(n, "continua", 0.5, "casi aleatorio", 0.1, "despreciable", None, None, 0.5, False, "Descartable", False) for n in names], "variable string, tipo string, auc_abs double, auc_interpretation string, effect_size double, effect_size_interpretation string, iv double, iv_interpretation string, p_value double, separation_detected boolean, clasificacion string, advertencia_iv boolean")
    out = {r["variable"]: r["transformacion_aplicada"] for r in assoc.feature_summary(rank, ("monto",)).collect()}
    assert out == names
    own = assoc.feature_summary(rank, ("monto",), {"q": "Otra"}).where(F.col("variable") == "q").first()
    assert own["transformacion_aplicada"] == "Otra"
