"""How features go with a binary target. Continuous ones are judged from their table of value counts, categorical ones from their
table of category counts: two exchanges of the data, whatever the number of features and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from ..functions.labels import AUC, COHEN_D, CRAMERS_V, IV, label
from ..sources.scratch import materialize
from ..sources.tables import MISSING, OTHER
from .ecdf import value_ecdf


def _p(function, *args: Column) -> Column:
    """A tail probability for each of a few result rows, one a feature; null where an argument is."""

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else float(function(*row)) for row in zip(*columns)], dtype="float64")

    return of(*[a.cast("double") for a in args])


def continuous_statistics(ecdf: DataFrame) -> DataFrame:
    """One row a feature from ``value_ecdf``: n0, n1, U of class 0 and its z, KS, point-biserial r and its t, AUC, Cohen's d.
    Each is null where a class is empty or a variance it divides by is zero."""
    total = ecdf.groupBy("feature").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum(F.col("n0") * F.col("value")).alias("s0"), F.sum(F.col("n1") * F.col("value")).alias("s1"))
    mean = lambda s, n: F.try_divide(F.col(s), F.col(n))
    rows = ecdf.join(total.withColumn("m0", mean("s0", "t0")).withColumn("m1", mean("s1", "t1")), "feature")
    n = (F.col("n0") + F.col("n1")).cast("double")
    out = rows.groupBy("feature").agg(
        F.first("t0").alias("n0"), F.first("t1").alias("n1"), F.first("m0").alias("m0"), F.first("m1").alias("m1"),
        F.sum(F.col("n0") * (F.col("cum_n1") - F.col("n1") / 2)).alias("below"), F.sum(n * n * n - n).alias("ties"),
        F.max(F.abs(F.try_divide("cum_n0", "t0") - F.try_divide("cum_n1", "t1"))).alias("ks_stat"),
        F.sum(F.col("n0") * (F.col("value") - F.col("m0")) * (F.col("value") - F.col("m0"))).alias("q0"), F.sum(F.col("n1") * (F.col("value") - F.col("m1")) * (F.col("value") - F.col("m1"))).alias("q1"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n, both = n0 + n1, (F.col("n0") > 0) & (F.col("n1") > 0)
    spread = F.coalesce("q0", F.lit(0.0)) + F.coalesce("q1", F.lit(0.0))
    whole = spread + n0 * n1 / n * (F.col("m1") - F.col("m0")) ** 2
    auc = F.when(both, F.col("below") / (n0 * n1))
    # below counts, for rows of class 0, those of class 1 at or under them: U of class 0
    out = out.withColumn("mannwhitney_stat", F.when(both, F.col("below"))).withColumn("auc", 1 - auc)
    sigma = F.sqrt(n0 * n1 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    u = F.greatest("mannwhitney_stat", n0 * n1 - F.col("mannwhitney_stat"))
    out = out.withColumn("mannwhitney_z", F.when(both & (sigma > 0), (u - n0 * n1 / 2 - 0.5) / sigma))
    out = out.withColumn("ks_stat", F.when(both, F.col("ks_stat")))
    r = F.when(both & (whole > 0), (F.col("m1") - F.col("m0")) * F.sqrt(n0 * n1) / n / F.sqrt(whole / n))
    out = out.withColumn("point_biserial_corr", r)
    out = out.withColumn("point_biserial_t", F.when(F.abs("point_biserial_corr") < 1, F.col("point_biserial_corr") * F.sqrt((n - 2) / (1 - F.col("point_biserial_corr") ** 2))))
    pooled = F.sqrt(spread / (n - 2))
    out = out.withColumn("cohens_d", F.when((F.col("n0") > 1) & (F.col("n1") > 1) & (spread > 0), (F.col("m1") - F.col("m0")) / pooled))
    out = out.withColumn("auc_abs", F.greatest("auc", 1 - F.col("auc")))
    return out.select("feature", "n0", "n1", "mannwhitney_stat", "mannwhitney_z", "ties", "ks_stat", "point_biserial_corr", "point_biserial_t", "auc", "auc_abs", label(F.col("auc_abs"), AUC).alias("auc_interpretation"), "cohens_d", label(F.abs("cohens_d"), COHEN_D).alias("cohens_d_interpretation"))


def logit_wald(ecdf: DataFrame, max_iterations: int = 35) -> DataFrame:
    """A logistic regression on each feature alone: (feature, logit_beta, logit_odds_ratio, logit_p_value, logit_separation_detected).

    All features are fitted together: a Newton step is one aggregate of five sums a feature over the value counts, and a 2 x 2 system
    each on the driver. Values are standardised for it and the slope is put back. Separation is flagged where the steps don't settle or the
    slope is over 20; with one class or one value there is nothing to fit: nulls and the flag."""
    spark, held = ecdf.sparkSession, not ecdf.is_cached
    ecdf = ecdf.persist()  # each step reads it
    base = ecdf.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.try_divide(F.sum((F.col("n0") + F.col("n1")) * F.col("value")), F.sum(F.col("n0") + F.col("n1"))).alias("mean"), F.sum((F.col("n0") + F.col("n1")) * F.col("value") * F.col("value")).alias("sq")).collect()
    state, final = {}, {}
    for r in base:
        n = r["n0"] + r["n1"]
        sd = math.sqrt(max(0.0, r["sq"] / n - r["mean"] ** 2))
        if not r["n0"] or not r["n1"] or sd <= 1e-12 * max(1.0, abs(r["mean"])):
            final[r["feature"]] = (None, None, None, True)
        else:
            state[r["feature"]] = [math.log(r["n1"] / r["n0"]), 0.0, r["mean"], sd]
    schema = "feature string, b0 double, b1 double, mean double, sd double"
    for step in range(max_iterations + 1):
        if not state:
            break
        now = F.broadcast(spark.createDataFrame([(f, *v) for f, v in state.items()], schema))  # a row a feature
        z = (F.col("value") - F.col("mean")) / F.col("sd")
        p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("z"))))
        n = F.col("n0") + F.col("n1")
        w = n * F.col("p") * (1 - F.col("p"))
        sums = ecdf.join(now, "feature").withColumn("z", z).withColumn("p", p).groupBy("feature").agg(F.sum(F.col("n1") - n * F.col("p")).alias("g0"), F.sum((F.col("n1") - n * F.col("p")) * F.col("z")).alias("g1"), F.sum(w).alias("h0"), F.sum(w * F.col("z")).alias("h1"), F.sum(w * F.col("z") * F.col("z")).alias("h2")).collect()
        for r in sums:
            b0, b1, mean, sd = state[r["feature"]]
            det = r["h0"] * r["h2"] - r["h1"] ** 2
            if not det > 1e-12 * max(1e-300, r["h0"] * r["h2"]) or step == max_iterations:
                beta = b1 / sd
                final[r["feature"]] = (beta, _exp(beta), None, True)
                del state[r["feature"]]
                continue
            d0, d1 = (r["h2"] * r["g0"] - r["h1"] * r["g1"]) / det, (r["h0"] * r["g1"] - r["h1"] * r["g0"]) / det
            if max(abs(d0), abs(d1)) < 1e-9:
                beta = b1 / sd
                se = math.sqrt(r["h0"] / det) / sd
                final[r["feature"]] = (beta, _exp(beta), special.normal_two_sided(beta / se), abs(beta) > 20)
                del state[r["feature"]]
            else:
                state[r["feature"]] = [b0 + d0, b1 + d1, mean, sd]
    if held:
        ecdf.unpersist()
    return spark.createDataFrame([(f, *v) for f, v in final.items()], "feature string, logit_beta double, logit_odds_ratio double, logit_p_value double, logit_separation_detected boolean")


def _exp(x: float) -> float:
    return math.exp(x) if x < 700 else math.inf


def continuous_battery(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """All tests of the continuous features, one row each, the best AUC first."""
    ecdf = materialize(value_ecdf(df, cols, target), "value-counts")  # read by every step of the logits, and once more when the result is
    s = continuous_statistics(ecdf).join(logit_wald(ecdf), "feature", "left")
    s = s.withColumn("mannwhitney_p_value", _p(special.rank_sum_two_sided, *[F.col(c) for c in ("mannwhitney_stat", "n0", "n1", "mannwhitney_z", "ties")])).withColumn("ks_p_value", _p(special.distance_sf, F.col("ks_stat"), F.col("n0"), F.col("n1"))).withColumn("point_biserial_p_value", _p(special.t_two_sided, F.col("point_biserial_t"), F.col("n0") + F.col("n1") - 2))
    columns = ["mannwhitney_stat", "mannwhitney_p_value", "ks_stat", "ks_p_value", "point_biserial_corr", "point_biserial_p_value", "auc", "auc_abs", "auc_interpretation", "cohens_d", "cohens_d_interpretation", "logit_beta", "logit_odds_ratio", "logit_p_value", "logit_separation_detected"]
    return s.select(F.col("feature").alias("variable"), *columns).orderBy(F.desc_nulls_last("auc_abs"), "variable")


def category_counts(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, category, n0, n1); null is a category of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in cols]))
    rows = df.where(F.col(target).isin(0, 1)).select(F.col(target).alias("y"), pairs.alias("p")).select("y", "p.*")
    return rows.groupBy("feature", "category").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))


def _margins(counts: DataFrame) -> DataFrame:
    margins = counts.groupBy("feature").agg(F.sum("n0").alias("g"), F.sum("n1").alias("b"), F.count("*").alias("levels"))
    return counts.join(margins, "feature")


def chi_square(counts: DataFrame) -> DataFrame:
    """Independence over all levels, with Yates' correction at one degree of freedom, and Cramér's V of the same statistic. With one class or
    one level: a statistic of 0 at 0 degrees of freedom, and no V."""
    rows = _margins(counts)
    n = (F.col("g") + F.col("b")).cast("double")
    t = F.col("n0") + F.col("n1")
    classes = F.when((F.col("g") > 0) & (F.col("b") > 0), 2).otherwise(1)
    dof = (F.col("levels") - 1) * (classes - 1)

    def part(seen: str, margin: str) -> Column:
        expected = t * F.col(margin) / n
        gap = F.abs(F.col(seen) - expected)
        gap = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.when(expected > 0, gap * gap / expected).otherwise(0.0)

    out = rows.groupBy("feature").agg(F.sum(part("n0", "g") + part("n1", "b")).alias("chi2_stat"), F.first(dof).alias("chi2_dof"), F.first(n).alias("n"), F.first(F.least("levels", classes)).alias("k"))
    v = F.when(F.col("k") > 1, F.sqrt(F.col("chi2_stat") / (F.col("n") * (F.col("k") - 1))))
    return out.select("feature", "chi2_stat", F.col("chi2_dof").cast("int").alias("chi2_dof"), v.alias("cramers_v"), label(v, CRAMERS_V).alias("cramers_v_interpretation"))


def collapse_rare(counts: DataFrame, max_bins: int = 20) -> DataFrame:
    """Counts of at most ``max_bins`` categories a feature: with more, all but the commonest ``max_bins - 1`` become one."""
    order = Window.partitionBy("feature").orderBy(F.desc(F.col("n0") + F.col("n1")), "category")
    ranked = counts.withColumn("pos", F.row_number().over(order)).withColumn("levels", F.count("*").over(Window.partitionBy("feature")))
    name = F.when((F.col("levels") > max_bins) & (F.col("pos") >= max_bins), OTHER).otherwise(F.col("category"))
    return ranked.groupBy("feature", name.alias("category")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def woe_table(counts: DataFrame, max_bins: int = 20) -> DataFrame:
    """Weight of evidence of each category, with half a row added to each count, and its part of the information value."""
    rows = _margins(collapse_rare(counts, max_bins))
    good = (F.col("n0") + 0.5) / (F.col("g") + 0.5 * F.col("levels"))
    bad = (F.col("n1") + 0.5) / (F.col("b") + 0.5 * F.col("levels"))
    rows = rows.withColumn("pct_good", good).withColumn("pct_bad", bad).withColumn("woe", F.log(F.col("pct_good") / F.col("pct_bad")))
    return rows.select(F.col("feature").alias("variable"), F.col("category").alias("categoria"), (F.col("n0") + F.col("n1")).alias("n_total"), F.col("n0").alias("n_good"), F.col("n1").alias("n_bad"), "pct_good", "pct_bad", "woe", ((F.col("pct_good") - F.col("pct_bad")) * F.col("woe")).alias("iv_contribution"))


def information_value(woe: DataFrame) -> DataFrame:
    iv = woe.groupBy("variable").agg(F.sum("iv_contribution").alias("iv"))
    return iv.withColumn("iv_interpretation", label(F.col("iv"), IV))


def auc_woe(woe: DataFrame) -> DataFrame:
    """AUC of the category's weight of evidence as a score; categories of the same weight tie."""
    order = Window.partitionBy("variable").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    # weights equal but for their last digits are equal
    tied = woe.groupBy("variable", F.round("woe", 12).alias("w")).agg(F.sum("n_good").alias("n0"), F.sum("n_bad").alias("n1"))
    rows = tied.withColumn("below", F.sum("n0").over(order) - F.col("n0") / 2)  # at most max_bins rows a variable
    out = rows.groupBy("variable").agg(F.try_divide(F.sum(F.col("n1") * F.col("below")), F.sum("n0") * F.sum("n1")).alias("auc_woe"))
    top = F.greatest("auc_woe", 1 - F.col("auc_woe"))
    return out.select("variable", "auc_woe", top.alias("auc_woe_abs"), label(top, AUC).alias("auc_woe_interpretation"))


def lr_test(counts: DataFrame, max_categories: int = 20) -> DataFrame:
    """Likelihood ratio of the logistic model with a dummy a category against the one without: its likelihood is known in closed form. A category with one class only
    is where such a fit diverges: the limit is given and flagged. One category: no test."""
    x = lambda a, t: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / t)).otherwise(0.0)
    rows = _margins(collapse_rare(counts, max_categories))
    t, n = F.col("n0") + F.col("n1"), F.col("g") + F.col("b")
    out = rows.groupBy("feature").agg(F.sum(x("n0", t) + x("n1", t)).alias("full"), F.first(x("g", n) + x("b", n)).alias("null_"), (F.count("*") - 1).alias("dof"), F.max((F.col("n0") == 0) | (F.col("n1") == 0)).alias("zero"))
    return out.select("feature", F.when(F.col("dof") > 0, F.greatest(F.lit(0.0), 2 * (F.col("full") - F.col("null_")))).alias("lr_stat"), F.col("dof").cast("int").alias("lr_dof"), (F.col("zero") | (F.col("dof") == 0)).alias("lr_separation_detected"))


def categorical_battery(df: DataFrame, cols: list[str], target: str, max_bins: int = 20) -> DataFrame:
    """All tests of the categorical features, one row each, the highest information value first."""
    counts = materialize(category_counts(df, cols, target), "category-counts")
    woe = woe_table(counts, max_bins)
    f = lambda d: d.withColumnRenamed("variable", "feature")
    out = chi_square(counts).join(f(information_value(woe)), "feature").join(f(auc_woe(woe)), "feature").join(lr_test(counts, max_bins), "feature")
    out = out.withColumn("chi2_p_value", _p(special.chi2_sf, F.col("chi2_stat"), F.col("chi2_dof"))).withColumn("lr_p_value", _p(special.chi2_sf, F.col("lr_stat"), F.col("lr_dof")))
    columns = ["chi2_stat", "chi2_p_value", "chi2_dof", "cramers_v", "cramers_v_interpretation", "iv", "iv_interpretation", "auc_woe", "auc_woe_abs", "auc_woe_interpretation", "lr_stat", "lr_p_value", "lr_dof", "lr_separation_detected"]
    return out.select(F.col("feature").alias("variable"), *columns).orderBy(F.desc_nulls_last("iv"), "variable")


# Words of the ranking.
REVIEW, USEFUL, MARGINAL, USELESS = "Revisar antes de decidir (inestabilidad numérica)", "Útil", "Marginal (evaluar en conjunto)", "Descartable"
CONTINUOUS, CATEGORICAL = "continua", "categórica"
TESTS = {CONTINUOUS: "Continua (Mann-Whitney, KS, punto-biserial, AUC, Cohen's d, Wald)", CATEGORICAL: "Categórica (Chi², V de Cramér, IV/WoE, AUC-WoE, LR test)"}
POWER = {"casi aleatorio": "casi aleatoria", "separación débil": "débil", "separación moderada": "moderada", "separación fuerte": "fuerte"}
ENDINGS = {"_missing": "Missing indicator (flag de nulo)", "_is_zero": "Zero flag (flag de valor cero)", "_log": "Transformación logarítmica (log1p)", "_top1pct": "Percentile flag (top 1%)", "_bin": "Bins por cuantiles (5 bins)", "_grouped": "Agrupación de categorías raras (rare grouping)", "_freq_enc": "Frequency encoding", "_target_enc": "Target encoding con validación cruzada"}
SPECIAL = {
    "pca_dm_1": "PCA (1 componente) sobre d y m", "ratio_monto_l": "Ratio monto / l", "fecha_hour": "Extracción de hora del día", "fecha_weekday": "Extracción de día de la semana",
    "fecha_is_weekend": "Extracción de indicador de fin de semana", "fecha_hour_sin": "Codificación cíclica de hora (seno)", "fecha_hour_cos": "Codificación cíclica de hora (coseno)",
}
ORIGINAL, UNKNOWN = "Variable original (sin transformar)", "Transformación no clasificada"


def feature_ranking(continuous: DataFrame, categorical: DataFrame) -> DataFrame:
    """Both batteries in common columns, with a verdict on each feature."""
    a = continuous.select("variable", F.lit(CONTINUOUS).alias("tipo"), "auc_abs", "auc_interpretation", F.abs("cohens_d").alias("effect_size"), F.col("cohens_d_interpretation").alias("effect_size_interpretation"), F.lit(None).cast("double").alias("iv"), F.lit(None).cast("string").alias("iv_interpretation"), F.col("mannwhitney_p_value").alias("p_value"), F.col("logit_separation_detected").alias("separation_detected"))
    b = categorical.select("variable", F.lit(CATEGORICAL).alias("tipo"), F.col("auc_woe_abs").alias("auc_abs"), F.col("auc_woe_interpretation").alias("auc_interpretation"), F.col("cramers_v").alias("effect_size"), F.col("cramers_v_interpretation").alias("effect_size_interpretation"), "iv", "iv_interpretation", F.col("chi2_p_value").alias("p_value"), F.col("lr_separation_detected").alias("separation_detected"))
    verdict = F.when(F.col("separation_detected"), REVIEW).when(F.col("auc_abs") >= 0.7, USEFUL).when(F.col("auc_abs") >= 0.6, MARGINAL).otherwise(USELESS)
    suspect = F.coalesce(F.col("iv_interpretation") == IV[-1][1], F.lit(False))
    return a.unionByName(b).withColumn("clasificacion", verdict).withColumn("advertencia_iv", suspect).orderBy(F.desc_nulls_last("auc_abs"), "variable")


def feature_summary(ranking: DataFrame, originals: tuple[str, ...] = (), described: dict[str, str] | None = None) -> DataFrame:
    """The ranking in words: what was done to the feature, what it was tested by, and what came out. ``described`` has words for features by name, beside SPECIAL."""
    done = F.when(F.col("variable").isin(*originals), ORIGINAL) if originals else F.when(F.lit(False), ORIGINAL)
    for name, words in (SPECIAL | (described or {})).items():
        done = done.when(F.col("variable") == name, words)
    for ending, words in ENDINGS.items():
        done = done.when(F.col("variable").endswith(ending), words)
    power = F.create_map(*[F.lit(x) for kv in POWER.items() for x in kv])
    tests = F.create_map(*[F.lit(x) for kv in TESTS.items() for x in kv])
    effect = F.concat(F.lit("efecto ("), F.when(F.col("tipo") == CONTINUOUS, "Cohen's d").otherwise("V de Cramér"), F.lit(") "), F.col("effect_size_interpretation"))
    notes = F.concat_ws("; ", "clasificacion", effect, F.when(F.col("advertencia_iv"), "IV sospechoso, revisar posible leakage"), F.when(F.col("separation_detected"), "inestabilidad numérica en el ajuste logístico"))
    return ranking.select("variable", done.otherwise(UNKNOWN).alias("transformacion_aplicada"), tests[F.col("tipo")].alias("tipo_test_aplicado"), "iv", "auc_abs", power[F.col("auc_interpretation")].alias("poder_predictivo"), notes.alias("observaciones_generales"))


def logit_comparison(df: DataFrame, cols: list[str], target: str, without: tuple[str, ...] = ("d", "m")) -> DataFrame:
    """Standardised logistic regressions on complete rows: coefficients and standard errors with all columns and with each of ``without``
    left out, and each model's condition number: (model, term, coef, se, condition)."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from .fitted import Standardizer

    rows = df.select(target, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    std = Standardizer(cols, suffix="").fit(rows)
    rows = std.transform(rows).withColumn(target, F.col(target).cast("double")).persist()
    moments = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(cols) for b in cols[i + 1 :]]).first() if len(cols) > 1 else None
    out = []
    for name, use in [("full", cols), *[(f"sin_{x}", [c for c in cols if c != x]) for x in without]]:
        r = np.eye(len(use))
        for i, a in enumerate(use):
            for j, b in enumerate(use[i + 1 :], i + 1):
                r[i, j] = r[j, i] = moments[f"{a}|{b}" if cols.index(a) < cols.index(b) else f"{b}|{a}"]
        condition = float(np.sqrt(np.linalg.cond(r)))
        data = VectorAssembler(inputCols=use, outputCol="x").transform(rows)
        fit = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="x", labelCol=target, maxIter=50, tol=1e-10).fit(data)
        try:
            errors = [float(e) for e in fit.summary.coefficientStandardErrors]
        except Exception:  # collinear columns: the fit has coefficients but no errors
            errors = [None] * (len(use) + 1)
        out += [(name, c, float(b), e, condition) for c, b, e in zip([*use, "const"], [*fit.coefficients, fit.intercept], errors)]
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, T.StructType([T.StructField("model", T.StringType()), T.StructField("term", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("coef", "se", "condition")]]))
