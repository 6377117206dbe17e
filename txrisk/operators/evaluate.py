"""Scores against labels and money: each figure from one pass, for any number of models at once (``by`` names the model column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ecdf import running_sums

TINY = 1e-9


def _amount(amount: str | None):
    return F.col(amount).cast("double") if amount else F.lit(1.0)


def business_j(df: DataFrame, target: str, predicted: str, amount: str | None = None, margin: float = 0.25, loss: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    a = _amount(amount)
    missed = F.coalesce(F.sum(F.when((F.col(target) == 1) & (F.col(predicted) == 0), a)), F.lit(0.0))
    blocked = F.coalesce(F.sum(F.when((F.col(target) == 0) & (F.col(predicted) == 1), a)), F.lit(0.0))
    return df.groupBy(*by).agg((-loss * missed - margin * blocked).alias("j"))


def threshold_buckets(df: DataFrame, target: str, score: str, amount: str | None, n_thresholds: int, by: tuple[str, ...]) -> DataFrame:
    """For each threshold i / (n - 1): what scores at or over it, by class (t0, t1 rows; a0, a1 amounts), and the totals. A score goes to its highest
    threshold by one division, put right by comparing with the neighbouring thresholds, so it is the same as ``score >= t``."""
    last = n_thresholds - 1
    guess = F.floor(F.col(score).cast("double") * last).cast("int")
    t = lambda i: i / F.lit(float(last))
    at = F.when(F.col("__g") + 1 <= last, F.when(F.col("__s") >= t(F.col("__g") + 1), F.col("__g") + 1)).otherwise(None)
    at = F.coalesce(at, F.when(F.col("__s") >= t(F.col("__g")), F.col("__g")).otherwise(F.col("__g") - 1))
    rows = df.where(F.col(score).isNotNull() & F.col(target).isin(0, 1)).withColumn("__s", F.col(score).cast("double")).withColumn("__g", F.greatest(F.lit(-1), F.least(guess, F.lit(last)))).withColumn("bucket", F.greatest(F.lit(-1), at))
    y = F.col(target)
    sums = rows.groupBy(*by, "bucket").agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"), F.coalesce(F.sum(F.when(y == 0, _amount(amount))), F.lit(0.0)).alias("a0"), F.coalesce(F.sum(F.when(y == 1, _amount(amount))), F.lit(0.0)).alias("a1"))
    # from here on there are at most n_thresholds + 1 rows a model
    grid = sums.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = grid.crossJoin(df.sparkSession.range(-1, n_thresholds).select(F.col("id").cast("int").alias("bucket")))
    full = grid.join(sums, [*by, "bucket"], "left").fillna(0)
    keys = list(by) or [F.lit(0)]
    over = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    out = full.select(*by, "bucket", *[F.sum(c).over(over).alias(f"over_{c}") for c in ("n0", "n1", "a0", "a1")], *[F.sum(c).over(every).alias(f"all_{c}") for c in ("n0", "n1", "a0", "a1")])
    return out.where("bucket >= 0").withColumn("threshold", F.col("bucket") / F.lit(float(last)))


def profit_sweep(df: DataFrame, target: str, score: str, amount: str | None = None, margin: float = 0.25, loss: float = 1.0, n_thresholds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """J at each threshold; the best is the first of the highest."""
    rows = threshold_buckets(df, target, score, amount, n_thresholds, by)
    return rows.select(*by, "bucket", "threshold", (-margin * F.col("over_a0") - loss * (F.col("all_a1") - F.col("over_a1"))).alias("j"))


def fbeta_sweep(df: DataFrame, target: str, score: str, beta: float = 2.0, n_thresholds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    rows = threshold_buckets(df, target, score, None, n_thresholds, by)
    p = F.col("over_n1") / (F.col("over_n1") + F.col("over_n0") + TINY)
    r = F.col("over_n1") / (F.col("all_n1") + TINY)
    return rows.select(*by, "bucket", "threshold", ((1 + beta**2) * p * r / (beta**2 * p + r + TINY)).alias("fbeta"))


def best_of_sweep(sweep: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first threshold of the highest value. Values that differ only by the order of their sums are equal."""
    order = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy(F.desc(F.round(value, 6)), "bucket")
    return sweep.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def pr_points(df: DataFrame, target: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision and recall at each distinct score, from the value counts in falling order."""
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    counts = rows.where(F.col(score).isNotNull() & F.col(target).isin(0, 1)).groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1"))
    cum = running_sums(counts, ["n0", "n1"], keys, "threshold", descending=True)
    total = counts.groupBy(*keys).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    out = cum.join(total, keys)
    out = out.withColumn("precision", F.col("cum_n1") / (F.col("cum_n0") + F.col("cum_n1"))).withColumn("recall", F.try_divide("cum_n1", "t1"))
    return out if by else out.drop("__all")


def pr_summary(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average precision, ROC-AUC, the threshold of the best F1 (the lowest of equals) and the base rate."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + TINY)
    rows = points.withColumn("f1", F.round(f1, 12))
    ap = F.sum(F.try_divide("n1", "t1") * F.col("precision"))
    auc = F.sum(F.col("n0") * (F.col("cum_n1") - F.col("n1") / 2)) / F.first(F.col("t0") * F.col("t1").cast("double"))
    return rows.groupBy(*by).agg(ap.alias("auc_pr"), auc.alias("roc_auc"), (-F.max(F.struct(F.col("f1").alias("f"), (-F.col("threshold")).alias("t")))["t"]).alias("best_f1_threshold"), F.max("f1").alias("best_f1"), F.first(F.col("t1") / (F.col("t0") + F.col("t1"))).alias("baseline"))


def confusion(df: DataFrame, target: str, score: str, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(target)
    c = df.where(F.col(score).isNotNull() & y.isin(0, 1)).groupBy(*by).agg(F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(hit & (y == 1)).alias("tp"))
    return c.withColumns({"tn_pct": F.try_divide("tn", F.col("tn") + F.col("fp")), "fp_pct": F.try_divide("fp", F.col("tn") + F.col("fp")), "fn_pct": F.try_divide("fn", F.col("fn") + F.col("tp")), "tp_pct": F.try_divide("tp", F.col("fn") + F.col("tp")), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + TINY), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + TINY)})


def classification_report(df: DataFrame, target: str, score: str, threshold: float) -> DataFrame:
    """(label, precision, recall, f1, support) of both classes, their macro and weighted means, and the accuracy; 0 where nothing was
    predicted or there is nothing to find."""
    c = confusion(df, target, score, threshold)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f = lambda p, r: safe(2 * p * r, p + r)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    c = c.select(safe(tn, tn + fn).alias("p0"), safe(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"), safe(tp, tp + fp).alias("p1"), safe(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"), safe(tn + tp, tn + fp + fn + tp).alias("acc"))
    c = c.withColumn("f0", f(F.col("p0"), F.col("r0"))).withColumn("f1", f(F.col("p1"), F.col("r1"))).withColumn("n", F.col("s0") + F.col("s1"))
    row = lambda name, p, r, v, s: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), v.alias("f1"), s.alias("support"))
    macro = lambda x: (F.col(f"{x}0") + F.col(f"{x}1")) / 2
    weighted = lambda x: safe(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), F.col("n"))
    rows = [row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")), row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")), row("accuracy", F.col("acc"), F.col("acc"), F.col("acc"), F.col("n")), row("macro avg", macro("p"), macro("r"), macro("f"), F.col("n")), row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("n"))]
    return c.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def evaluate_models(scores: DataFrame, target: str, score: str, amount: str | None, model: str = "model", threshold: float = 0.5, n_thresholds: int = 300) -> DataFrame:
    """One row a model over the long table of scores: quality without a threshold, figures at the fixed one and at the one of the highest J."""
    by = (model,)
    ranked = pr_summary(pr_points(scores, target, score, by), by).select(model, F.col("roc_auc").alias("auc"), F.col("auc_pr").alias("pr_auc"))
    fixed = confusion(scores, target, score, threshold, by)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    fixed = fixed.select(model, safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_fixed"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_fixed"))
    j_fixed = business_j(scores.withColumn("__p", F.when(F.col(score) >= threshold, 1).otherwise(0)), target, "__p", amount, by=by).withColumnRenamed("j", "j_fixed")
    buckets = threshold_buckets(scores, target, score, amount, n_thresholds, by).withColumn("j", -0.25 * F.col("over_a0") - (F.col("all_a1") - F.col("over_a1")))
    block_all = buckets.where("bucket = 0").select(model, F.col("j").alias("j_block_all"))
    best = best_of_sweep(buckets, "j", by).select(model, F.col("threshold").alias("best_threshold"), safe(F.col("over_n1"), F.col("over_n0") + F.col("over_n1")).alias("precision_best"), safe(F.col("over_n1"), F.col("all_n1")).alias("recall_best"), F.col("j").alias("j_best"))
    out = ranked.join(fixed, model).join(j_fixed, model).join(block_all, model).join(best, model)
    return out.select(model, *[F.round(c, 4).alias(c) for c in out.columns if c != model])


def calibration_gain(evaluated: DataFrame) -> DataFrame:
    """What the best threshold gains over the fixed one, and in percent of its size."""
    gain = F.col("j_best") - F.col("j_fixed")
    return evaluated.withColumn("gain", F.round(gain, 4)).withColumn("gain_pct", F.round(F.try_divide(gain, F.abs("j_fixed")) * 100, 4))


def profit_decomposition(df: DataFrame, target: str, predicted: str, amount: str, margin: float = 0.25, loss: float = 1.0) -> DataFrame:
    """The whole result in money, its part that no decision can change, and the rest, which is J."""
    a, y, p = F.col(amount).cast("double"), F.col(target), F.col(predicted)
    s = lambda c: F.coalesce(F.sum(F.when(c, a)), F.lit(0.0))
    tn, fn, fp = s((y == 0) & (p == 0)), s((y == 1) & (p == 0)), s((y == 0) & (p == 1))
    out = df.agg(tn.alias("tn"), fn.alias("fn"), fp.alias("fp"), s(y == 0).alias("legit"))
    return out.select((margin * F.col("tn") - loss * F.col("fn")).alias("result"), (margin * F.col("legit")).alias("constant"), (-loss * F.col("fn") - margin * F.col("fp")).alias("j"))


def elkan_threshold(cost_fp: float, cost_fn: float) -> float:
    """The score from which blocking costs less than approving."""
    return cost_fp / (cost_fp + cost_fn)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(label, n, balanced, neg_per_pos)."""
    total = df.where(F.col(target).isNotNull()).agg(F.count("*").alias("n_all"), F.try_divide(F.count_if(F.col(target) == 0).cast("double"), F.count_if(F.col(target) == 1).cast("double")).alias("neg_per_pos"))
    n = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n_all") / (2 * F.col("n"))).alias("balanced"), "neg_per_pos")
