"""Edge cases and properties of the operators on small tables made by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from txrisk.functions import labels, scalar, special
from txrisk.operators import assoc, drift, ecdf, evaluate, fitted, joins, order, profile, split, windows
from txrisk.plans import pipeline
from txrisk.sources import tables

from conftest import ROOT

S = "k long, j string, fecha timestamp, monto double, fraude int"


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, j string, t string, monto double, fraude int").withColumn("fecha", F.to_timestamp("t")).drop("t")


ROWS = [(1, "a", "2024-01-01 00:00:00", 1.0, 0), (2, "a", "2024-01-01 01:00:00", 2.0, 1), (3, "a", "2024-01-01 01:00:00", 4.0, 0), (4, "a", "2024-01-01 02:00:00", 8.0, 0), (5, None, "2024-01-01 02:00:00", 3.0, 0), (6, "b", None, 5.0, 1), (7, "b", "2024-01-03 00:00:00", None, 0), (8, "b", "2024-01-03 00:30:00", 6.0, 1)]


def one(df, column, key="k"):
    return {r[key]: r[column] for r in df.collect()}


@pytest.mark.parametrize("buckets", [False, True])
def test_window_bounds(spark, buckets):
    got = one(windows.velocity_grid(frame(spark, ROWS), windows=("1h",), aggregates=("sum",), buckets=buckets), "monto_sum_1h")
    # the row at exactly t - w counts, rows of the same time don't; no entity, no time and no earlier row: null
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 6.0, 5: None, 6: None, 7: None, 8: None}


def test_window_unknown(spark):
    with pytest.raises(ValueError):
        windows.velocity_grid(frame(spark, ROWS), windows=("2h",))


def test_window_against_loops(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:00:00", float(rng.randint(1, 50)), 0) for i in range(300)]
    grid = windows.velocity_grid(frame(spark, rows), windows=("1d", "3d"), buckets=True).collect()
    base = [(r["k"], r["j"], r["fecha"], r["monto"]) for r in grid]
    for r in grid:
        for w, days in (("1d", 1), ("3d", 3)):
            seen = sorted(v for _, j, t, v in base if j == r["j"] and 0 < (r["fecha"] - t).total_seconds() <= days * 86400)
            assert r[f"monto_sum_{w}"] == (sum(seen) if seen else None)
            assert r[f"monto_max_{w}"] == (max(seen) if seen else None)
            middle = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2 if seen else None
            assert r[f"monto_median_{w}"] == middle


def test_history_is_what_new_rows_see(spark):
    t = frame(spark, [r for r in ROWS if r[2] and r[1]])
    whole = windows.velocity_grid(t, windows=("1d",), aggregates=("sum",))
    cut = "fecha >= timestamp'2024-01-01 01:30:00'"
    new = windows.with_history(t.where(cut), t.where(f"NOT {cut}"), windows=("1d",), aggregates=("sum",))
    assert one(new, "monto_sum_1d") == one(whole.where(cut), "monto_sum_1d")


def test_null_rules_of_row_features(spark):
    df = spark.createDataFrame([(1, -1.0, 0.0), (2, None, None), (3, -2.0, 3.0), (4, 0.0, 2.0)], "k long, x double, y double")
    assert one(df.select("k", scalar.log_feature("x").alias("v")), "v") == {1: None, 2: None, 3: None, 4: 0.0}
    assert one(df.select("k", scalar.zero_flag("x").alias("v")), "v") == {1: 0, 2: 0, 3: 0, 4: 1}
    assert one(df.select("k", scalar.ratio("x", "y", 9.0).alias("v")), "v") == {1: 9.0, 2: None, 3: -2 / 3, 4: 0.0}
    with pytest.raises(ValueError):
        scalar.hour_cyclic("x", "tan")


def test_nan_is_null(spark):
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert sorted(str(r[0]) for r in df.collect()) == ["1.0", "None"]


def test_date_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "x", None), ("2024-02-01", "2024-01-01", None)], "a string, b string, date_c string")
    assert {r["column_name"]: r["is_date"] for r in tables.detect_date_columns(df).collect()} == {"a": True, "b": False, "date_c": False}


def test_bins(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([1, 2, 3, 4, None])], "k long, x double")
    bins = fitted.QuantileBins("x", 2, name="b").fit(df)
    assert one(bins.transform(df), "b") == {0: "0", 1: "0", 2: "1", 3: "1", 4: "__MISSING__"}
    beyond = spark.createDataFrame([(1, -99.0), (2, 99.0)], "k long, x double")
    assert one(bins.transform(beyond), "b") == {1: "0", 2: "1"}
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k long, x double")
    assert one(fitted.QuantileBins("x", 3, name="b").fit(same).transform(same), "b") == {1: None, 2: None}


def test_maps_unseen_and_null(spark):
    train = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1), (4, "b", 0)], "k long, c string, fraude int")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "k long, c string")
    freq = one(fitted.FrequencyEncoding("c", name="f").fit(train).transform(new), "f")
    assert freq == {1: 0.5, 2: 0.25, 3: pytest.approx(1 / 3)}
    rare = one(fitted.RareGrouping("c", 0.5, name="r").fit(train).transform(new), "r")
    assert rare == {1: "a", 2: "__OTHER__", 3: "__OTHER__"}
    enc = one(fitted.TargetEncoding("c", shrinkage=2, name="e").fit(train).transform(new), "e")
    assert enc == {1: pytest.approx((1 + 2 * 0.5) / 4), 2: pytest.approx((1 + 1) / 3), 3: 0.5}


def test_out_of_fold_ignores_own_fold(spark):
    rows = [(i, "ab"[i % 2], i % 3 == 0) for i in range(60)]
    make = lambda flip: spark.createDataFrame([(k, c, int(y) if k != 7 else flip) for k, c, y in rows], "k long, c string, fraude int")
    own = fitted.fold_of("k", 5)
    fold = make(0).where("k = 7").select(own).first()[0]
    enc = lambda flip: {r["k"]: r["e"] for r in fitted.TargetEncoding("c", shrinkage=0, name="e").fit_transform(make(flip)).withColumn("fold", own).where(F.col("fold") == fold).collect()}
    assert enc(0) == enc(1)


def test_pca_sign_and_order(spark):
    df = spark.createDataFrame([(float(i), float(-2 * i), None if i == 3 else 0.0) for i in range(10)], "x double, y double, z double")
    p = fitted.PCA(["x", "y", "z"], 2).fit(df)
    assert max(p.components[0], key=abs) > 0 and abs(p.components[0][1]) > abs(p.components[0][0])


def test_ecdf_properties(spark):
    rng = random.Random(5)
    data = [(float(rng.randint(0, 30)), float(-rng.randint(0, 30)), int(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(data, "x double, y double, t int").withColumn("nx", -F.col("x"))
    e = ecdf.value_ecdf(df, ["x", "nx"], "t", slices=5)
    s = {r["feature"]: r for r in assoc.continuous_statistics(e).collect()}
    n0, n1 = s["x"]["n0"], s["x"]["n1"]
    u0 = sum((a > b) + 0.5 * (a == b) for a, _, t in data if t == 0 for b, _, u in data if u == 1)
    assert s["x"]["mannwhitney_stat"] == u0
    assert s["x"]["mannwhitney_stat"] + s["nx"]["mannwhitney_stat"] == n0 * n1
    assert s["x"]["auc"] == pytest.approx(1 - s["nx"]["auc"])


def test_one_class_gives_nulls(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, t int")
    r = assoc.continuous_statistics(ecdf.value_ecdf(df, ["x"], "t")).first()
    assert (r["auc"], r["ks_stat"], r["cohens_d"], r["mannwhitney_stat"]) == (None,) * 4
    w = assoc.logit_wald(ecdf.value_ecdf(df, ["x"], "t")).first()
    assert w["logit_beta"] is None and w["logit_separation_detected"]


def test_separation_is_flagged(spark):
    df = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, t int")
    assert assoc.logit_wald(ecdf.value_ecdf(df, ["x"], "t")).first()["logit_separation_detected"]


def test_logit_against_newton(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, t int")
    r = assoc.logit_wald(ecdf.value_ecdf(df, ["x"], "t")).first()
    X, b = np.column_stack([np.ones(400), x]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        h = X.T @ (X * (p * (1 - p))[:, None])
        b += np.linalg.solve(h, X.T @ (y - p))
    assert r["logit_beta"] == pytest.approx(b[1], rel=1e-6)
    assert r["logit_p_value"] == pytest.approx(special.normal_two_sided(b[1] / math.sqrt(np.linalg.inv(h)[1, 1])), rel=1e-4)


# Published class counts of three categorical features, and the statistics published for them.
COUNTS = [("o", "N", 9189, 2718), ("o", "Y", 15919, 1108), ("o", "__MISSING__", 74431, 1616), ("n", "0", 8371, 1695), ("n", "1", 91168, 3747), ("f_missing", "0", 99528, 5442), ("f_missing", "1", 11, 0)]
CHI2 = {"o": 9049.1809, "n": 3074.4099, "f_missing": 0.0091204}
LR = {"o": 6175.1519, "n": 2118.3611}
CRAMERS_V_O, IV_O, AUC_WOE_O = 0.29360, 1.11408, 0.244056


def test_published_statistics(spark):
    counts = spark.createDataFrame(COUNTS, "feature string, category string, n0 long, n1 long")
    chi = {r["feature"]: r for r in assoc.chi_square(counts).collect()}
    for f, v in CHI2.items():
        assert chi[f]["chi2_stat"] == pytest.approx(v, rel=1e-4)
    assert chi["o"]["cramers_v"] == pytest.approx(CRAMERS_V_O, abs=1e-5)
    lr = {r["feature"]: r for r in assoc.lr_test(counts).collect()}
    for f, v in LR.items():
        assert lr[f]["lr_stat"] == pytest.approx(v, rel=1e-6)
    assert lr["f_missing"]["lr_separation_detected"] and not lr["o"]["lr_separation_detected"]
    woe = assoc.woe_table(counts)
    assert one(assoc.information_value(woe), "iv", "variable")["o"] == pytest.approx(IV_O, abs=1e-5)
    auc = one(assoc.auc_woe(woe), "auc_woe", "variable")["o"]
    assert auc == pytest.approx(AUC_WOE_O, abs=1e-6)


def test_tail_probabilities():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.kolmogorov_sf(1.3580986393225505 * math.sqrt(2 / 1000), 1000, 1000) == pytest.approx(0.05, abs=1e-4)
    assert special.kolmogorov_sf(0.0, 5, 5) == 1.0


def test_psi_of_itself_is_zero(spark):
    df = spark.createDataFrame([(w, c) for w in (0, 1) for c in ("a", "a", "b", None)], "week int, c string")
    r = drift.psi(df, ["c"], "week", [1, 2]).orderBy("week").collect()
    assert r[0]["psi"] == pytest.approx(0) and r[0]["psi_label"] == "sin drift"
    assert r[1]["psi"] is None and r[1]["psi_label"] == "sin datos"


def test_ks_of_an_empty_week(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0)], "week int, x double")
    r = {x["week"]: x for x in drift.ks_drift(df, ["x"], "week", [1, 2]).collect()}
    assert r[1]["ks_stat"] == 0.5 and r[2]["ks_stat"] is None and r[2]["ks_label"] == "sin datos"


def test_sweep_at_zero_blocks_all(spark):
    df = spark.createDataFrame([(0.0, 0, 4.0), (0.5, 1, 10.0), (1.0, 0, 8.0), (None, 1, 99.0)], "p double, y int, m double")
    s = {r["bucket"]: r["j"] for r in evaluate.profit_sweep(df, "y", "p", "m", n_thresholds=3).collect()}
    assert s == {0: -3.0, 1: -2.0, 2: -12.0}


def test_thresholds_are_exact(spark):
    """A score equal to a threshold is over it, whatever the rounding of its product."""
    df = spark.createDataFrame([(i / 299.0, 0) for i in range(300)], "p double, y int")
    got = {r["bucket"]: r["over_n0"] for r in evaluate.threshold_buckets(df, "y", "p", None, 300, ()).collect()}
    assert got == {i: 300 - i for i in range(300)}


def test_split_shares_no_day(spark):
    rows = [(i, "a", f"2024-01-{1 + i // 7:02d} 00:00:0{i % 7}", 1.0, 0) for i in range(70)]
    t = frame(spark, rows)
    for args in ({}, {"val_size": 0.2}):
        sides = split.time_split(t, "fecha", "k", 0.25, **args)
        names = {r[0] for r in sides.select("side").distinct().collect()}
        for a in names:
            for b in names - {a}:
                assert split.shared_days(sides.where(F.col("side") == a), sides.where(F.col("side") == b), "fecha").count() == 0
    exact = split.time_split(t, "fecha", "k", 0.25, align_to_day=False)
    assert exact.where("side = 'train'").count() == int(70 * 0.75)
    with pytest.raises(ValueError):
        split.time_split(t, "fecha", "k", strategy="other")


def test_nearest_day_is_the_earlier_of_two(spark):
    starts = [("d0", 0), ("d1", 10), ("d2", 20), (None, 30)]
    assert split.aligned_cut(starts, 15) == ("d1", 10)


def test_consolidate_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k long, v int")
    with pytest.raises(ValueError):
        joins.consolidate(a, b)
    assert joins.consolidate(a, b.dropDuplicates(["k"])).count() == 2


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert profile.economic_impact(empty, "fecha", "fraude", "monto").count() <= 1
    assert windows.velocity_grid(empty).count() == 0
    assert ecdf.value_ecdf(empty, ["monto"], "fraude").count() == 0
    assert evaluate.pr_points(empty, "fraude", "monto").count() == 0
    assert profile.general_structure(empty).count() == 5


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, x double")
    assert one(fitted.TopPercentileFlag("x", name="f").fit(df).transform(df), "f") == {1: 0, 2: 0}
    assert one(fitted.Standardizer(["x"]).fit(df).transform(df), "x_std") == {1: None, 2: None}
    assert profile.numeric_distribution(df, ["x"]).first()["n_outliers"] == 0


def test_filter_config():
    steps = [{"name": "b", "type": "QuantileBinsDropnaTransformer", "cols": ["b"]}, {"name": "c", "type": "LogFeatureTransformer", "cols": ["c"]}]
    kept = pipeline.filter_config_by_features({"steps": steps}, ["b_qbin_dropna"], ["b", "c"])["steps"]
    assert [s["name"] for s in kept] == ["b", "b_raw"]
    with pytest.raises(ValueError):
        pipeline.make_stage("no_such_step", "x")


def test_failing_entry(spark):
    df = spark.createDataFrame([(1, 2.0)], "k long, x double")
    config = [{"process": "nothing", "column": "x"}, {"process": "log_feature", "column": "x", "new_column": "v"}]
    out, failed = pipeline.apply_transformations(df, config, skip_errors=True)
    assert len(failed) == 1 and "v" in out.columns
    with pytest.raises(ValueError):
        pipeline.apply_transformations(df, config)


def test_labels_at_their_bounds(spark):
    df = spark.createDataFrame([(0.1,), (0.0999,), (None,)], "x double")
    assert [r[0] for r in df.select(labels.label(F.col("x"), labels.PSI, missing=labels.NO_DATA)).collect()] == ["drift moderado", "sin drift", "sin datos"]


@pytest.mark.parametrize("crowded", [0, 40])
def test_busy_entities_in_blocks(spark, crowded):
    """Worked through in blocks, all or some of the entities have what frames give them."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), None if i % 50 == 0 else f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:{rng.choice((0, 30)):02d}:00", None if i % 7 == 0 else float(rng.randint(-50, 50)), 0) for i in range(400)]
    t = frame(spark, rows)
    names = [f"monto_{a}_{w}" for a in windows.AGGREGATES for w in ("1h", "1d", "3d")]
    grid = lambda c: {r["k"]: [r[n] for n in names] for r in windows.velocity_grid(t, windows=("1h", "1d", "3d"), crowded=c).collect()}
    got, want = grid(crowded), grid(10**9)
    assert set(got) == set(want) and len(got) == 400
    for k in want:
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(got[k], want[k]))


@pytest.mark.parametrize("key_type", ["long", "string"])
def test_position_with_crowded_seconds(spark, key_type):
    rng = random.Random(6)
    rows = [(rng.randint(-500, 500) * 1000 + i, None if i % 40 == 0 else f"2024-01-0{rng.randint(1, 3)} 00:00:00") for i in range(300)] + [(None, "2024-01-02 00:00:00")]
    t = spark.createDataFrame(rows, "k long, t string").select(F.col("k").cast(key_type).alias("k"), F.to_timestamp("t").alias("t"), F.lit(1).alias("position_of"))
    got = {r["k"]: r["position"] for r in windows.row_position(t, "t", "k").collect()}
    order = sorted(t.collect(), key=lambda r: (r["t"] is None, r["t"] and r["t"].timestamp(), r["k"] is not None, r["k"] or ""if key_type == "string" else r["k"] or 0))
    assert got == {r["k"]: i for i, r in enumerate(order)}
    assert windows.row_position(t.limit(0), "t", "k").count() == 0


@pytest.mark.parametrize("key_type", ["long", "string"])
def test_position_ranges_are_even(spark, key_type):
    """A day of one date and a skewed key are dealt to ranges of about the same size: none has twice the median."""
    t = spark.range(60_000).select(F.when(F.col("id") % 10 < 7, F.col("id") % 1000).otherwise(F.col("id") * 1_000_003).cast(key_type).alias("k"), F.lit("2024-01-01").cast("timestamp").alias("t"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = order.ordered(t, ["t", "k", "n"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.agg(F.count_distinct("position"), F.max("position")).first() == (60_000, 59_999)
    sizes = sorted(r["count"] for r in spark.read.parquet(placed._scratch_path).groupBy("__range").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ordered_in_groups_with_sums(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randint(0, 5), rng.randint(1, 9)) for i in range(300)] * 2
    t = spark.createDataFrame(rows, "i long, g string, v int, w long")
    got = order.ordered(t, [F.col("v").desc(), F.col("i")], by=["g"], name="at", count="n", sums={"run": "w"}).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        of = want.setdefault(r[1], [])
        of.append((r[0], r[2], len(of), (of[-1][3] if of else 0) + r[3]))
    assert len(got) == 600
    for g, expected in want.items():
        mine = sorted((r["at"], r["i"], r["v"], r["run"], r["n"]) for r in got if r["g"] == g)
        assert [(i, v, at, run) for at, i, v, run, _ in mine] == expected and {r[4] for r in mine} == {len(expected)}
    assert order.ordered(t.limit(0), ["v"], by=["g"], count="n", sums={"run": "w"}).count() == 0


def test_history_windows_share_an_exchange(spark):
    """A plan applies all windows of an entity to new rows in one pass over the history."""
    t = frame(spark, [r for r in ROWS if r[2] and r[1]])
    steps = [{"name": f"s{a}{w}", "type": f"{a}_window", "cols": ["monto"], "params": {"window": w}} for a in ("sum", "max") for w in ("1h", "1d")]
    plan = pipeline.build_preprocessor({"steps": steps}).fit(t)
    out = plan.transform(t.withColumn("fecha", F.col("fecha") + F.expr("INTERVAL 30 MINUTES")))
    assert out._jdf.queryExecution().executedPlan().toString().count("Union") == 1
    assert out.where("k = 4").first()["monto_max_1h"] == 8.0


def test_kolmogorov_p(spark):
    rows = [(0.3, 50, 60), (0.05, 40, 40), (0.9, 30, 30), (0.0, 5, 5), (None, 5, 5), (0.11, 2000, 3000)]
    got = [r["p"] for r in spark.createDataFrame(rows, "d double, n long, m long").select(drift.kolmogorov_p(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    for (d, n, m), p in zip(rows, got):
        assert p is None if d is None else abs(p - special.kolmogorov_sf(d, n, m)) < 1e-12


def test_rolling_against_slices():
    from txrisk.streaming.jobs import rolling

    rng = random.Random(8)
    times = sorted(rng.randint(0, 200) for _ in range(150))
    values = [rng.choice([None, float("nan"), float(rng.randint(-9, 9))]) if rng.random() < 0.2 else float(rng.randint(-9, 9)) for _ in times]
    at = sorted(rng.sample(range(250), 60) + times[:20])
    got = rolling(times, values, at, 30)
    for i, t in enumerate(at):
        seen = [v for u, v in zip(times, values) if t - 30 <= u < t and v is not None and v == v]
        want = (sum(seen), sum(seen) / len(seen), max(seen), min(seen)) if seen else (None,) * 4
        assert all(x is y is None or abs(x - y) < 1e-9 for x, y in zip((got["sum"][i], got["mean"][i], got["max"][i], got["min"][i]), want))


def test_stream_with_history(spark, tmp_path):
    """Rows of a stream see the history it was given; an idle entity leaves the state."""
    from txrisk.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = frame(spark, [r for r in ROWS if r[2] and r[1] == "a"]).select("k", "j", "fecha", "monto")
    t.where("k > 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    out = jobs.stream_velocity(stream, windows=("1d",), history=t.where("k <= 3"), watermark="1 hour")
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert one(spark.read.parquet(str(tmp_path / "out")), "monto_sum_1d") == {4: 7.0}


def _replay(stream, folder):
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start(str(folder / "out"))
    q.awaitTermination(300)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(folder / "out")), q


def _stateful(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def test_stream_of_late_rows(spark, tmp_path):
    """Rows that arrive in any order within the watermark, a third of them of one entity, get what a table of all rows gives them; a row that is later is left out.
    The busy entity's rows of a batch have several stretches, and state goes with them."""
    from txrisk.streaming import jobs

    rng = random.Random(12)
    minutes = sorted(rng.sample(range(14 * 1440), 240))
    rows = [(i, rng.choice(["hot", "b", "c"]) if i % 3 else "hot", f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}:00", None if i % 11 == 0 else float(rng.randint(0, 50)), 0) for i, m in enumerate(minutes)]
    t = frame(spark, rows).select("k", "j", "fecha", "monto", F.concat(F.lit("é|"), F.col("k").cast("string")).alias("note"), (F.col("k") / 3).alias("x"))
    order_ = [r[0] for r in sorted(rows, key=lambda r: r[0] + rng.randint(0, 30))]  # rows come up to 30 rows late
    for n in range(6):
        t.where(F.col("k").isin(order_[40 * n : 40 * n + 40])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = frame(spark, [(1000, "b", "2024-03-01 00:00:00", 1.0, 0)]).select("k", "j", "fecha", "monto", F.lit("end").alias("note"), F.lit(0.0).alias("x"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = frame(spark, [(1001, "b", "2024-01-02 00:00:00", 1e9, 0)]).select("k", "j", "fecha", "monto", F.lit("late").alias("note"), F.lit(0.0).alias("x"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = _stateful(spark)
    stream = own.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, query = _replay(jobs.stream_velocity(stream, windows=("1h", "3d"), aggregates=("sum", "median"), watermark="4 days", late=True, stretch="1d"), tmp_path)
    got = {r["k"]: r for r in out.collect()}
    want = {r["k"]: r for r in windows.velocity_grid(t, windows=("1h", "3d"), aggregates=("sum", "median")).collect()}
    assert set(got) == set(want) and 1001 not in got
    for k, r in want.items():
        for c in r.asDict():
            assert got[k][c] == r[c] or (isinstance(r[c], float) and abs(got[k][c] - r[c]) < 1e-9), (k, c)
    progress = query.recentProgress
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > progress[-1]["stateOperators"][0]["numRowsTotal"]
    hot = t.where("j = 'hot'").select(F.floor(F.unix_micros("fecha") / windows.window_length("1d")).alias("s")).distinct().count()
    assert hot >= 10  # keys of the busy entity, each a task's own


def test_late_rows_of_many_entities_share_their_state(spark, tmp_path):
    """Entities of a part and a stretch are one group of few packs, so the state has fewer rows than the stream; every aggregate, nulls and history as in a table."""
    from txrisk.streaming import jobs

    at = F.timestamp_seconds(1_704_067_200 + F.col("id") * 104_729 % 345_600)
    every = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("u"), F.col("id") * 7919 % 1000).alias("j"), at.alias("fecha"), F.when(F.col("id") % 11 != 0, (F.col("id") * 31 % 97).cast("double")).alias("monto"), F.concat(F.lit("line\nbreak "), "id").alias("note"))
    old, t = every.where("fecha < timestamp'2024-01-02'"), every.where("fecha >= timestamp'2024-01-02'")
    for n in range(3):
        t.where(F.col("k") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t.limit(1).withColumns({"k": F.lit(-1).cast("long"), "fecha": F.lit("2024-03-01").cast("timestamp")}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = _stateful(spark).readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kinds = {"windows": ("1h", "1d"), "aggregates": ("sum", "mean", "max", "min", "median")}
    out, query = _replay(jobs.stream_velocity(stream, **kinds, watermark="5 days", late=True, stretch="1d", history=old), tmp_path)
    got, want = ({r["k"]: r.asDict() for r in x.collect()} for x in (out, windows.with_history(t, old, **kinds)))
    assert got.keys() == want.keys() and any(r["monto_sum_1d"] for r in got.values())
    for k, r in want.items():
        assert all(got[k][c] == v or (isinstance(v, float) and got[k][c] == pytest.approx(v, abs=1e-9)) for c, v in r.items()), (got[k], r)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 2000 < t.count()


def test_folds_of_ranges():
    np = pytest.importorskip("numpy")
    rng = random.Random(4)
    for _ in range(20):
        v = np.array([float(rng.randint(-9, 9)) for _ in range(rng.randint(1, 70))])
        low = np.array([rng.randint(0, len(v)) for _ in range(30)])
        high = np.array([rng.randint(a, len(v)) for a in low])
        for fold, none in ((np.add, 0.0), (np.maximum, -np.inf), (np.minimum, np.inf)):
            assert windows.range_folds(v, low, high, fold, none).tolist() == [fold.reduce(v[a:b], initial=none) for a, b in zip(low, high)]
    assert windows.range_folds(np.array([1e300, 1.0, 2.0]), np.array([1]), np.array([3]), np.add, 0.0).tolist() == [3.0]


def _plan_of(spark, train):
    from txrisk.queries import scoring

    return scoring.fit_plan(train)


def test_saved_plan_in_a_fresh_process(spark, small, tmp_path):
    """Another process loads the preprocessor with the model and gives raw rows the same features and scores; versions count up, and a half-written one doesn't exist."""
    import shutil
    import subprocess
    import sys

    from txrisk.plans import artifact

    tx = tables.transactions(spark, small)
    train, new = tx.where("fecha < timestamp'2024-01-21'"), tx.where("fecha >= timestamp'2024-01-21'")
    plan, model, meta = _plan_of(spark, train)
    artifact.save_model(model, meta, str(tmp_path / "m"), "a", plan)
    artifact.save_model(model, meta, str(tmp_path / "m"), "b")
    second = artifact.save_model(model, meta, str(tmp_path / "m"), "a", plan)
    broken = artifact.save_model(model, meta, str(tmp_path / "m"), "a", plan)
    shutil.rmtree(f"{broken}/manifest")  # the writer died before its last step
    found = artifact.load_models(spark, str(tmp_path / "m"))
    assert list(found) == ["a", "b"] and found["a"].version == 2 and found["b"].preprocessor is None
    assert artifact.load_model(spark, str(tmp_path / "m"), "a", 1).version == 1 and second.endswith(artifact._manifests(spark, f"{tmp_path}/m/a/*/manifest")[-1]["folder"])
    with pytest.raises(FileNotFoundError):
        artifact.load_model(spark, str(tmp_path / "m"), "a", 3)
    assert not artifact.load_models(spark, str(tmp_path / "none"))
    want = {r["k"]: r for r in artifact.Artifact("a", 0, plan, model, meta).score(new).collect()}
    code = f"""
from pyspark.sql import SparkSession
from txrisk.plans import artifact
from txrisk.sources.tables import transactions
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
new = transactions(s, {small!r}).where("fecha >= timestamp'2024-01-21'")
artifact.load_model(s, {str(tmp_path / 'm')!r}, "a").score(new).write.parquet({str(tmp_path / 'scored')!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=str(ROOT), capture_output=True)
    got = {r["k"]: r for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert set(got) == set(want) and len(want) > 100
    for k, r in want.items():
        for c, v in r.asDict().items():
            assert got[k][c] == v or (isinstance(v, float) and got[k][c] == pytest.approx(v, abs=1e-9)), (k, c)
    with pytest.raises(Exception, match="history was kept"):
        found["a"].score(train).count()


def test_what_cannot_be_stored(spark, tmp_path):
    from txrisk.plans import artifact

    plan = pipeline.Preprocessor([fitted.Expression("x", F.lit(1))])
    with pytest.raises(ValueError, match="make_stage"):
        artifact._recipe(plan.stages[0])
    kept = fitted.Standardizer(["a"], "_s")
    assert artifact._built(artifact._recipe(kept)) == kept


def test_streamed_scores(spark, small, tmp_path):
    """Windows, maps and model in one stream, late rows too: each row's score is the batch's."""
    from txrisk.plans import artifact
    from txrisk.streaming import jobs

    tx = tables.transactions(spark, small)
    train, new = tx.where("fecha < timestamp'2024-01-21'"), tx.where("fecha >= timestamp'2024-01-21'")
    plan, model, meta = _plan_of(spark, train)
    artifact.save_model(model, meta, str(tmp_path / "m"), "a", plan)
    own = _stateful(spark)
    for n in range(3):
        new.where(F.pmod(F.col("k"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = new.limit(1).withColumn("k", F.lit(-1)).withColumn("fecha", F.lit("2025-01-01").cast("timestamp"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, _ = _replay(jobs.stream_scores(stream, artifact.load_model(own, str(tmp_path / "m"), "a"), watermark="60 days", late=True), tmp_path)
    got = one(out, "probability_1")
    want = one(artifact.Artifact("a", 0, plan, model, meta).score(new), "probability_1")
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_medians_of_ranges():
    np = pytest.importorskip("numpy")
    rng = random.Random(2)
    for _ in range(20):
        v = np.array([rng.choice([float("nan"), float(rng.randint(0, 9)), rng.random()]) for _ in range(rng.randint(1, 60))])
        low = np.array([rng.randint(0, len(v)) for _ in range(30)])
        high = np.array([rng.randint(a, len(v)) for a in low])
        want = [np.nanmedian(v[a:b]) if (~np.isnan(v[a:b])).any() else np.nan for a, b in zip(low, high)]
        assert np.array_equal(windows.range_medians(v, low, high), want, equal_nan=True)


def test_medians_of_a_busy_entity_in_time(spark):
    """Four times the rows of one entity, in the same time, cost no more than five times the time."""
    import time

    took = {}
    for n in (10_000, 40_000, 10_000, 40_000):  # the first two warm up
        rows = spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("j"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 864_000 / n).alias("fecha"), (F.col("id") * 7919 % 1009).cast("double").alias("monto"))
        began = time.time()
        windows.velocity_grid(rows, windows=("15d",), aggregates=("median",)).write.format("noop").mode("overwrite").save()
        took[n] = time.time() - began
    assert took[40_000] <= 5 * took[10_000], took


def test_kendall_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 1.0, float(rng.randint(0, 9)), rng.random()]), rng.choice([None, 0.0, 0.0, 0.0, rng.random()]), float(rng.randint(0, 400)), 5.0) for _ in range(500)]
    t = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(t, ["a", "b", "c", "d"], "kendall").collect()}
    sign = lambda x: (x > 0) - (x < 0)
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            s = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for n, p in enumerate(both) for q in both[:n]]
            below = math.sqrt(sum(u != 0 for u, _ in s) * sum(v != 0 for _, v in s))
            assert got[x, y] == (pytest.approx(sum(u * v for u, v in s) / below, abs=1e-12) if below else None), (x, y)


def test_exact_p_values():
    """Counted orders: U without ties for small samples, and the distance of distributions; beyond, the limits."""
    from itertools import combinations

    for m, n in ((1, 6), (3, 4), (4, 5)):
        orders = list(combinations(range(m + n), m))
        us = [sum(a - i for i, a in enumerate(o)) for o in orders]
        assert special.rank_sum_counts(m, n) == [us.count(u) for u in range(m * n + 1)]
        for u in range(m * n + 1):
            far = max(u, m * n - u)
            assert special.rank_sum_two_sided(u, m, n, 0.0, 0.0) == pytest.approx(min(1.0, 2 * sum(x >= far for x in us) / len(us)))

        def distance(o, m=m, n=n):
            at, best = 0, 0.0
            for k in range(m + n):
                at += k in o
                best = max(best, abs(at / m - (k + 1 - at) / n))
            return best

        ds = [distance(set(o)) for o in orders]
        for d in {round(x, 12) for x in ds}:
            assert special.distance_sf(d, m, n) == pytest.approx(sum(x >= d - 1e-9 for x in ds) / len(ds))
    assert special.rank_sum_two_sided(0, 3, 3, -1.7, 0) == pytest.approx(0.1)
    assert special.distance_sf(1.0, 10, 10) == pytest.approx(2 / math.comb(20, 10), rel=1e-9)
    assert special.rank_sum_two_sided(0, 9, 9, 2.0, 0) == special.normal_two_sided(2.0) == special.rank_sum_two_sided(0, 3, 3, 2.0, 6)
    assert special.distance_sf(0.02, 20_000, 9_000) == special.kolmogorov_sf(0.02, 20_000, 9_000)
    assert special.distance_sf(0.03, 9_000, 8_000) == pytest.approx(special.kolmogorov_sf(0.03, 9_000, 8_000), rel=0.05)


def test_quantiles_by_selection(spark):
    """Ties, one value, nulls, few rows and many: what numpy's linear interpolation gives, also where the sketch is coarse."""
    np = pytest.importorskip("numpy")
    rng = random.Random(4)
    rows = [(None if i % 7 == 0 else rng.gauss(0, 1) ** 3, float(i % 3), 4.0, None, float(i) if i < 3 else None) for i in range(3000)]
    t = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for accuracy in (20, 10_000):
        got = fitted.quantiles(t, list("abcde"), at, accuracy)
        for i, c in enumerate("abce"):
            have = [r["abcde".index(c)] for r in rows if r["abcde".index(c)] is not None]
            assert got[c] == pytest.approx(np.quantile(have, at).tolist(), abs=1e-12)
        assert got["d"] is None
    assert fitted.quantiles(t.limit(0), ["a"], [0.5]) == {"a": None}


def test_settings_and_small_helpers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"steps": [1]}')
    assert tables.load_config(str(tmp_path / "a.json")) == {"steps": [1]}
    got = spark.createDataFrame([("2024-01-01 00:00:00",), ("no time",), (None,)], "t string").select(scalar.coerce_timestamp("t").alias("t")).collect()
    assert [r["t"] is not None for r in got] == [True, False, False]
    assert evaluate.elkan_threshold(1.0, 3.0) == 0.25
