"""Row features, windows, splits and joins over the transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins, split, windows
from ..roles import Roles
from ..sources import tables
from ..sources.scratch import scratch_dir
from ..sources.tables import transactions as tx
from ..sources.tables import tx_sql


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def r9(c, name=None):
    """Nine digits, so that means of few amounts in cents don't end in a half."""
    return F.round(c, 9).alias(name or c)


def text(c, name=None):
    """A time or day as text, so that both engines write it alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def row(name, make, sql):
    """A query of one expression beside the key."""
    add(name, lambda s, d: tx(s, d).select("k", make().alias("value")), tx_sql(f"SELECT k, {sql} AS value FROM tx"))


def _csv_round_trip(spark, sf_dir):
    """Transactions written as CSV by Spark into its shared folder and read back with a schema."""
    import uuid

    path = f"{scratch_dir(spark)}/transactions-{uuid.uuid4().hex}"
    rows = tx(spark, sf_dir).select("k", text("fecha"), "j", "monto", "fraude", "b", "o")
    tables.write_table(rows, path, "csv")
    back = tables.read_transactions(spark, path, "k long, fecha string, j string, monto double, fraude int, b double, o string", fmt="csv")
    return back.select("k", text("fecha"), "j", "monto", "fraude", r6("b"), "o")


add("s1_read_transactions", lambda s, d: tx(s, d).select("k", text("fecha"), "j", "monto", "fraude", "score", "a", r6("b"), r6("c"), "d", r6("m"), r6("e"), "f", "g", "h", r6("l"), "n", "o", "p"), tx_sql("SELECT k, strftime(fecha, '%Y-%m-%d %H:%M:%S.%f') AS fecha, j, monto, fraude, score, a, round(b, 6) AS b, round(c, 6) AS c, d, round(m, 6) AS m, round(e, 6) AS e, f, g, h, round(l, 6) AS l, n, o, p FROM tx"))
add("s3_csv_round_trip", _csv_round_trip, tx_sql("SELECT k, strftime(fecha, '%Y-%m-%d %H:%M:%S.%f') AS fecha, j, monto, fraude, round(b, 6) AS b, o FROM tx"))
add("s2_detect_date_columns", lambda s, d: tables.detect_date_columns(tables.events(s, d).select("ts", "event_type", F.col("ts").cast("string").alias("ts_text"), "props")), "SELECT 'ts' AS column_name, 0::BIGINT AS sampled, 0::BIGINT AS parsed, true AS is_date UNION ALL SELECT 'event_type', least(500, count(*)), 0, false FROM events UNION ALL SELECT 'ts_text', least(500, count(*)), least(500, count(*)), true FROM events UNION ALL SELECT 'props', least(500, count(*)), 0, false FROM events")

row("p1_log_feature", lambda: F.round(S.log_feature("f"), 6), "CASE WHEN f > -1 THEN round(ln(1 + f), 6) END")
row("p2_missing_flag", lambda: S.missing_flag("b"), "CASE WHEN b IS NULL THEN 1 ELSE 0 END")
row("p3_zero_flag", lambda: S.zero_flag("d"), "CASE WHEN d = 0 THEN 1 ELSE 0 END")
row("p4_hour", lambda: S.hour("fecha"), "hour(fecha)::INT")
row("p5_weekday", lambda: S.weekday("fecha"), "(isodow(fecha) - 1)::INT")
row("p6_is_weekend", lambda: S.is_weekend("fecha"), "CASE WHEN isodow(fecha) >= 6 THEN 1 ELSE 0 END")
add("p7_hour_cyclic", lambda s, d: tx(s, d).select("k", r6(S.hour_cyclic("fecha", "sin"), "hour_sin"), r6(S.hour_cyclic("fecha", "cos"), "hour_cos")), tx_sql("SELECT k, round(sin(hour(fecha) * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour(fecha) * 2 * pi() / 24), 6) AS hour_cos FROM tx"))
row("p8_ratio", lambda: F.round(S.ratio("monto", "l"), 6), "round(CASE WHEN l <> 0 THEN monto / l END, 6)")
row("p9_coerce_numeric", lambda: S.coerce_numeric(F.when(F.col("k") % 13 == 0, "x").otherwise(F.col("score").cast("string"))), "CASE WHEN k % 13 = 0 THEN NULL ELSE score::DOUBLE END")
add("p10_week_index", lambda s, d: S.with_week_index(tx(s, d), "fecha").select("k", "week"), tx_sql("SELECT k, floor(datediff('day', (SELECT min(fecha)::DATE FROM tx), fecha::DATE) / 7)::INT AS week FROM tx"))
row("p11_decide", lambda: S.decide(F.col("score") / 99.0, 0.5), "CASE WHEN score / 99.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END")
add("p13_drop_roles", lambda s, d: S.drop_roles(tx(s, d).select("k", "fraude", "a", "p"), "fraude"), tx_sql("SELECT k, a, p FROM tx"))
add("p14_classify_columns", lambda s, d: tx(s, d).agg(*[F.count(c).alias(f"{kind}_{c}") for kind, cols in S.classify_columns(tx(s, d), ("a", "n"), ("k", "fraude")).items() for c in cols]), tx_sql("SELECT " + ", ".join(f"count({c}) AS {k}_{c}" for k, cols in (("continuous", ["monto", "score", "b", "c", "d", "m", "e", "f", "h", "l"]), ("categorical", ["j", "a", "g", "n", "o", "p"])) for c in cols) + " FROM tx"))
add("p15_complete_rows", lambda s, d: S.complete_rows_report(tx(s, d), ["b", "d"]), tx_sql("SELECT count(*) FILTER (b IS NOT NULL AND d IS NOT NULL) AS used, count(*) FILTER (b IS NULL OR d IS NULL) AS dropped FROM tx"))
add("p16_filter_by_label", lambda s, d: S.filter_by_label(tx(s, d), "fraude", 1).select("k", "monto"), tx_sql("SELECT k, monto FROM tx WHERE fraude = 1"))

GRID = ("1h", "1d", "7d")
_frame = lambda w: f"(PARTITION BY j ORDER BY fecha RANGE BETWEEN INTERVAL '{windows.WINDOWS[w] // windows.HOUR} hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)"
for _id, _a, _f in (("w1", "sum", "sum"), ("w2", "mean", "avg"), ("w3", "median", "median"), ("w4", "max", "max"), ("w5", "min", "min")):
    add(f"{_id}_{_a}_window", lambda s, d, a=_a: windows.velocity_grid(tx(s, d), windows=GRID, aggregates=(a,)).select("k", *[r9(f"monto_{a}_{w}") for w in GRID]), tx_sql(f"SELECT k, {', '.join(f'round({_f}(monto) OVER {_frame(w)}, 9) AS monto_{_a}_{w}' for w in GRID)} FROM tx"))
_names = [f"monto_{a}_{w}" for w in windows.WINDOWS for a in windows.AGGREGATES]
_sql_of = {"sum": "sum", "mean": "avg", "median": "median", "max": "max", "min": "min"}
GRID_SQL = ", ".join(f"round({_sql_of[a]}(monto) OVER {_frame(w)}, 9) AS monto_{a}_{w}" for w in windows.WINDOWS for a in windows.AGGREGATES)
add("w6_velocity_grid", lambda s, d: windows.velocity_grid(tx(s, d)).select("k", *[r9(n) for n in _names]), tx_sql(f"SELECT k, {GRID_SQL} FROM tx"))
LINES = Roles(key="l_orderkey", entity="l_suppkey", time="l_shipdate", amount="l_extendedprice")
add("w6_velocity_grid_buckets", lambda s, d: windows.velocity_grid(s.read.parquet(f"{d}/lineitem.parquet"), ("l_extendedprice",), ("7d", "15d"), ("sum", "max"), LINES, buckets=True).select("l_orderkey", "l_suppkey", "l_linenumber", *[F.round(f"l_extendedprice_{a}_{w}", 2).alias(f"{a}_{w}") for w in ("7d", "15d") for a in ("sum", "max")]), "SELECT l_orderkey, l_suppkey, l_linenumber, " + ", ".join(f"round({a}(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL '{n} days' PRECEDING AND INTERVAL '1 microsecond' PRECEDING), 2) AS {a}_{n}d" for n in (7, 15) for a in ("sum", "max")) + " FROM lineitem")
add("w8_row_position", lambda s, d: windows.row_position(tx(s, d), "fecha", "k").select("k", "position"), tx_sql("SELECT k, row_number() OVER (ORDER BY fecha, k) - 1 AS position FROM tx"))
add("w9_week_label", lambda s, d: split.week_labels(S.with_week_index(tx(s, d), "fecha").groupBy("week").count(), "week"), tx_sql("SELECT week, count, 'semana_' || row_number() OVER (ORDER BY week) AS label FROM (SELECT floor(datediff('day', (SELECT min(fecha)::DATE FROM tx), fecha::DATE) / 7)::INT AS week, count(*) AS count FROM tx GROUP BY 1)"))


def _history(spark, sf_dir):
    t = tx(spark, sf_dir)
    old, new = t.where("fecha < timestamp'2024-01-20'"), t.where("fecha >= timestamp'2024-01-20'")
    return windows.with_history(new, old, windows=("1d", "7d"), aggregates=("sum", "mean")).select("k", *[r9(f"monto_{a}_{w}") for w in ("1d", "7d") for a in ("sum", "mean")])


add("j6_history_union", _history, tx_sql(f"SELECT * FROM (SELECT k, {', '.join(f'round({f}(monto) OVER {_frame(w)}, 9) AS monto_{a}_{w}' for w in ('1d', '7d') for a, f in (('sum', 'sum'), ('mean', 'avg')))} , fecha FROM tx) WHERE fecha >= TIMESTAMP '2024-01-20'").replace("SELECT * FROM (SELECT k", "SELECT * EXCLUDE (fecha) FROM (SELECT k"))

add("j1_consolidate", lambda s, d: joins.consolidate(tx(s, d).select("k", "monto"), tx(s, d).select("k", S.missing_flag("b").alias("b_missing")), tx(s, d).select("k", r6(S.log_feature("c"), "log_c"))), tx_sql("SELECT k, monto, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS b_missing, round(ln(1 + c), 6) AS log_c FROM tx"))


def _orders(spark, sf_dir):
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    named = joins.map_lookup(o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey, "left"), n, "c_nationkey", "n_nationkey", "n_name", "nation")
    return named.select("o_orderkey", "nation", "o_totalprice")


add("j2_map_lookup", _orders, "SELECT o_orderkey, n_name AS nation, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
add("j3_isin_top", lambda s, d: joins.isin_top(tx(s, d), "g", 5).select("k", "in_top"), tx_sql("SELECT k, CASE WHEN g IN (SELECT g FROM (SELECT g, count(*) AS n FROM tx WHERE g IS NOT NULL GROUP BY g ORDER BY n DESC, g LIMIT 5)) THEN 1 ELSE 0 END AS in_top FROM tx"))
add("j4_unseen_categories", lambda s, d: joins.unseen_categories(tx(s, d).where("k % 50 = 0"), tx(s, d).where("k % 50 <> 0"), ["g", "j", "o"]), tx_sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM tx WHERE k % 50 <> 0 AND {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM tx WHERE k % 50 = 0 AND {c} IS NOT NULL) GROUP BY {c}" for c in ("g", "j", "o"))))
add("o1_top_k", lambda s, d: joins.top_k(tx(s, d), "monto", 20, "k").select("k", "monto"), tx_sql("SELECT k, monto FROM tx ORDER BY monto DESC NULLS LAST, k LIMIT 20"))
add("o2_bottom_k", lambda s, d: joins.bottom_k(tx(s, d), "c", 20, "k").select("k", r6("c")), tx_sql("SELECT k, round(c, 6) AS c FROM tx ORDER BY tx.c NULLS LAST, k LIMIT 20"))
add("o4_union", lambda s, d: joins.stack(tx(s, d).groupBy(F.col("o").alias("value")).agg(F.count("*").alias("n")).withColumn("column_name", F.lit("o")), tx(s, d).groupBy(F.col("p").alias("value")).agg(F.count("*").alias("n")).withColumn("column_name", F.lit("p"))), tx_sql("SELECT o AS value, count(*) AS n, 'o' AS column_name FROM tx GROUP BY o UNION ALL SELECT p, count(*), 'p' FROM tx GROUP BY p"))
add("o5_set_operations", lambda s, d: tx(s, d).where("fraude = 1").select("j").intersect(tx(s, d).where("monto > 20").select("j")).union(tx(s, d).select("g").distinct().withColumnRenamed("g", "j")), tx_sql("(SELECT j FROM tx WHERE fraude = 1 INTERSECT SELECT j FROM tx WHERE monto > 20) UNION ALL SELECT DISTINCT g FROM tx"))
add("w10_best_per_group", lambda s, d: joins.best_per_group(tx(s, d), "j", "monto", "k").select("j", "k", "monto"), tx_sql("SELECT j, k, monto FROM tx QUALIFY row_number() OVER (PARTITION BY j ORDER BY monto DESC NULLS LAST, k) = 1"))

# --- splits -----------------------------------------------------------------------------------------------------------------------
_DAYS = """days AS (SELECT fecha::DATE AS day, count(*) AS c FROM tx GROUP BY 1), starts AS (SELECT day, coalesce(sum(c) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM days),
    total AS (SELECT count(*) AS n FROM tx)"""
_cut = lambda name, share: f"{name} AS (SELECT day, before FROM starts, total WHERE before > 0 ORDER BY abs(before - floor(n * (1 - {share}))), before LIMIT 1)"
add("x1_time_split", lambda s, d: split.time_split(tx(s, d), "fecha", "k", 0.3).select("k", "side"), tx_sql("SELECT k, CASE WHEN fecha::DATE < (SELECT day FROM cut) THEN 'train' ELSE 'test' END AS side FROM tx", _DAYS, _cut("cut", 0.3)))
add("x2_split_last", lambda s, d: split.time_split(tx(s, d), "fecha", "k", 0.2, 0.2).select("k", "side"), tx_sql("SELECT k, CASE WHEN fecha::DATE < (SELECT day FROM a) THEN 'train' WHEN fecha::DATE < (SELECT max(day) FROM (SELECT day FROM a UNION ALL SELECT day FROM b)) THEN 'val' ELSE 'test' END AS side FROM tx", _DAYS, _cut("a", "0.2 - 0.2"), _cut("b", 0.2)))
add("x3_same_period", lambda s, d: split.time_split(tx(s, d), "fecha", "k", 0.2, 0.2, "same_period").select("k", "side"), tx_sql("SELECT k, CASE WHEN pos < before THEN 'train' WHEN (pos - before) % 2 = 0 THEN 'val' ELSE 'test' END AS side FROM (SELECT k, row_number() OVER (ORDER BY fecha, k) - 1 AS pos FROM tx), a", _DAYS, _cut("a", "0.2 - 0.2")))
add("x4_split_exact", lambda s, d: split.time_split(tx(s, d), "fecha", "k", 0.25, align_to_day=False).select("k", "side"), tx_sql("SELECT k, CASE WHEN pos < floor(n * 0.75) THEN 'train' ELSE 'test' END AS side FROM (SELECT k, row_number() OVER (ORDER BY fecha, k) - 1 AS pos, count(*) OVER () AS n FROM tx)"))


def _sides(s, d):
    return split.time_split(tx(s, d), "fecha", "k", 0.3)


def _shared(s, d):
    sides = split.time_split(tx(s, d), "fecha", "k", 0.3, align_to_day=False)
    return split.shared_days(sides.where("side = 'train'"), sides.where("side = 'test'"), "fecha").select(F.col("day").cast("string").alias("day"))


add("x5_shared_days", _shared, tx_sql("SELECT DISTINCT fecha::DATE::VARCHAR AS day FROM p WHERE pos < floor(n * 0.7) AND fecha::DATE IN (SELECT fecha::DATE FROM p WHERE pos >= floor(n * 0.7))", "p AS (SELECT fecha, row_number() OVER (ORDER BY fecha, k) - 1 AS pos, count(*) OVER () AS n FROM tx)"))
add("x6_split_report", lambda s, d: split.split_report(_sides(s, d), "fecha", "fraude").select("side", "n_rows", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), r6("rate")), tx_sql("SELECT side, count(*) AS n_rows, min(fecha)::DATE::VARCHAR AS first_day, max(fecha)::DATE::VARCHAR AS last_day, round(avg(fraude), 6) AS rate FROM (SELECT *, CASE WHEN fecha::DATE < (SELECT day FROM cut) THEN 'train' ELSE 'test' END AS side FROM tx) GROUP BY side", _DAYS, _cut("cut", 0.3)))
add("a17_distinct_days", lambda s, d: split.distinct_days(tx(s, d), "fecha").select("n_days", r6("test_share")), tx_sql("SELECT count(DISTINCT fecha::DATE) AS n_days, round(14 / count(DISTINCT fecha::DATE), 6) AS test_share FROM tx"))
