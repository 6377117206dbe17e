"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, with_row_id, words_of

LEAF = ["domain", "lang", "source"]
#: Coarse steps of an epoch's order: a leaf's documents fall into 2^BUCKET_BITS buckets of their 60-bit order key.
BUCKET_BITS = 12


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits that give the order of documents in an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _pour(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Deal each parent's ``budget`` to its children by ``weight``, none above its ``capacity``; what a full child leaves goes to its
    siblings by their weights. Adds ``share``. The children of one parent are few: names, not documents."""
    of = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = of.orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("full", F.col("capacity") <= F.col("weight") * (F.col("budget") - before) / onward)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(of), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(of)
    return level.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * F.greatest(left, F.lit(0.0)) / open_)).drop("full")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """Token budgets of the leaves of a domain-language-source tree.

    ``leaves`` has domain, lang, source, tokens (long) and the weights domain_weight, lang_weight and source_weight, each equal on all
    rows of its node; ``budget`` is an expression over aggregates of the leaves, such as sum(tokens). A leaf can give max_epochs times
    its tokens, a node what its leaves can. Top down, each node's budget is poured over its children, so a shortage is made up by
    siblings, and reaches the next ancestor's siblings only where a whole node is exhausted. Leaves with a weight of zero, null
    or less anywhere on their path get nothing and are left out. Adds leaf_budget (long)."""
    live = leaves.where("domain_weight > 0 AND lang_weight > 0 AND source_weight > 0 AND tokens > 0").withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    total = leaves.agg(budget.cast("double").alias("budget"))
    domains = live.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("domain_weight").cast("double").alias("weight")).crossJoin(F.broadcast(total))  # one row
    domains = _pour(domains, [], "domain").select("domain", F.col("share").alias("budget"))
    langs = live.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("lang_weight").cast("double").alias("weight")).join(domains, "domain")
    langs = _pour(langs, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    sources = live.withColumn("weight", F.col("source_weight").cast("double")).join(langs, ["domain", "lang"])
    return _pour(sources, ["domain", "lang"], "source").select(*LEAF, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("leaf_budget"))


def mix(docs: DataFrame, domain: Column, weights, budget: Column, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """Selected rows of ``docs``, one for each (row, epoch) chosen.

    ``docs`` has doc_id, text, lang and source. ``domain`` is an expression over them, ``weights`` gives the columns domain_weight,
    lang_weight and source_weight from domain, lang and source (a dict of expressions), ``budget`` is the number of tokens (words) to
    choose as an expression over ``tokens`` of the leaves. Null languages, sources and domains count as the value "". Returns __row (an
    id of the input row), doc_id, domain, lang, source, n_tokens, epoch.

    Epochs before the last are whole; of the last, the longest prefix in its seeded order whose tokens fit in what is left of the
    leaf's budget, so no leaf is overrun. Rows with no words go along with the prefix they stand in. Equal rows are told apart by nothing
    but their place; which of them stands first is open and doesn't change the result. An empty table, or a budget of 0, gives none.

    A leaf may hold a third of all rows: its order is cut into 4096 buckets of the order key, whose sums are few; only documents
    in the one bucket that the prefix ends in are ordered among themselves, and of these, rows of one doc_id (or of none) and one length are counted first."""
    name = lambda c: F.coalesce(c, F.lit(""))
    keyed = docs.select("doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"), (F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()).alias("__row"))
    rows = materialize(keyed, "mix-rows")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")).withColumns(weights)
    counted = materialize(leaves, "mix-leaves")
    leaves = materialize(leaf_budgets(counted, budget, max_epochs), "mix-budgets")
    release(counted)
    plan = leaves.withColumn("whole", F.floor(F.col("leaf_budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("leaf_budget") - F.col("whole") * F.col("tokens")).select(*LEAF, "whole", "rest")
    planned = rows.join(plan, LEAF)
    full = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))

    last = planned.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("__key", order_key(seed, F.col("epoch"), F.col("doc_id"))).withColumn("__bucket", F.shiftright("__key", 60 - BUCKET_BITS))
    last = materialize(last, "mix-last")
    sums = last.groupBy(*LEAF, "__bucket").agg(F.sum("n_tokens").alias("tokens"))
    end = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("__bucket"))
    sums = sums.select(*LEAF, "__bucket", (end - F.col("tokens")).alias("__start"), end.alias("__end"))
    placed = last.join(sums, [*LEAF, "__bucket"])
    inside = placed.where("__end <= rest")
    edge = materialize(placed.where("__start <= rest AND __end > rest"), "mix-edge")
    # rows of one document and length are equal here: they are counted before any are put in order
    alike = [*LEAF, "__key", "doc_id", "n_tokens"]
    equals = edge.groupBy(*alike).agg(F.count("*").alias("__n"), F.first("__start").alias("__start"), F.first("rest").alias("rest"))
    upto = F.sum(F.col("n_tokens") * F.col("__n")).over(Window.partitionBy(*LEAF).orderBy("__key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    room = F.col("rest") - F.col("__start") - upto + F.col("n_tokens") * F.col("__n")
    fits = F.when(room < 0, 0).when(F.col("n_tokens") == 0, F.col("__n")).otherwise(F.least("__n", F.floor(room / F.col("n_tokens")))).cast("long")
    equals = materialize(equals.withColumn("__take", fits).where("__take > 0").select(*alike, "__n", "__take"), "mix-equals")
    same = F.lit(True)
    for c in alike:
        same &= F.col(f"edge.{c}").eqNullSafe(F.col(f"equals.{c}"))
    chosen = edge.alias("edge").join(equals.alias("equals"), same).select("edge.*", "__n", "__take")
    columns = ["__row", "doc_id", *LEAF, "n_tokens", "epoch"]
    return full.select(columns).union(inside.select(columns)).union(chosen.where("__take = __n").select(columns)).union(_some(chosen.where("__take < __n"), alike).select(columns))


def _some(rows: DataFrame, alike: list[str]) -> DataFrame:
    """``__take`` of each group of equal ``rows``, by a hash of __row. Of a hot group only one bucket of the hash is put in order."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(1 << BUCKET_BITS)))
    sums = rows.groupBy(*alike, "__part").agg(F.count("*").alias("__here"), F.first("__take").alias("__take"))
    upto = F.sum("__here").over(Window.partitionBy(*alike).orderBy("__part"))
    sums = sums.select(*alike, "__part", (F.col("__take") - upto + F.col("__here")).alias("__left"), F.col("__here").alias("__many")).where("__left > 0")
    same = F.col("rows.__part") == F.col("sums.__part")
    for c in alike:
        same &= F.col(f"rows.{c}").eqNullSafe(F.col(f"sums.{c}"))
    both = rows.alias("rows").join(sums.alias("sums"), same).select("rows.*", "__left", "__many")
    place = F.row_number().over(Window.partitionBy(*alike, "__part").orderBy("__row"))
    part = both.where("__left < __many").withColumn("__place", place).where("__place <= __left").drop("__place")
    return both.where("__left >= __many").union(part)


#: The tree of the query and the pipeline has sources in three domains by their number.
def source_number() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,6})$", 1), F.lit("")).cast("int"), F.lit(0))


def default_domain() -> Column:
    return F.concat(F.lit("d"), (source_number() % 3).cast("string"))


def default_weights() -> dict[str, Column]:
    return {
        "domain_weight": F.when(F.col("domain") == "d0", 2).when(F.col("domain") == "d1", 1).otherwise(1),
        "lang_weight": F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 3).otherwise(2),
        "source_weight": 1 + source_number() % 4,
    }


def mix_documents(docs: DataFrame, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """The documents of the default mix, with all their columns; a document chosen in two epochs comes twice."""
    numbered = with_row_id(docs.select(F.struct("*").alias("__doc")), "__row")
    chosen = mix(numbered.select("__doc.doc_id", "__doc.text", "__doc.lang", "__doc.source", "__row"), default_domain(), default_weights(), F.sum("tokens"), max_epochs, seed)
    return numbered.join(chosen.select("__row"), "__row").select("__doc.*")


def oracle_sql(max_epochs: int, seed: int) -> str:
    """The default mix in DuckDB's SQL, with a budget of four fifths of the tokens."""

    def pour(table: str, parents: str, name: str) -> str:
        of = f"PARTITION BY {parents}" if parents else ""
        order = f"{of} ORDER BY capacity / weight, {name}"
        return f"""SELECT *, CASE WHEN is_full THEN capacity ELSE weight * greatest(budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({of}), 0), 0)
            / sum(CASE WHEN NOT is_full THEN weight END) OVER ({of}) END AS share FROM (SELECT *, capacity <= weight * (budget
            - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM {table})"""

    return rf"""
    WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(try_cast(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS INT), 0) AS num,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
    rows_ AS (SELECT *, 'd' || (num % 3) AS domain FROM r),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, CASE domain WHEN 'd0' THEN 2.0::DOUBLE ELSE 1 END AS dw, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 3 ELSE 2 END AS lw,
            (1 + max(num) % 4)::DOUBLE AS sw FROM rows_ GROUP BY domain, lang, source),
    live AS (SELECT *, (tokens * {max_epochs})::DOUBLE AS capacity FROM leaves WHERE tokens > 0),
    d AS (SELECT domain, sum(capacity) AS capacity, max(dw) AS weight, (SELECT floor(sum(tokens) * 4 / 5)::DOUBLE FROM leaves) AS budget FROM live GROUP BY domain),
    dp AS ({pour('d', '', 'domain')}),
    l AS (SELECT v.domain, v.lang, sum(v.capacity) AS capacity, max(lw) AS weight, max(dp.share) AS budget FROM live v JOIN dp USING (domain) GROUP BY v.domain, v.lang),
    lp AS ({pour('l', 'domain', 'lang')}),
    s AS (SELECT v.domain, v.lang, v.source, v.tokens, v.capacity, v.sw AS weight, lp.share AS budget FROM live v JOIN lp USING (domain, lang)),
    sp AS ({pour('s', 'domain, lang', 'source')}),
    plan AS (SELECT domain, lang, source, floor(floor(share + 1e-6) / tokens)::INT AS whole, floor(share + 1e-6)::BIGINT - floor(floor(share + 1e-6) / tokens)::BIGINT * tokens AS rest FROM sp),
    p AS (SELECT rows_.*, whole, rest FROM rows_ JOIN plan USING (domain, lang, source)),
    part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, n_tokens
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p WHERE rest > 0)
    SELECT doc_id, domain, lang, source, n_tokens, unnest(range(whole))::INT AS epoch FROM p WHERE whole > 0
    UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch FROM part WHERE upto <= rest"""
