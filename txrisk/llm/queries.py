"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fixity, language_id, line_dedup, manifest, mixing, pieces, quality_model, quality_rules, resampling, sharding, simhash, url_filter
from .common import documents, tables

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.near_lines(docs.withColumn("uid", F.monotonically_increasing_id())).select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def may_learn(doc_id, parts: int, held: int):
    """Whether a document is outside the held-out part: crc32 of its doc_id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) != held


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = documents(spark, sf_dir), may_learn(F.col("doc_id"), 5, 0)
    weights = quality_model.train(docs, spark.read.parquet(tables(sf_dir, "labels")), learn)
    scored = quality_model.score(docs, weights)
    return scored.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.drill(spark.read.parquet(tables(sf_dir, "pages")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "kept_chars", "kept"]
    return quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text")).select(columns)


# The rules of the query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


# Words of hosts that the small labelled table blocks, and words of made-up hosts that it allows.
UNWANTED = ["adult", "ads", "bet", "bets", "bingo", "bonus", "casino", "cheap", "click", "coupon", "crack", "dating", "escort", "free", "gamble", "hack", "jackpot", "keygen", "loan", "lotto", "nude", "payday", "pharma", "pills", "poker", "porn", "popup", "prize", "replica", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx"]
WANTED = ["academy", "archive", "arts", "biology", "book", "city", "clinic", "college", "council", "courts", "culture", "docs", "earth", "energy", "forum", "garden", "gazette", "health", "herald", "history", "journal", "kitchen", "language", "law", "library", "math", "museum", "music", "nature", "news", "open", "physics", "press", "recipes", "review", "school", "science", "society", "sports", "studio", "theatre", "travel", "university", "weather", "wiki"]


def unwanted(host):
    """Whether one of the words that a host's labels are made of is an unwanted one."""
    return F.exists(F.split(host, "[.-]"), lambda w: w.isin(UNWANTED))


def labelled_urls(spark: SparkSession, pages: DataFrame | None = None, held_out=None) -> DataFrame:
    """(host, path, allowed): a small labelled table. Hosts of ``pages`` are labelled by whether a word of theirs is unwanted, but for those ``held_out`` (a condition
    over host); of each host some urls count, the first by a hash. Besides, words of one label make hosts by themselves and in pairs; both labels have the same
    ends, folders and numbers, so that only the words tell them apart. None of the rules had a part in it."""
    fronts, ends, folders = ["", "www.", "m.", "blog."], ["com", "org", "net", "info"], ["en", "de", "fr", "es", "it", "a"]
    rows = []
    for allowed, words in ((True, WANTED), (False, UNWANTED)):
        for i, w in enumerate(words):
            for k in range(24):
                name = [w, f"{w}-{words[(i + k) % len(words)]}", f"{words[(i + 5 * k) % len(words)]}{w}"][k % 3]
                mid = "" if k % 2 else ("example." if k % 4 else "site.")
                rows.append((f"{fronts[(i + k) % 4]}{name}.{mid}{ends[(i + k // 3) % 4]}", f"/{folders[(i + k) % 6]}/{(i * 37 + k * 101) % 1000}", allowed))
    made = spark.createDataFrame(rows, "host string, path string, allowed boolean")
    if pages is None:
        return made
    seen = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")).where("host <> ''")
    if held_out is not None:
        seen = seen.where(~held_out)
    # of each host the one url that a hash puts first, for each of four values of the hash: a hot host gives four rows at most
    few = seen.groupBy("host", F.pmod(F.xxhash64("path"), F.lit(4)).alias("part")).agg(F.min_by("path", F.xxhash64("path", F.lit(1))).alias("path"))
    return made.union(few.select("host", "path", (~unwanted(F.col("host"))).alias("allowed")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(tables(sf_dir, "pages")).select("page_id", "url")
    return url_filter.judge(pages, RULES, url_filter.train(labelled_urls(spark, pages))).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = documents(spark, sf_dir), may_learn(F.col("doc_id"), 3, 1)
    found = language_id.predict(docs, language_id.train(docs, learn))
    return found.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir), model_path(), dropout=0.1, seed=7)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = F.floor(F.sum("tokens") * 4 / 5)
    return mixing.mix(documents(spark, sf_dir), mixing.default_domain(), mixing.default_weights(), budget, max_epochs=2, seed=7).drop("__row")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    struck = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(documents(spark, sf_dir), tampered={"text": F.when(struck, lower).otherwise(F.col("text"))})


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_texts(documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(tables(sf_dir, "benchmark")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_model": op3_quality_model,
    "op4_merkle_audit": op4_merkle_audit,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_pieces": op9_pieces,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sharding": op12_sharding,
    "op13_resampling": op13_resampling,
}

ORACLES = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents),
        g AS (SELECT doc_id, x, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g""",
    "op4_merkle_audit": fixity.drill_sql(),
    "op5_quality_rules": quality_rules.oracle_sql(),
    "op10_mixing": mixing.oracle_sql(max_epochs=2, seed=7),
    "op11_merkle_manifest": manifest.oracle_sql(),
    "op13_resampling": resampling.oracle_sql(),
}
