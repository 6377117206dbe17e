"""Line-first quality rules, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, let, words_of

# The patterns of the line rules, for Java's and RE2's regular expressions alike.
SYMBOL = r"[#*$%&|<>]"
#: A line that closes a sentence.
CLOSED = r"[.!?:;,…。！？\"'”’»)\]][\x20\x09-\x0D]*$"
#: Runs of marks as shouted or torn text has them.
SHOUT = r"[!?]{2,}|[.]{4,}"
#: What separates the entries of a menu, a path or a table row.
DIVIDER = r"[\x20\x09-\x0D][|>»•·/][\x20\x09-\x0D]"
#: Whole lines of site navigation.
MENU = r"(?i)^[\x20\x09-\x0D]*(home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next( page)?|prev(ious)?( page)?|back( to top)?|read more|more|share|tweet|reply|comments?|contact( us)?|about( us)?|skip to (main )?content|site ?map)[\x20\x09-\x0D]*[.:»>]?[\x20\x09-\x0D]*$"
#: Phrases of legal and technical boilerplate; only lines of up to ``SHORT`` code points are searched for them.
BOILERPLATE = r"(?i)all rights reserved|copyright|©|licensed under|released under the|cookie|privacy policy|terms of (use|service)|javascript|subscribe|newsletter|lorem ipsum|powered by|click here|unsubscribe"
SHORT = 300
#: Limits: a line fails with over 1 symbol for 5 word characters, over 1 shout for 4 words, over 1 divider for 5 words; a line of
#: fewer words than ``MENU_WORDS`` that closes no sentence is a menu entry; one of 8 to 60 words fails if no more than half of them
#: differ (longer lines of prose repeat their common words). A text keeps its place with half of its word characters.
SYMBOL_SHARE, SHOUT_SHARE, DIVIDER_SHARE, MENU_WORDS, STUTTER, MIN_LEFT = 5, 4, 5, 4, (8, 60), 0.5


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern)) - 1


def line_fails(line: Column) -> Column:
    """True for a line that a rule rejects. Blank lines pass."""
    squeezed = F.regexp_replace(line, BLANK, " ")
    def judged(x: Column) -> Column:
        n_words = F.size(F.split(x, " "))
        stutter = n_words.between(*STUTTER) & (F.size(F.array_distinct(F.split(x, " "))) * 2 <= n_words)
        chars = F.length(x) - n_words + 1
        punctuation = (count_matches(line, SYMBOL) * SYMBOL_SHARE > chars) | (count_matches(line, SHOUT) * SHOUT_SHARE > n_words) | stutter
        navigation = (count_matches(line, DIVIDER) * DIVIDER_SHARE > n_words) | ((n_words < MENU_WORDS) & ~line.rlike(CLOSED)) | ((F.length(x) <= SHORT) & line.rlike(MENU))
        return (x != "") & (punctuation | navigation | ((F.length(x) <= SHORT) & line.rlike(BOILERPLATE)))

    return let(F.trim(squeezed), judged)


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words that lie in windows of ``n`` words found twice or more in the array.

    Hashes show whether any window repeats at all; where one does, the windows themselves are sorted and compared."""

    def covered(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        windows = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i + 1, n), " ").alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(at, lambda k: (F.get(s, k)["g"] == F.get(s, k - 1)["g"]) | (F.get(s, k)["g"] == F.get(s, k + 1)["g"]))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda sum_, k: sum_ + F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(n))))

        return let(let(windows, places), lambda p: F.when(F.size(p) == 0, 0).otherwise(total(p)))

    def any_twice(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        return let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))

    return let(words, lambda w: F.when(F.size(w) <= n, 0).when(any_twice(w), covered(w)).otherwise(0)).cast("long")


def judge(docs: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """``docs`` with these columns in place of any of the same name, and all other columns as they were:

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words, base_failed (under 10 words, or over a fifth of them in repeated 5-word windows), n_lines, n_failed_lines,
    clean_text (the lines that no rule rejects), kept_chars (code points in words left), kept.

    Lines are judged first: punctuation, navigation and boilerplate rules, each on one line. What they reject is removed, and a text
    is rejected if under ``min_left`` of its word characters are left, or on base_failed. A null text has no words and no lines, is
    rejected, and has a null clean_text. A window costs time in proportion to the text; nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    words = words_of(text)
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    counted = docs.withColumns({
        "__words": let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeats"))),
        "__lines": let(F.filter(lines, has_word), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups"))),
        "__clean": let(F.filter(lines, lambda x: ~line_fails(x)), lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, has_word)).cast("long").alias("full"), F.array_join(x, "\n").alias("text"))),
    })
    out = counted.withColumns({
        "n_words": F.col("__words.n"), "word_chars": F.col("__words.chars"), "n_symbols": count_matches(text, SYMBOL).cast("long"), "n_dup_lines": F.col("__lines.dups"), "n_repeat_words": F.col("__words.repeats"),
        "n_lines": F.col("__lines.n"), "n_failed_lines": F.col("__lines.n") - F.col("__clean.full"), "clean_text": F.when(F.col("text").isNotNull(), F.col("__clean.text")), "kept_chars": F.length(F.regexp_replace(F.col("__clean.text"), BLANK, "")).cast("long"),
    }).drop("__words", "__lines", "__clean")
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= min_left * F.col("word_chars")))


def clean(docs: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that pass, with their failed lines removed and n_chars, where there is one, counted anew."""
    judged = judge(docs.select(F.struct("*").alias("__doc"), "text"), min_left).where("kept")
    out = judged.select("__doc.*", F.col("clean_text").alias("__text")).withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle_sql(min_left: float = MIN_LEFT) -> str:
    """The same verdicts in DuckDB's SQL."""
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    quote = lambda s: s.replace("'", "''")
    many = lambda x, p: f"len(regexp_extract_all({x}, '{quote(p)}'))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{word}') AS ws FROM d),
    win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
    l AS (SELECT rid, line, trim(regexp_replace(line, '{blank}', ' ', 'g'), ' ') AS x FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
    j AS (SELECT rid, line, x, len(string_split(x, ' ')) AS n, length(x) AS len FROM l WHERE x <> ''),
    f AS (SELECT rid, line, x, n, (
            {many('line', SYMBOL)} * {SYMBOL_SHARE} > len - n + 1 OR {many('line', SHOUT)} * {SHOUT_SHARE} > n
            OR (n BETWEEN {STUTTER[0]} AND {STUTTER[1]} AND len(list_distinct(string_split(x, ' '))) * 2 <= n)
            OR {many('line', DIVIDER)} * {DIVIDER_SHARE} > n OR (n < {MENU_WORDS} AND NOT regexp_matches(line, '{quote(CLOSED)}'))
            OR (len <= {SHORT} AND (regexp_matches(line, '{quote(MENU)}') OR regexp_matches(line, '{quote(BOILERPLATE)}')))) AS bad FROM j),
    a AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines,
            coalesce(sum(length(replace(x, ' ', ''))) FILTER (NOT bad), 0)::BIGINT AS kept_chars FROM f GROUP BY rid),
    c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {many('text', SYMBOL)}::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
            coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(kept_chars, 0)::BIGINT AS kept_chars
          FROM w LEFT JOIN rep USING (rid) LEFT JOIN a USING (rid)),
    b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, kept_chars,
        NOT base_failed AND kept_chars >= {min_left} * word_chars AS kept FROM b"""
