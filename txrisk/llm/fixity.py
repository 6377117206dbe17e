"""Merkle fixity audit of archive replicas: trees over records and ordered offset ranges, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, with_row_id

FANOUT = 16
#: Equal records are dealt to so many parts before each gets its place among them.
SPREAD = 4096


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record with its header lines; nulls are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(page_id), F.lit(">\r\nWARC-Target-URI: "), text(url), F.lit("\r\nContent-Length: "), F.octet_length(text(html)).cast("string"), F.lit("\r\n\r\n"), text(html), F.lit("\r\n\r\n"))


def lay_out(records: DataFrame, per_file: int = 4096) -> DataFrame:
    """Deal records into files of about ``per_file`` and place them one after another.

    ``records`` has digest (hex) and length; other columns stay. Adds file, seq (0, 1, ...) and offset within the file. The file follows
    from the digest, so no id, host or page can make a file hot; inside a file records stand in the order of their digests. Equal
    records have equal digests and stand side by side."""
    columns = records.columns
    records = with_row_id(records, "__row")
    n_files = records.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_file)).cast("long").alias("n_files"))
    dealt = records.crossJoin(F.broadcast(n_files))  # one row
    dealt = dealt.withColumn("file", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.col("n_files")).drop("n_files")
    # equal records stand side by side: they are counted before they are put in order, and spread out again by their number
    sizes = dealt.groupBy("file", "digest", "length").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("file").orderBy("digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(order), F.lit(0)).cast("long")
    sizes = sizes.withColumn("__seq", before(F.col("__n"))).withColumn("__offset", before(F.col("__n") * F.col("length")))
    spread = dealt.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(SPREAD)))
    parts = spread.groupBy("file", "digest", "length", "__part").agg(F.count("*").alias("__here"))
    ahead = F.coalesce(F.sum("__here").over(Window.partitionBy("file", "digest", "length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.withColumn("__ahead", ahead).join(sizes, ["file", "digest", "length"])
    within = F.row_number().over(Window.partitionBy("file", "digest", "length", "__part").orderBy("__row")) - 1 + F.col("__ahead")
    placed = spread.join(places, ["file", "digest", "length", "__part"]).withColumn("__within", within)
    return placed.withColumns({"seq": (F.col("__seq") + F.col("__within")).cast("long"), "offset": (F.col("__offset") + F.col("__within") * F.col("length")).cast("long")}).select(*columns, "file", "seq", "offset")


def height(largest: int | None, fanout: int) -> int:
    """How many times numbers 0 to ``largest`` must be divided by ``fanout`` until one is left."""
    n, out = largest or 0, 0
    while n > 0:
        n, out = n // fanout, out + 1
    return out


def build_tree(leaves: DataFrame, heights: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of one replica's tree, leaves first, each a written table (file, node, start, end, digest).

    ``leaves`` has file, seq, offset, length, digest. A parent covers the range from its first child to the end of its last; its digest is
    the SHA-256 of its children's places, ranges and digests in order. Up to the first of ``heights`` a node covers ``fanout`` times as many
    records of its file as one below; from there on, ``fanout`` times as many files, and its file is null. The last level is the
    replica's root: one row, or none for no records. No group has more than ``fanout`` rows."""
    level = materialize(leaves.select("file", F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "digest"), "merkle")
    levels = [level]
    for k in range(sum(heights)):
        file, node = parent_of(k, heights, fanout)
        child = F.struct("file", "node", "start", "end", "digest")
        up = level.groupBy(file.alias("f"), node.alias("n")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["file"], x["node"], x["start"], x["end"], x["digest"])), "|")
        level = materialize(up.select(F.col("f").alias("file"), F.col("n").alias("node"), F.array_min("c.start").alias("start"), F.array_max("c.end").alias("end"), F.sha2(text, 256).alias("digest")), "merkle")
        levels.append(level)
    return levels


def parent_of(k: int, heights: tuple[int, int], fanout: int) -> tuple[Column, Column]:
    """The file and the node above a node of level k."""
    if k < heights[0]:
        return F.col("file"), F.floor(F.col("node") / fanout).cast("long")
    return F.lit(None).cast("long"), F.floor(F.col("file" if k == heights[0] else "node") / fanout).cast("long")


def audit(good: DataFrame, copy: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Where ``copy`` differs from ``good``: (file, seq, offset, length, digest, copy_digest, status).

    Both have file, seq, offset, length, digest, where the copy's are those read at the ranges of the good one's index; (file, seq) is
    unique in each and not null. status is corrupt, missing (no such record in the copy) or extra. The roots are compared first, then
    only children of nodes that differ; equal replicas end at the root, and no record of an intact branch is compared. Empty replicas
    are equal. Extra columns are ignored."""
    most = good.select("file", "seq").union(copy.select("file", "seq")).agg(F.max("seq"), F.max("file")).first()
    heights = (height(most[0], fanout), max(1, height(most[1], fanout)))
    ours, theirs = build_tree(good, heights, fanout), build_tree(copy, heights, fanout)

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("digest").alias("copy_digest"), F.col("start").alias("copy_start"), F.col("end").alias("copy_end"))
        both = a.join(other, F.col("file").eqNullSafe(F.col("f")) & (F.col("node") == F.col("n")), "full")
        same = F.col("digest").eqNullSafe(F.col("copy_digest")) & F.col("start").eqNullSafe(F.col("copy_start")) & F.col("end").eqNullSafe(F.col("copy_end"))
        return both.where(~same).select(F.coalesce("file", "f").alias("file"), F.coalesce("node", "n").alias("node"), F.coalesce("start", "copy_start").alias("start"), F.coalesce("end", "copy_end").alias("end"), "digest", "copy_digest")

    found = materialize(differing(ours[-1], theirs[-1]), "merkle-diff")
    for k in range(sum(heights) - 1, -1, -1):
        up = found.select(F.col("file").alias("f"), F.col("node").alias("n"))
        file, node = parent_of(k, heights, fanout)
        under = lambda x: x.join(up, file.eqNullSafe(F.col("f")) & (node == F.col("n")), "left_semi")  # noqa: B023, E731
        before, found = found, materialize(differing(under(ours[k]), under(theirs[k])), "merkle-diff")
        release(before)
    release(*ours, *theirs)
    status = F.when(F.col("copy_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return found.select("file", F.col("node").alias("seq"), F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"), "digest", "copy_digest", status.alias("status"))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) and of a copy with known damage, for drills: (page_id, length, digest, copy_digest).

    In the copy the first character of the page is overwritten where page_id % 97 = 5, and the record is gone, copy_digest null, where
    page_id % 389 = 7."""
    page = F.coalesce(F.col("html"), F.lit(""))
    torn = F.when((F.col("page_id") % 97 == 5) & (page != ""), F.concat(F.lit("#"), F.substring(page, 2, 2147483647))).otherwise(page)
    good = record_bytes(F.col("page_id"), F.col("url"), page)
    lost = F.coalesce(F.col("page_id") % 389 == 7, F.lit(False))
    return pages.select("page_id", F.octet_length(good).cast("long").alias("length"), F.sha2(good, 256).alias("digest"), F.when(~lost, F.sha2(record_bytes(F.col("page_id"), F.col("url"), torn), 256)).alias("copy_digest"))


def drill(pages: DataFrame, per_file: int = 4096, fanout: int = FANOUT) -> DataFrame:
    """The audit of the damaged copy, with page_id: what it finds is what ``damaged_copy`` did, at the record's place."""
    laid = materialize(lay_out(materialize(damaged_copy(pages), "warc"), per_file), "warc-index")
    copy = laid.where("copy_digest IS NOT NULL").select("file", "seq", "offset", "length", F.col("copy_digest").alias("digest"))
    return audit(laid, copy, fanout).join(laid.select("file", "seq", "page_id"), ["file", "seq"], "left")


def drill_sql(per_file: int = 4096) -> str:
    record = """'WARC/1.0' || crlf || 'WARC-Type: response' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf
        || 'Content-Length: ' || strlen({0}) || crlf || crlf || {0} || crlf || crlf"""
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS page, chr(13) || chr(10) AS crlf, coalesce(page_id % 389 = 7, false) AS lost FROM pages),
    t AS (SELECT *, CASE WHEN page_id % 97 = 5 AND page <> '' THEN '#' || substr(page, 2) ELSE page END AS torn FROM p),
    r AS (SELECT page_id, {record.format('page')} AS good, {record.format('torn')} AS bad, lost FROM t),
    h AS (SELECT page_id, strlen(good)::BIGINT AS length, sha256(good) AS digest, CASE WHEN NOT lost THEN sha256(bad) END AS copy_digest FROM r),
    f AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {per_file}))::BIGINT FROM h) AS file FROM h),
    i AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f WINDOW w AS (PARTITION BY file ORDER BY digest, length))
    SELECT file, seq, "offset", length, digest, copy_digest, CASE WHEN copy_digest IS NULL THEN 'missing' ELSE 'corrupt' END AS status, page_id
    FROM i WHERE copy_digest IS NULL OR copy_digest <> digest"""
