"""Shards of near-equal size by minimax contiguous partition of atomic groups, with DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ordered
from .common import materialize, release

#: Cells of all refined ranges of one pass; a pass brings at most so many rows, with two ends each, to the driver.
CELLS = 16_384


@dataclass
class Ends:
    """What is known of the ends of the groups on the line of running sizes: ``known`` ends in order, from 0 to the total, and the
    ones of them (``open``) that may have unknown ends between them and the next known one."""

    known: list[int]
    open: set[int] = field(default_factory=set)

    def least(self, x: int) -> int:
        """The last known end up to x: no more than the last end up to x."""
        return self.known[bisect_right(self.known, x) - 1]

    def most(self, x: int) -> int:
        """No less than the last end up to x."""
        a = self.least(x)
        return min(x, self.known[bisect_right(self.known, a)] - 1) if a in self.open else a

    def greedy(self, capacity: int, shards: int, reach) -> list[int]:
        """Where shards end that each take all they can hold."""
        out = [0]
        for _ in range(shards):
            out.append(min(reach(out[-1] + capacity), self.known[-1]))
        return out[1:]

    def least_capacity(self, low: int, high: int, shards: int, reach) -> int:
        """By bisection, the smallest capacity of low to high that takes all groups under ``reach``; high is taken to do."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.greedy(mid, shards, reach)[-1] >= self.known[-1] else (mid + 1, high)
        return low

    def below(self, x: int, touched: set[int]) -> int:
        """The last end up to x, as far as known; where it isn't sure, the interval is ``touched``."""
        a = self.least(x)
        if a in self.open and a < x:
            touched.add(a)
        return a

    def above(self, x: int, touched: set[int]) -> int:
        """The first end from x on, likewise."""
        a = self.below(x, touched)
        return a if a == x else self.known[min(bisect_right(self.known, x), len(self.known) - 1)]

    def even(self, capacity: int, shards: int, touched: set[int]) -> list[int]:
        """Where shards end that all keep to ``capacity`` and are as even as the ends allow: from the right, how far each shard has to reach at least; from the
        left, each then ends where an even share of what is left does, or nearest to it."""
        must = [self.known[-1]]
        for _ in range(shards - 1):
            must.append(self.above(max(0, must[-1] - capacity), touched))
        out = [0]
        for k in range(1, shards):
            share = out[-1] + (self.known[-1] - out[-1]) // (shards - k + 1)
            a, b = self.below(share, touched), self.above(share, touched)
            best = a if share - a <= b - share else b
            out.append(max(must[shards - k], min(best, self.below(out[-1] + capacity, touched))))
        return [*out[1:], self.known[-1]]

    def around(self, starts) -> list[tuple[int, int]]:
        """The open intervals that begin at ``starts``, those that touch as one."""
        out: list[tuple[int, int]] = []
        for a in sorted(starts):
            b = self.known[bisect_right(self.known, a)]
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def learn(self, ranges: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> None:
        """Take in the (first end, last end, number of ends) of each cell of ``ranges``; a range runs from one known end to another."""
        known = set(self.known)
        for a, b in ranges:
            self.open.difference_update(self.known[bisect_left(self.known, a) : bisect_left(self.known, b)])
        for first, last, n in cells:
            known |= {first, last}
            if n > 2:
                self.open.add(first)
        self.known = sorted(known)


def _cells(groups: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The ends of ``groups`` in each range (above a, up to b), dealt to cells of equal width."""
    per = max(2, CELLS // len(ranges))
    at, cell = F.col("end"), None
    for i, (a, b) in enumerate(ranges):
        step = -(-(b - a) // per)
        hit = (at > a) & (at <= b)
        value = F.floor((at - a - 1) / step) + i * per
        cell = F.when(hit, value) if cell is None else cell.when(hit, value)
    rows = groups.select("end", cell.alias("cell")).where("cell IS NOT NULL").groupBy("cell").agg(F.min("end"), F.max("end"), F.count("*"))
    return [(r[1], r[2], r[3]) for r in rows.collect()]


def cuts_of(groups: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """The running sizes at which the shards end. ``groups`` has ``end``: the running size, this group included, in the order that is kept.

    The smallest capacity that ``shards`` shards, each filled greedily, can hold everything with, is found by bisection on what is known of the ends: two
    bounds of the greedy fill decide a capacity, or leave it undecided. Only ranges of ends that undecided capacities depend on are looked at more closely, in passes of bounded
    size over the groups. Under the capacity found the cuts are made as even as it allows, with further such passes until each is exact."""
    ends, low, high = Ends([0, total], {0}), max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        low = ends.least_capacity(low, high, shards, ends.most)
        high = ends.least_capacity(low, high, shards, ends.least)
        touched: set[int] = set()
        if low == high:
            cuts = ends.even(low, shards, touched)
            if not touched:
                return cuts
        else:
            for a, b in zip(ends.greedy(low, shards, ends.least), ends.greedy(high, shards, ends.most)):
                i, j = bisect_right(ends.known, a) - 1, bisect_right(ends.known, b)
                touched |= ends.open & set(ends.known[i:j])
        ranges = ends.around(touched)
        ends.learn(ranges, _cells(groups, ranges))


def shard(rows: DataFrame, size: str, group: list[str], first: str, shards: int = 24) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (the row's place in its shard, from 0).

    Rows with equal ``group`` columns (null equals null) form an atomic group and stay together. Groups stand in the order of their smallest ``first`` (null last), and this order is cut
    into contiguous runs whose largest total ``size`` (whole numbers over 0) is as small as it can be, and which are else as even as that allows. A group that alone is as large as an even share of what is left
    gets a shard of its own before that, the largest first; only where there are fewer groups than shards, or few of very uneven size, do shards stay empty.

    Groups of any size are summed up before they meet, and their rows are put in order by ranges of (group, ``first``), so a group of copies is
    dealt over many tasks. Repeated rows have slots of their own; an empty table stays empty; ``rows`` is to have no column whose name begins with two underscores."""
    rows = materialize(rows.withColumn("__id", F.monotonically_increasing_id()), "shard-rows")
    key = [F.xxhash64(F.lit(salt), *[x for c in group for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]).alias(f"__k{salt}") for salt in (1, 2)]
    groups = rows.groupBy(*key).agg(F.sum(size).cast("long").alias("__bytes"), F.min(first).alias("__first"))
    groups = materialize(groups, "shard-groups")
    total = groups.agg(F.sum("__bytes")).first()[0] or 0
    giants = []
    for r in groups.orderBy(F.desc("__bytes"), F.col("__first").asc_nulls_last(), "__k1", "__k2").limit(shards).collect():
        if len(giants) < shards and r["__bytes"] * (shards - len(giants)) >= total:
            giants.append(r)
            total -= r["__bytes"]
        else:
            break
    own = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(giants))):
        own = F.when((F.col("__k1") == r["__k1"]) & (F.col("__k2") == r["__k2"]), F.lit(i)).otherwise(own)
    named = groups.withColumn("__own", own)
    rest = ordered(named.where("__own IS NULL"), [F.col("__first").asc_nulls_last(), F.col("__k1"), F.col("__k2")], name="__at", sums={"end": "__bytes"})
    placed = materialize(rest.select("__k1", "__k2", "end"), "shard-ends")
    largest = groups.agg(F.max(F.when(own.isNull(), F.col("__bytes")))).first()[0] or 0
    cuts = cuts_of(placed, total, largest, shards - len(giants)) if total else []
    after = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("end"))) if cuts else F.lit(0)
    where = placed.select("__k1", "__k2", "end", (after + len(giants)).cast("int").alias("shard"))
    where = where.unionByName(named.where("__own IS NOT NULL").select("__k1", "__k2", F.lit(0).cast("long").alias("end"), F.col("__own").alias("shard")))
    where = materialize(where, "shard-of-group")  # plain exchanges on both sides, so that a large group can be dealt over many tasks
    dealt = rows.select("*", *key).join(where, ["__k1", "__k2"])
    out = ordered(dealt.select(*rows.columns, "end", "shard").withColumnRenamed("end", "__end"), [F.col("__end"), F.col(f"`{first}`").asc_nulls_last(), F.col("__id")], by=["shard"], name="slot")
    release(groups, rest, placed, where, rows)
    kept = out.drop("__id", "__end")
    kept._scratch_path = out._scratch_path
    return kept


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8 and eight for its frame; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_texts(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``: shards of near-equal bytes, in the order of doc_id, with equal texts together. A null text
    counts as an empty one, and both are one group. ``law`` is "bytes"; grown_shard, which is for a law of keys, is null."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"))
    out = shard(rows, "size", ["h1", "h2"], "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
