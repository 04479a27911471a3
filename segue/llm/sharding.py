"""Shards of near equal size: minimax contiguous partition of groups of equal texts.

Native: DataFrame functions only. The driver reads sums of at most BINS ranges of groups at a
time and narrows down where the cuts of the smallest feasible capacity lie.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.ranks import ranked
from segue.llm.store import dropped, saved

#: Shards, and bytes that a row has besides its text.
SHARDS, OVERHEAD = 40, 16
#: Sums of group ranges that the driver reads in a round, and bits of a group's key.
BINS, BITS = 1 << 16, 60


@dataclass(frozen=True)
class Range:
    """Groups next to each other in the order: least key, bytes, bytes of the largest group, and whether it is one group."""

    first: int
    size: int
    largest: int
    single: bool


def group_key(text: Column) -> Column:
    """Key of the group of equal texts, which is also its place in the order; texts that share a key stay together."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


class _Line:
    """All groups in order as a line of bytes, cut greedily; ranges not looked into give bounds of each cut."""

    def __init__(self, ranges: list[Range]):
        self.ranges, self.ends, total = ranges, [], 0
        for r in ranges:
            total += r.size
            self.ends.append(total)
        self.total = total

    def begin(self, i: int) -> int:
        return self.ends[i] - self.ranges[i].size

    def cuts(self, capacity: int, late: bool) -> list[int]:
        """Upper (late) or lower bounds of where greedy shards of this capacity end; exact where groups are known."""
        out, at = [], 0
        while at + capacity < self.total:
            end = at + capacity
            i = bisect_right(self.ends, end)
            r = self.ranges[i]  # begins at or before end, ends behind it: so does the group that doesn't fit any more
            at = self.begin(i) if r.single else end if late else max(self.begin(i), end - r.largest + 1)
            out.append(at)
        return out

    def smallest(self, shards: int, low: int, high: int, late: bool) -> int:
        """Smallest capacity within [low, high] that needs no more than ``shards``, by binary search."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if len(self.cuts(middle, late)) < shards else (middle + 1, high)
        return low


def minimax_cuts(groups: DataFrame, shards: int, bins: int | None = None) -> list[int]:
    """Least keys of shards 1, 2, ... when the groups (key, bytes), ordered by key, are cut into at most ``shards`` runs
    whose largest is as small as can be. Keys are distinct, of BITS bits; no group gives no cuts.

    A round sums the groups by key prefixes; only ranges in which some cut may lie are summed more finely in
    the next, so rounds grow with the logarithm of the number of groups and the driver sees ``bins`` sums each.
    """
    bins = bins or BINS
    shift, known, open_ = BITS, [], [(0, 0)]
    while True:
        finer = max(0, shift - max(1, ((bins or BINS) // sum(b - a + 1 for a, b in open_)).bit_length() - 1))
        prefix = F.shiftright("key", shift)
        inside = groups.where(reduce(or_, (prefix.between(a, b) for a, b in open_))) if shift < BITS else groups
        sums = inside.groupBy(F.shiftright("key", finer)).agg(F.min("key").alias("first"), F.sum("bytes").cast("long").alias("size"), F.max("bytes").alias("largest"), F.count("*").alias("n"))
        shift = finer
        ranges = sorted([*known, *(Range(r.first, r.size, r.largest, r.n == 1) for r in sums.collect())], key=lambda r: r.first)
        if not ranges:
            return []
        line = _Line(ranges)
        least = max(-(-line.total // shards), max(r.largest for r in ranges))
        low = line.smallest(shards, least, line.total, late=True)
        high = line.smallest(shards, low, line.total, late=False)
        doubt: set[int] = set()
        for a, b in zip(line.cuts(low, late=False)[: shards - 1], [*line.cuts(high, late=True), *[line.total - 1] * shards]):
            span = range(bisect_right(line.ends, a), min(bisect_right(line.ends, max(a, b)) + 1, len(ranges)))
            if not all(ranges[k].single for k in span):
                doubt.update(span)
        if not doubt:
            return [ranges[bisect_right(line.ends, at)].first for at in line.cuts(high, late=False)]
        ks = sorted(doubt)  # runs of neighbours, at most one for each cut
        starts = [k for k in ks if k - 1 not in doubt]
        open_ = [(ranges[i].first >> shift, ranges[j].first >> shift) for i, j in zip(starts, (k for k in ks if k + 1 not in doubt))]
        known = [r for k, r in enumerate(ranges) if k not in doubt]


def oversized(groups: DataFrame, shards: int) -> list[int]:
    """Keys of groups larger than an even share of what is left when the groups before them have shards of their own, largest first."""
    total, out = groups.agg(F.sum("bytes").cast("long")).first()[0] or 0, []
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if r.bytes * (shards - len(out)) <= total:
            break
        out.append(r.key)
        total -= r.bytes
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text; other columns don't matter).

    ``size`` is the bytes of the text and OVERHEAD; the law is ``bytes``: rows with equal texts share a shard,
    and the largest shard is as small as their order allows. The order is that of a hash of the text; groups
    above an even share lead it, each in a shard of its own. A null text counts as an empty one, null ids come first
    among equal texts, repeated rows each have a slot. An empty table has no rows; with few groups some shards stay empty.

    Slots follow the order inside a shard. They come from one range partitioning of narrow rows that tells even
    equal rows apart, so a group with a third of all rows spreads over many tasks; texts are never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", group_key(text).alias("key"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    rows = saved(rows, "sizes")
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    heavy = oversized(groups, shards)
    rest = groups.where(~F.col("key").isin(heavy)) if heavy else groups
    cuts = minimax_cuts(rest, shards - len(heavy)) if len(heavy) < shards else []
    dropped(groups)
    shard = F.lit(len(heavy))
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    for i, key in enumerate(heavy):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    placed = ranked(rows.withColumn("shard", shard.cast("int")), "shard", ["key", "doc_id", "row"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def manifest(placed: DataFrame) -> DataFrame:
    """(shard, rows, bytes) of what :func:`sharded` returned; empty shards have no row."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
