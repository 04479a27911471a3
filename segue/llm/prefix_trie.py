"""Conversation prefix trie by vertical bitmaps.

A shard is a run of conversations. It maps each (position, turn) to the bitset of the
conversations that have this turn there. Walking down from the root, the bitset of a node
and the posting of a turn give a child; what they leave gives the next one. Popcounts are members,
and members without a further turn are the end list. Nodes of all shards that stand for
the same turns are added up by a hash of their path.

Sums over a subtree need to know which nodes are the same in two shards. So each node belongs to its
smallest member: a first walk finds from which depth on a conversation owns its path, and in a second walk
everything is a sum over the members of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.ranks import ranked
from segue.llm.store import dropped, saved

#: Turns that a conversation sends as one row; a longer one is cut into blocks.
BLOCK = 256
#: Rows of a shard.
SHARD = 2048
#: A conversation takes its first turns, at most three, over from the first of its twenty.
FAMILY, TAKEN = 20, 4

_NEVER = np.iinfo(np.int64).max
_NODE = "depth long, k1 long, k2 long, low long, n long, ends long"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, turn_key, words) of every row with a conv_id: its place in its conversation and what tells turns apart.

    Order is by turn, null first; rows with equal turns are ordered by a hash of role and text. Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.md5(role), F.md5(text)))).alias("turn_key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return ranked(rows, "conv_id", ["turn", "turn_key"]).select("conv_id", "rank", "turn_key", "words")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, words) of each conversation with the head it takes over; no turns: one row with a null pos.

    ``rows`` is what :func:`turns` returns. A conversation c takes the first crc32(c) % TAKEN turns of conversation
    c - c % FAMILY, as many as there are, and its own turns behind its first crc32(c) % TAKEN.
    """
    head = F.sort_array(F.collect_list(F.when(F.col("rank") < TAKEN - 1, F.struct("rank", "turn_key", "words"))))
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own"), head.alias("head"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    convs = convs.select("conv_id", "own", skip.alias("skip"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(bases, "base", "left")
    taken = F.slice(F.coalesce("base_head", F.array().cast("array<struct<rank:bigint,turn_key:binary,words:bigint>>")), F.lit(1), F.col("skip").cast("int"))
    convs = saved(convs.select("conv_id", "own", "skip", taken.alias("taken")), "convs")
    first = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.rank").alias("pos"), "t.turn_key", "t.words")
    rest = rows.join(convs.select("conv_id", "skip", F.size("taken").alias("before")), "conv_id").where("rank >= skip")
    none = convs.where((F.size("taken") == 0) & (F.col("own") <= F.col("skip")))
    null = lambda kind: F.lit(None).cast(kind)
    return first.union(rest.select("conv_id", F.col("rank") - F.col("skip") + F.col("before"), "turn_key", "words")).union(none.select("conv_id", null("long"), null("binary"), null("long")))


def blocks(rows: DataFrame) -> DataFrame:
    """A row for each run of BLOCK turns of a conversation: the keys of its turns, the key of the path before it,
    and the words behind it. A turn's two keys hash its place and content; a path's keys are the xor of its turns'."""
    keyed = rows.select("conv_id", "pos", F.coalesce(F.floor(F.col("pos") / BLOCK), F.lit(0)).alias("block"), F.xxhash64("pos", "turn_key").alias("k1"), F.xxhash64("turn_key", "pos").alias("k2"), "words")
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "k1", "k2", "words"))
    some = keyed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.bit_xor(F.when(F.col("pos").isNotNull(), F.col("k1"))).alias("x1"), F.bit_xor(F.when(F.col("pos").isNotNull(), F.col("k2"))).alias("x2"), F.coalesce(F.sum("words"), F.lit(0)).alias("w"))
    along = Window.partitionBy("conv_id").orderBy("block")
    before, behind = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    return some.select(
        "conv_id", (F.col("block") * BLOCK).cast("long").alias("start"), F.coalesce(F.bit_xor("x1").over(before), zero).alias("up1"), F.coalesce(F.bit_xor("x2").over(before), zero).alias("up2"),
        F.col("t.k1").alias("k1"), F.col("t.k2").alias("k2"), F.col("t.words").alias("words"), F.coalesce(F.sum("w").over(behind), zero).alias("rest"), F.lead("block").over(along).isNull().alias("last"))


class _Shard:
    """Rows of one shard in order of conv_id, their turns in flat arrays, and the walk over them."""

    def __init__(self, batch: pa.RecordBatch):
        batch = batch.take(pa.array(np.argsort(batch.column("conv_id").to_numpy(), kind="stable")))
        flat = lambda name: batch.column(name).flatten().to_numpy()
        self.conv, self.start, self.last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "start", "last"))
        self.up = [batch.column(c).to_numpy() for c in ("up1", "up2")]
        self.size = batch.column("k1").value_lengths().to_numpy().astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        turn = [flat(c) for c in ("k1", "k2")]
        self.turn = list(zip(*(t.tolist() for t in turn)))
        row = np.repeat(np.arange(len(self.conv)), self.size)
        self.path = []
        for up, keys in zip(self.up, turn):
            total = np.concatenate(([0], np.bitwise_xor.accumulate(keys)))
            self.path.append(total[1:] ^ total[self.at[row]] ^ up[row])
        self.words = flat("words").astype(np.int64)
        # words from each turn on, those of later blocks included
        total = np.concatenate(([0], np.cumsum(self.words)))
        self.after = total[self.at[1:]][row] - total[:-1] + batch.column("rest").to_numpy()[row]
        self.extra = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("own_from", "leaf", "own_words") if c in batch.schema.names}
        self._posted()

    def _posted(self) -> None:
        """Bitsets: rows with a turn at its place, rows that end after so many turns, rows that go on."""
        self.having: dict[tuple[int, int], int] = {}
        self.ending: dict[int, int] = {}
        self.roots: dict[tuple[int, int, int], int] = {}
        for r, (a, b, last) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist(), self.last.tolist())):
            bit = 1 << r
            for t in self.turn[a:b]:
                self.having[t] = self.having.get(t, 0) | bit
            if last:
                self.ending[b - a] = self.ending.get(b - a, 0) | bit
        for r, key in enumerate(zip(self.start.tolist(), self.up[0].tolist(), self.up[1].tolist())):
            self.roots[key] = self.roots.get(key, 0) | 1 << r
        longer, self.longer = 0, [0] * (int(self.size.max(initial=0)) + 1)
        by_size: dict[int, int] = {}
        for r, n in enumerate(self.size.tolist()):
            by_size[n] = by_size.get(n, 0) | 1 << r
        for n in range(len(self.longer) - 1, -1, -1):
            self.longer[n] = longer
            longer |= by_size.get(n, 0)

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(turns into the block, members, members that end) of nodes with two members and more, depth first; (turns, ~row, 0) where a path has one member from there on."""
        for (start, _, _), members in self.roots.items():
            stack = [(members, 0)]
            while stack:
                bits, deep = stack.pop()
                if not bits & (bits - 1) and (deep or not start):
                    yield deep, ~(bits.bit_length() - 1), 0
                    continue
                if deep or not start:  # the node above a later block belongs to the block before
                    yield deep, bits, bits & self.ending.get(deep, 0)
                left = bits & self.longer[deep] if deep < len(self.longer) else 0
                while left:
                    r = (left & -left).bit_length() - 1
                    child = left & self.having[self.turn[self.at[r] + deep]]
                    left ^= child
                    stack.append((child, deep + 1))

    def members(self, bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))

    def nodes(self, sums: bool) -> Iterator[pa.RecordBatch]:
        """All nodes of the shard; ``sums`` adds what needs the owners."""
        row, deep, count, ends, lists = [], [], [], [], []
        extra: dict[str, list] = {"children": [], "leaves": [], "saved": []}
        alone: list[tuple[int, int]] = []
        for d, bits, ending in self.walk():
            if bits < 0:
                alone.append((~bits, d))
                continue
            r = (bits & -bits).bit_length() - 1
            row.append(r)
            deep.append(d)
            count.append(bits.bit_count())
            ends.append(ending.bit_count())
            if sums:
                who = self.members(bits)
                kids, leaves, gain = self._sums(who, np.full(len(who), d))
                for name, x in zip(extra, (kids.sum(), leaves.sum(), gain.sum())):
                    extra[name].append(int(x))
                lists.append(",".join(map(str, self.conv[self.members(ending)].tolist())) if ending else None)
        # paths with one member: all their nodes at once
        one, first = (np.array(x, np.int64) for x in zip(*alone)) if alone else (np.empty(0, np.int64),) * 2
        many = self.size[one] - first + 1
        rows1 = np.repeat(one, many)
        deep1 = np.arange(len(rows1)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        ends1 = self.last[rows1] & (deep1 == self.size[rows1])
        rows, d = np.concatenate((np.array(row, np.int64), rows1)), np.concatenate((np.array(deep, np.int64), deep1))
        top = d == 0
        last = np.where(top, 0, self.at[rows] + d - 1)
        pick = lambda values: np.where(top, 0, values[last]) if len(values) else np.zeros(len(rows), np.int64)
        out = {"depth": self.start[rows] + d, "k1": pick(self.path[0]), "k2": pick(self.path[1]), "low": self.conv[rows],
               "n": np.concatenate((np.array(count, np.int64), np.ones(len(rows1), np.int64))), "ends": np.concatenate((np.array(ends, np.int64), ends1.astype(np.int64)))}
        if sums:
            for k, name in enumerate(("p1", "p2")):
                second = d > 1
                above = self.path[k][np.where(second, last - 1, 0)] if len(self.path[k]) else np.zeros(len(rows), np.int64)
                out[name] = np.where(second, above, np.where(top, 0, self.up[k][rows]))
            for name, x in zip(extra, self._sums(rows1, deep1)):
                out[name] = np.concatenate((np.array(extra[name], np.int64), x.astype(np.int64)))
            text = [*lists, *np.where(ends1, self.conv[rows1].astype(str), None).tolist()]
        else:
            out["words"] = pick(self.words)
        arrays = {k: pa.array(v) for k, v in out.items()}
        if sums:
            arrays["list"] = pa.array(text, pa.string())
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    def _sums(self, who: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each member adds to a node so many turns into the block: owned children, owned leaves, and words it
        shares below (those of its path less those of the nodes it owns)."""
        own, depth = self.extra["own_from"][who], self.start[who] + deep
        more = ~self.last[who] | (deep < self.size[who])
        after = np.zeros(len(who), np.int64)
        held = self.size[who] > 0
        after[held] = self.after[self.at[who[held]] + np.maximum(deep[held], 1) - 1]
        return more & (own <= depth + 1), self.extra["leaf"][who], after - np.where(own <= depth, after, self.extra["own_words"][who])


def _walked(sums: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SHARD):
                yield from _Shard(batch.slice(i, SHARD)).nodes(sums)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined lists of each node; rows come sorted by node and first conversation."""
    node, state, done = None, None, []
    for batch in batches:
        for key, text in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), batch.column("list").to_pylist()):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["depth", "k1", "k2", "sha"])
            done = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["depth", "k1", "k2", "sha"])


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``conversations`` has conv_id, turn, role and text; other columns don't matter. Rows with a null conv_id belong to no
    conversation, a null turn comes first, null roles and texts are empty, repeated rows are turns of their own. An
    empty table has no node. Copies of a conversation are bits of the same bitsets; a very long one is cut
    into blocks; the end list of a node travels as one joined text for each shard, and only its hash is taken in one task.
    """
    rows = turns(conversations)
    cut = saved(blocks(rebuilt(rows)), "blocks")
    key = ["depth", "k1", "k2"]
    first = cut.mapInArrow(_walked(False), f"{_NODE}, words long")
    first = first.groupBy(*key).agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.any_value("words").alias("words"))
    owned = first.groupBy("low").agg(F.min("depth").alias("own_from"), F.max((F.col("n") == F.col("ends")).cast("long")).alias("leaf"), F.sum("words").alias("own_words"))
    owned = saved(owned.withColumnRenamed("low", "conv_id"), "owners")
    zero = F.lit(0).cast("long")
    full = cut.join(owned, "conv_id", "left").withColumns({"own_from": F.coalesce("own_from", F.lit(int(_NEVER))), "leaf": F.coalesce("leaf", zero), "own_words": F.coalesce("own_words", zero)})
    found = full.repartitionByRange("conv_id", "start").sortWithinPartitions("conv_id", "start").mapInArrow(_walked(True), f"{_NODE}, p1 long, p2 long, children long, leaves long, saved long, list string")
    found = saved(found, "nodes")
    dropped(cut)
    total = {c: F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")}
    nodes = found.groupBy(*key).agg(F.min("low").alias("low"), F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2"), *total.values())
    nodes = saved(nodes, "trie")
    lists = found.where("list is not null").select(*key, "low", "list").repartition(*key).sortWithinPartitions(*key, "low")
    hashes = lists.select(*key, "list").mapInArrow(_hashed, "depth long, k1 long, k2 long, sha string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("parent_conv_id"))
    out = nodes.join(hashes, key, "left").join(parents, ["depth", "p1", "p2"], "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", empty).alias("ends_sha256"))
