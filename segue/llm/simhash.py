"""SimHash near-duplicates: a binary trie of fingerprints joined with itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.llm.components import components
from segue.llm.store import saved
from segue.llm.text import chunks, text_bytes

#: Differing bits that still link two fingerprints.
BUDGET = 2
#: Words in a shingle and seed of its XXH64.
WIDTH, SEED = 3, 42
#: The four 16-bit blocks of a fingerprint; two that differ in two bits agree in two blocks at least.
LEADS = list(combinations(range(4), BUDGET))
#: Fingerprints under one node pair that a task takes at once; larger node pairs are divided.
NODE_ROWS = 200_000
#: Bits by which a node pair is divided.
STEP = 8

#: For each byte, its bits as eight counters in one 64-bit word, highest bit first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    of = xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return [of(line, SEED)]
    return [of(line[a + 1 : b], SEED) for a, b in zip(ends, ends[WIDTH:])]


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    """Majority bits of the shingle hashes of each text; zero without words."""
    each = [_shingle_hashes(t) for t in texts]
    counts = np.array([len(h) for h in each], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.fromiter((x for h in each for x in h), ">u8", int(counts.sum()))
    lanes = _LANES[flat.view(np.uint8).reshape(-1, 8)]
    parts = -(-counts[full] // 255)  # a counter holds 255 at most
    start = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    sums = np.add.reduceat(lanes, np.repeat(start, parts) + 255 * nth, axis=0)
    bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(2 * bits > counts[full][:, None], axis=1).view(">u8").ravel()
    return out


def printed(column: pa.Array) -> Iterator[np.ndarray]:
    """Signed fingerprints of the texts of a column, some texts at a time."""
    data, off = text_bytes(column)
    raw = data.tobytes()
    for i, j in chunks(off):
        yield _fingerprints([raw[off[k] : off[k + 1]] for k in range(i, j)]).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): SimHash of each text as a signed 64-bit integer. A null text is empty; empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.empty(0, np.int64), *printed(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got))], ["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, T.StructType([T.StructField("id", kept.schema[0].dataType), T.StructField("fp", T.LongType())]))


def _trie_pairs(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of values in the same range [lo, hi) of ``q`` with few differing bits.

    Values are sorted inside each range and agree above bit ``top``. Every range is a trie
    node; pairs of nodes go down together one bit at a time, and a pair is dropped once its
    paths differ in more than ``budget`` bits or it holds no two values.
    """
    keep = hi - lo > 1
    a0, a1, b0, b1 = lo[keep], hi[keep], lo[keep], hi[keep]
    err = np.zeros(len(a0), np.int64)
    for bit in range(top, -1, -1):
        ones = np.concatenate(([0], np.cumsum((q >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        sides = [(a0, am, b0, bm, err, own), (am, a1, bm, b1, err, own), (a0, am, bm, b1, err + 1, np.zeros_like(own)), (am, a1, b0, bm, err + 1, np.zeros_like(own))]
        got = []
        for k, (w, x, y, z, e, same) in enumerate(sides):
            ok = (x > w) & (z > y) & (e <= budget) & ~(same & (x - w < 2))
            if k == 3:
                ok &= ~own
            got.append([v[ok] for v in (w, x, y, z, e)])
        a0, a1, b0, b1, err = (np.concatenate(v) for v in zip(*got))
    return np.minimum(a0, b0), np.maximum(a0, b0)


def _lead_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first of LEADS whose blocks are equal in both, so that each link is reported once."""
    out = np.full(len(x), len(LEADS), np.int64)
    same = [((x ^ y) >> np.uint64(48 - 16 * b)) & np.uint64(0xFFFF) == 0 for b in range(4)]
    for k in range(len(LEADS) - 1, -1, -1):
        out[same[LEADS[k][0]] & same[LEADS[k][1]]] = k
    return out


def _join_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each node pair; rows come sorted by node pair, q."""

    def links(lead, depth, node, mask, q, fp, rep):
        change = np.flatnonzero((node[1:] != node[:-1]) | (mask[1:] != mask[:-1]) | (lead[1:] != lead[:-1]) | (depth[1:] != depth[:-1])) + 1
        lo, hi = np.concatenate(([0], change)), np.concatenate((change, [len(node)]))
        some = hi - lo > 1
        i, j = _trie_pairs(q, lo[some], hi[some], 63, BUDGET)
        ok = (_lead_of(fp[i], fp[j]) == lead[i]) & ((q[i] ^ q[j]) >> (64 - depth[i]).astype(np.uint64) == mask[i].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(rep[i[ok]]), pa.array(rep[j[ok]])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = [v.view(np.uint64) if k in (4, 5) else v for k, v in enumerate(now)]
        held = now if held is None else [np.concatenate(v) for v in zip(held, now)]
        if not len(held[0]):
            continue
        last = np.flatnonzero((held[2] != held[2][-1]) | (held[3] != held[3][-1]) | (held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*(v[:cut] for v in held))
            held = [v[cut:] for v in held]
    if held is not None and len(held[0]):
        yield links(*held)


def trie_links(prints: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): representatives of distinct fingerprints that differ in at most BUDGET bits.

    ``prints`` has one row per fingerprint: fp, rep. Six copies of the trie lead with each
    pair of 16-bit blocks, so traversal starts at nodes of 32 equal bits. A row belongs to a
    node pair {p, p ^ mask}. Node pairs with more than ``node_rows`` rows are replaced by
    their children, eight bits further down, whose masks still fit the budget; the rest is
    traversed inside the tasks. At full depth a node pair has two rows, so no task is unbounded.
    """
    block = lambda b: F.shiftrightunsigned("fp", 48 - 16 * b).bitwiseAND(0xFFFF)
    leads = []
    for k, lead in enumerate(LEADS):
        q = F.lit(0).cast("long")
        for b in [*lead, *(b for b in range(4) if b not in lead)]:
            q = F.shiftleft(q, 16).bitwiseOR(block(b))
        leads.append(F.struct(F.lit(k).alias("lead"), q.alias("q")))
    rows = prints.select("fp", "rep", F.inline(F.array(*leads))).withColumns({"depth": F.lit(32), "mask": F.lit(0).cast("long")})
    key = ["lead", "depth", "node", "mask"]

    def placed(df: DataFrame, depth: int) -> DataFrame:
        own = F.shiftrightunsigned("q", 64 - depth)
        other = own.bitwiseXOR(F.col("mask"))
        unsigned_less = F.when((own < 0) == (other < 0), own < other).otherwise(own >= 0)
        return df.withColumns({"depth": F.lit(depth), "node": F.when(unsigned_less, own).otherwise(other)})

    rows, done, depth = placed(rows, 32), [], 32
    while depth < 64:
        hot = rows.groupBy(*key).count().where(F.col("count") > node_rows).select(*key)
        hot = saved(hot, "nodes")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, key, "left_anti"))
        depth += STEP
        masks = [m for m in range(1 << STEP) if m.bit_count() <= BUDGET]
        deeper = rows.join(hot, key, "left_semi").withColumn("more", F.explode(F.array(*map(F.lit, masks))))
        deeper = deeper.where(F.bit_count("mask") + F.bit_count("more") <= BUDGET)
        rows = saved(placed(deeper.withColumn("mask", F.shiftleft("mask", STEP).bitwiseOR(F.col("more").cast("long"))).drop("more"), depth), "nodes")
    for part in done:
        rows = rows.unionByName(part)
    rows = rows.select("lead", "depth", "node", "mask", "q", "fp", "rep").repartition("lead", "depth", "node", "mask")
    rows = rows.sortWithinPartitions(*key, F.col("q") < 0, "q")
    return rows.mapInArrow(_join_nodes, "a long, b long")


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints that differ in at most two bits are linked; component_id is the least doc_id
    reachable. Equal fingerprints are folded to their least doc_id before anything is joined.
    Texts without words (null, empty, blanks) have fingerprint zero and link like any other.
    Repeated rows come back as often; a null doc_id is kept with its fingerprint and takes the
    component of its fingerprint (null if no other row has it). Other columns are ignored; an
    empty table gives no rows.
    """
    prints = saved(fingerprints(docs), "prints")
    folded = saved(prints.groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "folded")
    known = components(trie_links(folded.where("rep is not null"), node_rows), "a", "b")
    classes = folded.join(known, folded.rep == known.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(classes, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
