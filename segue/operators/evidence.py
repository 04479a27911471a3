"""Label evidence from per-window scores, and nearest vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions.basic import clip, r6, snap
from segue.functions.vectors import entropy, softmax
from segue.functions.vocab import ACTIVITIES, INTENSITIES, MOODS, STYLES
from segue.session import cut_lineage

GROUPS = {"mood": MOODS, "activity": ACTIVITIES, "intensity": INTENSITIES, "style": STYLES}


def _labelled(rows, group: str):
    return F.transform(rows, lambda r, i: F.struct(
        F.lit(group).alias("grp"), i.alias("ord"), r["label"].alias("label"), r["raw"].alias("raw"), r["rel"].alias("rel")))


def group_scores(windows: DataFrame, vector: str = "embedding", groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Raw and relative score per window and label: ``track_id, win, grp, ord, label, raw, rel``.

    The softmax of each group is taken on the row's array, before anything is exploded.
    """
    parts, at = [], 1
    for name, labels in (groups or GROUPS).items():
        raw = F.slice(F.col(vector), at, len(labels))
        rows = F.arrays_zip(raw.alias("raw"), softmax(raw).alias("rel"), F.array(*[F.lit(x) for x in labels]).alias("label"))
        parts.append(_labelled(rows, name))
        at += len(labels)
    return windows.select("track_id", "win", F.explode(F.concat(*parts)).alias("e")).select("track_id", "win", "e.*")


def label_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("track_id", "grp", "ord", "label").agg(F.avg("raw").alias("raw"), F.avg("rel").alias("rel"))


def variability(scores: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute deviation of windows from the track's summary (every window has all labels)."""
    m = means.select("track_id", "grp", "ord", F.col("rel").alias("m"))
    return scores.join(m, ["track_id", "grp", "ord"]).groupBy(*keys).agg(F.avg(F.abs(F.col("rel") - F.col("m"))).alias("spread"))


def separation(means: DataFrame, spread: DataFrame) -> DataFrame:
    """Top label, margins, entropy, consistency and reliability per track and group."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("rel")).alias("n"), "ord", "label")))
    raws = F.array_sort(F.collect_list(-F.col("raw")))
    a = means.groupBy("track_id", "grp").agg(ranked.alias("r"), raws.alias("w"), F.collect_list("rel").alias("v")).join(spread, ["track_id", "grp"])
    top, second = -F.element_at("r", 1)["n"], -F.element_at("r", 2)["n"]
    margin = F.greatest(F.lit(0.0), top - second)
    raw_margin = F.greatest(F.lit(0.0), F.element_at("w", 2) - F.element_at("w", 1))
    h = entropy(F.col("v"))
    consistency = clip(1 - F.col("spread") * 4)
    b = a.select("track_id", "grp", F.element_at("r", 1)["label"].alias("top_label"), top.alias("top"), second.alias("second"),
                 margin.alias("margin"), raw_margin.alias("raw_margin"), h.alias("entropy"), consistency.alias("consistency"))
    rel = clip(0.35 * clip(F.col("margin") / 0.08) + 0.25 * (1 - F.col("entropy")) + 0.20 * clip(F.col("raw_margin") / 0.12) + 0.20 * F.col("consistency"))
    return b.select("track_id", "grp", "top_label", r6(F.col("top")).alias("top_score"), r6(F.col("second")).alias("second_score"), r6(F.col("margin")).alias("margin"),
                    r6(F.col("entropy")).alias("entropy"), r6(F.col("raw_margin")).alias("raw_margin"), r6(F.col("consistency")).alias("window_consistency"), r6(rel).alias("reliability"))


def tags(metrics: DataFrame, min_reliability: float = 0.55, min_margin: float = 0.025) -> DataFrame:
    """Displayable labels in group order, at most six, and mean reliability."""
    order = {g: i for i, g in enumerate(GROUPS)}
    rank = None
    for g, i in order.items():
        rank = F.when(F.col("grp") == g, i) if rank is None else rank.when(F.col("grp") == g, i)
    good = (F.col("reliability") >= min_reliability) & (F.col("margin") >= min_margin)
    rows = F.array_sort(F.collect_list(F.when(good, F.struct(rank.alias("i"), F.col("top_label").alias("l")))))
    return metrics.groupBy("track_id").agg(rows.alias("t"), F.avg("reliability").alias("c")).select(
        "track_id", F.concat_ws(",", F.slice(F.transform("t", lambda x: x["l"]), 1, 6)).alias("tags"), snap(F.col("c"), 6).alias("confidence"))


def centroid(windows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean vector per track at unit length, one row per component."""
    parts = windows.select("track_id", F.posexplode(vector).alias("i", "x")).groupBy("track_id", "i").agg(F.avg("x").alias("x"))
    size = parts.groupBy("track_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return parts.join(size, "track_id").select("track_id", F.col("i").cast("bigint").alias("i"), (F.col("x") / F.greatest(F.col("n"), F.lit(1e-12))).alias("x"))


#: Rows of a matrix of similarities that are held at once, and rows that a search for cells sends on at once.
SLICE, SENT = 256, 4096


def _slices(pdf: pd.DataFrame):
    """``pdf`` in pieces, each with its vectors as a matrix."""
    for a in range(0, len(pdf), SLICE):
        part = pdf.iloc[a : a + SLICE]
        yield part, np.stack(part.iloc[:, 1].to_numpy())


def nearest(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of ``c`` (t, y) for each of ``q`` (track_id, unit, …); memory is bounded by ``SLICE`` rows of similarities."""
    none = pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "similarity": np.zeros(0)})
    if q.empty or c.empty:
        return none
    c = c.sort_values("t", kind="stable")
    ids, y, out = c["t"].to_numpy(), np.stack(c["y"].to_numpy()).T, [none]
    for part, x in _slices(q[["track_id", "unit"]]):
        qids = part["track_id"].to_numpy()
        sim = np.round(np.clip((x @ y + 1) / 2, 0, 1), 6)
        sim[qids[:, None] == ids[None, :]] = -1.0
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        got = pd.DataFrame({"src": np.repeat(qids, top.shape[1]), "dst": ids[top].ravel(), "similarity": np.take_along_axis(sim, top, 1).ravel()})
        out.append(got[got["similarity"] >= 0])
    return pd.concat(out, ignore_index=True)


def _blocks(cell: Column, rows: dict[int, int], block: int) -> Column:
    """In how many blocks of about ``block`` rows each cell is cut."""
    more = [F.lit(x) for c, n in sorted(rows.items()) if n > block for x in (c, -(-n // block))]
    return F.coalesce(F.try_element_at(F.create_map(*more), cell), F.lit(1)) if more else F.lit(1)


def knn(vectors: DataFrame, k: int = 5, cell_rows: int = 1024, pivots: int = 2048, block: int = 4096) -> DataFrame:
    """The k nearest vectors of each vector by cosine mapped to [0, 1]; ties by id. Exact.

    Each vector belongs to the cell of its nearest pivot. A query is first compared with its own
    cell; its k-th similarity there rules out every cell that can't hold a better one, since
    q.y <= q.p + |y - p| for each member y of the cell of p. A cell's rows and the queries that ask for it are
    cut into blocks of bounded size by their own numbers, and a block returns k rows per query, so no pair is ever emitted.

    A zero vector has similarity 0.5 with every vector: as a query it takes the smallest ids, and
    as targets only the k + 1 smallest ids among zero vectors can matter.
    """
    f = F.col
    v = vectors.select("track_id", "embedding").where(f("embedding").isNotNull())
    share = min(1 / cell_rows, pivots / max(v.count(), 1))
    spread = F.pmod(F.xxhash64("track_id"), F.lit(1 << 40))
    picked = v.where(spread < int(share * (1 << 40))).orderBy(F.xxhash64("track_id"), "track_id").limit(2 * pivots).collect()
    p = np.stack([r.embedding for r in picked]) if picked else None
    if p is not None:
        p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)

    def homes(parts):
        for pdf in parts:
            for part, u in _slices(pdf):
                norm = np.linalg.norm(u, axis=1)
                u = u / np.maximum(norm, 1e-300)[:, None]
                dots = u @ p.T if p is not None else np.zeros((len(u), 1))
                cell = dots.argmax(axis=1)
                size = (p * p).sum(axis=1)[cell] if p is not None else np.zeros(len(u))
                far = np.sqrt(np.maximum((u * u).sum(axis=1) + size - 2 * dots[np.arange(len(u)), cell], 0))
                yield pd.DataFrame({"track_id": part["track_id"], "unit": list(u), "zero": norm == 0, "cell": cell, "far": far})

    placed = cut_lineage(v.mapInPandas(homes, "track_id long, unit array<double>, zero boolean, cell long, far double"))
    queries = placed.where(~f("zero"))
    targets = queries.unionByName(placed.where("zero").orderBy("track_id").limit(k + 1))
    cells = targets.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    radius = np.full(len(p) if p is not None else 1, -np.inf)
    for r in cells:
        radius[r.cell] = r.far
    parts = _blocks(f("cell"), {r.cell: r.n for r in cells}, block)
    right = targets.select(f("track_id").alias("t"), f("unit").alias("y"), f("cell").alias("yc"), F.pmod(F.xxhash64("track_id"), parts).alias("yj"))

    def searched(asked: DataFrame, rows: dict[int, int]) -> DataFrame:
        """k best of each (track_id, unit, cell) inside that cell, block by block; ``rows`` ask for each cell."""
        left = asked.withColumn("i", F.pmod(F.xxhash64("track_id", F.lit(1)), _blocks(f("cell"), rows, block).cast("long"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        met = F.explode(F.sequence(F.lit(0).cast("long"), _blocks(f("yc"), rows, block).cast("long") - 1))
        there = right.where(f("yc").isin(list(rows))).withColumn("yi", met) if rows else right.limit(0).withColumn("yi", met)
        best = lambda q, c: nearest(q, c, k)
        return left.groupBy("cell", "i", "j").cogroup(there.groupBy("yc", "yi", "yj")).applyInPandas(best, "src long, dst long, similarity double")

    count = lambda df: {r.cell: r.n for r in df.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(f("rank") <= k)
    own = cut_lineage(ranked(searched(queries.select("track_id", "unit", "cell"), count(queries.select("cell", F.lit(1).alias("n"))))))
    floor = own.groupBy("src").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).otherwise(-1.0).alias("floor"))

    def others(batches):
        """(track_id, unit, cell) of each other cell that may hold a better one, some rows at a time."""
        for pdf in batches:
            for part, u in _slices(pdf):
                most = (np.minimum((u @ p.T if p is not None else np.zeros((len(u), 1))) + radius, 1) + 1) / 2
                ok = (most >= part["floor"].to_numpy()[:, None] - 2e-6) & np.isfinite(most)
                ok[np.arange(len(u)), part["cell"].to_numpy()] = False
                yield part["track_id"].to_numpy(), u, ok

    def sent(batches):
        for ids, u, ok in others(batches):
            i, c = np.nonzero(ok)
            for a in range(0, len(i), SENT):
                j = i[a : a + SENT]
                yield pd.DataFrame({"track_id": ids[j], "unit": list(u[j]), "cell": c[a : a + SENT]})

    def counted(batches):
        n = sum((ok.sum(axis=0) for _, _, ok in others(batches)), np.zeros(len(radius), np.int64))
        c = np.flatnonzero(n)
        yield pd.DataFrame({"cell": c, "n": n[c]})

    asked = queries.join(floor, queries.track_id == floor.src, "left").select("track_id", "unit", "cell", F.coalesce("floor", F.lit(-1.0)).alias("floor"))
    far = searched(asked.mapInPandas(sent, "track_id long, unit array<double>, cell long"), count(asked.mapInPandas(counted, "cell long, n long")))
    first = F.broadcast(placed.select(f("track_id").alias("dst")).orderBy("dst").limit(k + 1).agg(F.collect_list("dst").alias("ids")))
    blank = placed.where("zero").select(f("track_id").alias("src")).join(first).select("src", F.explode("ids").alias("dst"), F.lit(0.5).alias("similarity")).where("src <> dst")
    return ranked(own.drop("rank").unionByName(far).unionByName(blank))
