"""Embedding near-dedup: exact range join of unit vectors over pivot cells.

Vectors with a cosine of at least 0.98 lie at most ``sqrt(2 - 2 * 0.98)`` apart. Each vector
belongs to the cell of its nearest pivot and is also sent to every cell that may hold a
neighbour of it, so each cell finds all links of its own vectors by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.components import components
from segue.llm.store import saved

#: Least cosine of a link.
COSINE = 0.98
#: Distinct vectors a pivot is to stand for, and pivots at most (they travel to each task).
CELL_ROWS, PIVOTS = 1000, 4096
#: Rows of a cell that a task compares at once on either side; larger cells are cut into blocks.
BLOCK = 4096

_SLACK = 1e-9


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, unit): unit vectors as bytes of doubles; null where nothing may link."""
    for batch in batches:
        units: list[bytes | None] = []
        for i, label, v in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
            unit = None
            if i is not None and label is not None and v and all(x is not None for x in v):
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top  # no overflow in the norm
                    unit = (x / np.sqrt(x @ x)).tobytes()
            units.append(unit)
        dims = pa.array([None if u is None else len(u) // 8 for u in units], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, pa.array(units, pa.binary())], ["id", "label", "dim", "unit"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _by_key(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows of each (label, dim)."""
    keys: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        keys.setdefault(key, []).append(k)
    for key, rows in keys.items():
        yield key, np.array(rows)


def _homes(pivots: dict):
    """Adds the nearest pivot of each vector and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, 2.0)  # -1: no pivot of its kind
            for key, rows in _by_key(batch):
                if key in pivots:
                    cos = _matrix(batch.column(2).take(pa.array(rows)), key[1]) @ pivots[key].T
                    cell[rows] = cos.argmax(axis=1)
                    far[rows] = np.sqrt(np.maximum(2 - 2 * cos.max(axis=1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "home", "far"])

    return run


def _members(pivots: dict, radius: dict, r: float):
    """One row for each cell that may hold a neighbour of a vector, its home included.

    A vector x of cell h has a neighbour within r in cell c only if, by the triangle
    inequality, d(x, p_c) <= radius_c + r and d(x, p_c) <= d(x, p_h) + 2 r, and if x lies within r
    of the plane between both pivots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            home = batch.column(5).to_numpy()
            for key, rows in _by_key(batch):
                if key not in pivots:
                    at.append(rows)
                    cells.append(np.full(len(rows), -1, np.int64))
                    continue
                p = pivots[key]
                cos = _matrix(batch.column(2).take(pa.array(rows)), key[1]) @ p.T
                far = np.sqrt(np.maximum(2 - 2 * cos, 0))
                own = home[rows]
                near, apart = cos[np.arange(len(rows)), own], np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
                reach = np.array([radius.get((*key, c), -np.inf) for c in range(len(p))])
                ok = (far <= reach + r + _SLACK) & (far <= far[np.arange(len(rows)), own][:, None] + 2 * r + _SLACK)
                ok &= near[:, None] - cos <= r * apart[own] + _SLACK
                ok[np.arange(len(rows)), own] = True
                i, c = np.nonzero(ok)
                at.append(rows[i])
                cells.append(c)
            take = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
            out = batch.take(take)
            cell = np.concatenate(cells).astype(np.int32) if cells else np.empty(0, np.int32)
            own = pa.array(cell == out.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*out.columns[:5], pa.array(cell), own], ["label", "dim", "unit", "rep", "n", "cell", "own"])

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes by links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _joined(cosine: float):
    """Links of one block: rows of ``side`` 0 are the cell's own, rows of side 1 all it was sent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table["dim"][0].as_py()
        side = table["side"].to_numpy()
        rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
        unit = _matrix(table["unit"], dim)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right[np.argsort(rep[right], kind="stable")]
        count, roots = np.zeros(len(left), np.int64), rep[right].copy()
        place = np.arange(len(right))
        for k in range(0, len(left), 1024):
            near = unit[left[k : k + 1024]] @ unit[right].T >= cosine
            count[k : k + 1024] = near @ n[right]
            # the neighbours of one vector are linked with each other through it
            i, j = np.nonzero(near)
            if len(i):
                new = np.append(True, i[1:] != i[:-1])
                first = j[new][np.cumsum(new) - 1]
                # each row stays linked to its label from earlier chunks
                place = _least(len(right), np.concatenate((first, np.arange(len(right)))), np.concatenate((j, place)))
        # a vector of the cell is one of those that were sent to it, or of another block
        ends = [rep[right], rep[right[place]]]
        seen = np.isin(rep[left], rep[right])
        if not seen.all():
            lone = left[~seen]
            near = unit[lone] @ unit[right].T >= cosine
            some = near.any(axis=1)
            ends = [np.concatenate((ends[0], rep[lone[some]])), np.concatenate((ends[1], rep[right[near[some].argmax(axis=1)]]))]
        moved = ends[0] != ends[1]
        a = np.concatenate((rep[left], ends[0][moved]))
        b = pa.array(np.concatenate((np.zeros(len(left), np.int64), ends[1][moved])), mask=np.arange(len(a)) < len(left))
        linked = np.concatenate((count, np.zeros(int(moved.sum()), np.int64)))
        return pa.table({"rep": a, "other": b, "linked": linked})

    return run


def range_links(folded: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(rep, other, linked) of distinct unit vectors (label, dim, unit, rep, n).

    Rows with a null ``other`` hold a part of the number of vectors (copies and itself included)
    linked with ``rep``; the others are links that connect the same vectors as all links do.
    """
    spark = folded.sparkSession
    r = float(np.sqrt(2 - 2 * cosine))
    total = folded.count()
    share = min(1 / cell_rows, pivots / max(total, 1))
    picked = folded.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < int(share * (1 << 40))).select("label", "dim", "unit", "rep")
    by_key: dict[tuple, list] = {}
    for row in sorted(picked.orderBy(F.xxhash64("rep")).limit(2 * pivots).collect(), key=lambda x: x.rep):
        by_key.setdefault((row.label, row.dim), []).append(np.frombuffer(row.unit, np.float64))
    by_key = {k: np.stack(v) for k, v in by_key.items()}
    homes = saved(folded.select("label", "dim", "unit", "rep", "n").mapInArrow(_homes(by_key), f"{_schema(folded)}, home int, far double"), "homes")
    # at most a row for each pivot, however many labels there are
    sizes = homes.where("home >= 0").groupBy("label", "dim", "home").agg(F.max("far").alias("far")).collect()
    radius = {(s.label, s.dim, s.home): s.far for s in sizes}
    members = homes.mapInArrow(_members(by_key, radius, r), f"{_schema(folded)}, cell int, own boolean")
    members = saved(members, "members")
    counts = members.groupBy("label", "dim", "cell").agg(F.ceil(F.sum(F.col("own").cast("long")) / block).alias("lefts"), F.ceil(F.count("*") / block).alias("rights"))
    placed = members.join(counts, ["label", "dim", "cell"])
    spot = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    keep = ["label", "dim", "cell", "unit", "rep", "n"]
    left = placed.where("own").select(*keep, spot("lefts", 1).alias("i"), every("rights").alias("j"), F.lit(0).alias("side"))
    right = placed.select(*keep, every("lefts").alias("i"), spot("rights", 2).alias("j"), F.lit(1).alias("side"))
    return left.union(right).groupBy("label", "dim", "cell", "i", "j").applyInArrow(_joined(cosine), "rep long, other long, linked long")


def _schema(folded: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in folded.select("label", "dim", "unit", "rep", "n").dtypes)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS, block: int = BLOCK,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors of equal labels link at ``cosine`` and above. Null, empty and zero vectors, vectors
    with null or non-finite components, and rows with a null id or label link with nothing;
    they are their own component. Vectors of different lengths never link. Equal vectors are
    folded before the join; nodes are hashes of label and vector, so rows that share an id count
    as vectors of their own, and a component has the least id of its rows. Other columns are ignored; an
    empty table gives no rows.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = kept.schema[1].dataType.simpleString()
    units = saved(kept.mapInArrow(_units, f"id long, label {kind}, dim int, unit binary"), "units")
    folded = units.where("unit is not null").groupBy("label", "dim", "unit").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    folded = saved(folded.withColumn("rep", F.xxhash64("label", "dim", "unit")), "folded")
    links = saved(range_links(folded, cosine, cell_rows, pivots, block), "links")
    known = components(links.where("other is not null"), "rep", "other")
    linked = links.where("other is null").groupBy("rep").agg((F.sum("linked") - 1).alias("n_links"))
    classes = folded.join(linked, "rep").join(known, folded.rep == known.node, "left")
    classes = classes.select("label", "dim", "unit", "low", "n_links", F.coalesce("component", "rep").alias("component"))
    least = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    out = units.where("unit is not null").join(classes.join(least, "component"), ["label", "dim", "unit"]).select("id", "n_links", "component_id")
    alone = units.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
