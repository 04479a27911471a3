"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by class log-count ratios; a linear hinge-loss model is fitted
to the scaled, length-normalised rows by dual coordinate descent; a logistic curve turns
margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.labels import sample
from segue.llm.text import SIGNS, chunks, hashes, pair_hash, spans, text_bytes

#: Slots of the hashed n-grams, so 2 MB of weights travel to each task.
SLOTS = 1 << 18
#: Labelled rows to learn from at most (those of least hash); every fifth sets the score curve.
FIT_ROWS, CURVE_EVERY = 12_000, 5
#: Smoothing of the counts, cost of the hinge loss, passes over the rows.
SMOOTH, COST, PASSES = 1.0, 1.0, 10
#: Lengths of runs of one word that are indicators whatever the word is.
RUNS = (3, 4, 8)
#: Score from which a document counts as good.
THRESHOLD = 0.3


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot), each once: words, runs of signs and neighbouring pairs of them, case kept, and runs of one word."""
    starts, ends, first = spans(data, off, SIGNS)
    h = hashes(data, starts, ends)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    same = text[1:] == text[:-1]
    pairs = pair_hash(h[:-1], h[1:], 1)[same]
    equal = np.concatenate(([0], np.cumsum((h[1:] == h[:-1]) & same)))
    runs = [text[n - 1 :][equal[n - 1 :] - equal[: 1 - n] == n - 1] if len(h) >= n else text[:0] for n in RUNS]
    slot = (np.concatenate((h, pairs, np.repeat(np.array(RUNS, np.uint64), [len(r) for r in runs]))) % np.uint64(SLOTS)).astype(np.int64)
    both = np.unique(np.concatenate((text, text[1:][same], *runs)) * SLOTS + slot)
    return both // SLOTS, both % SLOTS


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column(2))
        packed: list[bytes] = []
        for i, j in chunks(off):
            text, slot = indicators(data[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(text, np.arange(j - i + 1))
            packed += [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["nth", "label", "slots"])


def ratios(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Log ratio of the smoothed shares of each slot in the good and in the other rows."""
    count = np.full((2, SLOTS), SMOOTH)
    for label, at in rows:
        count[label, at] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def descend(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and bias, by dual coordinate descent on the hinge loss."""
    w, bias = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(rows))
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    x = [scaled(ratio, at) for _, at in rows]
    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, v = rows[i][1], x[i]
            square = 1.0 + float(len(at) > 0)
            gradient = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square, 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def scaled(ratio: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = ratio[at]
    return v / max(np.sqrt(v @ v), 1e-9)


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by damped Newton steps."""
    a, b = 1.0, 0.0
    if not len(margin):
        return a, b
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (label - p) - 1e-3 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def learn(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios, weights and (bias, slope, shift)."""
    fit = [r for k, r in enumerate(rows) if k % CURVE_EVERY] or rows
    rest = rows[::CURVE_EVERY]
    ratio = ratios(fit)
    w, bias = descend(fit, ratio)
    margin = np.array([w[at] @ scaled(ratio, at) + bias for _, at in rest])
    slope, shift = curve(margin, np.array([label for label, _ in rest], float))
    return ratio, w, np.array([bias, slope, shift])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += [(n, y, np.frombuffer(s, np.int32)) for n, y, s in zip(*(c.to_pylist() for c in batch.columns))]
    if rows:
        ratio, w, rest = learn([(y, s) for _, y, s in sorted(rows, key=lambda r: r[0])])
        yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float64).tobytes() for v in (ratio, w, rest)], pa.binary()), pa.array([0, 1, 2])], ["v", "k"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model from at most ``fit_rows`` labelled rows, taken in order of the hash of their ids.

    Null ids or labels don't count, and an id with both labels has label 1. Without labelled rows
    every score is 0.5.
    """
    rows = sample(docs, labels, label_col, fit_rows).mapInArrow(_featured, "nth long, label int, slots binary")
    got = rows.repartition(1).mapInArrow(_learn, "v binary, k long").collect()
    if not got:
        return np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(3)
    return tuple(np.frombuffer(r.v, np.float64) for r in sorted(got, key=lambda r: r.k))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``. Null and empty texts get the bias alone. One pass, no shuffle."""
    ratio, weight, (bias, slope, shift) = model[0].astype(np.float32), model[1].astype(np.float32), model[2].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, square = ratio * weight, ratio * ratio
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            out = [np.empty(0)]
            for i, j in chunks(off):
                text, slot = indicators(data[off[i] : off[j]], off[i : j + 1] - off[i])
                size = np.maximum(np.sqrt(np.bincount(text, square[slot], j - i)), 1e-9)
                margin = np.bincount(text, product[slot], j - i) / size + bias
                out.append(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["id", "score"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema[0].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0; rows of the remainder
    0 are held out. held_out is null for a null doc_id. Repeated rows come back as often.
    """
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = score(docs, fit(docs, labels.where(~out))).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
