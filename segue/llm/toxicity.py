"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.labels import sample
from segue.llm.text import LETTERS, LOWER, chunks, hashes, pair_hash, spans, text_bytes

#: Slots of the hashed weights, so 8 MB at most travel to each task.
SLOTS = 1 << 20
#: Labelled rows to learn from at most (those of least hash), and passes over them.
FIT_ROWS, PASSES = 12_000, 3
#: Rate, smoothing and penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
#: Score from which a document counts as toxic.
THRESHOLD = 0.3


def slots(data: np.ndarray, off: np.ndarray, n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each word, pair of neighbours and pair with one word between, lower-cased in A-Z."""
    data = LOWER[data]
    starts, ends, first = spans(data, off, LETTERS)
    h = hashes(data, starts, ends)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    keys, texts = [h], [text]
    for gap in (1, 2):
        same = text[gap:] == text[:-gap]
        keys.append(pair_hash(h[:-gap], h[gap:], gap)[same])
        texts.append(text[gap:][same])
    return np.concatenate(texts), (np.concatenate(keys) % np.uint64(n_slots)).astype(np.int64)


def distinct(text: np.ndarray, slot: np.ndarray, n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Each slot once for each text, in order of texts."""
    both = np.unique(text * n_slots + slot)
    return both // n_slots, both % n_slots


class Ftrl:
    """Per-coordinate FTRL-proximal steps on documents of binary features; slot 0 also holds the bias."""

    def __init__(self, n_slots: int = SLOTS):
        self.z, self.n = np.zeros(n_slots), np.zeros(n_slots)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        was = self.n[at]
        self.n[at] = was + g * g
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / ALPHA * w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, label, slots) of each sampled row."""
    for batch in batches:
        data, off = text_bytes(batch.column(2))
        packed: list[bytes] = []
        for i, j in chunks(off):
            text, slot = distinct(*slots(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            cut = np.searchsorted(text, np.arange(j - i + 1))
            packed += [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["nth", "label", "slots"])


def learn(rows: list[tuple[int, np.ndarray]], passes: int = PASSES) -> Ftrl:
    model = Ftrl()
    for _ in range(passes):
        for label, at in rows:
            model.step(np.append(at, 0) if not len(at) or at[0] else at, label)
    return model


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += [(n, y, np.frombuffer(s, np.int32)) for n, y, s in zip(*(c.to_pylist() for c in batch.columns))]
    model = learn([(y, s) for _, y, s in sorted(rows, key=lambda r: r[0])])
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "weight"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from at most ``fit_rows`` labelled rows, taken in order of the hash of their ids.

    ``labels`` holds doc_id and ``label_col`` (0 or 1); null ids or labels don't count, and an id
    with both labels has label 1. Without labelled rows all weights are zero. Features are made in
    parallel; the bounded sample of slots is learnt from in one task.
    """
    rows = sample(docs, labels, label_col, fit_rows).mapInArrow(_featured, "nth long, label int, slots binary")
    got = rows.repartition(1).mapInArrow(_learn, "slot long, weight double").toPandas()
    w = np.zeros(SLOTS)
    w[got.slot.to_numpy(np.int64)] = got.weight.to_numpy(float)
    return w


def _scorer(weights: np.ndarray):
    """Function from an Arrow column of texts to their scores; only nonzero weights travel."""
    used = np.flatnonzero(weights)
    value = weights[used].astype(np.float32)

    def open_() -> Callable[[pa.Array], np.ndarray]:
        w = np.zeros(SLOTS, np.float32)
        w[used] = value

        def of(column: pa.Array) -> np.ndarray:
            data, off = text_bytes(column)
            out = [np.empty(0)]
            for i, j in chunks(off):
                text, slot = slots(data[off[i] : off[j]], off[i : j + 1] - off[i])
                some = (w[slot] != 0) & (slot != 0)
                text, slot = distinct(text[some], slot[some])
                out.append(sigmoid(w[0] + np.bincount(text, w[slot], j - i)))
            return np.concatenate(out)

        return of

    return open_


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``. Null and empty texts get the bias alone. One pass, no shuffle."""
    scorer = _scorer(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1)))], ["id", "score"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema[0].dataType.simpleString()}, score double")


def clean(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    scorer = _scorer(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(batch.schema.get_field_index(text_col))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2; rows of the remainder
    2 are held out. held_out is null for a null doc_id. Repeated rows come back as often.
    """
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    weights = fit(docs, labels.where(~out))
    scored = score(docs, weights).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
