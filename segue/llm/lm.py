"""LM scoring: cross-entropy difference of two matched n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.text import LETTERS, LOWER, chunks, hashes, pair_hash, spans, text_bytes

#: Slots of the shared vocabulary and of pairs; the models take 24 MB as they travel to the tasks.
WORDS, PAIRS = 1 << 19, 1 << 21
#: Share of the pair estimate in a token's probability, and pseudo-counts of a vocabulary slot.
MIX, SMOOTH = 0.7, 0.5
#: Slots of counts that travel as one row.
PART = 1 << 15

_U = np.uint64


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, vocabulary slot, pair slot) of each token: letters and digits, lower-cased in A-Z.

    The first token of a text forms a pair with the text's start.
    """
    data = LOWER[data]
    starts, ends, first = spans(data, off, LETTERS)
    h = hashes(data, starts, ends)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return text, (h % _U(WORDS)).astype(np.int64), (pair_hash(before, h, 3) % _U(PAIRS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, in rows (model, part, counts). Column 1 tells rows of the target."""
    count = [np.zeros(WORDS + PAIRS, np.int64) for _ in range(2)]
    seen = [False, False]
    for batch in batches:
        data, off = text_bytes(batch.column(0))
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in chunks(off):
            text, word, pair = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            chosen = target[i:j][text]
            for k, some in ((0, slice(None)), (1, chosen)):
                own = word[some]
                if len(own):
                    seen[k] = True
                    count[k] += np.bincount(np.concatenate((own, pair[some] + WORDS)), minlength=WORDS + PAIRS)
    for k in range(2):
        parts = range(0, (WORDS + PAIRS) if seen[k] else 0, PART)
        values = [_narrow(count[k][a : a + PART]) for a in parts]
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), pa.array([a // PART for a in parts], pa.int32()), pa.array(values, pa.binary())], ["model", "part", "counts"])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them, the width first."""
    width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each (model, part)."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for model, part, packed in zip(*(c for c in (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))):
            key = (model, part)
            total[key] = total[key] + _wide(packed.as_py()) if key in total else _wide(packed.as_py())
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([_narrow(total[k]) for k in keys], pa.binary())], ["model", "part", "counts"])


def models(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Counts (model, slot) over all rows of ``docs`` (model 0) and over those whose id is in ``target`` (model 1).

    Every token of every row counts. Texts are dealt by id once, at every size, to meet the ids of
    the target, which grow with the labels and are never broadcast. Tasks send their counts in parts of fixed width, one row a
    part; the result has a fixed size, whatever the number of rows.
    """
    wanted = target.select(F.col(id_col).alias("want")).where("want is not null").distinct()
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = kept.join(wanted.hint("merge"), kept.id == wanted.want, "left").select("text", F.col("want").isNotNull().alias("chosen"))
    schema = "model int, part int, counts binary"
    added = kept.mapInArrow(_counted, schema).repartition("model", "part").mapInArrow(_added, schema)
    out = np.zeros((2, WORDS + PAIRS), np.int64)
    for row in added.toLocalIterator():
        out[row.model, row.part * PART : (row.part + 1) * PART] = _wide(bytes(row.counts))
    return out


def losses(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per model: probability of each vocabulary slot, and for pairs the counts; both as 32-bit values."""
    words = count[:, :WORDS] + SMOOTH
    return (words / words.sum(axis=1, keepdims=True)).astype(np.float32), count[:, WORDS:].astype(np.float32)


def score(docs: DataFrame, count: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) for every row of ``docs``.

    A token's probability mixes the share of its pair among the pairs of the word before it with
    the share of its vocabulary slot. Losses are mean bits a token; score is loss_target minus
    loss_background, so the lower the more like the target. Texts without tokens, null ones among
    them, have no losses and score 0.
    """
    single, pairs = losses(count)
    context = count[:, :WORDS].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            n, loss = [np.empty(0, np.int64)], [[np.empty(0)], [np.empty(0)]]
            for i, j in chunks(off):
                text, word, pair = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                size = np.bincount(text, minlength=j - i)
                n.append(size)
                head = np.ones(len(text), bool)
                head[1:] = text[1:] != text[:-1]
                for k in range(2):
                    before = np.empty(len(word), np.float32)
                    before[1:] = context[k, word[:-1]]
                    before[head] = np.inf  # the start of a text: the vocabulary share alone
                    p = MIX * np.minimum(pairs[k, pair] / np.maximum(before, 1), 1) + (1 - MIX) * single[k, word]
                    p = np.where(head, single[k, word], p)
                    loss[k].append(np.bincount(text, -np.log2(p.astype(np.float64)), j - i) / np.maximum(size, 1))
            n, (bg, tg) = np.concatenate(n), (np.concatenate(x) for x in loss)
            none = n == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(tg, mask=none), pa.array(bg, mask=none), pa.array(np.where(none, 0.0, tg - bg))],
                                             ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema[0].dataType.simpleString()}, n_tokens long, loss_target double, loss_background double, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cross-entropy difference of every row of ``docs``; the target are the rows that ``labels`` marks as good (quality 1).

    Null ids are no targets; an id is a target if any of its labels is 1. Repeated rows count
    and come back as often; an empty table gives no rows.
    """
    return score(docs, models(docs, labels.where("quality = 1").select("doc_id")))
