"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in blocks.

A word is a vector of 90 letter counts. One inserted or deleted letter moves it by a squared
distance of 1, one replaced letter by 2, so the product of two blocks of vectors shows all
pairs that can be near; their letters settle which of them are. Blocks hold the words of two
adjacent lengths that agree on the counts of coarse groups of letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.store import dropped, saved

#: Runs of these letters are words; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
#: Least letters and occurrences of a word; a word's form occurs this many times as often at least.
LETTERS, TIMES, RATIO = 5, 3, 2
#: One of so many (document, run) pairs loses a letter, by its hash.
MISPRINT = 97
#: Words of a block that are compared at once with another block; a fuller bucket is cut into blocks.
BLOCK = 4096
#: Letters a verification step gathers at once.
GATHER = 1 << 22

_DIMS = 26 + 64


def _lower(run: Column) -> Column:
    return F.when(run.rlike("[A-Z]"), F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(run)


def words(docs: DataFrame, least: int = LETTERS, times: int = TIMES, misprint: int = MISPRINT) -> DataFrame:
    """(word, n): words of at least ``least`` letters that occur ``times`` and more in all texts.

    Where ``misprint`` divides the crc32 of ``doc_id:run``, the run loses the letter that the hash
    points at; 0 leaves all runs as they are. A null text has no words, a null id counts as empty text. Counts are
    summed before the shuffle, so a frequent word sends one row a task.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).select("id", _lower(F.col("run")).alias("word"))
    if misprint:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % misprint == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0..89) of all words in one array, and n + 1 offsets."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) else np.empty(0, np.uint8)
    one = data != 0xC3  # the lead byte of all letters from U+00C0 to U+00FF
    at = np.concatenate(([0], np.cumsum(one)))[off - off[0]] if len(column) else np.zeros(1, np.int64)
    data = data[one]
    return np.where(data < 128, data - 97, data - 102).astype(np.uint8), at


def _counts(letters: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Letter counts of each word, as numbers that a product keeps exact."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    counts = np.bincount(rows * _DIMS + letters, minlength=(len(off) - 1) * _DIMS).reshape(-1, _DIMS)
    return counts.astype(np.float32 if counts.max(initial=0) < 400 else np.float64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.bincount(_letters(batch.column(0))[0], minlength=_DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_DIMS)), pa.array(total)], ["letter", "n"])


def _groups(vocabulary: DataFrame, groups: int) -> np.ndarray:
    """Group of each letter, so that all groups are about as frequent. Reads 90 sums to the driver."""
    n = dict.fromkeys(range(_DIMS), 0)
    n |= {r.letter: r.n for r in vocabulary.select("word").mapInArrow(_frequencies, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    load, group = [0] * groups, np.zeros(_DIMS, np.int64)
    for letter in sorted(n, key=lambda x: (-n[x], x)):
        group[letter] = load.index(min(load))
        load[group[letter]] += n[letter]
    return group


def _cells(group: np.ndarray):
    """A row for the group counts of a word (tag -1), and one for each group it can lose a letter of (tag: the group).

    Two near words share exactly one such bucket in the right roles: both by all their letters (a letter
    replaced inside a group), one by all and the longer without a letter, or both without letters of different groups.
    """
    size = int(group.max()) + 1
    fold = np.zeros((_DIMS, size), np.float64)
    fold[np.arange(_DIMS), group] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(start, 1 << 14)
                cells = (_counts(*_letters(part.column(0))) @ fold).astype(np.int64)
                row, lost = np.nonzero(cells)
                row, tag = np.concatenate((np.arange(len(cells)), row)), np.concatenate((np.full(len(cells), -1), lost))
                keys = cells[row]
                keys[np.arange(len(row)), tag] -= tag >= 0
                keys = np.ascontiguousarray(keys & 255).astype(np.uint8).tobytes()
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(row), [None, pa.py_buffer(keys)]).cast(pa.binary())
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([key, pa.array(tag.astype(np.int16)), *out.columns], ["key", "tag", "word", "n"])

    return run


def _one_edit(letters: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by exactly one edit; their lengths differ by one at most."""
    size = np.diff(off)
    a, b = np.where(size[a] >= size[b], a, b), np.where(size[a] >= size[b], b, a)
    ok, order = np.zeros(len(a), bool), np.argsort(size[a], kind="stable")
    letters = np.append(letters, np.uint8(255))
    i = 0
    while i < len(order):
        width = int(size[a[order[i]]])
        step = max(1, GATHER // (width + 1))
        rows = order[i : i + step]
        rows = rows[size[a[rows]] == width]
        i += len(rows)
        x, y, n = a[rows], b[rows], size[b[rows]]
        at = np.arange(width)
        long = letters[off[x][:, None] + at]
        short = np.where(at < n[:, None], letters[np.minimum(off[y][:, None] + at, len(letters) - 1)], 255)
        same = n == width
        differ = long != short
        ok[rows[same]] = differ[same].sum(axis=1) == 1
        # a letter more: equal up to the first difference, equal behind it once shifted
        first = differ.argmax(axis=1)
        behind = (long[:, 1:] != short[:, :-1]) & (at[:-1] >= first[:, None])
        ok[rows[~same]] = ~behind[~same].any(axis=1)
    return ok


def _pairs(letters: np.ndarray, off: np.ndarray, tag: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of the rows ``left`` and ``right`` of a bucket; each pair once if both are the same rows."""
    x, size, twice = _counts(letters, off), np.diff(off), left is right
    square, a, b = (x * x).sum(axis=1), [], []
    for i in range(0, len(left), 2048):
        rows = left[i : i + 2048]
        apart = x[rows] @ x[right].T
        apart *= -2
        apart += square[rows][:, None]
        apart += square[right]
        p, q = np.nonzero(apart <= 2)
        p, q, d = rows[p], right[q], apart[p, q]
        keep = ((tag[p] != tag[q]) | (tag[p] < 0)) & (d == 1 + (size[p] == size[q]))
        if twice:
            keep &= p < q
        a.append(p[keep])
        b.append(q[keep])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = _one_edit(letters, off, a, b)
    return a[keep], b[keep]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a bucket its near words there: how many, and the most frequent of them."""

    def bucket(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        letters, off = _letters(rows.column("word"))
        tag, part = rows.column("tag").to_numpy(), rows.column("part").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left = np.flatnonzero(part == i)
        a, b = _pairs(letters, off, tag, left, left if i == j else np.flatnonzero(part == j))
        if not len(a):
            return None
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        word, n = rows.column("word"), rows.column("n").to_numpy()
        rank = np.empty(len(tag), np.int64)  # UTF-8 sorts by code points
        rank[pc.array_sort_indices(word.cast(pa.binary())).to_numpy()] = np.arange(len(tag))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        many = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays([word.take(pa.array(a[first])), pa.array(many), word.take(pa.array(b[first])), pa.array(n[b[first]])], ["word", "n_near", "form", "form_n"])

    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        edge = np.zeros(max(batch.num_rows - 1, 0), bool)
        for name in ("key", "i", "j"):
            edge |= pc.not_equal(batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        out = [x for s, e in zip(cuts, cuts[1:]) if e - s > 1 and (x := bucket(batch.slice(s, e - s)))]
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        rest = batch.slice(cuts[-1])
    if rest is not None and rest.num_rows > 1 and (x := bucket(rest)):
        yield x


def near_words(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) for every row of ``vocabulary`` (word, n), words distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter of RUN. A word's form
    is its most frequent near word (ties: the least by code points) if it occurs ``ratio`` times as often.
    The number of letter groups grows with the logarithm of the vocabulary, so that buckets stay small; one
    that holds over BLOCK words all the same is cut into blocks and each pair of blocks is a unit of its own.
    """
    many = vocabulary.count()
    group = _groups(vocabulary, min(_DIMS, max(1, round(0.7 * math.log2(max(many, 2)) - 5.8))))
    kind = dict(vocabulary.dtypes)["n"]
    cells = saved(vocabulary.select("word", "n").mapInArrow(_cells(group), f"key binary, tag short, word string, n {kind}"), "cells")
    full = cells.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    units = cells.join(full, "key", "left").withColumn("part", F.pmod(F.hash("word"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    units = units.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "tag", "word", "n")
    found = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared, f"word string, n_near long, form string, form_n {kind}")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    form, form_n = F.col("best.form"), -F.col("best.less")
    out = vocabulary.join(found, "word", "left")
    enough = form_n >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, form).alias("form"), F.when(enough, form_n).alias("form_n"))


def with_roots(near: DataFrame) -> DataFrame:
    """``near`` with ``root``: the last word reached from form to form, the word itself if it has none.

    Each step doubles the way a word looks ahead. Frequencies grow by RATIO at each form, so the steps are few
    whatever the size of the vocabulary.
    """
    roots = saved(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        further = saved(roots.join(ahead, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "roots")
        dropped(roots)
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text; other columns don't matter).

    Null and empty texts have no words, an empty table has no rows, repeated rows count as often as they occur.
    """
    vocabulary = saved(words(docs), "words")
    near = saved(near_words(vocabulary), "near")
    return with_roots(near).select("word", "form", "root", "n", "n_near", "form_n")
