"""Substring dedup: windows of words travel as super-k-mers to the bucket of their minimiser."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.store import saved
from segue.llm.text import WORDS, chunks, hashes, run_hash, text_bytes

#: Words in a window and in the gram whose least hash places it.
WINDOW, GRAM = 13, 4
#: Bytes of text whose super-k-mers are folded and packed together.
FLUSH = 4 << 20
#: Bytes of packed strings, before compression, that a bucket is to hold.
BUCKET_BYTES = 8 << 20
#: Occurrences of one string in a flush beyond which they wait for its answer instead of travelling with it.
RIDERS = 64
#: Minimisers with this share of all super-k-mers are placed window by window; so there are a million at most.
HEAVY_SHARE, HEAVY_LEAST = 1e-6, 100_000

_U = np.uint64


def _run_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    size, part = 1, g
    while size * 2 <= width:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    n = len(g) - width + 1
    return np.minimum(part[:n], part[width - size : width - size + n])


class _Words:
    """Words of some texts, joined by single spaces, with the number of words before each text."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        word = WORDS[raw] == 1
        keep = word.copy()
        keep[1:] |= word[:-1]  # one blank after each word
        data = np.where(word, raw, 32)[keep][:-1].astype(np.uint8)
        self.line = data.tobytes()
        gaps = np.flatnonzero(data == 32)
        self.starts = np.concatenate(([0], gaps + 1)) if len(data) else gaps
        self.ends = np.concatenate((gaps, [len(data)])) if len(data) else gaps
        ended = np.flatnonzero(keep & ~word)  # the blank after each word
        self.first = np.searchsorted(ended, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.hash = hashes(data, self.starts, self.ends)


def _super_kmers(words: _Words, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: text, first word, windows, minimiser, all by run.

    Windows whose minimiser is heavy are runs of their own and are placed by their own hash.
    """
    n = np.diff(words.first)
    most = len(words.hash) - WINDOW + 1
    if most <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    least = _run_min(run_hash(words.hash, GRAM), WINDOW - GRAM + 1)
    valid = np.zeros(most, bool)
    for a, k in zip(words.first, n):
        if k >= WINDOW:
            valid[a : a + k - WINDOW + 1] = True
    at = np.flatnonzero(valid)
    least = least[at]
    alone = np.zeros(len(at), bool)
    if len(heavy) and len(at):
        alone = heavy[np.minimum(np.searchsorted(heavy, least), len(heavy) - 1)] == least
        least[alone] = run_hash(words.hash, WINDOW)[at[alone]]
    text = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | alone[1:]
    begin = np.flatnonzero(new)
    return text[begin], at[begin], np.diff(np.append(begin, len(at))), least[begin]


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, base, texts) of up to FLUSH bytes; a longer text comes alone."""
    for batch in batches:
        data, off = text_bytes(batch.column(2))
        doc, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        raw = memoryview(data)
        for i, j in chunks(off, FLUSH):
            yield doc[i:j], base[i:j], [bytes(raw[off[k] : off[k + 1]]) for k in range(i, j)]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per flush: the minimisers of many super-k-mers, and in a row without one the totals."""
    none = np.empty(0, np.uint64)
    for _, _, texts in _flushes(batches):
        words = _Words(texts)
        _, at, count, least = _super_kmers(words, none)
        size = int((words.ends[at + count + WINDOW - 2] - words.starts[at]).sum()) if len(at) else 0
        value, times = np.unique(least, return_counts=True)
        often = times >= 16
        cols = [np.append(value[often].view(np.int64), 0), np.append(times[often], len(at)), np.append(np.zeros(often.sum(), np.int64), size)]
        keys = pa.array(cols[0], mask=np.append(np.zeros(often.sum(), bool), True))
        yield pa.RecordBatch.from_arrays([keys, pa.array(cols[1]), pa.array(cols[2])], ["minimiser", "n", "bytes"])


_PACKED = "bucket int, kind int, text binary, docs binary, at binary, which binary, hot binary"


def _packer(buckets: int, heavy: np.ndarray):
    """Rows by bucket: folded strings and who has them; long lists of holders wait in rows of any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for doc, base, texts in _flushes(batches):
            words = _Words(texts)
            text, at, count, least = _super_kmers(words, heavy)
            bucket = (least % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            text, at, count, bucket = text[order], at[order], count[order], bucket[order]
            line = words.line
            strings = [line[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at + count + WINDOW - 2].tolist())]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            rows: list[tuple] = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                known: dict[bytes, int] = {}
                which = np.array([known.setdefault(s, len(known)) for s in strings[lo:hi]], np.int32)
                own = doc[text[lo:hi]]
                where = base[text[lo:hi]] + at[lo:hi] - words.first[text[lo:hi]]
                hot = np.flatnonzero(np.bincount(which) > RIDERS)
                if len(hot):
                    names, stay = list(known), np.ones(len(which), bool)
                    for h in hot.tolist():
                        mine = np.flatnonzero(which == h)
                        stay[mine] = False
                        stay[mine[np.argmin(own[mine])]] = True
                        rows.append((int(own[mine[0]]) % buckets, 1, names[h], own[mine].tobytes(), where[mine].tobytes(), b"", b""))
                    which, own, where = which[stay], own[stay], where[stay]
                rows.append((int(bucket[lo]), 0, zip_(b"\n".join(known)), zip_(own.tobytes()), zip_(where.tobytes()), zip_(which.tobytes()), hot.astype(np.int32).tobytes()))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bucket", "kind", "text", "docs", "at", "which", "hot"])

    return run


_FOUND = "kind int, doc long, start long, stop long, text binary, docs array<long>, at array<long>, least array<long>"


def _found(kind: int, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    many = pa.list_(pa.int64())
    kinds = {"doc": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "text": pa.binary(), "docs": many, "at": many, "least": many}
    data = [pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *data], ["kind", *kinds])


def _judge_bucket(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Sort the windows of one bucket; ranges of words to remove, and answers for waiting holders."""
    unzip = zstandard.ZstdDecompressor().decompress
    lines, docs, ats, of, hots, n = [], [], [], [], [], 0
    for text, own, at, which, hot in parts:
        lines.append(unzip(text).split(b"\n"))
        docs.append(np.frombuffer(unzip(own), np.int64))
        ats.append(np.frombuffer(unzip(at), np.int64))
        of.append(np.frombuffer(unzip(which), np.int32).astype(np.int64) + n)
        hots.append(np.frombuffer(hot, np.int32).astype(np.int64) + n)
        n += len(lines[-1])
    strings = [s for part in lines for s in part]
    doc, at, of, hot = np.concatenate(docs), np.concatenate(ats), np.concatenate(of), np.concatenate(hots)
    words = _Words(strings)
    first = words.first
    count = np.diff(first) - WINDOW + 1  # windows of each string
    begin = np.cumsum(count) - count
    window = np.repeat(first[:-1] - begin, count) + np.arange(int(count.sum()))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    least = np.repeat(least, count)
    key = run_hash(words.hash, WINDOW)[window]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] |= key[1:] == key[:-1]
    same[:-1] |= key[1:] == key[:-1]
    again = order[same]  # windows whose hash occurs more than once; their words decide
    known: dict[bytes, int] = {}
    line, low = words.line, least[again].tolist()
    text = [line[a:b] for a, b in zip(words.starts[window[again]].tolist(), words.ends[window[again] + WINDOW - 1].tolist())]
    for s, d in zip(text, low):
        if known.setdefault(s, d) > d:
            known[s] = d
    least[again] = [known[s] for s in text]
    which = np.repeat(np.arange(len(of)), count[of])  # one entry for each window of each holder
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count[of]) - count[of], count[of])
    gone = np.flatnonzero(least[begin[of][which] + nth] < doc[which])
    if len(gone):
        new = np.ones(len(gone), bool)
        new[1:] = (np.diff(gone) != 1) | (which[gone[1:]] != which[gone[:-1]])
        a = gone[new]
        length = np.diff(np.append(np.flatnonzero(new), len(gone)))
        start = at[which[a]] + nth[a]
        yield _found(0, doc=doc[which[a]], start=start, stop=start + length - 1 + WINDOW)
    asked = {strings[h]: h for h in hot.tolist()}
    if asked:
        yield _found(2, text=list(asked), least=[least[begin[h] : begin[h] + count[h]].tolist() for h in asked.values()])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 1:
                yield _found(1, text=[r["text"]], docs=[np.frombuffer(r["docs"], np.int64).tolist()], at=[np.frombuffer(r["at"], np.int64).tolist()])
            else:
                held.setdefault(r["bucket"], []).append((r["text"], r["docs"], r["at"], r["which"], r["hot"]))
    for bucket in list(held):
        yield from _judge_bucket(held.pop(bucket))


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that less of them goes through the last join."""
    zip_ = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    for batch in batches:
        data, off = text_bytes(batch.column(2))
        raw = memoryview(data)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([zip_(raw[a:b]) for a, b in zip(off[:-1], off[1:])], pa.binary())], ["doc_id", "base", "packed"])


def _strip(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Words outside the ranges of each text."""
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for doc, packed, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = unzip(packed.as_py()).split()
            n = len(words)
            if gone:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [r["start"] & 0xFFFFFFFF for r in gone], 1)
                np.add.at(edge, [r["stop"] & 0xFFFFFFFF for r in gone], -1)
                words = [w for w, out in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not out]
            kept = b" ".join(words)
            rows.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        cols = list(zip(*rows)) or [()] * 5
        kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES,
                    heavy_share: float = HEAVY_SHARE, heavy_least: int = HEAVY_LEAST, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row: texts without repeated windows.

    A word goes when a window of 13 words covers it whose word sequence also starts in a row
    with a smaller doc_id. Texts of fewer words, null and empty texts keep all. Rows with a
    null doc_id neither lose words nor make others lose any. Rows that share a doc_id don't
    affect one another; each is judged by its own text. Other columns are ignored.

    Consecutive windows with one minimiser travel as one string; equal strings of a flush are
    folded before the shuffle. A string with many holders sends one of them; the others wait
    in rows spread over all buckets and meet its answer in a join that Spark may split. Minimisers
    with more than ``heavy_share`` of all strings are placed window by window.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    twice = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        docs = docs.withColumn("base", F.lit(0).cast("long"))
    else:  # rows that share an id count their words from different bases
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long")
        apart = docs.join(twice, "doc_id", "left_semi").withColumn("base", F.shiftleft(nth, 32))
        docs = docs.join(twice, "doc_id", "left_anti").withColumn("base", F.lit(0).cast("long")).unionByName(apart)
    ours = docs.where("doc_id is not null").select("doc_id", "base", "text")
    survey = saved(ours.mapInArrow(_survey, "minimiser long, n long, bytes long").groupBy("minimiser").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "survey")
    total = survey.where("minimiser is null").first()
    n, size = (total.n, total.bytes) if total else (0, 0)
    least = max(heavy_least, int(n * heavy_share))
    heavy = np.sort(np.array([r.minimiser for r in survey.where(F.col("minimiser").isNotNull() & (F.col("n") > least)).collect()], np.int64).view(np.uint64))
    buckets = max(1, -(-size // bucket_bytes))
    packed = ours.mapInArrow(_packer(buckets, heavy), _PACKED).repartition(int(buckets), "bucket")
    found = saved(packed.mapInArrow(_judge, _FOUND), "found")
    ranges = found.where("kind = 0").select("doc", "start", "stop")
    waiting = found.where("kind = 1").select("text", "docs", "at").join(found.where("kind = 2").select("text", "least"), "text")
    waiting = waiting.select("least", F.inline(F.arrays_zip("docs", "at"))).select("docs", "at", F.posexplode("least").alias("nth", "low")).where("low < docs")
    ranges = ranges.union(waiting.select("docs", F.col("at") + F.col("nth"), F.col("at") + F.col("nth") + WINDOW))
    by_doc = ranges.groupBy("doc", F.shiftright("start", 32).alias("nth")).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    texts = docs.select("doc_id", "base", "text").mapInArrow(_shrunk, "doc_id long, base long, packed binary")
    joined = texts.join(by_doc, (texts.doc_id == by_doc.doc) & (F.shiftright(texts.base, 32) == by_doc.nth), "left")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return joined.select("doc_id", "packed", "gone").mapInArrow(lambda batches: _strip(batches, with_text), kind)
