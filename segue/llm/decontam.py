"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.text import chunks, run_hash, text_bytes

#: Characters in a q-gram; an item is searched for in parts of about PART characters, each within EDITS of its length.
Q, PART, EDITS = 10, 100, 0.08
#: Shared q-grams that a region needs at least; a short part's edit budget is lowered until it does.
SHARED = 4
#: Length and stride of the overlapping windows that find excerpts: one of WINDOW + STRIDE - 1 characters holds a window.
WINDOW, STRIDE = 50, 12
#: Shorter items are found by exact match alone; those without a q-gram as whole words.
LEAST = 32
#: Characters of benchmark text that are searched for in one pass over the documents.
BLOCK = 2_000_000

_U = np.uint64
_BITS = 22
_STEP = 1 << 20
_GAP = np.uint32(0xFFFFFFFF)
#: Length-preserving folding of characters: lower case, white space and NUL to a blank.
_FOLD = np.array([32 if chr(c).isspace() or c == 0 else ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x3000)], np.uint32)


def fold(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < len(_FOLD), _FOLD[np.minimum(code, len(_FOLD) - 1)], code)


class Index:
    """q-grams of the parts and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.part, self.code, self.budget = [], [], [], []
        for item, text in items:
            code = fold(text)
            if (code == 32).all():
                continue
            n = max(1, round(len(code) / PART))
            cuts = [(len(code) * k // n, len(code) * (k + 1) // n) for k in range(n)]
            if len(code) >= WINDOW + STRIDE:
                cuts += [(a, a + WINDOW) for a in (*range(0, len(code) - WINDOW, STRIDE), len(code) - WINDOW)]
            for k, (a, b) in enumerate(cuts):
                self.item.append(item)
                self.part.append(k)
                self.code.append(code[a:b])
                self.budget.append(max(0, min(int(EDITS * (b - a)), (b - a - Q + 1 - SHARED) // Q)) if len(code) >= LEAST else 0)
        self.length = np.array([len(c) for c in self.code], np.int64)
        self.budget = np.array(self.budget, np.int64)
        self.need = self.length - Q + 1 - Q * self.budget
        self.tiny = np.flatnonzero(self.length < Q)
        grams = [run_hash(c.astype(np.uint64), Q) for c in self.code]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(self.begin, len(flat))
        self.of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.gram >> _U(64 - _BITS)] = True

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, part entry) of each q-gram of ``code`` that some part has."""
        where, entry = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, max(0, len(code) - Q + 1), _STEP):
            gram = run_hash(code[a : a + _STEP + Q - 1].astype(np.uint64), Q)
            at = np.flatnonzero(self.maybe[gram >> _U(64 - _BITS)])
            k = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
            same = self.gram[k] == gram[at]
            at, k = at[same], k[same]
            n = self.begin[k + 1] - self.begin[k]
            where.append(np.repeat(at + a, n))
            entry.append(np.repeat(self.begin[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        return np.concatenate(where), np.concatenate(entry)

    def regions(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, part entry, start, stop, edits) of the verified regions of texts ``code[begin:end]``.

        Regions of one part in one text don't overlap; the one of fewer edits stays.
        """
        kept = list(self.words(code, begin))
        pos, entry = self.hits(code) if len(self.gram) else (np.empty(0, np.int64), np.empty(0, np.int64))
        of, diag = self.of[entry], pos - self.at[entry]
        text = np.searchsorted(begin, pos, "right") - 1
        stride = self.budget[of] + 1
        band = diag // stride
        keys = np.stack((np.tile(text, 2), np.tile(of, 2), np.concatenate((band, band - 1))))
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)) if len(order) else np.empty(0, bool)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        text, of, band = keys[:, first][:, count >= self.need[keys[1, first]]]
        for a in range(0, len(text), 512):
            kept += self.align(code, begin, end, text[a : a + 512], of[a : a + 512], band[a : a + 512])
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, p, start, stop, edits in sorted(kept, key=lambda r: (r[4], r[2])):
            have = best.setdefault((t, p), [])
            if all(stop <= s or start >= e for s, e, _ in have):
                have.append((start, stop, edits))
        return sorted((t, p, *r) for (t, p), rs in best.items() for r in rs)

    def words(self, code: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Exact matches of items without a q-gram, as whole words."""
        for p in self.tiny.tolist():
            own = self.code[p]
            at = np.flatnonzero(code[: max(0, len(code) - len(own) + 1)] == own[0])
            for k in range(1, len(own)):
                at = at[code[at + k] == own[k]]
            for a in at.tolist():
                t = int(np.searchsorted(begin, a, "right")) - 1
                ends = [x for x in (a - 1, a + len(own)) if 0 <= x < len(code) and code[x] != _GAP]
                if not any(chr(code[x]).isalnum() for x in ends):
                    yield t, p, a - int(begin[t]), a + len(own) - int(begin[t]), 0

    def align(self, code, begin, end, text, of, band) -> Iterator[tuple[int, int, int, int, int]]:
        """Edit distance of whole parts to any stretch of text inside their bands, all candidates at once.

        Column c of row i stands for i letters of the part against a stretch that ends at letter
        i + base + c. A cell holds cost * 2**16 + the column where its stretch began.
        """
        size, budget = self.length[of], self.budget[of]
        width = 2 * (budget + 1)
        base = band * (budget + 1)
        rows, cols = int(size.max()), int(width.max())
        part = np.zeros((len(of), rows), np.uint32)
        for k, o in enumerate(of):
            part[k, : size[k]] = self.code[o]
        at = base[:, None] + np.arange(rows + cols)
        inside = (at >= begin[text][:, None]) & (at < end[text][:, None])
        around = np.where(inside, code[np.clip(at, 0, len(code) - 1)], _GAP)
        one, far = 1 << 16, 1 << 40
        col = np.arange(cols)
        own = col < width[:, None]
        cell = np.where(own, col, far) + np.zeros((len(of), 1), np.int64)
        last = cell.copy()
        for i in range(rows):
            step = cell + one * (part[:, i, None] != around[:, i : i + cols])
            step[:, :-1] = np.minimum(step[:, :-1], cell[:, 1:] + one)
            step = np.minimum.accumulate(np.where(own, step, far) - one * col, axis=1) + one * col
            cell = np.where(own, step, far)
            last = np.where((size == i + 1)[:, None], cell, last)
        best = last.argmin(axis=1)
        value = last[np.arange(len(of)), best]
        for k in np.flatnonzero(value // one <= budget):
            t, start, stop = int(text[k]), int(base[k] + value[k] % one), int(base[k] + size[k] + best[k])
            yield t, int(of[k]), max(start, int(begin[t])) - int(begin[t]), min(stop, int(end[t])) - int(begin[t]), int(value[k] // one)


def _regions(index: Index, column: pa.Array) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Regions of the texts of a column, by chunk; texts are numbered through the column."""
    data, off = text_bytes(column)
    raw = memoryview(data)
    for i, j in chunks(off):
        codes = [fold(str(raw[off[k] : off[k + 1]], "utf-8")) for k in range(i, j)]
        size = np.array([len(c) for c in codes])
        end = np.cumsum(size + 1) - 1
        code = np.concatenate([v for c in codes for v in (c, np.array([_GAP]))])
        yield [(t + i, *rest) for t, *rest in index.regions(code, end - size, end)]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> Iterator[Index]:
    """Indexes of blocks of about ``block`` characters of the benchmark: what travels to the tasks is bounded."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total * (1 + -(-WINDOW // STRIDE)) // block))  # each character is in a part and in some windows
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield Index(sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, part, start, stop, edits): every region of a text that holds a part or a window of a benchmark item.

    Items are searched for in parts of about 100 characters, in any case and with any kind of
    white space, within 8 % edits (the parts of one item are numbered from 0), and in overlapping
    windows of 50 characters every 12 within 3 edits, numbered after the parts: a verbatim
    excerpt of 61 characters is found wherever it begins. Items of up to 61 characters are
    searched for as a whole, under 32 by exact match, and under 10 as whole words. Offsets count
    characters of the whole text. Blank, empty and null items are not searched for; null and empty texts have no region. Repeated rows and repeated items give repeated
    regions; null ids stay null; other columns are ignored; empty tables give no rows. One pass
    over the documents for each block of the benchmark, without a shuffle.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kept.schema[0].dataType.simpleString()}, item_id long, part long, start long, stop long, edits long"
    out = None
    for index in blocks(benchmark, block=block):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in _regions(index, batch.column(1)):
                    t, p, *rest = ([list(c) for c in zip(*found)] or [[]] * 5)
                    cols = [batch.column(0).take(pa.array(t, pa.int64())), *(pa.array(v, pa.int64()) for v in ([index.item[x] for x in p], [index.part[x] for x in p], *rest))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "part", "start", "stop", "edits"])

        part = kept.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no part of a benchmark item."""
    for index in blocks(benchmark, block=block):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for found in _regions(index, batch.column(batch.schema.get_field_index(text_col))):
                    keep[[r[0] for r in found]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
