"""Packing: vector bin packing of token pieces under several limits at once."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.text import of_worker, text_bytes

#: Limits of one sequence: tokens, segments and loss-bearing tokens.
TOKENS, SEGMENTS, LOSS_TOKENS = 1024, 256, 1024
#: Pieces among which the next one is chosen; a piece waits here until it is placed.
WAITING = 512
#: Splits of text that a worker remembers with their ids.
REMEMBERED = 300_000

#: Characters whose classes the fast splitter and the tokenizer agree on, and its split pattern.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ſ]*")
_SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _merger(file: str) -> Callable[[str], list[int]] | None:
    """Merges one split of text, several times faster than the tokenizer that reads the same file.

    It merges by the ids of results, so it is used only where the file lists every merge in the order
    of these ids; otherwise there is none.
    """
    import tiktoken

    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + n for n, (a, b) in enumerate(pairs)):
        return None
    letter = _bytes_of_letters()
    ranks = {bytes(letter[c] for c in token): n for token, n in vocab.items() if n < 256 + len(pairs)}
    if len(ranks) != 256 + len(pairs):
        return None
    return tiktoken.Encoding("splits", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Known(dict):
    """Ids of splits; a new split is merged, and remembered while there is room."""

    def __init__(self, merge: Callable[[str], list[int]]):
        super().__init__()
        self.merge = merge

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.merge(part)).tobytes()
        if len(self) < REMEMBERED and len(part) < 64:
            self[part] = ids
        return ids


class Ids:
    """Token ids of texts as unsigned 32-bit values.

    A byte-level BPE treats each split of a text apart, so ids of frequent splits are
    remembered. Texts with characters outside the plain classes, or with a special token's
    string, go to the tokenizer whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known = _Known(_merger(file) or (lambda part: self.whole.encode(part, add_special_tokens=False).ids))

    def of(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, _SPLIT.findall(text))), np.uint32)


class Packer:
    """Fills one sequence at a time with the waiting piece whose demand points most along what is left.

    Demands are (tokens, segments, loss-bearing tokens) as shares of the limits. When no waiting
    piece fits whole, the best one is cut at the sequence's end, so only the last sequence of a
    task is short.
    """

    def __init__(self, limits: tuple[int, int, int]):
        self.limit = np.array(limits, float)
        self.size = np.zeros((2 * WAITING, 2), np.int64)  # tokens, first loss-bearing token
        self.item: list = [None] * (2 * WAITING)
        self.n = 0
        self.open()
        self.number = -1

    def open(self) -> None:
        self.used, self.placed = [0, 0, 0], 0

    def add(self, tokens: int, prompt: int, item: tuple) -> None:
        """A piece whose first ``prompt`` tokens bear no loss."""
        self.size[self.n] = tokens, prompt
        self.item[self.n] = item
        self.n += 1

    def drain(self, keep: int) -> Iterator[tuple]:
        """(item, start in the piece, tokens, sequence, offset) until ``keep`` pieces wait."""
        while self.n > keep:
            left = self.limit - self.used
            if left[0] < 1 or left[1] < 1 or left[2] < 1:
                self.open()
                left = self.limit.copy()
            tokens, prompt = self.size[: self.n, 0], self.size[: self.n, 1]
            loss = tokens - prompt
            want = left / self.limit
            value = tokens * (want[0] / self.limit[0]) + want[1] / self.limit[1] + loss * (want[2] / self.limit[2])
            fits = (tokens <= left[0]) & (loss <= left[2])
            k = int(np.argmax(np.where(fits, value, -1.0)))
            take = int(tokens[k])
            if not fits[k]:
                k = int(np.argmax(tokens))  # none fits whole: the longest is cut
                take = int(min(tokens[k], left[0], prompt[k] + left[2]))
            if self.used[0] == 0:
                self.number += 1
            yield self.item[k], take, self.number, self.used[0]
            self.used = [self.used[0] + take, self.used[1] + 1, self.used[2] + max(0, take - int(prompt[k]))]
            if take < tokens[k]:
                self.size[k] = tokens[k] - take, max(0, int(prompt[k]) - take)
                first, *rest = self.item[k]
                self.item[k] = (first + take, *rest)
            else:
                self.n -= 1
                self.size[k], self.item[k] = self.size[self.n], self.item[self.n]


def pack(docs: DataFrame, tokenizer: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS_TOKENS),
         end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all texts, placed in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text becomes its ids and ``end_id``; a null or empty text is that id alone. Pieces
    are cut freely; each id lies in one piece. ``prompt_col`` names the number of leading
    tokens that bear no loss (none when null or not given). A sequence keeps within all three
    limits. Repeated rows are packed as often; null ids stay null; other columns are ignored; an
    empty table gives no rows. Tasks pack their own rows without a shuffle; each leaves at
    most one short sequence, and holds WAITING pieces and one text at a time, however
    long. ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = of_worker(f"ids:{tokenizer}", lambda: Ids(tokenizer)), Packer(limits)
        first = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def out(keep: int) -> Iterator[pa.RecordBatch]:
            for (at, doc, ids, total), take, seq, offset in packer.drain(keep):
                piece = ids[at : at + take]
                rows.append((doc, at, take, zlib.crc32(piece.tobytes()), total, first + seq, offset, piece))
                if len(rows) >= 1024:
                    yield batch_of()
            if rows and keep == 0:
                yield batch_of()

        def batch_of() -> pa.RecordBatch:
            *cols, pieces = zip(*rows)
            rows.clear()
            arrays = [pa.array(c, t) for c, t in zip(cols, [id_type, *[pa.int64()] * 6])]
            if with_ids:
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            prompts = batch.column(2).to_pylist()
            data, off = text_bytes(batch.column(1))
            raw = memoryview(data)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.append(ids_of.of(str(raw[off[i] : off[i + 1]], "utf-8")), np.uint32(end_id)).astype("<u4")
                packer.add(len(ids), min(max(prompts[i] or 0, 0), len(ids)), (0, doc, ids, len(ids)))
                if packer.n >= 2 * WAITING:
                    yield from out(WAITING)
        yield from out(0)

    prompt = F.col(prompt_col).cast("long") if prompt_col else F.lit(None).cast("long")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    kind = kept.schema[0].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return kept.mapInArrow(run, schema)
