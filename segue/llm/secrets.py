"""Secret scans: fixed patterns, and strings in sensitive context that a primed zstandard can't shorten."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.text import text_bytes

# The patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Order of kinds that start together.
KINDS = ["assign", "access", "hex", "novel"]
#: A word that makes what follows on its line sensitive, and the string that follows.
CONTEXT = re.compile(
    r"(?:passw|pwd|secret|token|key|auth|bearer|credential|private|signature|salt|cookie|session)"
    r"[^\n]{0,40}?(?<![A-Za-z0-9+/_=.~-])([A-Za-z0-9+/_=.~-]{16,})", re.I | re.A)
#: Characters before and after a candidate that prime the compressor.
AROUND = 4096
#: Compressed bytes a character from which a candidate counts as new to its surroundings.
NOVEL = 0.8
#: Identifiers of configuration and code that prime it as well.
IDENTIFIERS = (
    b"import from return class function const static public private protected string number boolean default "
    b"username password passwd secret token access_token refresh_token api_key apikey client_id client_secret "
    b"authorization bearer basic credential signature certificate session cookie private_key public_key "
    b"aws_access_key_id aws_secret_access_key connection_string database_url http:// https:// www. .com/ .org/ "
    b"0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx example EXAMPLE changeme "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in characters of the text."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def novelty(candidate: str, around: str) -> float:
    """Bytes that the candidate adds to its surroundings when compressed after them, a character."""
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS + around.replace(candidate, " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    zip_ = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return (len(zip_(candidate.encode())) - len(zip_(b""))) / len(candidate)


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates in sensitive context, apart from the known spans, that are new to their surroundings."""
    out, at = [], 0
    while m := CONTEXT.search(text, at):
        start, end = m.span(1)
        at = end
        word = m[1]
        if any(a < end and start < b for a, _, b in known) or not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
            continue
        around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
        if novelty(word, around) >= NOVEL:
            out.append((start, 3, end))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _texts(column: pa.Array) -> Iterator[str]:
    data, off = text_bytes(column)
    raw = memoryview(data)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield str(raw[a:b], "utf-8")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for every row of ``docs``.

    Spans count characters of the whole text. A null or empty text has none, an empty list and
    the digest of the empty string. Repeated rows come back as often; null ids stay null;
    other columns are ignored; an empty table gives no rows. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                base, every = scan(text)
                kinds = [k for _, k, _ in every]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def without(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with every span of their text replaced; ``size_col`` follows where text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = (batch.schema.get_field_index(c) for c in (text_col, size_col))
            texts, sizes = batch.column(t).to_pylist(), batch.column(n).to_pylist() if n >= 0 else None
            for k, text in enumerate(texts):
                spans = scan(text)[1] if text else []
                if spans:
                    texts[k] = redact(text, spans)
                    if sizes:
                        sizes[k] = len(texts[k])
            batch = batch.set_column(t, batch.schema.field(t), pa.array(texts, batch.schema.field(t).type))
            yield batch if n < 0 else batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))

    return docs.mapInArrow(run, docs.schema)
