"""URL filters: all wildcard rules run at once as one bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.text import text_bytes

#: Production rules, (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Globs that block an address no rule fits; ``*`` is any run of bytes, ``?`` any byte.
GLOBS = ["*casino-win*", "*cheap-pills*", "*free-bets*", "*/wp-login*", "*.exe", "*.zip"]

_U, _WORD = np.uint64, 64


class ShiftAnd:
    """Multiword Shift-And masks of many patterns.

    A pattern is a list of tokens: a set of bytes that must come next, or ``("gap", set)``
    for a run of any length of those bytes. Each pattern takes one bit for its start and one
    for each set; all patterns lie one after another in the same words. A gap lets the state
    before it stay alive on its bytes.
    """

    def __init__(self, patterns: Sequence[list]):
        size = sum(1 + sum(not isinstance(t, tuple) for t in p) for p in patterns)
        self.words = max(1, -(-size // _WORD))
        step, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.final, at = np.zeros(self.words, np.uint64), [], 0

        def mark(table, among, bit):
            table[sorted(among), bit // _WORD] |= _U(1 << (bit % _WORD))

        for p in patterns:
            self.start[at // _WORD] |= _U(1 << (at % _WORD))
            for t in p:
                if isinstance(t, tuple):
                    mark(stay, t[1], at)
                else:
                    at += 1
                    mark(step, t, at)
            self.final.append(at)
            at += 1
        self.step, self.stay = step, stay

    def run(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Boolean (text, pattern): which patterns fit each whole text. All texts step together."""
        n, length = len(off) - 1, np.diff(off)
        order = np.argsort(-length, kind="stable")
        begin, left = off[:-1][order], length[order]
        state = np.broadcast_to(self.start, (n, self.words)).copy()
        alive = n
        for t in range(int(left[0]) if n else 0):
            alive = int(np.searchsorted(-left[:alive], -t, "left"))  # the first have more than t bytes
            byte, now = data[begin[:alive] + t], state[:alive]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(_WORD - 1)
            state[:alive] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((n, len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[:, bit // _WORD] >> _U(bit % _WORD)) & _U(1) == 1
        return out


_ANY = set(range(256))


def rule_pattern(host: str, path: str) -> list:
    """A rule over ``.host/path``: labels before its host, then the path's prefix. The first
    gap excludes ``/``, so the host part can't match inside a path."""
    literal = [{b} for b in f".{host}{path}".encode()]
    return [("gap", _ANY - {ord("/")}), *literal, ("gap", _ANY)]


def glob_pattern(glob: str) -> list:
    """``*``: any run; ``?``: any byte; anything else itself."""
    return [("gap", _ANY) if b == ord("*") else _ANY if b == ord("?") else {b} for b in glob.encode()]


def canonical(url):
    """Column pair (host, path): host lower-cased in A-Z, both empty for null or no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[str] = GLOBS,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest
    fitting rule wins (a tie goes to the smaller text). Without one, rule is null and an
    address that a glob matches, as host and path together, is blocked, any other allowed.
    Null or malformed addresses have an empty host and path and are allowed. Repeated rows
    come back as often, null ids stay null, other columns are ignored. One pass over the id
    and address columns, no shuffle; rules and globs are a parameter of fixed size.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    names = [h + p for h, p, _ in ranked]
    patterns = [rule_pattern(h, p) for h, p, _ in ranked] + [[{ord(".")}, *glob_pattern(g)] for g in globs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(patterns)
        for batch in batches:
            data, off = text_bytes(batch.column(3))
            fits = automaton.run(data, off)
            ruled = fits[:, : len(names)]
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1), -1) if names else np.full(len(fits), -1)
            bad = fits[:, len(names) :].any(axis=1)
            rule = pa.array([None if k < 0 else names[k] for k in first], pa.string())
            verdict = pa.array([ranked[k][2] if k >= 0 else "block" if b else "allow" for k, b in zip(first, bad)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    host, path = canonical(F.col(url_col))
    kept = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    kept = kept.withColumn("whole", F.concat(F.lit("."), "host", "path"))
    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string")
