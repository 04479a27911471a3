"""URL filter against a plain matcher."""

import fnmatch
import random

import numpy as np
import pytest

from segue.llm import urls

RULES = [*urls.RULES, ("a.b", "/x", "block"), ("b", "/x/y/z/very/long/path/that/needs/more/than/one/word/of/bits/to/hold/it", "allow")]
GLOBS = ["*.exe", "*bad?thing*", "evil.*"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[1:])
    bad = any(fnmatch.fnmatchcase(host + path, g) for g in GLOBS)
    return host, path, None, "block" if bad else "allow"


def test_every_url_as_by_hand(spark):
    rng = random.Random(3)
    rows = [None, "", "no scheme", "http://", "://", "a://b?x=://net/es/", "http://x.com", "HTTP://WWW.Example.COM/en/q#f", "http://é.net/es/ü?",
            "http://evil.com/.net/es/x", "http://bad1thing.org/", "http://q.org/setup.exe", "http://evil.org", "http://net/es/", "http://xnet/es/",
            "http://q.b/x/y/z/very/long/path/that/needs/more/than/one/word/of/bits/to/hold/it/", "http://a.org/" + "y" * 200_000]
    parts = ["com", "net", "example", "www", "es", "en", "a", "b", "/", ".", "?", "#", "://", "x", "/x", "exe"]
    rows += ["http://" + "".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i if i % 50 else None, u, "x", 1) for i, u in enumerate(rows * 2)], "page_id long, url string, host string, rule int")
    got = sorted((tuple(r) for r in urls.judge(df, RULES, GLOBS).collect()), key=str)
    assert got == sorted(((i if i % 50 else None, *brute(u)) for i, u in enumerate(rows * 2)), key=str)


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(df).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(one, [], []).collect()] == [(1, "a.com", "/x", None, "allow")]


@pytest.mark.parametrize("n", [1, 63, 64, 130])
def test_automaton_across_word_borders(n):
    patterns = [urls.glob_pattern(g) for g in ["a" * n, "*" + "b" * n, "a*" + "c" * (n % 7 + 1)]]
    texts = ["a" * n, "x" + "b" * n, "aqq" + "c" * (n % 7 + 1), "", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    got = urls.ShiftAnd(patterns).run(data, off)
    want = [[fnmatch.fnmatchcase(t, g) for g in ["a" * n, "*" + "b" * n, "a*" + "c" * (n % 7 + 1)]] for t in texts]
    assert got.tolist() == want
