import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import SCHEMA, corpus, docs, none, rows  # noqa: F401
from wardrank.llm import queries
from wardrank.llm.recompression import Grammar, find_runs, periodic_runs


def plain_runs(w, least=6, times=4):
    """All maximal stretches by their definition."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


sequences = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 12),
              st.lists(st.integers(0, 3), max_size=8)).map(lambda x: x[0] + x[1] * x[2] + x[3]))


@settings(max_examples=300, deadline=None)
@given(st.lists(sequences, max_size=5))
def test_runs_equal_the_definition(texts):
    found = periodic_runs([np.array(t, dtype=np.int64) for t in texts])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(t) for t in texts]


def test_grammar_extensions():
    rng = random.Random(4)
    for kinds in (1, 2, 3, 50):
        w = np.array([1000, *(rng.randrange(kinds) for _ in range(150)), *[7] * 40, *[8, 9] * 30, 1001])
        g = Grammar(w)
        assert len(g.symbols[-1]) == 1
        pairs = np.array([(i, j) for i in range(1, len(w) - 1) for j in range(i + 1, len(w) - 1)])
        ahead, back = g.extend(pairs[:, 0], pairs[:, 1], True), g.extend(pairs[:, 0], pairs[:, 1], False)
        for (i, j), x, y in zip(pairs.tolist(), ahead.tolist(), back.tolist()):
            k = 0
            while w[i + k] == w[j + k]:
                k += 1
            assert x == k
            k = 0
            while w[i - k] == w[j - k]:
                k += 1
            assert y == k


def test_long_runs():
    w = np.array([0] * 5000 + [1, 2, 3] * 3000 + list(range(4, 2004)) * 5, dtype=np.int64)
    assert [tuple(r) for r in periodic_runs([w])[0].tolist()] == [(0, 5000, 1), (5000, 9000, 3), (14000, 10000, 2000)]


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], None if not runs else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, none, tmp_path):  # noqa: F811
    some = [r for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    some += [(1000 + i, " ".join(f"w{k}" for k in range(3 + 7 * i)), *some[0][2:]) for i in range(60)]
    spark.createDataFrame(some, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((expected(r[0], r[1]) for r in some), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_operator(spark, docs, none, rows):  # noqa: F811
    assert find_runs(none).collect() == []
    twice = docs.selectExpr("doc_id", "text", "'x' as collapsed", "1 as runs", "score")
    out = find_runs(twice, batch_words=500)
    assert out.columns == ["doc_id", "text", "score", "runs", "collapsed"] and out.count() == len(rows)
    for r in out.where("doc_id is not null").collect():
        words = (r.text or "").encode().split()
        if len(words) < 3000:
            runs = plain_runs(words)
            assert [tuple(x) for x in r.runs] == runs
            gone = {i for s, length, q in runs for i in range(s + q, s + length)}
            assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
