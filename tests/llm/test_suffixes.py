import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import suffixes


def _brute(texts, length):
    count = Counter(d[i:i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))
        out.append((len(d), mark.count(1), spans, hashlib.sha256(bytes(x for x, m in zip(d, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,shard", [(400, 128, 2 << 20), (60, 16, 700), (25, 25, 300)])
def test_equals_brute_force(docs, rows, length, gram, shard):
    """Also with several shards an owner, which are merged by binary search."""
    want = Counter((r[0], *b) for r, b in zip(rows, _brute([(r[1] or "").encode() for r in rows], length)))
    out = suffixes.repeated_spans(docs, length=length, gram=gram, shard_bytes=shard)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    assert got == want and any(k[2] for k in want)


def test_hot_passage(spark, tmp_path):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(150))
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 90))) + passage[rng.randrange(3):]
             + "".join(rng.choice("abcdef ") for _ in range(50)) for _ in range(90)]
    path = str(tmp_path / "hot")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    out = suffixes.repeated_spans(spark.read.parquet(path), length=100, gram=32, shard_bytes=500)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert got == dict(enumerate(_brute([t.encode() for t in texts], 100)))


def test_removal_keeps_rows_and_columns(docs, rows, none):
    cut = suffixes.without_repeats(docs, length=60, gram=16)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for (doc_id, t, *_), (n, removed, _, sha) in zip(rows, _brute(texts, 60)):
        want[doc_id, removed > 0, sha if removed else t] += 1
    got = Counter()
    before = {(r[0], r[1]) for r in rows}
    for r in cut.collect():
        same = (r.doc_id, r.text) in before
        got[r.doc_id, not same, r.text if same else hashlib.sha256(r.text.encode()).hexdigest()] += 1
        assert same or r.n_chars == len(r.text)
    # a cut character goes as a whole, so compare those texts by their ASCII part only
    assert sum(got.values()) == sum(want.values())
    assert {k for k in want if not k[1]} == {k for k in got if not k[1]}
    assert suffixes.without_repeats(none).count() == 0
    assert suffixes.repeated_spans(none).count() == 0


def test_suffix_array_and_kasai():
    rng = random.Random(1)
    for trial in range(150):
        t = bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) + (b"ab" * 30 if trial % 7 == 0 else b"")
        data = np.frombuffer(t, np.uint8)
        order = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        common = suffixes.common_prefixes(data, order, lane=rng.choice([3, 7, 512]))
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert common[b] == k


def test_equal_strings_have_equal_owners():
    rng = np.random.RandomState(5)
    shared = rng.randint(0, 250, 90).astype(np.uint8)
    owners = []
    for before, after in ((17, 40), (200, 3)):
        data = np.concatenate([rng.randint(0, 250, before), shared, rng.randint(0, 250, after)]).astype(np.uint8)
        owner, first, _ = suffixes.owner_runs(data, 60, 20)
        owners.append([owner[np.searchsorted(first, before + i, "right") - 1] for i in range(31)])
    assert owners[0] == owners[1]
