import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import jaccard
from wardrank.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _set(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows, threshold=0.8):
    """(id, text) -> (class members, links) by comparing all pairs."""
    sets = [_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return links, [members[find(i)] for i in range(len(rows))]


def _same(got, rows):
    links, classes = _brute(rows)
    low = [min((rows[j][0] for j in c if rows[j][0] is not None), default=None) for c in classes]
    want = Counter((rows[i][0], low[i], len(classes[i]), links[i]) for i in range(len(rows)))
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got) == want


def test_equals_all_pairs(docs, rows):
    plain = [r[:2] for r in rows]
    _same(jaccard.jaccard_join(docs).collect(), plain)
    # small buckets, blocks and depths: recursion, tiles and their limits
    _same(jaccard.jaccard_join(docs, small=3, block_sets=4, block_shingles=900, dense=0.9).collect(), plain)
    _same(jaccard.jaccard_join(docs, small=2, block_sets=3, max_depth=1).collect(), plain)


def test_hot_groups(spark, tmp_path):
    """A third copies, a third near copies, a passage in all others."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 120):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for i in range(120, 180)]
    path = str(tmp_path / "hot")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    _same(jaccard.jaccard_join(spark.read.parquet(path), small=8, block_sets=16).collect(), rows)


def test_keep_one(docs, rows, none):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    plain = list({r[:2] for r in rows})
    _, classes = _brute(plain)
    want = {min((plain[j] for j in c), key=lambda r: (r[0] is None, r[0] or 0)) if _set(plain[i][1]) else plain[i]
            for i, c in enumerate(classes)}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert jaccard.keep_one(none).count() == 0 and jaccard.jaccard_join(none).count() == 0


def test_recall_of_the_runs():
    """Simulated: one run loses a pair at the threshold no more often than stated."""
    for threshold, branch in ((0.8, 2), (0.7, 3)):
        rng, lost = random.Random(1), 0
        for _ in range(3000):
            alive = 1
            for _ in range(12):
                alive = min(50, sum(rng.random() < threshold for _ in range(alive * branch)))
            lost += alive == 0
        assert (lost / 3000) ** jaccard.runs_needed(threshold, branch, 0.9999) < 2e-4


def test_minhash_agreement_estimates_similarity():
    rng = np.random.RandomState(3)
    x = rng.randint(0, 1 << 62, 1000).astype(np.uint64)
    a, b = jaccard.minhash(x[:900], 2000), jaccard.minhash(x[100:], 2000)
    assert abs((a == b).mean() - 0.8) < 0.04


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_of_runs_that_share_their_places():
    for threshold, branch, depth in ((0.8, 2, 4), (0.8, 2, 12), (0.7, 3, 12)):
        runs, missed = jaccard.runs_needed(threshold, branch, 0.9999), 0.0
        for same in range(65):
            lost = 0.0
            for _ in range(depth):
                lost = (1 - same / 64 * (1 - lost)) ** branch
            missed += math.comb(64, same) * threshold ** same * (1 - threshold) ** (64 - same) * lost ** runs
        assert missed <= 1e-4


def test_a_level_reads_its_split_rows_once(spark, tmp_path, monkeypatch):
    """The rows of a split meet the buckets that go on in one join; what is
    dense is taken off by bucket, not by row."""
    rng, plans, keep = random.Random(8), [], jaccard.stored

    def watched(df, name, *args):
        if name == "buckets":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name, *args)

    monkeypatch.setattr(jaccard, "stored", watched)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):  # alike, but seldom enough to be split on
        w = list(base)
        for _ in range(4):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    path = str(tmp_path / "alike")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    jaccard.jaccard_join(spark.read.parquet(path), small=16).collect()
    levels = [p for p in plans if "parent#" in p]
    assert levels
    for p in levels:
        rows = [line for line in p.splitlines() if "Relation [" in line and "rep#" in line]
        assert len(rows) == 1 and p.count("LeftAnti") == 1
