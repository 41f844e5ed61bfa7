import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import sharding


def _shards(df, n=5, **kw):
    return sharding.shard_by_bytes(df, n, F.octet_length("text"), F.xxhash64("text"), F.col("doc_id"), **kw)


def _check(out, rows, n):
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += len((r.text or "").encode())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted(
        (r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_rows_slots_and_bytes(docs, rows):
    sizes = _check(_shards(docs).collect(), rows, 5)
    total, longest = sum(sizes.values()), max(len((r[1] or "").encode()) for r in rows)
    assert all(abs(sizes[k] - total / 5) <= longest for k in range(5))


def test_several_cells_a_shard(docs, rows):
    """Shards of one cell and of many hold the same bytes, but for a row at each border."""
    longest = max(len((r[1] or "").encode()) for r in rows)
    one, many = (_check(_shards(docs, **o).collect(), rows, 5) for o in ({}, {"cell_bytes": 2000}))
    assert sum(one.values()) == sum(many.values()) and set(one) == set(many)
    assert all(abs(one[k] - many[k]) <= 2 * longest for k in one)


def test_a_hot_group_is_cut_evenly(spark):
    rng = random.Random(1)
    rows = [(i, "hot text" if i % 3 else "t" * rng.randrange(1, 20)) for i in range(3000)]
    out = _shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = _check(out, rows, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 20
    same = spark.createDataFrame([(7, "one row again")] * 800, "doc_id long, text string")
    sizes = _check(_shards(same, 4).collect(), [(7, "one row again")] * 800, 4)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 13


def test_pieces_of_a_cell(spark, docs, rows):
    """Fewer cells than the bytes ask for: pieces stay bounded, slots gapless, shards as without."""
    _check(_shards(docs, cell_bytes=500, max_cells=5).collect(), rows, 5)
    many = [(i % 900, "hot text" if i % 3 else f"text {i % 700}") for i in range(6000)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    plain, cut = (_shards(df, 4, **o).collect() for o in ({}, {"cell_bytes": 600, "max_cells": 8}))
    assert _check(cut, many, 4) == _check(plain, many, 4)
    size = F.octet_length("text")
    placed = sharding.place_rows(df, F.struct(size.alias("b")), 4, size, F.xxhash64("text"), F.col("doc_id"), 0.001, 600, 8)
    held = placed.groupBy("_cell", "_piece").agg(F.sum("_row.b").alias("b")).collect()
    assert len({r["_cell"] for r in held}) == 8 and max(r.b for r in held) < 2 * 600


def test_empty_and_weightless(spark, none):
    assert _shards(none).count() == 0
    rows = [(i, None) for i in range(9)]
    odd = spark.createDataFrame([(1, "a", 2, 3, 4, 5, 6)], "doc_id long, text string, _h int, _size int, _cell int, slot int, `a.b` int")
    assert _shards(odd).select("_h", "_size", "_cell", "slot", "`a.b`").first() == (2, 3, 4, 0, 6)
    assert sum(_check(_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 5).values()) == 0


def test_cell_is_a_binary_search_over_pairs():
    rng = np.random.RandomState(0)
    probes = sorted({(int(a), int(b)) for a, b in rng.randint(0, 4, (12, 2))})
    h, u = rng.randint(0, 5, 200).astype(np.uint64), rng.randint(0, 5, 200).astype(np.uint64)
    got = sharding._cell(h, u, *(np.array(x, np.uint64) for x in zip(*probes)))
    assert got.tolist() == [sum(p <= (int(a), int(b)) for p in probes) for a, b in zip(h, u)]
