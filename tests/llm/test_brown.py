import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import brown, common
from wardrank.llm.common import fields, id_remainder, stored


def _tokens(t):
    return (t or "").encode().lower().split() + ["end"]


@pytest.fixture(scope="module")
def scored(docs):
    options = dict(max_head=300, n_exchange=6, exchange_words=80, passes=3)
    return brown.score_texts(docs, id_remainder("doc_id", 4) != 0, **options).collect()


def test_base_counts_and_scores(scored, rows):
    def held(doc_id):
        return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 4 == 0
    train = Counter(w for doc_id, t, *_ in rows if not held(doc_id) for w in _tokens(t))
    n, v = sum(train.values()), len(train)
    want = []
    for doc_id, t, *_ in rows:
        words = _tokens(t)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((str(doc_id), not held(doc_id), len(words), sum(train[w] > 0 for w in words), n, round(base, 6)))
    got = [(str(r.doc_id), r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)


def test_probabilities_sum_to_one(docs):
    training = id_remainder("doc_id", 4) != 0
    counts = brown.count_words(docs.where(training))
    tokens, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = brown.frequent_words(counts, 300)
    head = {w: i for i, (w, _) in enumerate(top)}
    encoded = brown.encode(docs, head, "doc_id", "text", training)
    model = brown.build_model(encoded, top, tokens, types, 6, 80, 2)
    everything = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for prev in (model.end, 3, brown.TAIL):
        total = 0.0
        for w, n in [*everything.items(), (None, 0)]:  # None: the unknown word
            c = model.class_of[head.get(w, brown.TAIL)]
            total += (n + 0.1) * 10 ** model.log_factor[model.class_of[prev], c]
        assert abs(total - 1) < 1e-9


def test_exchange_finds_the_classes_and_beats_the_unigram(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(400):  # words of kind a and b take turns
        rows.append((i, " ".join(f"{'ab'[k % 2]}{rng.randint(30)}" for k in range(rng.randint(10, 60)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = brown.score_texts(docs, F.col("doc_id") % 10 != 0, n_exchange=4, exchange_words=200, passes=4).collect()
    held = [r for r in out if not r.training]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.2  # half the words are ruled out: log10(2) = 0.30 a word


def test_top_counts_equal_a_plain_count(spark):
    ids = [[1, 0, 2], [2, 2], [3, 1, 70_000, 1, 2], [5, 2]]  # 2 ends each document; 4 top words
    df = spark.createDataFrame([(i < 3, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)], "training boolean, ids binary")
    klass = np.array([0, 1, 0, 1])
    linked = brown.top_links(df.repartition(2), "<u4", 4, 2, blocks=3)
    after, before = brown.top_counts(linked, klass, 4, 2)
    a, b = np.zeros((6, 2), int), np.zeros((6, 2), int)
    for x in ids[:3]:
        for p, w in zip([2, *x], x):
            if p < 4 and w < 4:
                a[w, klass[p]] += 1
                b[p, klass[w]] += 1
    assert after.tolist() == a.tolist() and before.tolist() == b.tolist()
    assert [len(x) for x in brown.top_links(df.limit(0), "<u4", 4, 2)] == [0, 0, 0]


def test_probabilities_sum_to_one_with_far_words(docs):
    training = id_remainder("doc_id", 4) != 0
    counts = stored(brown.count_words(docs.where(training)), "words")
    tokens, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = brown.frequent_words(counts, 40)
    head = {w: i for i, (w, _) in enumerate(top)}
    encoded = stored(brown.encode(docs, head, "doc_id", "text", training), "encoded")
    far, n_far = brown.far_words(counts, head)
    coded = stored(brown.with_far_ids(encoded, far, "doc_id"), "coded")
    model = brown.build_model(encoded, top, tokens, types, 6, 20, 2, coded=coded, n_far=n_far)
    ids = head | {bytes(r["word"]): r["far"] for r in far.collect()}
    everything = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert n_far > 100 and set(ids) == set(everything)
    for prev in (model.end, 3, brown.FAR, brown.FAR + n_far - 1, brown.TAIL):
        total = 0.0
        for w, n in [*everything.items(), (None, 0)]:  # None: the unknown word
            total += (n + 0.1) * 10 ** model.log_factor[model.class_of[prev], model.class_of[ids.get(w, brown.TAIL)]]
        assert abs(total - 1) < 1e-9


def test_empty_and_nothing_to_learn(spark, none):
    assert brown.score_texts(none, F.lit(True)).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = brown.score_texts(docs, F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(3, 0, 0), (1, 0, 0)}
    assert all(math.isfinite(r.score) for r in out)


def test_words_past_the_head_are_clustered(spark):
    """As above, but the words of the two kinds lie past the head, or past the
    words that are moved one by one."""
    rng = np.random.RandomState(1)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.randint(300)}" for k in range(rng.randint(10, 60)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in (dict(max_head=20, exchange_words=8), dict(exchange_words=8)):
        out = brown.score_texts(docs, F.col("doc_id") % 10 != 0, n_exchange=2, passes=12, **options).collect()
        held = [r for r in out if not r.training]
        assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.2


def test_best_classes_equal_a_plain_exchange():
    rng = np.random.RandomState(4)
    ids = np.concatenate([[0], rng.randint(1, 60, 5000)])
    ids = ids[np.append(True, ids[1:] != ids[:-1])]  # no word next to itself
    n_classes, n_exchange = 6, 5
    klass = rng.randint(0, n_classes, 60)
    prev = np.roll(ids, 1)
    after, before = np.zeros((60, n_classes), np.int64), np.zeros((60, n_classes), np.int64)
    np.add.at(after, (ids, klass[prev]), 1)
    np.add.at(before, (prev, klass[ids]), 1)
    pairs = brown.class_bigrams(after, klass, n_classes)
    word, near, side = np.concatenate([ids, prev]), np.concatenate([prev, ids]), np.repeat([0, 1], len(ids))
    words, best = brown.best_classes(word, klass[near], side, np.ones(len(word), np.int64), klass[word], pairs, n_exchange)
    assert words.tolist() == list(range(60))
    f = lambda x: x * np.log(x) if x > 0 else 0.0
    same = 0
    for w in words:
        gains = []
        for c in range(n_exchange):
            p = pairs.astype(float)
            p[:, klass[w]] -= after[w]
            p[klass[w], :] -= before[w]
            q = p.copy()
            q[:, c] += after[w]
            q[c, :] += before[w]
            fit = [sum(f(x) for x in t.ravel()) - sum(map(f, t.sum(0))) - sum(map(f, t.sum(1))) for t in (p, q)]
            gains.append(fit[1] - fit[0])
        same += gains[best[w]] >= max(gains) - 0.5
    assert same >= 57  # only the word's links within its own class are not taken out twice


def test_counts_beyond_32_bits_keep_their_sum():
    most = (1 << 32) - 1
    keys, times = np.array([3, 5, 9, 12], np.uint64), np.array([most, 7, 3 * most + 4, most + 1])
    k, t = brown._in_32_bits(keys, times)
    assert (t >= 1).all() and (t <= most).all() and (k[1:] >= k[:-1]).all() and k.dtype == keys.dtype
    assert [int(t[k == x].sum()) for x in keys] == times.tolist()
    plain = brown._in_32_bits(keys[:2], times[:2])
    assert plain[0].tolist() == [3, 5] and plain[1].tolist() == [most, 7]


def test_far_words_beyond_the_ids_are_an_error():
    with pytest.raises(OverflowError):
        brown.cluster(None, [], 0, 4, 8, n_far=1 << 31)


def test_counts_travel_in_few_bytes_and_come_back():
    for most, width in ((0, 2), (65_535, 2), (65_536, 4), ((1 << 32) - 1, 4), (1 << 32, 8)):
        x = np.array([0, 3, most, 7], dtype=np.float64)
        blob = brown._packed(x)
        assert len(blob) == 4 * width and brown._unpacked(blob, 4).tolist() == x.tolist()


def test_best_classes_in_pieces_equal_each_word_alone():
    """More words than one piece holds."""
    rng = np.random.RandomState(3)
    n_words, n_classes, n_exchange = 9000, 6, 4
    word = np.repeat(np.sort(rng.randint(0, n_words, 15_000)), 2)
    side, near = np.tile([0, 1], 15_000), rng.randint(0, n_classes, 30_000)
    n = np.repeat(rng.choice([1, 2, 3, 40], 15_000), 2)  # as often after a word as before one
    class_of = rng.randint(0, n_exchange + 1, n_words)  # the last one: not placed yet
    pairs = rng.randint(20_000, 90_000, (n_classes, n_classes))
    words, best = brown.best_classes(word, near, side, n, class_of[word], pairs, n_exchange)
    assert words.tolist() == sorted(set(word.tolist())) and len(words) > 4001
    for k in (0, 1, 3999, 4000, 4001, *range(5, len(words), 500), len(words) - 1):
        own = word == words[k]
        assert brown.best_classes(word[own], near[own], side[own], n[own], class_of[word[own]], pairs, n_exchange)[1] == best[k]


def test_words_that_occur_once_move_as_any_other_word():
    rng = np.random.RandomState(6)
    n_classes, n_exchange, n_words = 6, 4, 3000
    before, after = rng.randint(0, n_classes, (2, n_words))
    own = rng.randint(0, n_exchange + 1, n_words)  # the last one: not placed yet
    pairs = rng.randint(0, 9, (n_classes, n_classes)) * rng.choice([1, 50], (n_classes, n_classes)) + 1
    word, side = np.repeat(np.arange(n_words), 2), np.tile([0, 1], n_words)
    near = np.stack([before, after], axis=1).ravel()
    plain = brown.best_classes(word, near, side, np.ones(len(word), np.int64), own[word], pairs, n_exchange)[1]
    single = brown.best_of_single(before, after, own, brown.Gains(pairs, n_exchange), n_classes, n_exchange)
    assert single.tolist() == plain.tolist() and len(set(plain.tolist())) > 1


def test_links_hold_each_word_once_in_few_bytes(spark):
    ids = [[5, 6, 5, 6, 5, 70_000, 2], [2], [9, 2], [5, 6, 2]]  # 2 ends each document; 4 top words
    df = spark.createDataFrame([(i < 3, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)], "training boolean, ids binary")
    want = Counter()
    for x in ids[:3]:
        for p, w in zip([2, *x], x):
            want.update([(w, p, 0)] * (w >= 4) + [(p, w, 1)] * (p >= 4))
    got = []
    for r in brown.links(df.repartition(2), "<u4", 4, 2, 14, per_bucket=5).collect():
        words, lengths, near = (np.frombuffer(r[c], "<u4") for c in ("words", "lengths", "near"))
        times = brown._unpacked(bytes(r["times"]), len(near))
        assert len(r["times"]) == 2 * len(near) and len(set(words.tolist())) == len(words) and lengths.sum() == len(near)
        got += [((w, x >> 1, x & 1), n) for w, x, n in zip(np.repeat(words, lengths).tolist(), near.tolist(), times.tolist())]
    assert len(got) == len(want) and dict(got) == want


def test_texts_are_read_in_small_batches(spark, docs, monkeypatch):
    limits, held = {}, brown.stored

    def watched(df, name, *rest):
        limits[name] = [int(spark.conf.get(k)) for k in common._BATCHES]
        return held(df, name, *rest)

    monkeypatch.setattr(brown, "stored", watched)
    before = [spark.conf.get(k) for k in common._BATCHES]
    brown.score_texts(docs, id_remainder("doc_id", 4) != 0, max_head=300, n_exchange=6, exchange_words=80, passes=1)
    assert all(max(limits[k]) <= 500 for k in ("words", "encoded", "coded", "links"))
    assert [spark.conf.get(k) for k in common._BATCHES] == before

    def sizes(df):
        return [r.n for r in common.map_arrow(df, fields("n long"), lambda bs: ({"n": [len(b["id"])]} for b in bs)).collect()]

    ids = spark.range(0, 1050, 1, 1)
    with common.small_batches(spark, 100):
        assert sum(found := sizes(ids)) == 1050 and max(found) == 100
    with pytest.raises(ValueError), common.small_batches(spark, 100):
        raise ValueError
    assert sizes(ids) == [1050]


def test_far_ids_need_no_python_workers_but_their_own(spark):
    words = stored(spark.createDataFrame([(bytearray(f"w{i}".encode()), i) for i in range(200)], "word binary, n long").repartition(3), "words")
    far, n_far = brown.far_words(words, {b"w7": 0, b"w9": 1})
    assert "ExistingRDD" not in plan_text(far)  # a list turned into rows by Python
    assert n_far == 198 and sorted(r.far for r in far.collect()) == list(range(brown.FAR, brown.FAR + 198))
    none, n_none = brown.far_words(words.where("n < 0"), {})
    assert n_none == 0 and none.count() == 0
