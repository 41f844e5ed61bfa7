import itertools
import random
import re
from collections import Counter

import numpy as np

from conftest import SF01
from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import linecrf, queries


def _base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside),
            n < 20 or 100 * len(inside) > 30 * n)


def test_base_rules_equal_brute_force(docs, rows, none):
    model = linecrf.fit_crf([], [])
    got = linecrf.judge(docs, model)
    want = Counter((r[0], *_base(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got.collect()) == want
    assert got.where("kept and base_failed").count() == 0  # without labels all lines are content
    assert got.where("not kept and not base_failed").count() == 0
    assert linecrf.judge(none, model).count() == 0


def test_viterbi_equals_all_paths():
    rng = np.random.RandomState(0)
    for _ in range(30):
        model = linecrf.LineCrf(rng.randn(8, 2), rng.randn(2, 2))
        marks = rng.randint(0, 8, rng.randint(1, 7)).tolist()

        def score(path):
            return sum(model.emission[m, y] for m, y in zip(marks, path)) + sum(model.transition[a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product((0, 1), repeat=len(marks)), key=score)
        assert abs(score(model.decode(marks)) - score(best)) < 1e-9


def test_gradient_training_separates_lines():
    rng = random.Random(2)
    good, bad = [[rng.choice([0, 2, 1024]) for _ in range(rng.randrange(1, 9))] for _ in range(80)], \
        [[rng.choice([4, 28, 128]) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    model = linecrf.fit_crf([np.array(s) for s in good + bad], [1] * 80 + [0] * 40)
    assert all(set(model.decode(s)) == {1} for s in good) and all(set(model.decode(s)) == {0} for s in bad)


def test_repeats_without_false_windows():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 60))]
        assert linecrf.repeated_words(words) == _base(b" ".join(words).decode())[4]


def test_query_keeps_good_and_drops_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    out = [r for r in queries.op6_quality_rules(spark, SF01).collect() if not r.base_failed and r.doc_id in labels]
    good, bad = [r.kept for r in out if labels[r.doc_id] == 1], [r.kept for r in out if labels[r.doc_id] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_long_documents_and_replacements_are_learnt_from(spark):
    """The bad documents are tables of more than 120 lines, and most labels
    belong to no document with lines."""
    good = [(i, "The river runs past the old mill.\nNobody had seen the keeper that day.") for i in range(40)]
    bad = [(100 + i, "\n".join(f"| {k} | {k + i} |" for k in range(150))) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, *((1000 + i, " \n") for i in range(300))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100 or i % 2)) for i in [*range(40), *range(100, 140), *range(1000, 1300), *range(5000, 5300)]],
                                   "doc_id long, quality int")
    model = linecrf.train_crf(docs, labels, max_docs=20)
    assert set(model.decode(linecrf.lines_of(bad[0][1])[0])) == {linecrf.BOILERPLATE}
    assert set(model.decode(linecrf.lines_of(good[0][1])[0])) == {linecrf.CONTENT}
