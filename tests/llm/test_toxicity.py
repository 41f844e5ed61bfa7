import random

import numpy as np
from conftest import SF01
from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import queries, toxicity


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))] + ([rng.choice(["vile", "vileness", "scum"])] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "scum"), (7, rows[7][1])]
    labels += [(None, 1), (9, None), (99999, 1), (labels[0][0], 1 - labels[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs.where("doc_id % 5 <> 0"), lab.where("doc_id % 5 <> 0"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    truth = {i: bool({"vile", "vileness", "scum"} & set(t.split())) for i, t in rows if i is not None and t}
    held = [(truth[r.doc_id], r.toxicity >= 0.5) for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 5 == 0]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.03 * len(held)
    none_scores = {r.toxicity for r in got if r.doc_id in (5000, 5001)}
    assert len(none_scores) == 1 and none_scores.pop() < 0.5


def test_without_positives_or_documents(spark, none):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    nobody = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, nobody)
    assert {r.toxicity < 1e-9 for r in toxicity.score_toxicity(docs, model).collect()} == {True}
    assert toxicity.score_toxicity(none, toxicity.train_toxicity(none, nobody), out="score").count() == 0


def test_query_learns_nothing_from_held_out_labels(spark):
    out = queries.op10_toxicity(spark, SF01).collect()
    assert len(out) == 1000 and {r.predicted == int(r.score >= 0.5) for r in out} == {True}
    assert 0 < sum(r.held_out for r in out) < 400


def test_risk_over_all_documents_equals_plain_numpy(spark, docs, rows):
    """Every sum over the corpus against whole feature rows, and the fit
    against the same steps in memory."""
    bits = 12
    all_rows = [toxicity.word_features(r[1], 1 << bits) for r in rows]
    positive = [toxicity.word_features(r[1], 1 << bits) for r in rows[10:30]]
    seen = toxicity.frequencies(positive, 1 << bits)
    sets = toxicity.feature_sets(docs, "text", seen >= 8)
    common, n = toxicity.corpus_frequencies(sets, 1 << bits)
    plain = toxicity.frequencies(all_rows, 1 << bits)
    assert n == len(rows) and (common == np.where(seen >= 8, plain, 0)).all()
    active = toxicity.active_places(seen, len(positive), common, n, min_ratio=1.0)
    assert len(active) > 3
    column = np.full(1 << bits, -1, np.int32)
    column[active] = np.arange(len(active))
    whole = toxicity._Sparse(all_rows, column)

    def in_memory(t):
        z = whole.dot(t[:-1]) + t[-1]
        pull = 1 / (1 + np.exp(-z))
        return np.logaddexp(0, z).sum(), np.append(whole.pull(pull, len(active)), pull.sum()), whole.n

    theta = np.linspace(-1, 1, len(active) + 1)
    for got, want in zip(toxicity.unlabelled_risk(sets, column, theta), in_memory(theta)):
        assert np.allclose(got, want)
    p = toxicity._Sparse(positive, column)
    spread = toxicity.refine(p, lambda t: toxicity.unlabelled_risk(sets, column, t), theta * 0, 0.2, 0.01, passes=8)
    assert np.allclose(spread, toxicity.refine(p, in_memory, theta * 0, 0.2, 0.01, passes=8))
    far = toxicity.refine(p, in_memory, theta * 0, 0.2, 0.01, passes=500, settled=0)

    def risk(t):
        zp, (total, _, n) = p.dot(t[:-1]) + t[-1], in_memory(t)
        return (0.2 * np.logaddexp(0, -zp).mean() + max(0, total / n - 0.2 * np.logaddexp(0, zp).mean()) + 0.005 * (t[:-1] ** 2).sum())

    rng = np.random.default_rng(1)
    assert risk(far) < risk(theta * 0)
    assert all(risk(far) <= risk(far + 0.05 * rng.normal(size=len(far))) + 1e-4 for _ in range(50))
