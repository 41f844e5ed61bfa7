import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import importance, queries


def test_weights_and_draw_equal_a_plain_count(docs, rows, spark):
    bits = 10
    good = docs.where("doc_id % 2 = 0")
    got = importance.resample(docs, good, keep=0.6, bits=bits).collect()

    def total(texts):
        return sum((np.bincount(importance.ngram_places(t, bits), minlength=1 << bits) for t in texts if t), np.zeros(1 << bits, int))
    target, raw = total(r[1] for r in rows if r[0] is not None and r[0] % 2 == 0), total(r[1] for r in rows)
    ratio = np.log((target + 1) / (target.sum() + (1 << bits))) - np.log((raw + 1) / (raw.sum() + (1 << bits)))
    want = sorted(round(float(ratio[importance.ngram_places(r[1], bits)].sum()) if r[1] else 0.0, 6) for r in rows)
    assert sorted(round(r.log_weight, 6) for r in got) == want
    kept = sum(r.kept for r in got)
    assert kept == round(0.6 * len(rows))
    assert min(r.perturbed for r in got if r.kept) >= max(r.perturbed for r in got if not r.kept)


def test_gumbel_noise_and_extremes(spark, none):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = importance.resample(docs, docs.limit(0), keep=0.25).collect()
    noise = np.array([r.perturbed - r.log_weight for r in got])
    assert abs(noise.mean() - 0.5772) < 0.08 and abs(noise.std() - 1.2825) < 0.08
    assert sum(r.kept for r in got) == 1000
    assert {r.log_weight for r in got} == {0.0}
    few = docs.limit(7)
    assert [sum(r.kept for r in importance.resample(few, few, keep=k).collect()) for k in (0.0, 1.0)] == [0, 7]
    assert importance.resample(none, none, keep=0.5).count() == 0


def test_query_prefers_good_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    out = queries.op9_quality(spark, SF01).collect()
    good, bad = [r.kept for r in out if labels.get(r.doc_id) == 1], [r.kept for r in out if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in out) == round(1000 * sum(labels.values()) / len(labels))
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.4
