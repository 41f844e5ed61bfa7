"""Toxicity by non-negative positive-unlabelled learning.

A linear model on hashed words is trained with numpy from confirmed toxic
documents (positives) and unlabelled text: the risk is
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``
with the logistic loss, the class prior taken from the training labels.  When
the bracket turns negative its gradient is reversed, which keeps the model
from fitting the positives' share of the unlabelled text.

The positives are a bounded sample of the labelled rows (``max_positive``, the
lowest hashes of the id).  The unlabelled text is all text: one pass reduces
each document to its candidate features (those of the positives); equal sets
are counted together and stored, the corpus frequencies that choose the
features come from that table, and the risk and its gradient are summed over it
in every pass of the fit.  The fit starts from one on ``start_docs`` documents,
which only saves passes, and goes on with L-BFGS steps over all documents until
the risk settles, in at most ``passes`` passes.  Scoring covers every whole text.

Features: the distinct words of a text and their first ``STEMS`` bytes (word
stems), hashed to ``2**bits`` places; those seen in fewer than
``min_positive`` sampled positives, or not ``min_ratio`` times as often among
them as in all documents, get no weight.

Defined cases: null and empty texts have no features and score the model's
bias; without positive examples every score is 0; repeated documents score
alike; labels that are null or have no document are ignored, conflicting
labels of one id count as toxic; input columns named like an added one are
replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, stored, words_of


STEMS = (6, 4)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic."""
        z = self.bias + float(self.weights[word_features(text, len(self.weights))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def word_features(text: str | None, places: int) -> np.ndarray:
    """Sorted distinct hash places of the words of a text and of their stems."""
    found = set(words_of(text))
    for k in STEMS:
        found |= {w[:k] + b"~" for w in found if len(w) > k and w[-1] != 0x7E}
    return np.unique(np.fromiter(map(zlib.crc32, found), dtype=np.int64) & (places - 1))


def _sampled_features(docs: DataFrame, ids: DataFrame, id_col: str, text: str, bits: int) -> list[np.ndarray]:
    """Features of the documents whose id is in ``ids`` (a bounded sample)."""
    places = 1 << bits

    def run(batches):
        for b in batches:
            yield {"places": [word_features(t, places).astype("<i4").tobytes() for t in b[text].to_pylist()]}

    chosen = docs.select(F.col(id_col).alias("_id"), text).join(F.broadcast(ids), "_id", "left_semi").select(text)
    rows = map_arrow(chosen, fields("places binary"), run).collect()
    return [np.frombuffer(x, "<i4") for x in sorted(bytes(r[0]) for r in rows)]


_BLOCK = 256  # numbers of a summed vector that travel in one row


def _sigma(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Sparse:
    """Rows of active features, with the two products training needs."""

    def __init__(self, rows: list[np.ndarray], column: np.ndarray):
        kept = [column[r][column[r] >= 0] for r in rows]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(k) for k in kept])
        self.col = np.concatenate([*kept, np.empty(0, np.int32)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def pull(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=width)


def active_places(seen: np.ndarray, n_positive: int, common: np.ndarray, n_all: int, min_positive: int = 8,
                  min_ratio: float = 2.0) -> np.ndarray:
    """The places that mark the positives, from how many of them and of all
    documents have each."""
    marks = seen * n_all >= min_ratio * common * n_positive
    return np.flatnonzero((seen >= min(min_positive, n_positive)) & marks)


def frequencies(rows: list[np.ndarray], places: int) -> np.ndarray:
    total = np.zeros(places, np.int64)
    for r in rows:
        total[r] += 1  # the features of a row are distinct
    return total


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], active: np.ndarray, prior: float, bits: int,
             steps: int = 240, rate: float = 0.1, l2: float | None = None) -> ToxicityModel:
    """Full-batch Adam on the non-negative risk, with a rate that falls to 0.

    The weight of the penalty falls with the number of positives, from which
    the weights are learnt, unless ``l2`` is given.
    """
    places = 1 << bits
    l2 = l2 if l2 is not None else 0.1 / max(1, len(positive))
    weights = np.zeros(places)
    if not positive or not unlabelled:
        return ToxicityModel(weights, -500.0, prior)
    column = np.full(places, -1, np.int32)
    column[active] = np.arange(len(active))
    p, u, width = _Sparse(positive, column), _Sparse(unlabelled, column), len(active)
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    for t in range(1, steps + 1):
        zp, zu = p.dot(theta[:-1]) + theta[-1], u.dot(theta[:-1]) + theta[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, down_p, down_u = -prior * _sigma(-zp) / p.n, -prior * _sigma(zp) / p.n, _sigma(zu) / u.n
        gp, gu = (up + down_p, down_u) if negative >= 0 else (-down_p, -down_u)
        grad = np.append(p.pull(gp, width) + u.pull(gu, width) + l2 * theta[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (1 - t / steps) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights[active] = theta[:-1]
    return ToxicityModel(weights, float(theta[-1]), prior)


def feature_sets(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(places, n): how many documents have each set of the wanted places.
    Equal sets of a batch are one row; no set is moved."""
    def run(batches):
        for b in batches:
            sets = Counter()
            for t in b[text].to_pylist():
                f = word_features(t, len(wanted))
                sets[f[wanted[f]].astype("<i4").tobytes()] += 1
            yield {"places": list(sets), "n": list(sets.values())}

    return stored(map_arrow(docs.select(text), fields("places binary", "n long"), run), "features")


def _sums(sets: DataFrame, width: int, add) -> np.ndarray:
    """The sum over all tasks of the vectors of ``width`` numbers that ``add``
    makes of (row of each place, place, n of each row).  A task sends one row
    for each block of numbers that it has any of, and the blocks are added up
    in tasks."""
    def run(batches):
        total = np.zeros(width)
        for b in batches:
            blobs = b["places"].to_pylist()
            sizes = np.array([len(x) // 4 for x in blobs], dtype=np.int64)
            places = np.frombuffer(b"".join(blobs), "<i4")
            add(total, np.repeat(np.arange(len(blobs)), sizes), places, b["n"].to_numpy().astype(float))
        at = np.flatnonzero(total)
        blocks, first = np.unique(at // _BLOCK, return_index=True)
        parts = np.split(at, first[1:]) if len(at) else []
        yield {"block": blocks, "at": [(p % _BLOCK).astype("<i4").tobytes() for p in parts],
               "x": [total[p].astype("<f8").tobytes() for p in parts]}

    def merge(batches):
        sums = {}
        for b in batches:
            for block, at, x in zip(*(b[c].to_pylist() for c in ("block", "at", "x")), strict=True):
                sums.setdefault(block, np.zeros(_BLOCK))[np.frombuffer(at, "<i4")] += np.frombuffer(x, "<f8")
        yield {"block": list(sums), "x": [v.astype("<f8").tobytes() for v in sums.values()]}

    parts = map_arrow(sets, fields("block long", "at binary", "x binary"), run).repartition("block")
    out = np.zeros(-(-width // _BLOCK) * _BLOCK)
    for block, x in map_arrow(parts, fields("block long", "x binary"), merge).collect():  # at most width numbers
        out[block * _BLOCK:(block + 1) * _BLOCK] = np.frombuffer(x, "<f8")
    return out[:width]


def corpus_frequencies(sets: DataFrame, places: int) -> tuple[np.ndarray, int]:
    """How many documents have each place, and the number of documents."""
    def add(total, row, place, n):
        total[:places] += np.bincount(place, weights=n[row], minlength=places)
        total[places] += n.sum()

    out = _sums(sets, places + 1, add)
    return out[:-1].astype(np.int64), int(out[-1])


def unlabelled_risk(sets: DataFrame, column: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Sum over all documents of the loss of calling them clean, its gradient
    (weights, then bias), and the number of documents."""
    width = len(theta) - 1

    def add(total, row, place, n):
        col = column[place]
        row, col = row[col >= 0], col[col >= 0]
        z = np.bincount(row, weights=theta[col], minlength=len(n)) + theta[-1]
        pull = n * _sigma(z)
        total[:width] += np.bincount(col, weights=pull[row], minlength=width)
        total[width:] += pull.sum(), (n * np.logaddexp(0, z)).sum(), n.sum()

    out = _sums(sets, width + 3, add)
    return out[-2], out[:-2], out[-1]


def refine(positive: _Sparse, unlabelled, theta: np.ndarray, prior: float, l2: float, passes: int = 24,
           settled: float = 1e-4, memory: int = 8) -> np.ndarray:
    """L-BFGS on ``prior * R+ + max(0, R-(unlabelled) - prior * R-(positives))``
    plus the penalty; ``unlabelled(theta)`` gives sums over all documents and
    is called at most ``passes`` times."""
    width = len(theta) - 1

    def risk(t: np.ndarray) -> tuple[float, np.ndarray]:
        zp = positive.dot(t[:-1]) + t[-1]
        total, pull, n = unlabelled(t)
        left = total / n - prior * np.logaddexp(0, zp).mean()
        gp = -prior * _sigma(-zp) / positive.n
        grad = np.append(l2 * t[:-1], 0.0)
        if left > 0:
            gp = gp - prior * _sigma(zp) / positive.n
            grad = grad + pull / n
        grad = grad + np.append(positive.pull(gp, width), gp.sum())
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, left) + 0.5 * l2 * (t[:-1] ** 2).sum(), grad

    value, grad = risk(theta)
    used, moves = 1, []
    while used < passes:
        d, parts = -grad, []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            parts.append(a)
            d = d - a * y
        if moves:
            s, y = moves[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(parts)):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0 if moves else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12)), grad @ d
        while used < passes:
            to = theta + step * d
            new, new_grad = risk(to)
            used += 1
            if new <= value + 1e-4 * step * slope:
                break
            step /= 4
        else:
            break
        s, y = to - theta, new_grad - grad
        gained = value - new
        theta, value, grad = to, new, new_grad
        if s @ y > 1e-12:
            moves = [*moves[1 - memory:], (s, y)]
        if gained < settled * max(value, 1e-12):
            break
    return theta


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "toxic", bits: int = 18, max_positive: int = 6000,
                   start_docs: int = 12000, passes: int = 24) -> ToxicityModel:
    """Fit on ``docs`` (the unlabelled text) and ``labels`` (id, 0/1 label).

    Pass only rows that may be learnt from.  At most ``max_positive`` labelled
    toxic documents are used, those with the lowest hash of the id, and all
    documents as unlabelled text.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("_y") == 1).cast("int")), F.lit(0))).first()

    def lowest(ids: DataFrame, k: int, seed: int) -> DataFrame:
        return ids.select("_id").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(k)

    positive = _sampled_features(docs, lowest(known.where("_y = 1"), max_positive, 1), id_col, text, bits)
    prior = min(max(n_toxic / n, 1e-4), 1 - 1e-4) if n else 0.0
    places = 1 << bits
    if not positive:
        return ToxicityModel(np.zeros(places), -500.0, prior)
    seen = frequencies(positive, places)
    sets = feature_sets(docs, text, seen >= min(8, len(positive)))
    common, n_all = corpus_frequencies(sets, places)
    active = active_places(seen, len(positive), common, n_all)
    everything = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull())
    start = fit_nnpu(positive, _sampled_features(docs, lowest(everything, start_docs, 2), id_col, text, bits), active, prior, bits)
    column = np.full(places, -1, np.int32)
    column[active] = np.arange(len(active))
    theta = refine(_Sparse(positive, column), lambda t: unlabelled_risk(sets, column, t),
                   np.append(start.weights[active], start.bias), prior, 0.1 / len(positive), passes)
    weights = np.zeros(places)
    weights[active] = theta[:-1]
    return ToxicityModel(weights, float(theta[-1]), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``out``: the probability of being toxic."""
    kept = docs.drop(out)

    def run(batches):
        for b in batches:
            yield b | {out: [model.score(t) for t in b[text].to_pylist()]}

    return map_arrow(kept, T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]), run)
