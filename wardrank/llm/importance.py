"""Quality selection by importance resampling of hashed n-grams.

Tokens (words, runs of punctuation) and their pairs are hashed to ``2**bits`` places.  Two bag-of-n-grams
models are counted, one over the target text (a bounded sample of documents
labelled good, see ``labelled_sample``) and one over all text; a document's log weight is the sum over its n-grams of
``log p_target - log p_raw``.  Adding independent Gumbel noise to the log
weights and taking the k largest draws k documents without replacement in
proportion to their weights.  The noise is a function of the id and a seed.
The k-th largest value is found by counting rounds over all rows, not by a
sort into one task; equal values are cut by a hash of the id and the row id.

Defined cases: null and empty texts have weight 0; without target text all
weights are 0 (the sample is uniform); labels that are null or have no
document are ignored; repeated rows are drawn independently of each other
apart from equal noise; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_arrow, stored
from .sharding import _cell, _split, _unsigned, find_splitters


_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")


def ngram_places(text: str | None, bits: int) -> np.ndarray:
    """Hash places of all tokens (lower-cased words and runs of punctuation)
    and neighbouring pairs of a text."""
    tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    h = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([h & np.uint64((1 << bits) - 1), pairs >> np.uint64(64 - bits)]).astype(np.int64)


def count_places(docs: DataFrame, bits: int, text: str = "text") -> np.ndarray:
    """Occurrences of every place in all documents."""
    places = 1 << bits

    def run(batches):
        total = np.zeros(places, np.int64)
        for b in batches:
            for t in b[text].to_pylist():
                total += np.bincount(ngram_places(t, bits), minlength=places) if t else 0
        full = np.flatnonzero(total)
        yield {"place": full, "n": total[full]}

    parts = map_arrow(docs.select(text), fields("place long", "n long"), run)
    out = np.zeros(places, np.int64)
    for place, n in parts.groupBy("place").agg(F.sum("n")).collect():  # at most 2**bits rows
        out[place] = n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label: str, at_most: int) -> DataFrame:
    """The documents with label 1, at most ``at_most`` ids: those with the
    lowest hash.  Only these ids are broadcast; no text is moved."""
    ids = (labels.where(F.col(label) == 1).select(F.col(id_col).alias("_id")).dropna().distinct()
           .orderBy(F.xxhash64("_id"), "_id").limit(at_most))
    return docs.join(F.broadcast(ids), docs[id_col] == ids["_id"], "left_semi")


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per place, each with one added count."""
    if not target.sum():
        return np.zeros(len(target))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def resample(docs: DataFrame, target: DataFrame, keep: float, id_col: str = "doc_id", text: str = "text",
             bits: int = 14, seed: int = 0) -> DataFrame:
    """``docs`` without the text, with ``log_weight``, ``perturbed`` (with
    noise) and ``kept``: true for the ``round(keep * rows)`` drawn rows."""
    ratio = log_ratio(count_places(target, bits, text), count_places(docs, bits, text))
    added = ("log_weight", "perturbed", "kept")
    kept = [c for c in docs.columns if c != text and c not in added]
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    source = docs.select(*kept, F.col(text).alias("_text"), (-F.log(-F.log(uniform))).alias("_noise"),
                         F.xxhash64(F.lit(seed + 1), F.col(id_col), F.monotonically_increasing_id()).alias("_u"))

    def weigh(batches):
        for b in batches:
            w = np.array([ratio[ngram_places(t, bits)].sum() if t else 0.0 for t in b["_text"].to_pylist()], dtype=float)
            y = w + b["_noise"].to_numpy(zero_copy_only=False)
            bits_of = (-y).view(np.int64)  # falling order of y as rising order of integers
            h = np.where(bits_of < 0, bits_of ^ np.int64(0x7FFFFFFFFFFFFFFF), bits_of)
            yield {c: b[c] for c in [*kept, "_u"]} | {"log_weight": w, "perturbed": y, "_h": h}

    schema = docs.select(*kept).schema
    weighed = map_arrow(source, type(schema)([*schema.fields, *fields(
        "log_weight double", "perturbed double", "_h long", "_u long").fields]), weigh)
    weighed = stored(weighed.withColumn("_size", F.lit(1).cast("long")), "weights")
    n = weighed.count()
    cut = find_splitters(weighed, [round(keep * n)], (n, n), [0])[0][0] if n else 0
    ph, pu = _split([min(cut, (1 << 128) - 1)])

    def draw(batches):
        for b in batches:
            below = _cell(_unsigned(b["_h"]), _unsigned(b["_u"]), ph, pu) == 0
            yield {c: b[c] for c in [*kept, *added[:2]]} | {"kept": below | (cut >= 1 << 128)}

    out = weighed.select(*kept, *added[:2]).schema
    return map_arrow(weighed, type(out)([*out.fields, *fields("kept boolean").fields]), draw)
