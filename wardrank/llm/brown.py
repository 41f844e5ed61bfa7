"""LM scoring by a Brown class-based bigram model, smoothed.

``log10 p(w | v) = log10(mix * p(class w | class v) * p(w | class w) + (1 - mix) * p(w))``
over the words of a text and one end token; the word before the first is the
end token.

* Word counts cover all training text (partial counts in the tasks, then one
  shuffle by word).
* The ``head`` are the most frequent words, at most ``max_head`` and seen at
  least twice, cut at a frequency band, and the end token.  They are found by
  a broadcast table; the ids of all other training words (the far words) by a
  join that no word can skew (a far word is rarer than every head word).  Texts
  are stored once as ids.  A word that is not in the training text is unknown.
* Exchange clustering of all training words: words are moved between classes
  while that raises the class bigram likelihood.  In a pass half of the words,
  in turn, may move to their best class.  The ``exchange_words`` most frequent
  ones move one after the other, from exact tables of their counts next to
  every class; the pairs of two of them are counted once, in one pass.  The links of every other word (its neighbours and how often)
  are gathered once, by word; tasks move their words against the class bigrams
  of the pass.  Only the class of each word, a byte, goes to all tasks.
* Clustering ends when two passes, which offer every word a move, raise the
  log likelihood by less than ``settled`` a token (so also when no word
  moves), or after ``passes``, if given; the classes with the highest
  likelihood are kept.
* A far word's probability is (its count + 0.1) times a factor that depends
  on the classes only.

Defined cases: a null or empty text is one end token; a null id is held out
(its crc32 is 0); repeated documents count and score each by themselves; with
no training text every score is the smoothing of empty counts; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, slices, small_batches, stored

END = b"\n"  # no word holds white space
TAIL = 0xFFFF  # a word outside the head; once far words have ids, an unknown word
FAR = 0x10000  # the first id of a far word
ADD = 0.1  # added to every count
_FEW = 16  # counts up to this have a table of their own


def lm_tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def count_words(docs: DataFrame, text: str = "text", flush: int = 400_000) -> DataFrame:
    """(word, n) of all tokens; tasks pass on partial counts of bounded size."""
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b[text].to_pylist():
                seen.update(lm_tokens(t))
                if len(seen) > flush:
                    yield {"word": list(seen), "n": list(seen.values())}
                    seen = Counter()
        yield {"word": list(seen), "n": list(seen.values())}

    parts = map_arrow(docs.select(text), fields("word binary", "n long"), run)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, at_most: int) -> list[tuple[bytes, int]]:
    """The words of the highest frequency bands, at most ``at_most``, with a
    count of at least 2; most frequent first."""
    band = F.floor(F.log2("n") * 8)
    sizes = sorted(((r[0], r[1]) for r in counts.where("n >= 2").groupBy(band).count().collect()), reverse=True)
    low, total = None, 0
    for b, n in sizes:  # a few hundred bands at most
        if total + n > at_most:
            break
        low, total = b, total + n
    if low is None:
        return []
    rows = counts.where((F.col("n") >= 2) & (band >= low)).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def encode(docs: DataFrame, head: dict[bytes, int], id_col: str, text: str, training: Column) -> DataFrame:
    """A row per document: ids of its tokens (uint16), its distinct tail words,
    and which of them stands at each TAIL (``spots``, uint32)."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"), training.alias("training"),
                         F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), *fields(
        "row long", "training boolean", "ids binary", "tail array<binary>", "times array<int>", "spots binary").fields])

    def run(batches):
        for b in slices(batches, 1000):
            ids, tail, times, spots = [], [], [], []
            for t in b["_text"].to_pylist():
                words = lm_tokens(t)
                codes = np.fromiter(map(head.get, words, repeat(TAIL)), "<u2", len(words))
                ids.append(codes.tobytes())
                outside = list(compress(words, (codes == TAIL).tolist()))
                rare = Counter(outside)
                place = dict(zip(rare, count()))
                tail.append(list(rare))
                times.append(list(rare.values()))
                spots.append(np.fromiter(map(place.__getitem__, outside), "<u4", len(outside)).tobytes())
            yield {id_col: b["_id"], "row": b["row"], "training": b["training"], "ids": ids, "tail": tail, "times": times,
                   "spots": spots}

    return map_arrow(source, schema, run)


def far_words(counts: DataFrame, head: dict[bytes, int]) -> tuple[DataFrame, int]:
    """(word, n, far) of the words outside the head, with ids from FAR on
    without gaps, and their number."""
    def run(batches):
        for b in batches:
            kept = pa.array([i for i, w in enumerate(b["word"].to_pylist()) if w not in head], pa.int64())
            yield {n: c.take(kept) for n, c in b.items()}

    found = stored(map_arrow(counts, counts.schema, run).select(
        "word", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "far")
    sizes = sorted((r[0], r[1]) for r in found.groupBy("part").count().collect())
    starts = FAR + np.cumsum([0, *(n for _, n in sizes)])
    first = found.sparkSession.createDataFrame(pa.table({  # of an Arrow table: a list would go through Python workers
        "part": pa.array([p for p, _ in sizes], pa.int32()), "first": pa.array(starts[:-1], pa.int64())}))
    far = found.join(F.broadcast(first), "part").select(
        "word", "n", (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("far"))
    return far, int(starts[-1]) - FAR


def with_far_ids(encoded: DataFrame, far: DataFrame, id_col: str) -> DataFrame:
    """A row per document: the ids (uint32) of all its tokens, the sum of
    log10(count + ADD) over its tail words, and how many of them are known."""
    rare = encoded.where(F.size("tail") > 0).select("row", F.posexplode(F.arrays_zip("tail", "times")).alias("at", "t"))
    rare = rare.select("row", "at", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    seen = F.coalesce(F.col("n"), F.lit(0))
    found = (rare.join(far, "word", "left").groupBy("row")
             .agg(F.sum(F.col("times") * F.log10(seen + F.lit(ADD))).alias("tail_score"),
                  F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("tail_known"),
                  F.array_sort(F.collect_list(F.struct("at", F.coalesce("far", F.lit(TAIL)).alias("far"))))["far"].alias("far")))
    source = encoded.select(id_col, "row", "training", "ids", "spots").join(found, "row", "left")
    schema = T.StructType([encoded.schema[id_col], *fields(
        "training boolean", "ids binary", "tail_score double", "tail_known long").fields])

    def run(batches):
        for b in slices(batches, 1000):
            out = []
            for ids, spots, found in zip(b["ids"].to_pylist(), b["spots"].to_pylist(), b["far"]):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                if spots:
                    ids[ids == TAIL] = found.values.to_numpy()[np.frombuffer(spots, "<u4")]
                out.append(ids.tobytes())
            yield {id_col: b[id_col], "training": b["training"], "ids": out, "tail_score": b["tail_score"].fill_null(0.0),
                   "tail_known": b["tail_known"].fill_null(0)}

    return map_arrow(source, schema, run)


def _concatenated(blobs, kind: str = "<u2") -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind)


def top_links(coded: DataFrame, kind: str, n_top: int, end: int, blocks: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, how often) of all neighbouring top words in the
    training text, found in one pass.

    At most ``n_top ** 2`` pairs, whatever the text; tasks pass on the pairs
    they hold, which are added up in ``blocks`` parts.
    """
    schema = fields("block long", "pairs binary", "times binary")

    def dealt(held):
        pairs, times = np.unique(np.concatenate(held), return_counts=True)
        block = pairs // n_top * blocks // n_top  # rises with the pair
        for k, (a, z) in enumerate(zip(cuts := np.searchsorted(block, np.arange(blocks + 1)), cuts[1:])):
            if z > a:
                yield {"block": [k], "pairs": [pairs[a:z].astype("<i8").tobytes()], "times": [times[a:z].astype("<i8").tobytes()]}

    def find(batches):
        held, size = [], 0
        for b in slices(batches, 1000):
            ids = _concatenated(b["ids"].to_pylist(), kind).astype(np.int64)
            if not len(ids):
                continue
            prev = np.concatenate([np.array([end], np.int64), ids[:-1]])  # each document ends with the end token
            top = (ids < n_top) & (prev < n_top)
            held.append(prev[top] * n_top + ids[top])
            size += len(held[-1])
            if size > 2_000_000:
                yield from dealt(held)
                held, size = [], 0
        if size:
            yield from dealt(held)

    def add(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, 4):
            for k, pairs, times in zip(b["block"].to_pylist(), b["pairs"].to_pylist(), b["times"].to_pylist()):
                pairs, times = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
                if k in held:
                    pairs, times = np.concatenate([held[k][0], pairs]), np.concatenate([held[k][1], times])
                    order = np.argsort(pairs, kind="stable")
                    pairs, at = np.unique(pairs[order], return_index=True)
                    times = np.add.reduceat(times[order], at)
                held[k] = pairs, times
        for k, (pairs, times) in held.items():
            yield {"block": [k], "pairs": [pairs.tobytes()], "times": [times.tobytes()]}

    parts = map_arrow(coded.where("training").select("ids"), schema, find)
    rows = map_arrow(parts.repartition(blocks, "block"), schema, add).select("pairs", "times").collect()  # ``blocks`` rows
    pairs, times = (_concatenated([bytes(r[c]) for r in rows], "<i8") for c in (0, 1))
    return pairs // max(n_top, 1), pairs % max(n_top, 1), times


def top_counts(linked: tuple[np.ndarray, np.ndarray, np.ndarray], class_of: np.ndarray, n_top: int,
               n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit (a top word, or a class of other words) stands
    after and before every class, counting pairs of top words."""
    before, word, n = linked
    cells = (n_top + n_classes) * n_classes
    own = class_of[:n_top].astype(np.int64)
    after = np.bincount(word * n_classes + own[before], weights=n, minlength=cells)
    ahead = np.bincount(before * n_classes + own[word], weights=n, minlength=cells)
    return tuple(t.reshape(-1, n_classes).astype(np.int64) for t in (after, ahead))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold each of them."""
    most = counts.max(initial=0)
    return counts.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<i8").tobytes()


def _narrow(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of ``_packed`` as they lie."""
    return np.frombuffer(blob, {2: "<u2", 4: "<u4", 8: "<i8"}[len(blob) // n])


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of ``_packed``."""
    return _narrow(blob, n).astype(np.int64)


def _summed(df: DataFrame, count, n_units: int, n_classes: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the (2, units * classes) tables that ``count`` makes of each
    task's batches."""
    def cells(k: int) -> int:
        return 2 * min(block, n_units - k) * n_classes

    def parts_of(batches):
        for table in count(batches):
            table = table.reshape(2, n_units, n_classes)
            for k in range(0, n_units, block):
                yield {"block": [k], "counts": [_packed(table[:, k:k + block])]}

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b["block"].to_pylist(), b["counts"].to_pylist()):
                x = _unpacked(blob, cells(k))
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield {"block": [k], "counts": [_packed(x)]}

    schema = fields("block long", "counts binary")
    parts = map_arrow(df, schema, parts_of)
    n_blocks = -(-n_units // block)
    table = np.zeros((2, n_units, n_classes), np.int64)
    for k, blob in map_arrow(parts.repartition(n_blocks, "block"), schema, add).collect():  # n_blocks rows
        x = _unpacked(bytes(blob), cells(k)).reshape(2, -1, n_classes)
        table[:, k:k + x.shape[1]] += x
    return table[0], table[1]


def _in_32_bits(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same counts, those beyond 32 bits as several entries of their key."""
    most = (1 << 32) - 1
    entries = -(-times // most)
    if (entries <= 1).all():
        return keys, times
    nth = np.arange(entries.sum()) - np.repeat(np.cumsum(entries) - entries, entries)
    return np.repeat(keys, entries), np.minimum(np.repeat(times, entries) - nth * most, most)


def links(coded: DataFrame, kind: str, n_top: int, end: int, n_links: int, per_bucket: int = 1_000_000) -> DataFrame:
    """The neighbours in the training text of every word whose id is at least
    ``n_top``: rows of ``words`` (uint32, sorted), ``lengths`` (links of each,
    uint32), ``near`` (neighbour << 1 | side, uint32, sorted for each word; side
    0: the neighbour stands before the word, 1: after it) and ``times`` (in the
    fewest bytes; a link of more than 32 bits has several entries).  All
    links of a word are in one row; ``n_links``, their number with repeats,
    decides the number of rows."""
    buckets = max(1, -(-n_links // per_bucket))
    schema = fields("bucket long", "keys binary", "times binary")  # keys: word << 32 | near

    def dealt(held):
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        found, at = np.unique(bucket[order], return_index=True)
        for k, o in zip(found.tolist(), np.split(order, at[1:])):
            yield {"bucket": [k], "keys": [keys[o].astype("<u8").tobytes()], "times": [times[o].astype("<u4").tobytes()]}

    def find(batches):
        held, size = [], 0
        for b in slices(batches, 1000):
            ids = _concatenated(b["ids"].to_pylist(), kind).astype(np.uint64)
            if not len(ids):
                continue
            prev = np.concatenate([np.array([end], np.uint64), ids[:-1]])  # each document ends with the end token
            own, back = ids >= n_top, prev >= n_top
            held += [ids[own] << np.uint64(32) | prev[own] << np.uint64(1),
                     prev[back] << np.uint64(32) | ids[back] << np.uint64(1) | np.uint64(1)]
            size += len(held[-1]) + len(held[-2])
            if size > 2_000_000:
                yield from dealt(held)
                held, size = [], 0
        if size:
            yield from dealt(held)

    def gather(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, keys, times in zip(b["bucket"].to_pylist(), b["keys"].to_pylist(), b["times"].to_pylist()):
                held.setdefault(k, []).append((keys, times))
        while held:
            k, parts = held.popitem()
            keys, times = _concatenated([x for x, _ in parts], "<u8"), _concatenated([x for _, x in parts], "<u4")
            order = np.argsort(keys, kind="stable")
            keys, at = np.unique(keys[order], return_index=True)
            total = np.add.reduceat(times[order].astype(np.int64), at)
            keys, total = _in_32_bits(keys, total)
            word = (keys >> np.uint64(32)).astype("<u4")
            starts = _word_starts(word)
            yield {"words": [word[starts].tobytes()], "lengths": [np.diff(starts, append=len(word)).astype("<u4").tobytes()],
                   "near": [keys.astype("<u4").tobytes()], "times": [_packed(total)]}

    parts = map_arrow(coded.where("training").select("ids"), schema, find)
    rows = fields("words binary", "lengths binary", "near binary", "times binary")
    return stored(map_arrow(parts.repartition(buckets, "bucket"), rows, gather), "links", "zstd")


def _link_rows(batches):
    """The (words, lengths, near, times) arrays of each row of ``links``."""
    for b in batches:
        for words, lengths, near, times in zip(*(b[c] for c in ("words", "lengths", "near", "times"))):
            words, lengths, near = (np.frombuffer(x.as_buffer(), "<u4") for x in (words, lengths, near))
            yield words, lengths, near, _narrow(times.as_buffer(), len(near))


def _word_starts(word: np.ndarray) -> np.ndarray:
    """Where each word begins in rows sorted by word."""
    return np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)


def link_counts(linked: DataFrame, class_of: np.ndarray, n_top: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What the linked words add to the tables of ``top_counts``: units
    are the top words, then the classes of the linked words (which have only
    the table of what stands before them)."""
    n_units = n_top + n_classes

    def count(batches):
        table = np.zeros((2, n_units * n_classes))
        between = np.zeros(n_classes * n_classes)  # classes of the linked words and of what stands before them
        for words, lengths, low, n in _link_rows(batches):
            own = np.repeat(class_of[words].astype(np.int32), lengths)
            ahead = np.flatnonzero(low & 1 == 0)
            between += np.bincount(own[ahead] * n_classes + class_of[low[ahead] >> 1], weights=n[ahead], minlength=len(between))
            top = np.flatnonzero(low < 2 * n_top)
            near = (low[top] >> 1).astype(np.int64) + (low[top] & 1 ^ 1) * np.int64(n_units)
            table += np.bincount(near * n_classes + own[top], weights=n[top], minlength=table.size).reshape(2, -1)
        table[0, n_top * n_classes:] += between
        yield table

    return _summed(linked, count, n_units, n_classes)


class Gains:
    """What a move changes, for the class bigrams ``pairs`` of a pass.  A cell is
    a side and a class (side * classes + class); ``kind`` is that of a cell and a
    count up to ``_FEW``."""

    def __init__(self, pairs: np.ndarray, n_exchange: int):
        self.table = np.concatenate([pairs[:, :n_exchange], pairs.T[:, :n_exchange]]).astype(float)  # cell x candidate
        self.value = _xlogx(self.table)
        few = [_xlogx(self.table + k) for k in range(1, _FEW + 1)]  # most counts are small
        self.few = np.concatenate([x - self.value for x in few])  # kind x candidate
        self.own = np.concatenate([2 * self.value - _xlogx(self.table - k) - x for k, x in enumerate(few, 1)])
        self.sizes = [pairs.sum(axis=k).astype(float)[:n_exchange] for k in (0, 1)]


def best_classes(word: np.ndarray, near_class: np.ndarray, side: np.ndarray, n: np.ndarray, own: np.ndarray,
                 pairs: np.ndarray, n_exchange: int, gains: Gains | None = None, piece: int = 32_000) -> tuple[np.ndarray, np.ndarray]:
    """(words, their best class) against the class bigrams ``pairs``.

    The rows are the links of whole words (best sorted by word); ``own`` is the
    class of the word of each row.  A word's own counts are taken out of its class.
    """
    gains = gains or Gains(pairs, n_exchange)
    n_classes = len(pairs)
    table, value, few = gains.table, gains.value, gains.few
    if (word[1:] < word[:-1]).any():
        order = np.argsort(word, kind="stable")
        word, near_class, side, n, own = (x[order] for x in (word, near_class, side, n, own))
    starts = _word_starts(word)
    words, own = word[starts], own[starts]
    bits = (2 * n_classes - 1).bit_length()
    cells = (np.repeat(np.arange(len(starts)), np.diff(starts, append=len(word))) << bits) + side * n_classes + near_class
    ends = np.append(starts[1:], len(word))
    best = np.empty(len(words), np.int64)
    a = 0
    while a < len(words):  # pieces whose cells stay in a core's cache
        z = min(a + 4_000, max(a + 1, int(np.searchsorted(ends, starts[a] + piece, "right"))))
        lo, hi = starts[a], ends[z - 1]
        links_of = np.sort((cells[lo:hi] - (a << bits)).astype(np.uint64) << np.uint64(32) | n[lo:hi].astype(np.uint64))
        cell = (links_of >> np.uint64(32)).astype(np.int64)
        first = _word_starts(cell)
        k = np.add.reduceat((links_of & np.uint64(0xFFFFFFFF)).astype(np.int64), first)
        row, c = cell[first] >> bits, cell[first] & (1 << bits) - 1
        kind = (np.minimum(k, _FEW) - 1) * (2 * n_classes) + c
        big = np.flatnonzero(k > _FEW)
        added = few
        if len(big):
            kind[big] = len(few) + np.arange(len(big))
            added = np.concatenate([few, _xlogx(table[c[big]] + k[big, None]) - value[c[big]]])
        number = np.bincount(row, minlength=z - a)  # cells of each word
        by_number = np.argsort(-number, kind="stable")
        at = (np.cumsum(number) - number)[by_number]  # the first cell of each word
        some = z - a - np.cumsum(np.bincount(number))  # the words that have more than 0, 1, ... cells
        sums, part = np.zeros((z - a, n_exchange)), np.empty((z - a, n_exchange))
        for p in range(len(some) - 1):  # the p-th cell of all words that have one
            m = int(some[p])
            sums[:m] += np.take(added, kind[at[:m] + p], axis=0, out=part[:m], mode="clip")
        gain = part
        gain[by_number] = sums
        before = np.flatnonzero(c < n_classes)
        total = np.bincount(row[before], weights=k[before], minlength=z - a)  # each occurrence has one word before it
        own_class = own[a:z]
        placed = np.flatnonzero(own_class < n_exchange)
        sel = np.flatnonzero((own_class < n_exchange)[row])  # a placed word's counts are in its class already
        in_class = own_class[row[sel]]
        change = gains.own[np.minimum(kind[sel], len(few) - 1), in_class]
        much = np.flatnonzero(kind[sel] >= len(few))
        there, n_here = table[c[sel[much]], in_class[much]], k[sel[much]]
        change[much] = 2 * _xlogx(there) - _xlogx(there - n_here) - _xlogx(there + n_here)
        gain[placed, own_class[placed]] += np.bincount(row[sel], weights=change, minlength=z - a)[placed]
        kinds, kind_of = np.unique(total, return_inverse=True)  # most words have one of a few totals
        for size in gains.sizes:
            change = (_xlogx(size + kinds[:, None]) - _xlogx(size))[kind_of]
            there = size[own_class[placed]]
            change[placed, own_class[placed]] = _xlogx(there) - _xlogx(there - total[placed])
            gain -= change
        found = gain.argmax(axis=1)
        here = gain[placed, own_class[placed]]
        stay = gain[placed, found[placed]] <= here + 1e-9
        found[placed[stay]] = own_class[placed[stay]]
        best[a:z] = found
        a = z
    return words, best


def best_of_single(before: np.ndarray, after: np.ndarray, own: np.ndarray, gains: Gains, n_classes: int, n_exchange: int) -> np.ndarray:
    """What ``best_classes`` finds for words that occur once, given the classes
    of the word before and after each: alike but for the word's own class, so
    candidates are weighed once for each pair of classes."""
    couples, couple = np.unique(before * n_classes + after, return_inverse=True)
    gain = gains.few[couples // n_classes] + gains.few[n_classes + couples % n_classes]
    for size in gains.sizes:
        gain -= _xlogx(size + 1) - _xlogx(size)
    each = np.arange(len(couples))
    first = gain.argmax(axis=1)
    most = gain[each, first]
    gain[each, first] = -np.inf
    second = gain.argmax(axis=1)
    next_most = gain[each, second]
    best = first[couple]
    placed = np.flatnonzero(own < n_exchange)
    own, before, after, couple = own[placed], before[placed], n_classes + after[placed], couple[placed]
    here = gains.few[before, own] + gains.few[after, own] + (gains.own[before, own] + gains.own[after, own])
    for size in gains.sizes:
        here -= (_xlogx(size) - _xlogx(size - 1))[own]
    is_first = best[placed] == own
    other = np.where(is_first, second[couple], best[placed])
    best[placed] = np.where(np.where(is_first, next_most[couple], most[couple]) <= here + 1e-9, own, other)
    return best


def move_linked(linked: DataFrame, class_of: np.ndarray, pairs: np.ndarray, step: int, n_exchange: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, new classes) of the linked words that move.

    Steps 2k and 2k + 1 offer a move to one half of the words and to the other;
    the halves differ by k, so that no two words always move together.
    """
    salt = np.uint64((step // 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))

    def moves(words, best):
        moved = best != class_of[words]
        return {"words": [words[moved].astype("<u4").tobytes()], "classes": [best[moved].astype("<u2").tobytes()]}

    def run(batches):
        gains = Gains(pairs, n_exchange)
        for words, lengths, low, n in _link_rows(batches):
            half = ((words.astype(np.uint64) ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(np.int64)
            offered = (half == step % 2) & (class_of[words] <= n_exchange)
            at = np.cumsum(lengths, dtype=np.int64) - lengths
            two = np.flatnonzero(offered & (lengths == 2))
            two = two[(n[at[two]] == 1) & (n[at[two] + 1] == 1)]  # they occur once: a link on either side
            if len(two):
                sides = low[at[two]], low[at[two] + 1]
                before, after = (class_of[np.where(sides[0] & 1 == k, *sides) >> 1].astype(np.int64) for k in (0, 1))
                yield moves(words[two], best_of_single(before, after, class_of[words[two]].astype(np.int64), gains, len(pairs), n_exchange))
                offered[two] = False
            if offered.any():
                sel = np.flatnonzero(np.repeat(offered, lengths))
                words, lengths, low = words[offered].astype(np.int64), lengths[offered], low[sel]
                yield moves(*best_classes(np.repeat(words, lengths), class_of[low >> 1].astype(np.int64), (low & 1).astype(np.int64),
                                          n[sel], np.repeat(class_of[words].astype(np.int64), lengths), pairs, n_exchange, gains))

    rows = map_arrow(linked, fields("words binary", "classes binary"), run).collect()
    return (_concatenated([bytes(r[0]) for r in rows], "<u4").astype(np.int64), _concatenated([bytes(r[1]) for r in rows], "<u2"))


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1))


def class_bigrams(after: np.ndarray, unit_class: np.ndarray, n_classes: int) -> np.ndarray:
    """(previous class, class) counts from the table of what stands before units."""
    out = np.zeros((n_classes, n_classes), np.int64)
    np.add.at(out.T, unit_class, after)
    return out


def exchange(after: np.ndarray, before: np.ndarray, unit_class: np.ndarray, movable: np.ndarray,
             n_exchange: int, n_classes: int) -> np.ndarray:
    """Move each ``movable`` unit to the exchange class (0 .. n_exchange - 1)
    with the highest likelihood, one after the other, the class bigram counts
    kept up to date."""
    classes = unit_class.copy()
    pairs = class_bigrams(after, classes, n_classes).astype(np.float64)
    cand = np.arange(n_exchange)
    for w in movable:
        left, right, own = after[w].astype(float), before[w].astype(float), classes[w]
        pairs[:, own] -= left
        pairs[own, :] -= right
        into, out = pairs.sum(axis=0), pairs.sum(axis=1)
        n = left.sum()
        new_in, new_out = pairs[:, cand] + left[:, None], pairs[cand, :] + right[None, :]
        gain = ((_xlogx(new_in) - _xlogx(pairs[:, cand])).sum(axis=0) + (_xlogx(new_out) - _xlogx(pairs[cand, :])).sum(axis=1)
                - (_xlogx(into[cand] + n) - _xlogx(into[cand])) - (_xlogx(out[cand] + n) - _xlogx(out[cand])))
        best = int(cand[np.argmax(gain)])
        if own < n_exchange and gain[best] <= gain[own] + 1e-9:
            best = own
        pairs[:, best] += left
        pairs[best, :] += right
        classes[w] = best
    return classes


@dataclass(frozen=True)
class BrownModel:
    class_of: np.ndarray  # class per id (TAIL's is the class of unknown words)
    log_count: np.ndarray  # log10(count + ADD) per head id, 0 for the tail
    log_factor: np.ndarray  # (previous class, class): log10 of what is left of p
    base_factor: float  # log10 of the base's denominator
    tokens: int
    end: int


def cluster(encoded: DataFrame, counts: list[tuple[bytes, int]], tokens: int, n_exchange: int, exchange_words: int,
            passes: int | None = None, coded: DataFrame | None = None, n_far: int = 0, settled: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(class per id, class bigram counts).

    After the exchange classes come that of the words not placed yet (in the
    end it is empty), the end token's and the unknown words'.  Without
    ``coded`` (the texts with the ids of far words) all far words count as
    unknown.
    """
    if FAR + n_far > 1 << 31:  # a link holds an id in 31 bits
        raise OverflowError(f"{n_far} far words are more than the ids of links can tell apart")
    n_top = min(exchange_words, len(counts))
    start, end_class, tail_class, n_classes = n_exchange, n_exchange + 1, n_exchange + 2, n_exchange + 3
    end = next((i for i, (w, _) in enumerate(counts) if w == END), TAIL)
    class_of = np.full(FAR + n_far, tail_class, np.uint8 if n_classes <= 256 else np.uint16)
    class_of[:n_top] = np.arange(n_top) % n_exchange
    class_of[n_top:len(counts)] = start
    class_of[FAR:] = start
    if end != TAIL:
        class_of[end] = end_class
    n_links = 2 * (tokens - sum(n for _, n in counts[:n_top]))
    with small_batches(encoded.sparkSession):
        linked = links(encoded if coded is None else coded, "<u2" if coded is None else "<u4", n_top, end, n_links)
        tops = top_links(encoded if coded is None else coded, "<u2" if coded is None else "<u4", n_top, end)
    best, best_fit, best_pairs = class_of, -np.inf, np.zeros((n_classes, n_classes), np.int64)
    movable = np.array([i for i in range(n_top) if i != end], dtype=np.int64)
    fits = []  # after every pass
    for k in count():
        unit_class = np.concatenate([class_of[:n_top].astype(np.int64), np.arange(n_classes)])
        after, before = (t + x for t, x in zip(top_counts(tops, class_of, n_top, n_classes), link_counts(linked, class_of, n_top, n_classes)))
        pairs = class_bigrams(after, unit_class, n_classes)
        fit = _xlogx(pairs.astype(float)).sum() - _xlogx(pairs.sum(0).astype(float)).sum() - _xlogx(pairs.sum(1).astype(float)).sum()
        if fit > best_fit:
            best, best_fit, best_pairs = class_of, fit, pairs
        fits.append(fit)
        if k == passes or (k % 2 == 0 and k >= 4 and fits[k] - fits[k - 2] < settled * tokens) or not tokens:
            break  # the first two passes place the words
        words, classes = move_linked(linked, class_of, pairs, k, n_exchange)
        moved = exchange(after, before, unit_class, movable[k % 2::2], n_exchange, n_classes)[:n_top]
        class_of = class_of.copy()
        class_of[:n_top] = moved
        class_of[words] = classes
    return best, best_pairs


def build_model(encoded: DataFrame, counts: list[tuple[bytes, int]], tokens: int, types: int, n_exchange: int = 64,
                exchange_words: int = 4096, passes: int | None = None, mix: float = 0.95, coded: DataFrame | None = None,
                n_far: int = 0) -> BrownModel:
    class_of, pairs = cluster(encoded, counts, tokens, n_exchange, exchange_words, passes, coded, n_far)
    n_classes = len(pairs)
    n = np.array([c for _, c in counts], dtype=np.int64)
    mass = pairs.sum(axis=0)  # each token follows one
    kinds = np.bincount(class_of[:len(n)], minlength=n_classes) + np.bincount(class_of[FAR:], minlength=n_classes)
    kinds[-1] = types - len(n) - n_far + 1  # all unknown words are one type
    real = kinds > 0  # a class without words gets no probability
    step = (pairs + ADD) * real / (pairs.sum(axis=1, keepdims=True) + ADD * real.sum())
    base = tokens + ADD * (types + 1)
    inside = mass + ADD * kinds
    factor = mix * step / np.where(inside > 0, inside, 1) + (1 - mix) / base
    log_count = np.zeros(65536)
    log_count[:len(n)] = np.log10(n + ADD)
    end = next((i for i, (w, _) in enumerate(counts) if w == END), TAIL)
    return BrownModel(class_of, log_count, np.log10(factor), float(np.log10(base)), tokens, end)


def _scores(coded: DataFrame, model: BrownModel, id_col: str) -> DataFrame:
    schema = T.StructType([coded.schema[id_col], *fields(
        "training boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double").fields])

    def run(batches):
        for b in slices(batches, 1000):
            blobs = b["ids"].to_pylist()
            n = np.array([len(x) // 4 for x in blobs], dtype=np.int64)
            if not len(n):
                continue
            ids = _concatenated(blobs, "<u4")
            starts = np.cumsum(n) - n
            classes = model.class_of[ids]
            prev = np.concatenate([classes[:1], classes[:-1]])
            prev[starts] = model.class_of[model.end]
            counted = np.add.reduceat(model.log_count[np.minimum(ids, TAIL)], starts) + b["tail_score"].to_numpy()
            yield {id_col: b[id_col], "training": b["training"], "n_tokens": n,
                   "n_known": np.add.reduceat((ids < TAIL).astype(np.int64), starts) + b["tail_known"].to_numpy(),
                   "train_tokens": np.full(len(n), model.tokens, np.int64), "base_score": counted - n * model.base_factor,
                   "score": counted + np.add.reduceat(model.log_factor[prev, classes], starts)}

    return map_arrow(coded, schema, run)


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text",
                max_head: int = 60_000, **model_options) -> DataFrame:
    """Train on the rows where ``training`` holds and score all rows.

    Columns: the id, ``training``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (unigram) and ``score`` (both log10).
    """
    source = docs.select(id_col, text)
    spark = docs.sparkSession
    with small_batches(spark):
        counts = stored(count_words(source.where(training), text), "words")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = [(END, r["n"]) for r in counts.where(F.col("word") == F.lit(END)).collect()]
    top = ends + [x for x in frequent_words(counts, max_head) if x[0] != END]
    head = {w: i for i, (w, _) in enumerate(top)}
    with small_batches(spark):
        encoded = stored(encode(source, head, id_col, text, training), "encoded", "zstd")
    far, n_far = far_words(counts, head)
    with small_batches(spark):
        coded = stored(with_far_ids(encoded, far, id_col), "coded", "zstd")
    model = build_model(encoded, top, tokens, types, coded=coded, n_far=n_far, **model_options)
    return _scores(coded, model, id_col)
