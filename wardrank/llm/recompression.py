"""Periodic runs of words, found by recompression.

A run is a stretch of words with smallest period q, at least ``least`` words
and ``times`` * q words long, that no neighbouring word extends.

1. Candidates lie on harmonic grids: a stretch of ``times`` * q words holds
   ``times`` neighbouring multiples of q, whose words are equal.  For every q
   the word sequence is looked at on the multiples of q only, which is
   n * (1 + 1/2 + 1/3 ...) places in all.
2. The texts that have candidates are recompressed into a run-length grammar:
   block compression replaces each stretch of one symbol by a symbol for
   (symbol, length), pair compression splits the symbols into left and right
   ones and replaces every left symbol followed by a right one; the two
   alternate until one symbol is left.  Equal strings get equal symbols, apart
   from their ends.
3. The grammar answers how far two places agree, forwards and backwards, in a
   number of steps that grows with its height: up while both places are at the
   edge of equal symbols, then down to the first difference.  A grid pair
   (i, i + q) thus extends exactly to its stretch.  Of the periods of one
   stretch the smallest counts.

Texts are worked on in batches of bounded words, within the tasks; unique
symbols between the texts keep runs inside one text.  No rows are moved.

Defined cases: null and empty texts have no words and no runs; a text longer
than a batch is a batch of its own; repeated documents are treated alike; an
empty table gives no rows; input columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, map_arrow
from .jaccard import mix

_AT_ONCE = 1 << 20  # candidates extended at a time


class Grammar:
    """Run-length grammar of a sequence whose first and last symbol occur once.

    ``symbols[l]`` is the sequence on level l; ``first[l]`` the place on level
    l where each symbol of level l + 1 begins (and, last, the length);
    ``parent[l]`` the place on level l + 1 that a place on level l belongs to;
    ``block[l]`` whether level l + 1 was made by block compression.
    """

    def __init__(self, sequence: np.ndarray):
        self.symbols = [np.unique(sequence, return_inverse=True)[1].astype(np.int64)]
        self.first: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.block: list[bool] = []
        seed = 0
        while len(self.symbols[-1]) > 1:
            self._blocks()
            self._pairs(seed := seed + 1)

    def _close(self, starts: np.ndarray, names: np.ndarray, block: bool) -> None:
        at = np.flatnonzero(starts)
        self.first.append(np.append(at, len(starts)).astype(np.int32))
        self.parent.append((np.cumsum(starts) - 1).astype(np.int32))
        self.block.append(block)
        self.symbols.append(np.unique(names[at], return_inverse=True)[1].astype(np.int64))

    def _blocks(self) -> None:
        x = self.symbols[-1]
        starts = np.concatenate([[True], x[1:] != x[:-1]])
        if starts.all():
            return
        at = np.flatnonzero(starts)
        names = np.zeros(len(x), np.int64)
        names[at] = x[at] * (len(x) + 1) + np.diff(np.append(at, len(x)))
        self._close(starts, names, True)

    def _pairs(self, seed: int) -> None:
        x = self.symbols[-1]
        n = int(x.max()) + 1
        left = (mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)[x]
        joined = np.append(left[:-1] & ~left[1:], False)
        if not joined.any():
            return
        starts = ~np.concatenate([[False], joined[:-1]])
        names = np.where(joined, n + x * n + np.append(x[1:], 0), x)
        self._close(starts, names, False)

    def _place(self, level: int, at: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        """(parent, symbols left of it from here on in the direction)."""
        up = self.parent[level][at]
        if ahead:
            return up, self.first[level][up + 1] - at
        return up, at - self.first[level][up] + 1

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """How many symbols from places ``i`` and ``j`` (different ones) on, or
        back from them, are equal."""
        step = 1 if ahead else -1
        a, b = i.astype(np.int64), j.astype(np.int64)
        level = np.zeros(len(a), np.int64)  # where the places differ
        rising = np.arange(len(a))
        for k in range(len(self.first)):
            x, waiting, rose = self.symbols[k], rising, []
            while len(waiting):
                same = x[a[waiting]] == x[b[waiting]]
                level[waiting[~same]] = k
                waiting = waiting[same]
                (pa_, left_a), (pb_, left_b) = (self._place(k, s[waiting], ahead) for s in (a, b))
                whole = self.first[k][1:] - self.first[k][:-1]
                edge = (left_a == whole[pa_]) & (left_b == whole[pb_])
                up = waiting[edge]
                a[up], b[up] = pa_[edge], pb_[edge]
                rose.append(up)
                far = np.minimum(left_a, left_b)[~edge] if self.block[k] else 1
                waiting = waiting[~edge]
                a[waiting] += step * far
                b[waiting] += step * far
            rising = np.concatenate(rose) if rose else rising[:0]
        for k in range(len(self.first) - 1, -1, -1):
            down = np.flatnonzero(level == k + 1)
            if ahead:
                a[down], b[down] = self.first[k][a[down]], self.first[k][b[down]]
            else:
                a[down], b[down] = self.first[k][a[down] + 1] - 1, self.first[k][b[down] + 1] - 1
            level[down] = k
            x, waiting = self.symbols[k], down
            while len(waiting):
                waiting = waiting[x[a[waiting]] == x[b[waiting]]]
                far = np.minimum(self._place(k, a[waiting], ahead)[1], self._place(k, b[waiting], ahead)[1]) if self.block[k] else 1
                a[waiting] += step * far
                b[waiting] += step * far
        return np.abs(a - i)


def grid_candidates(w: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): the first of ``times`` neighbouring multiples of a
    period with equal words.

    The texts stand in ``w`` in falling order of ``lengths`` and end at
    ``ends``, so that only a front part is as long as a period asks for.
    """
    places, periods = [], []
    reach = np.searchsorted(-lengths, -np.maximum(times * np.arange(int(lengths[0]) // times + 2), least), "right")
    for q in range(1, int(lengths[0]) // times + 1):
        if not reach[q]:
            break
        x = w[:ends[reach[q] - 1]:q]
        same = x[1:] == x[:-1]
        hit = same[:len(same) - times + 2]
        for k in range(1, times - 1):
            hit = hit & same[k:len(same) - times + 2 + k]
        at = np.flatnonzero(hit)
        if len(at):
            places.append(at * q)
            periods.append(np.full(len(at), q))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def periodic_runs(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """The runs of each text (an array of word numbers): rows of start, length
    and period, by start, then period."""
    found = [np.empty((0, 3), np.int64)] * len(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= max(least, times)]
    if not len(order):
        return found
    ends, w = _joined([texts[k] for k in order])
    i, q = grid_candidates(w, ends, lengths[order], least, times)
    owner = np.searchsorted(ends, i, "right")
    inside = i + (times - 1) * q < ends[owner]  # the multiples lie in one text
    i, q, owner = i[inside], q[inside], owner[inside]
    if not len(i):
        return found
    chosen, place = np.unique(owner, return_inverse=True)
    shift = (ends - lengths[order])[owner]  # from the place in w to that in the text
    ends, w = _joined([texts[order[k]] for k in chosen])
    i = i - shift + (ends - lengths[order[chosen]])[place]
    grammar = Grammar(w)
    start, end = np.empty_like(i), np.empty_like(i)
    for at in range(0, len(i), _AT_ONCE):
        s = slice(at, at + _AT_ONCE)
        start[s] = i[s] - grammar.extend(i[s] - 1, i[s] + q[s] - 1, False)
        end[s] = i[s] + q[s] + grammar.extend(i[s], i[s] + q[s], True)
    kept = end - start >= np.maximum(least, times * q)
    start, end, q, place = start[kept], end[kept], q[kept], place[kept]
    rank = np.lexsort((q, end, start))
    start, end, q, place = start[rank], end[rank], q[rank], place[rank]
    smallest = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[:len(start)]
    start, end, q, place = start[smallest], end[smallest], q[smallest], place[smallest]
    begin = start - (ends - lengths[order[chosen]])[place]
    rows = np.stack([begin, end - start, q], axis=1)
    rows = rows[np.lexsort((q, begin, place))]
    cuts = np.searchsorted(np.sort(place), np.arange(len(chosen) + 1))
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        found[order[chosen[k]]] = rows[a:z]
    return found


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, sequence): the texts one after the other, a symbol of its own
    before each of them and after the last."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    out = np.empty(int(ends[-1]) + 1, np.int64)
    top = max(int(t.max()) for t in texts) + 1
    out[np.append(ends - lengths - 1, ends[-1])] = top + np.arange(len(texts) + 1)
    for t, end in zip(texts, ends):
        out[end - len(t):end] = t
    return ends, out


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4, batch_words: int = 300_000) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length and period, by start,
    then period) and ``collapsed``: the text without what its runs repeat, its
    words joined by one space.  Words stand between ASCII white space."""
    run = T.ArrayType(fields("start long", "length long", "period long"))
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    schema = T.StructType([*kept, T.StructField("runs", run), *fields("collapsed string").fields])

    def solve(b: dict, texts: list[list[bytes]]) -> dict:
        number: dict[bytes, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int64) for t in texts]
        runs = periodic_runs(coded, least, times)
        sizes = np.cumsum([0, *(len(r) for r in runs)])
        flat = np.concatenate(runs)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        left = [b" ".join(without_repeats(t, r) if len(r) else t).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)]
        return b | {"runs": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows), "collapsed": left}

    def work(batches):
        for b in batches:
            at, texts, held = 0, [], 0
            for k, t in enumerate(b[text]):
                t = t.as_py()
                texts.append(t.encode("utf-8", "surrogatepass").split() if t else [])
                held += len(texts[-1])
                if held >= batch_words:
                    yield solve({n: c.slice(at, len(texts)) for n, c in b.items()}, texts)
                    at, texts, held = k + 1, [], 0
            if texts:
                yield solve({n: c.slice(at, len(texts)) for n, c in b.items()}, texts)

    return map_arrow(docs.select(*(f.name for f in kept)), schema, work)
