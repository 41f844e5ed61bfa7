"""Benchmark decontamination: a prefix-filtered set join with exact containment.

Items and documents are sequences of words.  A window is ``width``
consecutive words of an item (a shorter item is one window).  A window's set
is that of its word pairs (a one-word window has the word itself).
Containment of the whole set is asked for, so the necessary prefix of a
window, its shingles ordered by rarity in the documents, is one shingle: the
rarest.  A document position that holds that shingle is joined to the window;
the shingle's place in the window fixes the only possible start (positional
bound), which must leave room for the whole window (length bound); then all
words are compared.

The documents are never moved.  The items are taken in blocks of bounded
size; each block is sent to all tasks.  It gives one pass over the documents,
which counts its shingles; one more pass joins all blocks, one after the other,
so the cost grows in proportion to the blocks.

Defined cases: null and empty texts have no words and no hits; an item
without words has no windows; items with equal ids count once; a null item id
counts as the text ``""``; repeated documents are judged alike; empty tables
give no rows or no hits; input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_arrow, words_of

ADDED = fields("n_words long", "hit_spans array<int>", "item_ids array<string>")


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i:i + width] for i in range(max(1, len(words) - width + 1))]


def _shingles(words: list[bytes]) -> list[bytes]:
    return [a + b" " + b for a, b in zip(words, words[1:])] if len(words) > 1 else list(words)


def _count_shingles(docs: DataFrame, text: str, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the block's shingles in all documents."""
    single = any(b" " not in s for s in wanted)

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b[text].to_pylist():
                words = words_of(t)
                seen.update(filter(wanted.__contains__, [a + b" " + c for a, c in zip(words, words[1:])]))
                if single:
                    seen.update(filter(wanted.__contains__, words))
        yield {"shingle": list(seen), "n": list(seen.values())}

    parts = map_arrow(docs.select(text), fields("shingle binary", "n long"), count)
    return {bytes(s): n for s, n in parts.groupBy("shingle").agg(F.sum("n")).collect()}  # at most the block's shingles


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += (a, b)
    return flat


def _join_block(docs: DataFrame, source: DataFrame, text: str, block: list[tuple[str, list[bytes]]], width: int) -> DataFrame:
    """``docs`` joined with one more block, whose shingles are counted over the
    ``source`` of the documents: never through the joins of earlier blocks."""
    windows: dict[bytes, set[str]] = {}
    for item, words in block:
        for w in windows_of(words, width):
            windows.setdefault(b" ".join(w), set()).add(item)
    wanted = frozenset(s for w in windows for s in _shingles(w.split(b" ")))
    count = _count_shingles(source, text, wanted) if wanted else {}
    prefix: dict[bytes, set[tuple[int, int]]] = {}  # rarest shingle -> (place in the window, window's words)
    for w in windows:
        words = w.split(b" ")
        shingles = _shingles(words)
        at = min(range(len(shingles)), key=lambda i: (count.get(shingles[i], 0), shingles[i]))
        if count.get(shingles[at], 0):  # else no document can hold the window
            prefix.setdefault(shingles[at], set()).add((at, len(words)))
    single = any(b" " not in s for s in prefix)

    def join(batches):
        for b in batches:
            n, spans, items = [], b["hit_spans"].to_pylist(), b["item_ids"].to_pylist()
            for k, t in enumerate(b[text].to_pylist()):
                words = words_of(t)
                n.append(len(words))
                places = [(i, s) for i, s in enumerate([a + b" " + c for a, c in zip(words, words[1:])]) if s in prefix]
                if single:
                    places += [(i, w) for i, w in enumerate(words) if w in prefix]
                hits, found = [], set()
                for i, s in places:
                    for at, length in prefix[s]:
                        if i >= at and i - at + length <= len(words):
                            if owners := windows.get(b" ".join(words[i - at:i - at + length])):
                                hits.append((i - at, i - at + length))
                                found |= owners
                if hits:
                    old = spans[k]
                    spans[k] = _merged(hits + list(zip(old[::2], old[1::2])))
                    items[k] = sorted(found | set(items[k]))
            yield b | {"n_words": n, "hit_spans": spans, "item_ids": items}

    return map_arrow(docs, docs.schema, join)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (flat list: start, end, start,
    end ... of the merged word ranges that item windows cover) and ``item_ids``
    (sorted ids of the items with a window in the document).

    ``block_words`` bounds the words of one block of items, the only data sent
    to every task; a longer list of items takes more passes.
    """
    out = docs.drop(*ADDED.names).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_spans"),
        F.array().cast("array<string>").alias("item_ids"))
    block: list[tuple[str, list[bytes]]] = []
    held, blocks = 0, 0
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(item_text).cast("string"))
    for item, t in rows.toLocalIterator():  # one partition of items at a time
        words = words_of(t)
        if held and held + len(words) > block_words:
            out, block, held, blocks = _join_block(out, docs, text, block, width), [], 0, blocks + 1
        if words:
            block.append((item, words))
            held += len(words)
    return _join_block(out, docs, text, block, width) if block or not blocks else out


def hit_words(spans: str = "hit_spans"):
    """Number of words in the merged ranges."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda a, x: a + x)
