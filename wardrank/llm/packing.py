"""Best-fit packing of tokenized documents by hierarchical residual packing.

Partitions of bounded item counts pack locally, best fit in falling order of
length.  Bins whose free space is at most ``slack`` tokens are final; all
underfull ones become items of the next round, in as many partitions as they
fill (at most 1 / ``fan_in`` of those before), dealt anew, and are packed again
by best fit.  The tree ends with a single partition, or when a round has joined
fewer than one underfull bin in ``fan_in`` squared: any two bins of a partition
then hold more than the capacity together.  Nothing is dropped by that.

Tokenizing: byte-level BPE ids and an end id.  Documents longer than the
capacity are cut into pieces of exactly the capacity; the first piece takes
the remainder.

Defined cases: a null or empty text is the end id alone; equal lengths are
packed in the order of the items' ids; repeated documents are packed as often
as they occur; an empty table gives no rows; input columns named like an
added one are replaced.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, stored

#: Characters on whose classes the two BPE libraries' regex engines agree.
_PLAIN = regex.compile(r"[^\x00-\x7FÀ-ɏ]")


class BpeEncoder:
    """Ids of the byte-level BPE in the ``tokenizers`` file ``json_path``.

    ``ranks_path`` holds the same vocabulary as ranks; with it, texts of Latin
    letters take a faster library with the same result.  The files are read
    on the driver and travel with the task.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.json = Path(json_path).read_text(encoding="utf-8")
        self.ranks = Path(ranks_path).read_bytes() if ranks_path else None
        self.pattern = pattern
        self._slow = self._fast = None

    def __getstate__(self):
        return self.__dict__ | {"_slow": None, "_fast": None}

    def _exact(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.json)
            self._slow.encode_special_tokens = True  # their strings in a text are ordinary text
        return self._slow

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks and not _PLAIN.search(text):
            if self._fast is None:
                import tiktoken

                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
                self._fast = tiktoken.Encoding("bpe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return np.asarray(self._fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self._exact().encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(docs: DataFrame, encode: BpeEncoder, capacity: int = 2048, end_id: int = 0, text: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """A row per piece: ``id_col``, ``piece``, ``start``, ``length`` and
    ``ids`` (little-endian unsigned 32-bit ids)."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType),
                           *fields("piece int", "start long", "length long", "ids binary").fields])

    def cut(batches):
        for b in batches:
            ids, texts = b["_id"], b["_text"]
            for at in range(0, len(texts), 512):
                owner, piece, start, length, data = [], [], [], [], []
                for k, t in enumerate(texts.slice(at, 512).to_pylist(), at):
                    tokens = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
                    first = len(tokens) % capacity or capacity
                    edges = [0, *range(first, len(tokens) + 1, capacity)]
                    for i, (a, z) in enumerate(zip(edges, edges[1:])):
                        owner.append(k)
                        piece.append(i)
                        start.append(a)
                        length.append(z - a)
                        data.append(tokens[a:z].tobytes())
                yield {id_col: ids.take(pa.array(owner, pa.int64())), "piece": piece, "start": start,
                       "length": length, "ids": data}

    return map_arrow(source, schema, cut)


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) per item and fill per bin: each item, in the given order,
    goes to the open bin with the least sufficient space."""
    of, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set while a bin with s free tokens is open
    for i in order:
        n = int(lengths[i])
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, at = capacity, len(fill)
            fill.append(0)
        of[i], offset[i] = at, fill[at]
        fill[at] += n
        if space > n:
            by_space[space - n].append(at)
            spaces |= 1 << (space - n)
    return of, offset, np.array(fill, dtype=np.int64)


def _round(items: DataFrame, parts: int, number: int, capacity: int, slack: int) -> DataFrame:
    """Items (``_item``, ``_length``, payload) with ``_bin``, ``_offset``,
    ``_fill`` and ``_open``, packed within ``parts`` partitions."""
    items = items.repartition(parts, F.xxhash64(F.lit(number), "_item"))  # other neighbours every round
    schema = T.StructType([*items.schema.fields,
                           *fields("_bin long", "_offset long", "_fill long", "_open boolean").fields])

    def pack(batches):
        tables = [pa.table(b) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        lengths, ids = t["_length"].to_numpy(), t["_item"].to_numpy()
        of, offset, fill = best_fit(lengths, np.lexsort((ids, -lengths)), capacity)
        still_open = fill < capacity - slack
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        for a in range(0, len(of), 10_000):
            rows = slice(a, a + 10_000)
            part = t.slice(a, 10_000)
            yield {n: part[n] for n in t.column_names} | {
                "_bin": base + of[rows], "_offset": offset[rows], "_fill": fill[of[rows]],
                "_open": still_open[of[rows]]}

    return map_arrow(items, schema, pack)


def pack(pieces: DataFrame, length: str = "length", capacity: int = 2048, part_items: int = 50_000,
         fan_in: int = 8, slack: int = 16) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each
    sequence); no sequence is longer than ``capacity``."""
    payload = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    items = stored(pieces.select(*payload, F.monotonically_increasing_id().alias("_item"),
                                 F.col(length).cast("long").alias("_length")), "pieces")
    parts = max(1, -(-items.count() // part_items))
    first = stored(_round(items, parts, 0, capacity, slack), "packed")
    merges, level, number, before = [], first, 0, None
    while parts > 1:
        rest = level.where("_open and _offset = 0").select(F.col("_bin").alias("_item"), F.col("_fill").alias("_length"))
        n = rest.count()
        if not n or (before is not None and before - n < before / fan_in ** 2):
            break
        parts, number, before = max(-(-parts // fan_in), -(-n // part_items)), number + 1, n
        level = stored(_round(rest, parts, number, capacity, slack), "merged")
        merges.append(level.select(F.col("_item").alias("_from"), F.col("_bin").alias("_to"),
                                   F.col("_offset").alias("_shift")))
    final = None  # where the bins of the first round end up
    for merge in reversed(merges):
        if final is not None:
            onward = final.select(F.col("_from").alias("_to"), F.col("_to").alias("_to2"), F.col("_shift").alias("_shift2"))
            merge = merge.join(onward, "_to", "left").select(
                "_from", F.coalesce("_to2", "_to").alias("_to"),
                (F.col("_shift") + F.coalesce("_shift2", F.lit(0))).alias("_shift"))
        final = merge
    if final is None:
        placed = first.withColumn("_to", F.col("_bin")).withColumn("_shift", F.lit(0).cast("long"))
    else:
        placed = first.join(final, first["_bin"] == final["_from"], "left")
    return placed.select(*payload, F.coalesce("_to", "_bin").alias("sequence_id"),
                         (F.col("_offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))
