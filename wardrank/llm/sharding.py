"""Sharding by histogram sort: equal bytes per shard, rows moved once.

Rows are ordered by a 128-bit key.  The splitters between shards are found
without sorting: each round counts, in every partition, the exact bytes and
rows between a set of candidate keys (probes); the sums close in on each
splitter until the bytes below it are within the tolerance, or only one row
is left between the two nearest probes.  Then one exchange brings the rows to
their cells.  A shard consists of one or more cells.  Their number is bounded,
as the driver keeps their borders, so the cells of a large table are dealt by
a hash into pieces of bounded bytes; no task ever holds a whole shard, nor all
copies of a hot value.  The exact row counts below the cell borders, and a
table of the rows of each piece, make the slots of a shard gapless.

The key's first half is a hash of the grouping value (equal texts are
neighbours), the second half a hash of the id plus bits of the row id.  So a
value that a third of all rows share is cut between its rows, and rows that
are equal in all columns still differ in key.

Defined cases: null or empty grouping values hash like any other value; null
sizes count 0; an empty table gives no rows; columns of the input named like
an added one (``shard``, ``slot``) are replaced, all others keep their values.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, stored

_TOP = 1 << 128
_FLIP = np.uint64(1 << 63)


def _unsigned(a) -> np.ndarray:
    """Signed 64-bit Arrow column as order-preserving unsigned numbers."""
    return np.asarray(a.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64) ^ _FLIP


def _split(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([k >> 64 for k in keys], dtype=np.uint64),
            np.array([k & ((1 << 64) - 1) for k in keys], dtype=np.uint64))


def _cell(h: np.ndarray, u: np.ndarray, ph: np.ndarray, pu: np.ndarray) -> np.ndarray:
    """Number of probes (ph, pu), sorted, that are <= each key (h, u)."""
    lo, hi = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    cell = lo.astype(np.int64)
    tied = np.flatnonzero(lo < hi)  # the first half equals that of a probe
    for value in np.unique(h[tied]):
        rows = tied[h[tied] == value]
        a, b = lo[rows[0]], hi[rows[0]]
        cell[rows] = a + np.searchsorted(pu[a:b], u[rows], "right")
    return cell


def _histogram(keyed: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""
    ph, pu = _split(probes)
    n = len(probes) + 1

    def count(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            cell = _cell(_unsigned(b["_h"]), _unsigned(b["_u"]), ph, pu)
            np.add.at(size, cell, b["_size"].to_numpy(zero_copy_only=False).astype(np.int64))
            rows += np.bincount(cell, minlength=n)
        full = np.flatnonzero(rows)
        yield {"cell": full, "size": size[full], "n": rows[full]}

    parts = map_arrow(keyed.select("_h", "_u", "_size"), fields("cell long", "size long", "n long"), count)
    size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for cell, s, r in parts.groupBy("cell").agg(F.sum("size"), F.sum("n")).collect():  # at most one row a probe
        size[cell], rows[cell] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def find_splitters(keyed: DataFrame, targets: list[int], total: tuple[int, int], tolerance: list[int],
                   probes: int = 64) -> list[tuple[int, int]]:
    """(key, rows below it) per target number of bytes, in ascending order.

    A splitter is accepted when the bytes below it differ from the target by
    at most its tolerance, or when a single row lies between its bounds; then
    the nearer bound is taken.
    """
    low = [(0, 0, 0) for _ in targets]  # key, bytes below, rows below
    high = [(_TOP, *total) for _ in targets]
    chosen: list[tuple[int, int] | None] = [None] * len(targets)
    first = True
    while any(c is None for c in chosen):
        asked = {k * _TOP // (probes * (len(targets) + 1)) for k in range(1, probes * (len(targets) + 1))} if first else set()
        for (a, *_), (b, *_), c in zip(low, high, chosen, strict=True):
            if c is None and not first:
                asked |= {a + (b - a) * j // (probes + 1) for j in range(1, probes + 1)}
        first = False
        asked = sorted(k for k in asked if 0 < k < _TOP)
        sizes, rows = (x.tolist() for x in _histogram(keyed, asked))
        for i, target in enumerate(targets):
            if chosen[i] is not None:
                continue
            at = bisect_right(sizes, target)  # bytes below rise with the key
            if at and asked[at - 1] > low[i][0]:
                low[i] = (asked[at - 1], sizes[at - 1], rows[at - 1])
            if at < len(asked) and asked[at] < high[i][0]:
                high[i] = (asked[at], sizes[at], rows[at])
            a, b = low[i], high[i]
            near = a if target - a[1] <= b[1] - target else b
            if abs(near[1] - target) <= tolerance[i] or b[2] - a[2] <= 1 or b[0] - a[0] <= 1:
                chosen[i] = (near[0], near[2])
    keys: list[tuple[int, int]] = []
    for c in chosen:  # a row larger than a shard can make two splitters meet
        keys.append(max(c, keys[-1]) if keys else c)
    return keys


def shard_by_bytes(df: DataFrame, n_shards: int, size: Column, group: Column, row_id: Column,
                   tolerance: float = 0.001, cell_bytes: int = 64 << 20, max_cells: int = 4096) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0).

    ``tolerance`` is the accepted error of a shard border as a share of the
    ideal shard size; a border is never further off than one row.
    ``cell_bytes`` is about what one task gets at a time.  Of more bytes than
    ``max_cells`` such cells, which bounds the splitters on the driver, every
    cell consists of as many pieces as it takes.
    """
    payload = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in payload))
    placed = place_rows(df, row, n_shards, size, group, row_id, tolerance, cell_bytes, max_cells)
    order = Window.partitionBy("_cell", "_piece").orderBy("_h", "_u")
    return (placed.withColumn("slot", F.col("_base") + F.row_number().over(order) - 1)
            .select("_row.*", "shard", "slot"))


def place_rows(df: DataFrame, row: Column, n_shards: int, size: Column, group: Column, row_id: Column,
               tolerance: float, cell_bytes: int, max_cells: int) -> DataFrame:
    """``row`` as ``_row``, its key, ``shard``, ``_cell``, ``_piece`` of the
    cell, and ``_base``: the rows of the shard that lie before the piece."""
    bits = (1 << 20) - 1
    keyed = stored(df.select(
        row.alias("_row"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
        F.xxhash64(group).alias("_h"),
        (F.xxhash64(row_id).bitwiseAND(F.lit(~bits))
         .bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(bits)))).alias("_u"),
    ), "sharding")
    total = tuple(keyed.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first())
    per = max(1, min(-(-total[0] // (n_shards * cell_bytes)), max_cells // n_shards))
    n_cells = n_shards * per
    targets = [total[0] * k // n_cells for k in range(1, n_cells)]
    ideal = total[0] / n_shards
    allowed = [int(ideal * tolerance) if k % per == 0 else int(ideal / per / 4) for k in range(1, n_cells)]
    cuts = find_splitters(keyed, targets, total, allowed) if total[1] else [(0, 0)] * (n_cells - 1)

    ph, pu = _split([k for k, _ in cuts])
    starts = np.array([0, *(r for _, r in cuts)], dtype=np.int64)
    shard_of = np.arange(n_cells) // per
    base = starts - starts[shard_of * per]

    def place(batches):
        for b in batches:
            cell = _cell(_unsigned(b["_h"]), _unsigned(b["_u"]), ph, pu)
            yield b | {"_cell": cell, "shard": shard_of[cell], "_start": base[cell]}

    def placed(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, *fields("_cell long", "shard int", "_start long").fields])
        # _u differs between the rows of a hot value, and between copies of a row
        return map_arrow(rows, schema, place).withColumn("_piece", F.pmod(F.xxhash64("_u"), F.lit(pieces)))

    pieces = max(1, -(-total[0] // (n_cells * cell_bytes)))
    before = Window.partitionBy("_cell").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed(keyed.select("_h", "_u")).groupBy("_cell", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = stored(counts.select("_cell", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
                     "sharding-pieces")
    return (placed(keyed).join(earlier, ["_cell", "_piece"])
            .withColumn("_base", F.col("_start") + F.col("_before")))
