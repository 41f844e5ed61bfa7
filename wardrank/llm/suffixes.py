"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that
also starts anywhere else is removed.

1. Equal texts are reduced to one representative (all their bytes go, if the
   text has ``length`` bytes).
2. Routing.  Each start of a string of ``length`` bytes is owned by the lowest
   hash among the ``gram``-byte substrings of that string, so equal strings
   have equal owners.  Starts in a row with one owner form a run; a run whose
   owner occurs nowhere else holds no repeated string and is done.  The other
   runs are cut out of the texts.
3. Runs with equal bytes are repeated in every start.  Where an owner has
   several different runs, these go to a shard by owner, each shard bounded in
   bytes.  A shard's suffix array is built by Larsson-Sadakane refinement in
   numpy, its common prefixes by Kasai's algorithm, many lanes at a time;
   neighbours with ``length`` common bytes are repeated.
4. An owner with more runs than a shard holds has several shards.  They are
   merged by binary search: each gives the sorted fingerprints of its strings,
   cut into ranges; in each range every shard's strings are looked up among
   those of the others.
5. The repeated starts of a text give the removed ranges.

Defined cases: a null text is empty; texts shorter than ``length`` keep all
bytes; repeated rows are copies of each other; an empty table gives no rows;
bytes of a cut character are removed like any others (the kept bytes need not
be valid UTF-8).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, slices, stored, text_or_empty
from .jaccard import groups, mix

_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of every ``width``-byte substring."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _powers(pow(base, -1, 1 << 64), n - width + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block-wise running minima."""
    n = len(x)
    if n < width:
        return x[:0]
    grid = np.concatenate([x, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def owner_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first start, weight) of the runs of starts with one owner; the
    weight is 2 if the owner occurs more than once in the text."""
    h = window_hashes(data, gram)
    width = length - gram + 1
    low = sliding_min(h, width)
    if not len(low):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    # a place owns a start if its hash is the greatest of the minima around it
    edge = np.full(width - 1, ~np.uint64(0))
    owns = h == ~sliding_min(np.concatenate([edge, ~low, edge]), width)
    values, times = np.unique(h[owns], return_counts=True)
    owner = low[first]
    return owner, first, np.where(times[np.searchsorted(values, owner)] > 1, 2, 1)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by Larsson-Sadakane refinement.

    Suffixes are grouped by their first h bytes (8 at first); each round sorts
    within the groups of more than one by the group h bytes on, which doubles
    h.  Sorted groups are not touched again.
    """
    n = len(data)
    small = np.int32 if n < 1 << 31 else np.int64
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + n]
    order = np.argsort(word, kind="stable").astype(small)
    key = word[order]
    del word
    active = np.arange(n, dtype=small)
    rank = np.empty(n + 1, small)
    rank[n] = -1
    h = 8
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        if h == 8:  # of equal padded words at the end of the text the shorter come first
            short = np.minimum(n - order, 8)
            group = np.cumsum(head, dtype=small)
            if (short < 8).any():
                sub = np.lexsort((short, group))
                order, short, group = order[sub], short[sub], group[sub]
                head = np.concatenate([[True], (group[1:] != group[:-1]) | (short[1:] != short[:-1])])
            del short, group
        start = active[np.maximum.accumulate(np.where(head, np.arange(len(head), dtype=small), 0))]
        rank[order[active]] = start
        alone = head & np.concatenate([head[1:], [True]])
        active = active[~alone]
        if not len(active):
            return order
        pos = order[active]
        key = rank[pos] * np.int64(n + 1) + rank[np.minimum(pos.astype(np.int64) + h, n)] + 1
        sub = np.argsort(key, kind="stable")
        order[active] = pos[sub]
        key = key[sub]
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, lane: int = 64) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in the order.

    Going from a suffix to the next place in the text loses at most one byte
    of the common prefix.  The text is cut into lanes that advance together;
    bytes are compared eight at a time.
    """
    n = len(data)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(n + 8, np.uint64)
    for j in range(8):
        word |= padded[j:j + n + 8].astype(np.uint64) << np.uint64(8 * j)
    out = np.zeros(n, order.dtype)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for t in range(min(lane, n)):
        p = starts + t
        if p[-1] >= n:
            starts, h, p = starts[:-1], h[:-1], p[:-1]
            if not len(p):
                break
        q = before[p].astype(np.int64)
        h = np.where(q >= 0, np.maximum(h - 1, 0), 0)
        open_ = np.flatnonzero(q >= 0)
        while len(open_):
            a, b = p[open_] + h[open_], q[open_] + h[open_]
            inside = (a < n) & (b < n)
            open_, a, b = open_[inside], a[inside], b[inside]
            differ = word[a] ^ word[b]
            bit = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.frexp(bit.astype(np.float64))[1] - 1) >> 3)
            same = np.minimum(same, np.minimum(n - a, n - b))
            h[open_] += same
            open_ = open_[same == 8]
        out[p] = h
    return out


def _spans(flags: np.ndarray) -> np.ndarray:
    """(start, end) pairs, flat, of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))


class _Shard:
    """Classes of equal strings among the runs of one shard."""

    def __init__(self, contents: list[bytes], length: int):
        size = np.array([len(c) for c in contents], dtype=np.int64)
        self.offset = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(contents), np.uint8)
        n = len(self.data)
        valid = np.zeros(n + 1, np.int32)  # starts whose whole string lies in one run
        np.add.at(valid, self.offset, 1)
        np.add.at(valid, self.offset + np.maximum(size - length + 1, 0), -1)
        valid = np.cumsum(valid)[:-1] > 0
        order = suffix_array(self.data)
        prefix = common_prefixes(self.data, order)[order]
        klass = np.cumsum(prefix < length, dtype=order.dtype)  # numbers along the order
        inside = valid[order]
        members = np.bincount(klass[inside], minlength=int(klass[-1]) + 1 if n else 1)
        self.repeated = np.zeros(n, bool)
        self.repeated[order[inside]] = members[klass[inside]] > 1
        first = np.unique(klass[inside], return_index=True)[1]
        self.classes = order[inside][first]  # a start of each class, in suffix order
        self.length, self.size = length, size

    def spans(self, k: int) -> np.ndarray:
        a = self.offset[k]
        return _spans(self.repeated[a:a + self.size[k]])


def _cut_runs(texts: DataFrame, length: int) -> DataFrame:
    """A row per candidate run: rep, start, n (starts), owner, two content
    hashes and the bytes."""
    def cut(batches):
        for b in slices(batches, 64):
            rows = []
            for rep, text, wanted in zip(b["rep"].to_pylist(), b["_text"].to_pylist(), b["runs"].to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                for r in wanted:
                    content = data[r["start"]:r["start"] + r["n"] + length - 1]
                    digest = hashlib.blake2b(content, digest_size=16).digest()
                    rows.append((rep, r["start"], r["n"], r["owner"], int.from_bytes(digest[:8], "little", signed=True),
                                 int.from_bytes(digest[8:], "little", signed=True), content))
            names = ("rep", "start", "n", "owner", "c1", "c2", "content")
            yield dict(zip(names, map(list, zip(*rows)), strict=True)) if rows else {n: [] for n in names}

    return map_arrow(texts, fields("rep long", "start long", "n long", "owner long", "c1 long", "c2 long", "content binary"), cut)


def _shard_results(mixed: DataFrame, length: int, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """From rows (shard, ranges, owner, c1, c2, content): the repeated starts
    of each content, and the strings of owners that have several shards."""
    schema = fields("owner long", "c1 long", "c2 long", "spans array<int>", "cell long", "strings binary")
    dtype = np.dtype([("f1", "<u8"), ("f2", "<u8"), ("single", "?"), ("c1", "<i8"), ("c2", "<i8"), ("start", "<i4")])

    def solve(batches):
        for t in groups(batches, "shard"):
            shard = _Shard(t["content"].to_pylist(), length)
            owner, c1, c2 = (t[c].to_pylist() for c in ("owner", "c1", "c2"))
            spans = [shard.spans(k).tolist() for k in range(t.num_rows)]
            none = [None] * len(owner)
            yield {"owner": owner, "c1": c1, "c2": c2, "spans": spans, "cell": none, "strings": none}
            ranges = t["ranges"][0].as_py()
            if ranges > 1:
                at = shard.classes
                rows = np.zeros(len(at), dtype)
                rows["f1"] = window_hashes(shard.data, length)[at]
                rows["f2"] = window_hashes(shard.data, length, _BASE2)[at]
                rows["single"] = ~shard.repeated[at]
                k = np.searchsorted(shard.offset, at, "right") - 1
                rows["c1"], rows["c2"], rows["start"] = np.array(c1)[k], np.array(c2)[k], at - shard.offset[k]
                rows = rows[np.lexsort((rows["f2"], rows["f1"]))]
                part = rows["f1"] % np.uint64(ranges)
                for r in range(ranges):
                    yield {"owner": [owner[0]], "c1": [0], "c2": [0], "spans": [None],
                           "cell": [int(mix(np.array([owner[0]], np.int64).view(np.uint64) + np.uint64(r)).view(np.int64)[0])],
                           "strings": [rows[part == r].tobytes()]}

    solved = stored(map_arrow(mixed.repartition(n_shards, "shard").sortWithinPartitions("shard", "owner", "c1", "c2"), schema, solve), "shards")

    def merge(batches):
        for t in groups(batches, "cell"):
            parts = [np.frombuffer(s, dtype) for s in t["strings"].to_pylist()]
            every = np.concatenate(parts)
            every = every[np.lexsort((every["f2"], every["f1"]))]
            for part in parts:  # binary search of each shard's strings among all shards'
                lo = np.searchsorted(every["f1"], part["f1"], "left")
                hi = np.searchsorted(every["f1"], part["f1"], "right")
                hits = np.zeros(len(part), np.int64)
                for step in range(int((hi - lo).max()) if len(part) else 0):
                    at = np.minimum(lo + step, len(every) - 1)
                    hits += (lo + step < hi) & (every["f2"][at] == part["f2"])
                found = part[(hits > 1) & part["single"]]  # itself and one in another shard
                yield {"owner": [t["owner"][0].as_py()] * len(found), "c1": found["c1"], "c2": found["c2"],
                       "spans": [[int(s), int(s) + 1] for s in found["start"]]}

    out = fields("owner long", "c1 long", "c2 long", "spans array<int>")
    local = solved.where("cell is null").select("owner", "c1", "c2", "spans")
    cells = solved.where("cell is not null").select("cell", "owner", "strings")
    return local, map_arrow(cells.repartition("cell").sortWithinPartitions("cell"), out, merge)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400, gram: int = 128,
                   shard_bytes: int = 1 << 20) -> DataFrame:
    """A row per document: the id, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``spans`` (flat, of removed bytes; null if none), ``kept`` (remaining bytes
    where some were removed and some kept, else null), ``kept_sha256``.

    ``docs`` is read twice and must be a stored table.
    """
    keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("_text")).select(
        "id", "_text", F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), "_text").alias("b"),
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"))
    source = keyed.select("*", F.octet_length("_text").cast("long").alias("n_bytes"),
                          F.sha2(F.col("_text").cast("binary"), 256).alias("sha"))
    keep = ["id", "a", "b", "k", "n_bytes", "sha"]

    def own(batches):
        for b in slices(batches, 1000):
            owners, starts, weights = [], [], []
            for t in b["_text"].to_pylist():
                o, s, w = owner_runs(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), length, gram)
                owners.append(o.view(np.int64).tolist())
                starts.append(s.tolist())
                weights.append(w.tolist())
            yield {c: b[c] for c in keep} | {"owners": owners, "starts": starts, "weights": weights}

    schema = source.select(*keep).schema
    owned = stored(map_arrow(source, T.StructType([*schema.fields, *fields(
        "owners array<long>", "starts array<int>", "weights array<int>").fields]), own), "owners")
    texts = stored(owned.groupBy("a", "b").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("rep", F.monotonically_increasing_id()), "texts")

    # one row of each text; repeated rows (equal id and text) give one as well
    first = owned.join(texts, ["a", "b", "k"]).select("a", "b", "k", "rep", "n_bytes", "owners", "starts", "weights")
    runs = first.dropDuplicates(["a", "b", "k"]).select(
        "a", "b", "k", "rep", F.explode(F.expr(
            "transform(owners, (o, i) -> named_struct('owner', o, 'start', cast(starts[i] as bigint), "
            f"'n', cast(if(i + 1 < size(owners), starts[i + 1], n_bytes - {length} + 1) as bigint) - starts[i], "
            "'weight', weights[i]))")).alias("r")).select("a", "b", "k", "rep", "r.*")
    runs = stored(runs, "runs")
    twice = runs.groupBy("owner").agg(F.sum("weight").alias("times")).where("times > 1").select("owner")
    wanted = (runs.join(twice, "owner").groupBy("a", "b", "k", "rep")
              .agg(F.collect_list(F.struct("start", "n", "owner")).alias("runs")))
    held = stored(keyed.join(wanted.hint("merge"), ["a", "b", "k"]).dropDuplicates(["a", "b", "k"])
                  .select("rep", "_text", "runs"), "held")
    cut = stored(_cut_runs(held, length), "cut")

    contents = stored(cut.groupBy("owner", "c1", "c2").agg(
        F.count(F.lit(1)).alias("times"), F.first("content").alias("content")), "contents")
    size = F.length("content")
    owners = contents.groupBy("owner").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size).alias("bytes"), F.sum(
        F.when((F.col("times") == 1), size).otherwise(0)).alias("open_bytes"),
        F.max(size).alias("longest"))
    # several kinds, or one long enough to repeat a string within itself
    mixed = stored(contents.join(owners.where("open_bytes > 0"), "owner")
                   .select("owner", "c1", "c2", "content", "bytes"), "mixed")
    total = mixed.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_bytes))
    parts = F.ceil(F.col("bytes") / shard_bytes).cast("int")
    mixed = mixed.select(
        "owner", "c1", "c2", "content", parts.alias("ranges"),
        F.when(parts > 1, F.xxhash64("owner", F.pmod(F.xxhash64("c1", "c2"), parts)))
        .otherwise(F.pmod(F.xxhash64("owner"), F.lit(n_shards))).alias("shard"))
    local, across = _shard_results(mixed, length, n_shards)
    known = local.unionByName(across).where(F.size("spans") > 0)

    whole = (cut.join(contents.where("times > 1").select("owner", "c1", "c2"), ["owner", "c1", "c2"])
             .select("rep", F.array(F.col("start"), F.col("start") + F.col("n")).alias("starts")))
    partly = cut.select("rep", "start", "owner", "c1", "c2").join(known, ["owner", "c1", "c2"]).select(
        "rep", F.transform("spans", lambda x: x + F.col("start")).alias("starts"))
    spans = stored(whole.unionByName(partly).groupBy("rep").agg(F.collect_list("starts").alias("starts")), "spans")

    def remove(batches):
        for b in slices(batches, 200):
            flat, kept, sha = [], [], []
            for t, lists in zip(b["_text"].to_pylist(), b["starts"].to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                hit = np.zeros(len(data) + 1, np.int32)
                for s in lists:
                    np.add.at(hit, s[::2], 1)
                    np.add.at(hit, np.array(s[1::2], np.int64) + length - 1, -1)
                edges = _spans(np.cumsum(hit)[:-1] > 0)
                rest = b"".join(data[x:y] for x, y in zip([0, *edges[1::2]], [*edges[::2], len(data)]))
                flat.append(edges.tolist())
                kept.append(rest)
                sha.append(hashlib.sha256(rest).hexdigest())
            yield {"rep": b["rep"], "spans": flat, "kept": kept, "kept_sha": sha}

    removed = stored(map_arrow(held.select("rep", "_text").join(spans, "rep"), fields(
        "rep long", "spans array<int>", "kept binary", "kept_sha string"), remove), "removed")
    told = texts.select("a", "b", "copies", "rep").join(removed, "rep", "left").drop("rep")
    rows = owned.select("id", "a", "b", "n_bytes", "sha").join(told, ["a", "b"])
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    whole_span = F.array(F.lit(0), F.col("n_bytes").cast("int"))
    out = rows.select(
        F.col("id").alias(id_col), "n_bytes", F.when(gone, whole_span).otherwise(F.col("spans")).alias("spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"), "a", "b")
    n = F.aggregate(F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                    F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(id_col, "n_bytes", F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"),
                      "spans", "kept", "kept_sha256", "a", "b")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text (and what is
    left of a cut character); ``n_chars``, where there is one, follows."""
    found = repeated_spans(docs, id_col, text, **options).where("n_removed > 0")
    changed = found.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), "a", "b", "kept").dropDuplicates(["k", "a", "b"])

    def decode(batches):
        for b in batches:
            yield b | {"kept": [x.decode("utf-8", "ignore") for x in b["kept"].to_pylist()]}

    schema = T.StructType([*changed.schema.fields[:3], T.StructField("kept", T.StringType())])
    # the document is one column, whatever its own columns are called
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"),
                        F.xxhash64(text_or_empty(text)).alias("a"), F.xxhash64(F.lit(1), text_or_empty(text)).alias("b"))
    out = keyed.join(map_arrow(changed, schema, decode).hint("merge"), ["k", "a", "b"], "left")
    new = {text: F.coalesce("kept", F.col("doc")[text])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNull(), F.col("doc")["n_chars"]).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
