"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles (five words, lower-cased).  Equal texts
are joined once, through one representative.  Every set is embedded in
``places`` MinHash values; two embedded sets agree in a place with the
probability of their Jaccard similarity.

Chosen path: a run starts with ``branch`` places; at each of them the sets
split by their value there.  A bucket with one set is dropped, one with at most
``small`` sets is compared by brute force, a larger one is split again at
``branch`` places chosen by the bucket's path - unless its sets agree so often
at these places that splitting would not part them; then it is compared at
once.  A pair at the threshold stays together in a run with at least the
survival probability of this branching process; runs are repeated until the
missed share is below ``1 - recall``.

Brute force works on tiles (two blocks of a bucket's sets, bounded in sets and
shingles): agreements of the embedded values first, exact Jaccard of the
shingle sets for the pairs that pass.  A pair that several buckets hold is
counted in the smallest of them only.  Tiles give numbers of links and
spanning edges, never a row per pair; components of the edges are the classes.

Defined cases: null, empty and word-less texts are sets without shingles and
link to nothing, not even to each other; texts of fewer than five words have
their words as one shingle; ties and repeated rows are copies and link; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_arrow, stored, words_of
from .graph import components

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words_of(text)), dtype=np.uint64)
    n = max(1, len(h) - width + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(h))):
        out = mix(out * _C + h[j:j + n])
    return np.unique(out)


def minhash(shingles: np.ndarray, places: int, seed: int = 7) -> np.ndarray:
    rng = np.random.RandomState(seed)
    a = rng.randint(0, 1 << 31, places).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.randint(0, 1 << 31, places).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(places, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        out = np.minimum(out, (x[None, k:k + 4096] * a[:, None] + b[:, None]).min(axis=1))
    return out


def runs_needed(threshold: float, branch: int, recall: float, places: int = 64) -> int:
    """Runs until a pair at the threshold is missed with at most 1 - recall.

    All runs draw from the same ``places`` values of a pair, which agree in a
    binomial number of places.  Given their share, one run loses the pair with
    the extinction probability of a branching process in which each of
    ``branch`` children survives with that probability.
    """
    number = range(places + 1)
    weight = np.array([math.comb(places, k) * threshold ** k * (1 - threshold) ** (places - k) for k in number])
    share, lost = np.array(number) / places, np.zeros(places + 1)
    for _ in range(200):
        lost = (1 - share + share * lost) ** branch
    for runs in range(1, 1000):
        if (weight * lost ** runs).sum() <= 1 - recall:
            return runs
    raise ValueError("this recall needs more branches or places")


def _root_paths(values: np.ndarray, runs: int, branch: int) -> np.ndarray:
    places = np.random.RandomState(11).permutation(values.shape[1])
    chosen = np.resize(places, runs * branch)
    start = mix(np.arange(1, runs * branch + 1, dtype=np.uint64) * _C)
    return mix(start[None, :] ^ mix(values[:, chosen].astype(np.uint64)))


def _child_paths(path: np.ndarray, values: np.ndarray, branch: int) -> np.ndarray:
    out = np.empty((len(path), branch), np.uint64)
    for j in range(branch):
        start = mix(path + np.uint64((j + 1) * int(_C) % (1 << 64)))
        place = (start % np.uint64(values.shape[1])).astype(np.int64)
        out[:, j] = mix(start ^ mix(values[np.arange(len(path)), place].astype(np.uint64)))
    return out


def _values(column, places: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, places)


def groups(batches: Iterator[dict], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key, from batches sorted by it."""
    carry = None
    for b in batches:
        t = pa.table(b)
        t = pa.concat_tables([carry, t]) if carry is not None else t
        k = t[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            yield t.slice(a, z - a)
        carry = t.slice(cuts[-1]) if t.num_rows else carry
    if carry is not None and carry.num_rows:
        yield carry


def _final_buckets(reps: DataFrame, places: int, branch: int, runs: int, small: int, dense: float,
                   max_depth: int) -> DataFrame:
    """(bucket, rep) of the buckets to compare by brute force."""
    def roots(batches):
        for b in batches:
            paths = _root_paths(_values(b["mh"], places), runs, branch)
            yield {"path": paths.ravel().view(np.int64), "rep": b["rep"].to_numpy().repeat(paths.shape[1])}

    def children(batches):
        for b in batches:
            paths = _child_paths(b["path"].to_numpy().view(np.uint64), _values(b["mh"], places), branch)
            for j in range(branch):
                yield {"parent": b["path"], "child": paths[:, j].view(np.int64), "place": [j] * len(paths), "rep": b["rep"]}

    def sized(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return stored(rows.join(sizes, "path").select("path", "rep", "n"), "buckets")

    level = sized(map_arrow(reps.where("size > 0").select("rep", "mh"), fields("path long", "rep long"), roots))
    done = level.where(F.col("n") <= small).select(F.col("path").alias("bucket"), "rep")
    for _ in range(max_depth):
        large = level.where(F.col("n") > small)
        if large.isEmpty():
            return done
        split = stored(map_arrow(large.join(reps.select("rep", "mh"), "rep").select("path", "rep", "mh"),
                                 fields("parent long", "child long", "place int", "rep long"), children), "split")
        # a row per bucket: what the split decides, and which of its rows go on
        parts = stored(split.groupBy("parent", "place", "child").agg(F.count(F.lit(1)).alias("n")), "parts")
        agree = (parts.groupBy("parent", "place").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("share"))
                 .groupBy("parent").agg(F.min("share").alias("share")))
        kept = stored(agree.where(F.col("share") >= dense).select("parent"), "dense")
        done = done.unionByName(large.join(kept, F.col("path") == F.col("parent"), "left_semi")
                                .select(F.col("path").alias("bucket"), "rep"))
        further = parts.where("n > 1").join(kept, "parent", "left_anti").select(F.col("child").alias("path"), "n")
        level = stored(split.select(F.col("child").alias("path"), "rep").join(further, "path").select("path", "rep", "n"), "buckets")
        done = done.unionByName(level.where(F.col("n") <= small).select(F.col("path").alias("bucket"), "rep"))
    return done.unionByName(level.where(F.col("n") > small).select(F.col("path").alias("bucket"), "rep"))


def _tiles(final: DataFrame, reps: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """(tile, bucket, rep, side): side 0 or 1 in a tile of two blocks, 2 in a
    tile of one block, where all pairs count."""
    sized = final.join(reps.select("rep", "size"), "rep")
    blocks = (sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
              .select("bucket", F.greatest(F.lit(1), F.ceil(F.col("n") / block_sets),
                                           F.least(F.col("n"), F.ceil(F.col("shingles") / block_shingles))).cast("int").alias("g")))
    own = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    placed = (final.join(blocks, "bucket").withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))))
    return placed.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "bucket", "rep",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))


def _pair_mask(side: np.ndarray) -> np.ndarray:
    n = len(side)
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    return (i < j) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))


def _candidates(tiles: DataFrame, reps: DataFrame, places: int, threshold: float, slack: float) -> DataFrame:
    """(tile, rep, partners) for the members of pairs whose embedded values
    agree often enough, each pair in its smallest common bucket."""
    need = math.ceil(places * (threshold - slack))
    buckets = tiles.groupBy("rep").agg(F.collect_set("bucket").alias("buckets"))
    rows = (tiles.join(buckets, "rep").join(reps.select("rep", "size", "mh"), "rep")
            .repartition("tile").sortWithinPartitions("tile", "rep"))

    def compare(batches):
        for t in groups(batches, "tile"):
            if t.num_rows < 2:
                continue
            rep, side, size = (t[c].to_numpy() for c in ("rep", "side", "size"))
            low = _values(t["mh"], places).astype(np.uint8)
            ok = _pair_mask(side) & (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9)
            if not ok.any():
                continue
            agree = np.zeros(ok.shape, np.uint16)
            for k in range(places):
                agree += low[:, k, None] == low[None, :, k]
            ok &= agree >= need
            if not ok.any():
                continue
            bucket = t["bucket"][0].as_py()
            member: dict[int, list[int]] = {}
            for i, ids in enumerate(t["buckets"].to_pylist()):
                for b in ids:
                    if b < bucket:
                        member.setdefault(b, []).append(i)
            for rows_of in member.values():  # pairs that belong to a smaller bucket
                if len(rows_of) > 1:
                    ok[np.ix_(rows_of, rows_of)] = False
            used = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            if len(used):
                yield {"tile": t["tile"].to_numpy()[used], "rep": rep[used],
                       "partners": [rep[np.flatnonzero(ok[i])].tolist() for i in used]}

    return map_arrow(rows, fields("tile long", "rep long", "partners array<long>"), compare)


def _exact(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root): documents linked to the representative in the tile,
    and an edge to the root of its component in the tile."""
    rows = candidates.join(sets, "rep").repartition("tile").sortWithinPartitions("tile", "rep")

    def verify(batches):
        for t in groups(batches, "tile"):
            rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
            sets_of = [np.frombuffer(s, "<u8") for s in t["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets_of])
            at = {int(r): i for i, r in enumerate(rep)}
            token, column = np.unique(np.concatenate(sets_of), return_inverse=True)
            common = None
            if len(rep) * len(token) <= 20_000_000 and len(rep) > 8:
                grid = np.zeros((len(rep), len(token)), np.float32)
                grid[np.repeat(np.arange(len(rep)), size), column] = 1
                common = grid @ grid.T
            links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
            for i, partners in enumerate(t["partners"].to_pylist()):
                for j in (at[p] for p in partners):
                    if common is not None:
                        both = int(common[i, j])
                    else:
                        both = len(np.intersect1d(sets_of[i], sets_of[j], assume_unique=True))
                    if both >= threshold * (size[i] + size[j] - both) - 1e-9:
                        links[i] += copies[j]
                        links[j] += copies[i]
                        a, b = i, j
                        while root[a] != a:
                            a = root[a]
                        while root[b] != b:
                            b = root[b]
                        root[max(a, b)] = min(a, b)
            for i in range(len(rep)):
                root[i] = root[root[i]]
            found = np.flatnonzero(links)
            if len(found):
                yield {"rep": rep[found], "links": links[found], "root": rep[root[found]]}

    return map_arrow(rows, fields("rep long", "links long", "root long"), verify)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5,
                 recall: float = 0.9999, places: int = 64, branch: int = 2, small: int = 64, dense: float = 0.4,
                 slack: float = 0.25, max_depth: int = 12, block_sets: int = 512,
                 block_shingles: int = 1 << 20) -> DataFrame:
    """A row per document: the id, ``row`` (number of the row in ``docs``),
    ``a`` and ``b`` (hashes of the text),
    ``class_row`` (the row that stands for its class), ``class_id`` (the lowest
    id of the class), ``class_size`` and ``n_links`` (documents, copies
    included, with a similarity of at least ``threshold``).

    ``docs`` is read twice and must be a stored table.  ``max_depth`` ends the
    splitting; buckets that are still large then are compared in tiles.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("_text"),
                        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
                        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"))
    source = keyed.withColumn("row", F.monotonically_increasing_id())

    def embed(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b["_text"].to_pylist()]
            yield {c: b[c] for c in ("id", "row", "a", "b", "k")} | {
                "size": [len(s) for s in sets], "mh": [minhash(s, places).tobytes() for s in sets]}

    schema = source.drop("_text").schema
    embedded = stored(map_arrow(source, type(schema)([*schema.fields, *fields("size long", "mh binary").fields]), embed), "embedded")
    firsts = embedded.groupBy("a", "b").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low_id"), F.min("k").alias("k"))
    reps = stored(firsts.join(embedded.select("row", "size", "mh"), F.col("rep") == F.col("row")).drop("row"), "reps")
    final = stored(_final_buckets(reps, places, branch, runs_needed(threshold, branch, recall, places), small, dense, max_depth), "final")
    candidates = stored(_candidates(_tiles(final, reps, block_sets, block_shingles), reps, places, threshold, slack), "candidates")

    wanted = candidates.select("rep").distinct().join(reps.select("rep", "a", "b", "k", "copies"), "rep")

    def reread(batches):
        for b in batches:
            yield {"rep": b["rep"], "copies": b["copies"],
                   "shingles": [shingle_set(t, width).astype("<u8").tobytes() for t in b["_text"].to_pylist()]}

    # the key holds the id: of many copies of a text only one is moved
    texts = keyed.select("a", "b", "k", "_text").join(wanted.hint("merge"), ["a", "b", "k"]).dropDuplicates(["a", "b", "k"])
    sets = map_arrow(texts.select("rep", "copies", "_text"), fields("rep long", "copies long", "shingles binary"), reread)
    linked = stored(_exact(candidates, sets, threshold), "links")

    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (reps.select("rep", "a", "b", "copies", "low_id", "size").join(links, "rep", "left")
             .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("root", F.coalesce("root", "rep"))
             # texts without words are alike but not linked: each row stands for itself
             .withColumn("alone", F.col("size") == 0))
    known = stored(known, "classes")
    classes = known.where("not alone").groupBy("root").agg(F.min("low_id").alias("class_id"), F.sum("copies").alias("class_size"))
    told = known.join(classes, "root", "left").select(
        "a", "b", "root", "alone", "class_id", "class_size",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    own = embedded.select("id", "row", "a", "b").join(told, ["a", "b"])
    return own.select(
        F.col("id").alias(id_col), "row", "a", "b",
        F.when(F.col("alone"), F.col("row")).otherwise(F.col("root")).alias("class_row"),
        F.when(F.col("alone"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("alone"), 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(F.col("alone"), 0).otherwise(F.col("links")).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document per class, that of the lowest id.

    Rows equal in id and text are one document here, also without words.
    """
    found = jaccard_join(docs, id_col, text, **options)
    key = ["k", "a", "b"]
    rows = found.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.col(id_col).alias("id"), "a", "b", "class_row")
    low = rows.groupBy("class_row").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", *key)).alias("m"))
    keepers = low.select(*(F.col(f"m.{c}").alias(c) for c in key)).distinct()
    # the document is one column, whatever its own columns are called
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"),
                        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    kept = keyed.join(keepers.hint("merge"), key).dropDuplicates(key)
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
