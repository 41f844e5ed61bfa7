"""Cross-tokenizer alignment on Arrow columns.

Two tokenizers cut the same bytes: tokens ``A`` (byte-level BPE) and tokens
``B`` (pieces).  Where tokens of both end they cut a text into groups; a link
joins an A token and a B token whose byte ranges overlap.

1. The documents of a task are taken in chunks of bounded characters.  Both
   tokenizers always cut before a space between two other characters, so a
   chunk's texts are split there and each distinct stretch is encoded once.
   Texts without such places are one stretch.
2. Token ids are list columns.  They are flattened, with parent indices; the
   ends of the tokens are segmented cumulative sums of the tokens' byte
   lengths.  A full outer hash join of the A ends and the B ends on (stretch,
   end) has one row per link: between two neighbouring ends one A token and
   one B token lie.  Rows with both ends close the groups.
3. ``Table.group_by`` gives partial counts of the id pairs of a chunk, weighted
   by how often its stretches occur.  Spark merges them: the count of a pair
   and the highest count of each B id cover the whole corpus.
4. The counts come back to each chunk by a join on the pair and one on the
   chunk; there they are summed over the links of each stretch and of each
   document.  What a chunk needs for this travels as one compressed Arrow
   stream.

A text takes part if it is not empty and the joined bytes of its A tokens and
of its B tokens both equal a space and the text.

Defined cases: null, empty and unequal texts have no tokens: zeros and ``''``;
repeated documents count each; a text longer than a chunk is a chunk of its
own; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, slices, stored
from .packing import _PLAIN

#: Both tokenizers cut here, whatever stands around it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space in a row or at an edge: the text cannot simply be split at spaces.
_MESSY = re.compile(r"\s\s|^\s|\s$")


class ByteTokens:
    """Ids of the byte-level BPE in a ``tokenizers`` file, for text with a
    space before it.  Of the same vocabulary as ranks, a faster library takes
    the texts whose characters both libraries class alike."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.json = Path(json_path).read_text(encoding="utf-8")
        self.ranks = Path(ranks_path).read_bytes() if ranks_path else None
        self.pattern = pattern
        self._exact = self._fast = None  # made where they are needed

    def __getstate__(self):
        return self.__dict__ | {"_exact": None, "_fast": None}

    def _encode(self, text: str) -> list[int]:
        if self.ranks and not _PLAIN.search(text):
            if self._fast is None:
                import tiktoken

                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
                self._fast = tiktoken.Encoding("bpe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return self._fast.encode_ordinary(" " + text)
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_str(self.json)
            self._exact.encode_special_tokens = True  # their strings in a text are ordinary text
        return self._exact.encode(" " + text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self._encode(t) for t in texts]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: its entry, byte-level decoded."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        parsed = json.loads(self.json)
        entries = dict(parsed["model"]["vocab"]) | {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        out = [b""] * (max(entries.values()) + 1)
        for entry, at in entries.items():
            out[at] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        return out


class PieceTokens:
    """Ids of a sentencepiece model, which itself adds the space before."""

    def __init__(self, path: str):
        self.model = Path(path).read_bytes()
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _processor(self):
        if self._made is None:
            import sentencepiece

            self._made = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._made

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self._processor().encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: <0xHH> is a byte, U+2581 a space."""
        model = self._processor()
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def cuts_at_spaces(self) -> bool:
        """No piece has a space behind another character, so none can join
        the two sides of a place in ``_CUT``."""
        return not any(b" " in b.lstrip(b" ") for b in self.token_bytes())


def _cumulative(a: pa.Array) -> pa.Array:
    return pc.cumulative_sum(a.cast(pa.int64()))


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), values)


class _Side:
    """The tokens of one tokenizer over the stretches of a chunk."""

    def __init__(self, encode, texts: pa.Array, token_bytes: pa.Array, at_once: int = 10_000):
        kind = pa.large_list(pa.int32())
        parts = [pa.array(encode(texts.slice(k, at_once).to_pylist()), kind) for k in range(0, len(texts), at_once)]
        self.ids = pa.concat_arrays([pa.array([], kind), *parts])
        self.flat = pc.list_flatten(self.ids)
        self.owner = pc.list_parent_indices(self.ids)
        self.bytes = pc.take(token_bytes, self.flat)

    def joined(self) -> pa.Array:
        return pc.binary_join(pa.LargeListArray.from_arrays(self.ids.offsets, self.bytes), pa.scalar(b"", pa.large_binary()))

    def kept(self, good: np.ndarray) -> pa.Table:
        """(stretch, end, id) of the tokens of the good stretches."""
        size = pc.binary_length(self.bytes)
        total = _cumulative(size)
        before = pc.subtract(total, size.cast(pa.int64()))
        first = pc.take(before, self.ids.offsets[:-1].filter(pa.array(good)))
        place = pa.array(np.cumsum(good) - 1)
        table = pa.table({"stretch": pc.take(place, self.owner), "id": self.flat, "end": total})
        table = table.filter(pc.take(pa.array(good), self.owner))
        return table.set_column(2, "end", pc.subtract(table["end"], pc.take(first, table["stretch"])))


def _aligned(a: pa.Table, b: pa.Table) -> pa.Table:
    """A row per link, in order: stretch, end, a, b (ids), a_at, b_at (their
    places), both (whether a token of either side ends here)."""
    ends = a.select(["stretch", "end"]).append_column("in_a", pa.array(np.ones(len(a), np.int8)))
    other = b.select(["stretch", "end"]).append_column("in_b", pa.array(np.ones(len(b), np.int8)))
    both = ends.join(other, ["stretch", "end"], join_type="full outer", use_threads=False)
    # one sortable number of the two keys
    key = pc.add(pc.multiply(both["stretch"], pa.scalar(int(pc.max(both["end"]).as_py() or 0) + 1)), both["end"])
    both = both.take(pc.array_sort_indices(key))
    out = {"stretch": both["stretch"], "end": both["end"]}
    flags = [pc.fill_null(both[c], 0).combine_chunks() for c in ("in_a", "in_b")]
    for name, flag, side in (("a", flags[0], a), ("b", flags[1], b)):
        out[f"{name}_at"] = pc.subtract(_cumulative(flag), flag.cast(pa.int64()))  # ends of this side before the row
        out[name] = pc.take(side["id"], out[f"{name}_at"])
    return pa.table(out | {"both": pc.equal(pc.add(*flags), 2)})


def _group_texts(a: pa.Table, b: pa.Table, links: pa.Table) -> pa.Array:
    """``a1,a2|b1;a3|b2`` of every stretch."""
    closing = links.filter(links["both"])
    sides = []
    for side, at in ((a, "a_at"), (b, "b_at")):
        text = pc.cast(side["id"], pa.large_string()).combine_chunks()
        sides.append(pc.binary_join(_lists(text, closing[at].to_numpy() + 1), pa.scalar(",", pa.large_string())))
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    of = np.bincount(closing["stretch"].to_numpy())
    return pc.binary_join(_lists(groups, np.cumsum(of)), pa.scalar(";", pa.large_string()))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _chunk(ids: pa.Array, texts: list[str | None], encode_a, encode_b, bytes_a: pa.Array, bytes_b: pa.Array, split: bool) -> tuple[pa.Table, bytes]:
    """(pairs with partial counts, the rest as a compressed Arrow stream)."""
    stretches: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            parts = [t] if not split else _CUT.split(t) if _MESSY.search(t) else t.split(" ")
            counts[k] = len(parts)
            stretches += parts
    coded = pa.array(stretches, pa.large_string()).dictionary_encode()
    words, distinct = coded.indices.to_numpy(), coded.dictionary
    del stretches
    a, b = _Side(encode_a, distinct, bytes_a), _Side(encode_b, distinct, bytes_b)
    want = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), distinct.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    good = np.logical_and(*(pc.equal(s.joined(), want).to_numpy(zero_copy_only=False) for s in (a, b))) if len(distinct) else np.zeros(0, bool)
    ends = np.cumsum(counts)
    valid = (counts > 0) & (_sums((~good)[words], ends) == 0)
    words = words[np.repeat(valid, counts)]
    counts = np.where(valid, counts, 0)
    ends = np.cumsum(counts)
    used = np.bincount(words, minlength=len(distinct))
    good &= used > 0
    words = (np.cumsum(good) - 1)[words] if len(words) else words
    a, b = a.kept(good), b.kept(good)
    links = _aligned(a, b)
    n = int(good.sum())
    per = {"n_a": np.bincount(a["stretch"].to_numpy(), minlength=n), "n_b": np.bincount(b["stretch"].to_numpy(), minlength=n),
           "n_links": np.bincount(links["stretch"].to_numpy(), minlength=n),
           "n_groups": np.bincount(links["stretch"].to_numpy()[links["both"].to_numpy()], minlength=n)}
    groups = pc.take(_group_texts(a, b, links), pa.array(words))
    texts_of = pc.binary_join(_lists(groups, ends), pa.scalar(";", pa.large_string()))
    sha = [hashlib.sha256(t.encode()).hexdigest() if v else "" for t, v in zip(texts_of.to_pylist(), valid)]
    key = pc.add(pc.multiply(links["a"].cast(pa.int64()), pa.scalar(1 << 32)), links["b"].cast(pa.int64()))
    weight = pc.take(pa.array(used[good]), links["stretch"])
    pairs = pa.table({"pair": key, "n": weight}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    rest = {"id": ids, **{c: _sums(x[words], ends) for c, x in per.items()}, "sha": sha, "words": counts}
    batches = [pa.record_batch(rest), pa.record_batch({"word": pa.array(words, pa.int32())}),
               pa.record_batch({"links": pa.array(per["n_links"], pa.int32())}),
               pa.record_batch({"pair": pc.index_in(key, pairs["pair"].combine_chunks()).combine_chunks()})]
    return pairs, b"".join(_packed(x) for x in batches)


def _packed(batch: pa.RecordBatch) -> bytes:
    """The batch as a compressed Arrow stream, its length before it."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    data = out.getvalue().to_pybytes()
    return len(data).to_bytes(8, "little") + data


def _unpacked(data: bytes) -> list[pa.Table]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        out.append(pa.ipc.open_stream(pa.py_buffer(data)[at + 8:at + 8 + n]).read_all())
        at += 8 + n
    return out


def _chunks(batches, chunk_chars: int):
    """(ids, texts) with at most ``chunk_chars`` characters, if more than one text."""
    ids, texts, held = [], [], 0
    for b in slices(batches, 256):
        for k, t in enumerate(b["_text"].to_pylist()):
            if texts and held + len(t or "") > chunk_chars:
                yield pa.concat_arrays(ids), texts
                ids, texts, held = [], [], 0
            ids.append(b["_id"].slice(k, 1))
            texts.append(t)
            held += len(t or "")
        ids = [pa.concat_arrays(ids)] if ids else ids
    if texts:
        yield pa.concat_arrays(ids), texts


def align(docs: DataFrame, encode_a: ByteTokens, encode_b: PieceTokens, id_col: str = "doc_id", text: str = "text",
          chunk_chars: int = 1_500_000) -> DataFrame:
    """A row per document: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair count is the highest of their B id),
    ``count_sum`` (of the links' pair counts), ``groups_sha256``."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    bytes_a, bytes_b = encode_a.token_bytes(), encode_b.token_bytes()
    split = encode_b.cuts_at_spaces()

    def run(batches):
        tables = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        for k, (ids, texts) in enumerate(_chunks(batches, chunk_chars)):
            pairs, rest = _chunk(ids, texts, encode_a, encode_b, *tables, split)
            lists = {c: pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs[n].combine_chunks())
                     for c, n in (("pairs", "pair"), ("times", "n_sum"))}
            pa.default_memory_pool().release_unused()
            yield {"chunk": [(TaskContext.get().partitionId() << 32) + k], **lists, "rest": [rest]}

    chunks = stored(map_arrow(source, fields("chunk long", "pairs array<long>", "times array<long>", "rest binary"), run), "aligned")
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p")).select(
        "chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = stored(listed.groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    told = totals.join(highest, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    counts = (listed.select("chunk", "at", "pair").join(told, "pair").groupBy("chunk")
              .agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("c"))
              .select("chunk", F.col("c.n").alias("n"), F.col("c.best").alias("best")))

    def finish(batches):
        for b in slices(batches, 1):
            if not len(b["rest"]):
                continue
            rows, words, links, pairs = _unpacked(b["rest"][0].as_py())
            n, best = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.zeros(0, np.int64)
                       for x in (b["n"][0], b["best"][0]))
            pair, word = pairs["pair"].to_numpy(), words["word"].to_numpy()
            stretch_ends, doc_ends = np.cumsum(links["links"].to_numpy()), np.cumsum(rows["words"].to_numpy())
            out = {c: rows[c] for c in ("n_a", "n_b", "n_groups", "n_links")}
            for name, per_pair in (("n_best", best), ("count_sum", n)):
                out[name] = _sums(_sums(per_pair[pair], stretch_ends)[word], doc_ends)
            yield {id_col: rows["id"], **out, "groups_sha256": rows["sha"]}

    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), *fields(
        "n_a long", "n_b long", "n_groups long", "n_links long", "n_best long", "count_sum long", "groups_sha256 string").fields])
    return map_arrow(chunks.select("chunk", "rest").join(counts, "chunk", "left"), schema, finish)
