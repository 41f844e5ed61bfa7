import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import packing
from wardrank.llm.queries import BPE_PATTERN, tokenizers


@pytest.fixture(scope="module")
def encode():
    return packing.BpeEncoder(tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), BPE_PATTERN)


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer(encode, exact, rows):
    rng = random.Random(2)
    odd = ["".join(rng.choice(" \t\n\r\x0b\x85\xa0'sStTéÀʼ١٣ⅷ漢​ aZ09_-#|") for _ in range(200)) for _ in range(60)]
    odd += ["a" * 5000, " " * 5000 + "x", "\n" * 300, "it's we'LL 'S don't", "é" * 700]
    for t in odd + [r[1] or "" for r in rows]:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids, t[:80]


def _whole(pieces, rows, exact, capacity):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.crc))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want[doc_id] += [(i, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq), sum(n for p in by_seq.values() for _, n in p)


def test_round_trip_and_fill(docs, rows, encode, exact):
    for options in ({}, {"part_items": 9, "fan_in": 2}, {"part_items": 9, "fan_in": 3}, {"part_items": 30, "fan_in": 8}):
        pieces = packing.token_pieces(docs, encode, capacity=512).withColumn("crc", F.crc32("ids")).drop("ids")
        n, total = _whole(packing.pack(pieces, capacity=512, **options).collect(), rows, exact, 512)
        assert n <= total / 512 * (1.1 if options else 1.03) + 1


def test_best_fit_takes_the_least_space():
    of, offset, fill = packing.best_fit(np.array([6, 5, 4, 4, 1]), np.arange(5), 10)
    assert of.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 9] and fill.tolist() == [10, 10]


def test_empty(none, encode):
    assert packing.pack(packing.token_pieces(none, encode)).count() == 0
