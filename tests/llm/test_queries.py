"""The registered queries on the fixture, their digest columns included."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_fixtures import corpus
from llm_fixtures import SCHEMA
from wardrank.llm import queries


@pytest.fixture(scope="module")
def some():
    return [r for r in corpus() if r[1] is None or len(r[1]) < 30_000]


@pytest.fixture(scope="module")
def sf_dir(spark, some, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def _bag(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_op2(spark, sf_dir, some):
    starts = Counter()
    for _, t, *_ in some:
        b = (t or "").encode()
        starts.update(b[i:i + 400] for i in range(len(b) - 399))
    want = []
    for doc_id, t, *_ in some:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if starts[b[i:i + 400]] > 1:
                gone[i:i + 400] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:len(b)]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert _bag(queries.op2_suffix_dedup(spark, sf_dir).collect()) == _bag(want)
    assert sum(w[2] > 0 for w in want) > 5


def test_op3(spark, sf_dir, some):
    out = queries.op3_sharding(spark, sf_dir).collect()
    want = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "bytes", None) for r in some]
    assert _bag((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in out) == _bag(want)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append((r.slot, r["size"]))
    assert set(shards) <= set(range(40)) and all(sorted(s for s, _ in x) == list(range(len(x))) for x in shards.values())
    total, longest = sum(w[1] for w in want), max(w[1] for w in want)
    assert all(abs(sum(n for _, n in shards[k]) - total / 40) <= longest for k in range(40))


def test_op5(spark, sf_dir, some):
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in some}
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), b"\n"]
    train = Counter(w for r in some if not held[r[0]] for w in words(r[1]))
    n, v = sum(train.values()), len(train)
    want = [(r[0], held[r[0]], len(words(r[1])), sum(train[w] > 0 for w in words(r[1])), n) for r in some]
    out = queries.op5_lm_scores(spark, sf_dir).collect()
    assert _bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out) == _bag(want)
    base = Counter()
    for r in some:
        base[r[0]] += sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r[1]))
    got = Counter()
    for r in out:
        got[r.doc_id] += r.base_score
        assert np.isfinite(r.score) and r.score < 0
    assert all(abs(got[k] - base[k]) < 1e-6 * abs(base[k]) for k in base)


def test_op7(spark, sf_dir, some):
    t = Tokenizer.from_file(queries.tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for doc_id, text, *_ in some:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc_id, i, a, z - a, zlib.crc32(ids[a:z].tobytes())) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    out = queries.op7_packing(spark, sf_dir).collect()
    assert _bag(r[:5] for r in out) == _bag(want)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(places) <= 1.05 * sum(w[3] for w in want) / 2048 + 1


def test_op8(spark, sf_dir, some):
    from wardrank.llm.tokencount import UnigramCounter, read_vocabulary

    vocabulary = read_vocabulary(queries.tokenizers.path("piece_bpe_32k.model"))
    score, worst = dict(vocabulary), min(s for _, s in vocabulary) - 10

    def pieces(word):
        """All pieces by their length, one end after the other."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = None
            for start in range(max(0, end - 20), end):
                piece = word[start:end]
                if piece in score and (found is None or best[start][0] + score[piece] > found[0]):
                    found = best[start][0] + score[piece], best[start][1] + 1
            if word[end - 1] not in score and (found is None or best[end - 1][0] + worst > found[0]):
                found = best[end - 1][0] + worst, best[end - 1][1] + len(word[end - 1].encode())
            best.append(found)
        return best[-1][1]

    out = {(r.doc_id, r.n_words, r.n_tokens) for r in queries.op8_token_counts(spark, sf_dir).collect()}
    white = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    assert max(len(p) for p in score) <= 20
    for doc_id, text, *_ in some:
        if text and len(text) > 4000:
            continue
        words = re.findall(f"[^{white}]+", text or "")
        n = sum(pieces(p) for w in words for p in re.findall("\u2581[^\u2581]*", w if w.startswith("\u2581") else "\u2581" + w))
        assert (doc_id, len(words), n) in out
    assert UnigramCounter(vocabulary).text(None) == (0, 0)
