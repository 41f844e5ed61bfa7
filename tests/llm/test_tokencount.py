import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import tokencount
from wardrank.llm.queries import tokenizers


def _reference(vocabulary, unk=0):
    t = Tokenizer(models.Unigram(vocabulary, unk, True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace("▁", "always")])
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return tokencount.read_vocabulary(tokenizers.path("piece_bpe_32k.model"))


def test_counts_are_the_tokenizers(vocabulary, rows):
    reference, counter = _reference(vocabulary), tokencount.UnigramCounter(vocabulary, 50)
    rng = random.Random(4)
    odd = ["".join(rng.choice(" abetTh\n\x1c éß漢𝄞▁<0x4>") for _ in range(120)) for _ in range(80)]
    for t in odd + [r[1] or "" for r in rows]:
        assert counter.text(t)[1] == len(reference.encode(t, add_special_tokens=False).ids), t[:80]


def test_ties_follow_the_tokenizer():
    rng = random.Random(9)
    bytes_ = [(f"<0x{i:02X}>", -50.0) for i in range(256)]
    for _ in range(40):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(12)}
        vocabulary = [("<unk>", 0.0), *pieces.items(), *bytes_]
        reference, counter = _reference(vocabulary), tokencount.UnigramCounter(vocabulary)
        for _ in range(40):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            assert counter.text(w)[1] == len(reference.encode(w, add_special_tokens=False).ids), (vocabulary[:13], w)


def test_table(docs, none, rows, vocabulary):
    got = tokencount.count_tokens(docs.select("doc_id", "text", "n_words"), vocabulary).collect()
    counter = tokencount.UnigramCounter(vocabulary)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_tokens) for r in got)) == sorted(
        (r[0] is None, r[0] or 0, *counter.text(r[1])) for r in rows)
    assert tokencount.count_tokens(none, vocabulary).count() == 0
