import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from llm_fixtures import SCHEMA, corpus, docs, none, prose, rows  # noqa: F401
from wardrank.llm import alignment, queries

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTES.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

ODD = ["  two spaces", "end ", "a  b   c", "a\n\nb \n c", "\t x", " nb \xa0sp\xa0 x", "日本語 テキスト 日本", "a▁b c", "tab\tx <s> <unk> <0x41> [/INST]",
       "it's we'll I'd  they've 'sun", "x\x1cy \x85 z", "ﬁ ﬂ ½ é é", "𝄞𝄞 😀😀😀 👩‍👩‍👧", "‌zero​width", "    ", "!!! ??? ...", "a" * 300, "0123 456789 1e5",
       "don' t \x00 nul \x7f", " line sep", "a 　b"]


def ends_of(ids, size):
    at, out = 0, []
    for x in ids:
        at += size(x)
        out.append(at)
    return out


def plain(rows_):
    """Whole texts, all pairs of tokens."""
    entry = alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")).token_bytes()

    def piece(k):
        return bytes([int(PIECES.id_to_piece(k)[3:5], 16)]) if PIECES.is_byte(k) else PIECES.id_to_piece(k).replace("▁", " ").encode()

    docs_, count = [], Counter()
    for doc_id, text in rows_:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = BYTES.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
            whole = (" " + text).encode()
            if b"".join(entry[x] for x in a) != whole or b"".join(map(piece, b)) != whole:
                a, b = [], []
            ea, eb = ends_of(a, lambda x: len(entry[x])), ends_of(b, lambda x: len(piece(x)))
            i = j = 0
            while i < len(a):
                links.append((a[i], b[j]))
                step = ea[i], eb[j]
                i, j = i + (step[0] <= step[1]), j + (step[1] <= step[0])
            common = sorted(set(ea) & set(eb))
            fa, fb = 0, 0
            for c in common:
                na, nb = ea.index(c) + 1, eb.index(c) + 1
                groups.append(",".join(map(str, a[fa:na])) + "|" + ",".join(map(str, b[fb:nb])))
                fa, fb = na, nb
        count.update(links)
        docs_.append((doc_id, a, b, links, groups))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for doc_id, a, b, links, groups in docs_]


def test_query(spark, none, tmp_path):  # noqa: F811
    rng = random.Random(3)
    some = [r for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    texts = ODD + [" ".join(rng.choice(ODD) for _ in range(4)) for _ in range(60)] + [prose(rng, 50) for _ in range(20)]
    some += [(2000 + i, t, *some[0][2:]) for i, t in enumerate(texts)]
    spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(plain((r[0], r[1]) for r in some), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(not r[1] for r in want) > 4 and sum(r[3] < r[2] for r in want) > 50


def test_links_are_overlaps():
    """The links of the walk above are all overlapping pairs."""
    text = ODD[9] + " " + ODD[11]
    entry = alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")).token_bytes()
    side = alignment.PieceTokens(public_tokenizers.path("piece_bpe_32k.model")).token_bytes()
    a, b = BYTES.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    ea, eb = ends_of(a, lambda x: len(entry[x])), ends_of(b, lambda x: len(side[x]))
    pairs = [(x, y) for x, ex, sx in zip(a, ea, [0, *ea]) for y, ey, sy in zip(b, eb, [0, *eb]) if sx < ey and sy < ex]
    (found,) = plain([(1, text)])
    assert found[4] == len(pairs) and found[1:3] == (len(a), len(b))


def test_operator_cases(spark, docs, none, rows):  # noqa: F811
    a = alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))
    b = alignment.PieceTokens(public_tokenizers.path("piece_bpe_32k.model"))
    assert b.cuts_at_spaces()
    assert alignment.align(none, a, b).collect() == []
    small, large = (alignment.align(docs, a, b, chunk_chars=n).collect() for n in (500, 1 << 30))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, small), key=key) == sorted(map(tuple, large), key=key) and len(small) == len(rows)
